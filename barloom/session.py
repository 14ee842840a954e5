"""Session helpers: a local session for tests, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(cpus: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark.

    Lineage cuts go to a temporary folder unless the Spark defaults name one.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    if not _named_dir(spark):
        # Static to Spark SQL, so it has to be there when the session is made.
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _named_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    ``local_session`` sets it where the Spark defaults don't; any other session has to name it.
    """
    named = _named_dir(spark)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per application.

    Workers import the operators by name, wherever the driver runs.
    """
    context = spark.sparkContext
    if getattr(context, "_barloom_shipped", False):
        return
    # The driver serves the archive to executors, so it stays until the driver's context ends.
    archive = os.path.join(context._temp_dir, "barloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    context._barloom_shipped = True


class _Owned(threading.local):
    """Paths made inside each open ``scratch`` block of a thread; a stream's batches run in their own."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_OWNED = _Owned()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what ``scratch_path`` and ``cut_lineage`` make inside the block when it ends.

    Results that read those files have to be written or collected before that.
    """
    _OWNED.blocks.append([])
    try:
        yield
    finally:
        remove(spark, _OWNED.blocks.pop())


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths that ``scratch_path`` and ``cut_lineage`` make inside the block, for its owner to remove.

    A ``scratch`` block around it owns them too.
    """
    paths: list[str] = []
    _OWNED.blocks.append(paths)
    try:
        yield paths
    finally:
        _OWNED.blocks.pop()
        if _OWNED.blocks:
            _OWNED.blocks[-1].extend(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, if they are there."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it stays unless a ``scratch`` block owns it."""
    path = f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex}"
    if _OWNED.blocks:
        _OWNED.blocks[-1].append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later passes then see the very same rows, whatever executor is lost. Unlike a checkpoint, which
    computes its input once to count and once to write, the rows are computed once. The job runs at once,
    while the caller's plan is built; see ``scratch`` for who removes the files.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` with its rows kept on the workers' disks while the block runs, placed and sorted as they were made.

    Frames along a ticker then neither move nor sort them again, which a table read back would need. Rows of a lost worker
    are made anew. What reads them has to be written or collected inside the block.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()
