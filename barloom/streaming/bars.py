"""Incremental bar history with Structured Streaming.

The history is a table of snapshots split into periods, a year each unless told otherwise. A micro-batch
merges into the periods that its bars fall into and leaves the folders of all others as they are, so a
read never has to look for the newest copy of a bar. The snapshot that a batch makes also says that it has
been applied: a replayed batch changes nothing, and a new checkpoint starts a count of its own. Every row
keeps the order of its copy, so the newest wins however the stream was cut into batches.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.history import adjust, canonical, keep_newest
from barloom.schemas import BAR_COLUMNS, BARS
from barloom.session import cut_lineage, scratch
from barloom.sources.history import write_history
from barloom.sources.payloads import decode_chart
from barloom.streaming.snapshots import Snapshot, commit, new_folder, snapshot

STORED = T.StructType([*BARS.fields, T.StructField("source_seq", T.LongType())])
#: Date patterns of the periods a table can be split into; a period's name sorts as its dates do.
YEARLY, MONTHLY = "yyyy", "yyyy-MM"


def stream_adjust(stream: DataFrame, payload: str = "json") -> DataFrame:
    """Chart payloads of a stream as adjusted canonical bars; ``market``, ``code`` and an order ride along."""
    adjusted = adjust(decode_chart(stream, payload))
    return adjusted.select(*BAR_COLUMNS, *[c for c in ("source_seq",) if c in adjusted.columns])


def by_file_time(stream: DataFrame) -> DataFrame:
    """Add ``source_seq``, the time at which a file stream's file was last written, in microseconds."""
    return stream.select("*", F.unix_micros("_metadata.file_modification_time").alias("source_seq"))


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query's checkpoint keeps for it over restarts."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value)["id"]


def _stored(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*folders)


def _write_periods(rows: DataFrame, path: str, grain: str) -> str:
    """Write the newest row per key, split by period, to a new folder whose name is returned.

    The rows are ranged by date, so a period's files are few and sorted, and the same placing serves the
    grouping. A key has one row per version merged, as the batch has been reduced before.
    """
    folder = new_folder(path)
    newest = keep_newest(rows.select(*BAR_COLUMNS, "source_seq").repartitionByRange("date", "code"))
    split = newest.withColumn("period", F.date_format("date", grain)).sortWithinPartitions("period", "date", "code")
    split.write.option("compression", "zstd").partitionBy("period").parquet(f"{path}/{folder}")
    return folder


def upsert_batch(
    batch: DataFrame, batch_id: int, path: str, run: str, order: str = "source_seq", grain: str = YEARLY
) -> None:
    """Merge one batch into the periods it touches; one that ``run`` has applied already does nothing.

    Rows without a date belong to no period and are dropped.
    """
    spark = batch.sparkSession
    if snapshot(spark, path).applied.get(run, -1) >= batch_id:
        return
    with scratch(spark):
        ordered = batch.withColumn("source_seq", F.col(order).cast("long")).filter(F.col("date").isNotNull())
        fresh = cut_lineage(keep_newest(ordered.select(*BAR_COLUMNS, "source_seq")))
        named = fresh.select(F.date_format("date", grain).alias("period")).distinct().collect()
        touched = sorted(row.period for row in named)  # one row per year or month
        written: dict[str, tuple[str | None, str]] = {}

        def merge(base: Snapshot) -> Snapshot | None:
            if base.applied.get(run, -1) >= batch_id:
                return None
            # Another writer's version costs a new merge only where it changed the same period.
            stale = [p for p in touched if p not in written or written[p][0] != base.periods.get(p)]
            if stale:
                own = fresh.filter(F.date_format("date", grain).isin(stale)) if len(stale) < len(touched) else fresh
                folder = _write_periods(_stored(spark, base.folders(path, stale)).unionByName(own), path, grain)
                written.update({p: (base.periods.get(p), f"{folder}/period={p}") for p in stale})
            periods = base.periods | {p: written[p][1] for p in touched}
            return replace(base, periods=periods, applied=base.applied | {run: batch_id})

        commit(spark, path, merge)


def stream_upsert(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order: str = "source_seq",
    trigger: dict | None = None,
    grain: str = YEARLY,
) -> StreamingQuery:
    """Upsert a stream of bars into the table at ``path``; the newest row per key wins.

    ``order`` names the column that ranks copies of a key, over all batches and runs; a stream without it
    is refused, because the result would hang on how files fall into batches. :func:`by_file_time` adds
    one to streams of files. ``grain`` splits the table by year or month and has to stay the same.
    """
    if order not in stream.columns:
        raise ValueError(f"the stream has no column {order!r} that ranks copies of a key")

    def write(df: DataFrame, n: int) -> None:
        upsert_batch(df, n, path, run_id(df.sparkSession, checkpoint), order, grain)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_upserted(
    spark: SparkSession, path: str, since: dt.date | None = None, version: int | None = None
) -> DataFrame:
    """Bars of the newest version of the table, or of ``version``.

    The folders are listed once, so the frame stays on its version. With ``since``, only bars from that day
    on; folders of periods before it are not read.
    """
    held = snapshot(spark, path, version)
    periods = sorted(held.periods)
    if since is not None:
        day = since.isoformat()
        periods = [p for p in periods if p >= day[: len(p)]]
    bars = _stored(spark, held.folders(path, periods)).select(*BAR_COLUMNS)
    return bars if since is None else bars.filter(F.col("date") >= F.lit(since))


def compact(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Write the current bars as one history table at ``target``."""
    return write_history(read_upserted(spark, path), target)


def compact_periods(spark: SparkSession, path: str, periods: list[str], grain: str = YEARLY) -> None:
    """Rewrite the given periods into few sorted files, as a new version with the same bars.

    Batches may arrive meanwhile: a period that one of them merged into keeps that batch's folder, which
    is fresh anyway.
    """
    base = snapshot(spark, path)
    wanted = sorted(set(periods) & set(base.periods))
    if not wanted:
        return
    folder = _write_periods(_stored(spark, base.folders(path, wanted)), path, grain)

    def swap(now: Snapshot) -> Snapshot | None:
        same = {p: f"{folder}/period={p}" for p in wanted if now.periods.get(p) == base.periods[p]}
        return replace(now, periods=now.periods | same) if same else None

    commit(spark, path, swap)
