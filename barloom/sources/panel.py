"""Bars stored by ticker, so that what runs along tickers moves no stored row.

A panel is a table of buckets: a hash of the ticker decides the bucket, and a bucket is one file sorted by
ticker and date. Frames along a ticker, and upserts of later bars, find the rows where they need them; only
what is new gets shuffled. A ticker has one row per date and market, so no bucket outgrows the others by more
than its tickers do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.history import KEYS, keep_newest

#: Lets Spark rely on the order inside a bucket, which has one file here; without it frames sort each task's rows.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def store_panel(df: DataFrame, name: str, path: str, buckets: int, entity: str = "code") -> DataFrame:
    """Write ``df`` as the panel ``name`` of the session's catalog, its files in ``path``, and return it."""
    if buckets < 1:
        raise ValueError("a panel needs a bucket")
    placed = df.repartition(buckets, entity).sortWithinPartitions(entity, "date")
    (
        placed.write.mode("overwrite")
        .bucketBy(buckets, entity)
        .sortBy(entity, "date")
        .option("compression", "zstd")
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def panel_buckets(spark: SparkSession, name: str) -> int:
    """Number of buckets of a panel, as the catalog has it."""
    described = spark.sql(f"DESCRIBE EXTENDED {name}").filter(F.col("col_name") == "Num Buckets").first()
    if described is None:
        raise ValueError(f"{name} has no buckets")
    return int(described.data_type)


def upsert_panel(spark: SparkSession, name: str, fresh: DataFrame, entity: str = "code", seq: str = "source_seq") -> DataFrame:
    """The panel ``name`` with ``fresh`` merged in: the row with the highest ``seq`` per key.

    Copies within ``fresh`` collapse before it is dealt out like the panel. The stored rows stay in their
    buckets, and the result has the same placing, so storing it again as a panel is a plain write. It reads
    the files of the panel: store it under another path.
    """
    stored = spark.table(name)
    newest = keep_newest(fresh.select(*stored.columns), KEYS, seq).repartition(panel_buckets(spark, name), entity)
    return keep_newest(stored.unionByName(newest), KEYS, seq)
