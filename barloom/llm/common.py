"""What the operators of this package share: reading tables, sorted slices, word patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z only, so that the result doesn't depend on a locale."""
    return F.translate(value, UPPER, LOWER)


def sorted_slices(df: DataFrame, *order: str | Column) -> DataFrame:
    """Range-sort ``df`` once and fix the outcome.

    Adds ``_pos``, which rises along the order, and ``_slice``, the number of the range. The rows are
    written to the shared folder, so later passes see the same slices whatever executor is lost.
    """
    placed = df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id())
    return cut_lineage(placed).withColumn("_slice", F.shiftright("_pos", 33))


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
