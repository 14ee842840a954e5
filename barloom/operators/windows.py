"""Sliding windows of feature rows, their targets, and train/validation splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.panel import along

STEPS = 20


def windows(df: DataFrame, steps: int = STEPS) -> DataFrame:
    """Each row whose ticker has ``steps`` rows up to it, with those rows' features in ``window``."""
    frame = along().rowsBetween(-(steps - 1), 0)
    return (
        df.withColumn("_rows", F.row_number().over(along()))
        .withColumn("window", F.collect_list("feature").over(frame))
        .filter(F.col("_rows") >= steps)
        .drop("_rows")
    )


def windows_since(df: DataFrame, steps: int, cutoff: dt.date | str) -> DataFrame:
    """Windows whose last row is on or after ``cutoff``; their first rows may be earlier."""
    return windows(df, steps).filter(F.col("date") >= F.lit(cutoff).cast("date"))


def latest_windows(df: DataFrame, steps: int = STEPS) -> DataFrame:
    """Each ticker's last window.

    Rows other than the last ``steps`` of a ticker leave before any array is built.
    """
    newest_first = Window.partitionBy("ticker").orderBy(F.desc("date"))
    tail = df.withColumn("_age", F.row_number().over(newest_first)).filter(F.col("_age") <= steps)
    return windows(tail.drop("_age"), steps)


def window_target(df: DataFrame, steps: int = STEPS) -> DataFrame:
    """Each window with the label of its last row as ``target``."""
    return windows(df, steps).withColumnRenamed("label", "target")


def window_counts(df: DataFrame, steps: int = STEPS) -> DataFrame:
    count = F.greatest(F.count(F.lit(1)) - (steps - 1), F.lit(0))
    return df.groupBy("ticker").agg(count.alias("windows"))


def tagged_split(df: DataFrame, cutoff: dt.date | str, steps: int = STEPS) -> DataFrame:
    """Rows with their ``side`` of ``cutoff``, without the sides too short for a window."""
    side = F.when(F.col("date") < F.lit(cutoff).cast("date"), "train").otherwise("valid")
    rows = Window.partitionBy("ticker", "side")
    return (
        df.withColumn("side", side)
        .withColumn("_rows", F.count(F.lit(1)).over(rows))
        .filter(F.col("_rows") >= steps)
        .drop("_rows")
    )


def split_check(df: DataFrame, cutoff: dt.date | str, steps: int = STEPS) -> DataFrame:
    """One row: windows on each side of ``cutoff``, and whether both have any, which :func:`split` demands."""
    tagged = tagged_split(df, cutoff, steps).groupBy("ticker", "side").agg((F.count(F.lit(1)) - (steps - 1)).alias("_n"))
    sides = {name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("_n"))), F.lit(0)) for name in ("train", "valid")}
    counted = tagged.agg(*[count.cast("long").alias(f"{name}_windows") for name, count in sides.items()])
    return counted.withColumn("ok", (F.col("train_windows") > 0) & (F.col("valid_windows") > 0))


def split(
    df: DataFrame, cutoff: dt.date | str, steps: int = STEPS
) -> tuple[DataFrame, DataFrame]:
    """Training rows before ``cutoff`` and validation rows from it; neither may be empty."""
    tagged = tagged_split(df, cutoff, steps)
    sides = [tagged.filter(F.col("side") == name).drop("side") for name in ("train", "valid")]
    if any(side.isEmpty() for side in sides):
        raise ValueError("the split leaves one side empty; check the cutoff and the window length")
    return sides[0], sides[1]
