"""Reading and writing of bar history, curves, trade logs and holiday files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schemas import BARS, EQUITY_CSV, HOLIDAYS


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a stored history in canonical layout.

    Columns already of the right type are not cast, so filters on them reach the scan.
    """
    stored = spark.read.parquet(path)
    types = dict(stored.dtypes)
    return stored.select(
        *[
            F.col(f.name)
            if types.get(f.name) == f.dataType.simpleString()
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in BARS
        ]
    )


def write_history(df: DataFrame, path: str) -> DataFrame:
    """Write zstd Parquet, ranged and sorted by date, and return the written table.

    Reads of a span of dates then skip the files and row groups of the others. A date with many bars
    spans several files, split by code.
    """
    ranged = df.repartitionByRange("date", "code").sortWithinPartitions("date", "code")
    ranged.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row; a null reads back as an empty text."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_curves(spark: SparkSession, curves: Mapping[str, str]) -> DataFrame:
    """Equity curves of several CSV files, each tagged with its label as ``series``."""
    frames = [
        read_csv(spark, path, EQUITY_CSV).withColumn("series", F.lit(label))
        for label, path in curves.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def read_holidays(spark: SparkSession, folder: str) -> DataFrame:
    """Named days of every ``*.json`` file in ``folder``; a file is an array or one day per line."""
    return spark.read.schema(HOLIDAYS).option("pathGlobFilter", "*.json").json(folder)
