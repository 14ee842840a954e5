"""Building blocks that stay balanced when one group holds most of the rows.

A window over a large group puts the group into one task. These helpers use partial aggregates or
a global range sort instead, which split any group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import cut_lineage


def one_row(df: DataFrame) -> DataFrame:
    """Mark a global aggregate for broadcast: it has exactly one row."""
    return F.broadcast(df)


def per_day(df: DataFrame, key: str = "date") -> DataFrame:
    """Mark a table with one row per calendar day for broadcast.

    The SQL DATE type has 3.65 million values, and ten years of sessions are about 2,500 rows, so
    such a table is bounded no matter how large the bars are. Any other key is left to the planner.
    """
    if isinstance(df.schema[key].dataType, T.DateType):
        return F.broadcast(df)
    return df


def join_stats(df: DataFrame, key: str, stats: Sequence[Column]) -> DataFrame:
    """Attach aggregates over ``key`` to every row.

    Partial aggregation shrinks a hot group before the shuffle, and the joined side has one row
    per key, so the rows of ``df`` keep the partitioning they already have.
    """
    grouped = df.groupBy(key).agg(*stats)
    return df.join(per_day(grouped, key), key)


def top_in_group(df: DataFrame, by: str, order: Sequence[Column], k: int, name: str) -> DataFrame:
    """First ``k`` rows of each group with their position in ``name``.

    The bound on the row number lets Spark cut each map task's rows to ``k`` per group before the
    shuffle, so the size of a group does not matter.
    """
    frame = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(frame)).filter(F.col(name) <= k)


def _sorted_positions(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ordered = df.orderBy(*[F.col(name) for name in by], *order)
    placed = ordered.withColumn("_pos", F.monotonically_increasing_id())
    # The range split must be the same in every later pass, hence the cut.
    return cut_lineage(placed).withColumn("_slice", F.shiftright("_pos", 33))


def _slice_offsets(slices: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    before = (
        Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    return slices.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_before") for name in names],
        *[c for c in slices.columns if c not in (*by, "_slice", *names)],
    )


def _per_slice(offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Broadcast the offsets where days and partitions bound their number."""
    if all(isinstance(offsets.schema[name].dataType, T.DateType) for name in by):
        return F.broadcast(offsets)
    return offsets


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Position of every row in its group, with no bound on the group's size.

    ``order`` must be total within a group. The rows are range-sorted once, so a hot group spans
    many partitions; each partition adds the row count of its predecessors. Only counts per
    (group, partition) are windowed. The position is a long, as a group may have any number of rows.
    """
    placed = _sorted_positions(df, by, order)
    slices = placed.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    offsets = _slice_offsets(slices, by, ["_n"])
    ranked = placed.join(_per_slice(offsets, by), [*by, "_slice"])
    rank = (F.col("_pos") - F.col("_first") + F.col("_n_before") + 1).cast("long")
    return ranked.withColumn(name, rank).select(*df.columns, name)


def running_last(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Last value so far that is not null within each group, with no bound on the group's size.

    The rows are range-sorted once; each slice takes over the last value of the slices before it, of
    which there is one per (group, partition).
    """
    placed = _sorted_positions(df, by, order)
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_pos")))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy(*by, "_slice")
        .agg(newest.alias("_newest"))
        .withColumn("_carried", F.last("_newest", ignorenulls=True).over(before))
        .drop("_newest")
    )
    local = Window.partitionBy(*by, "_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last(value, ignorenulls=True).over(local), F.col("_carried"))
    return placed.join(_per_slice(carried, by), [*by, "_slice"]).withColumn(name, last).select(*df.columns, name)


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Running sum of ``value`` within each group, with no bound on the group's size."""
    placed = _sorted_positions(df, by, order)
    slices = placed.groupBy(*by, "_slice").agg(F.sum(value).alias("_sum"))
    offsets = _slice_offsets(slices, by, ["_sum"])
    local = Window.partitionBy(*by, "_slice").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    total = F.sum(value).over(local) + F.col("_sum_before")
    return placed.join(_per_slice(offsets, by), [*by, "_slice"]).withColumn(name, total).select(*df.columns, name)
