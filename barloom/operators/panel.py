"""Frames along one ticker's rows and statistics across one date's rows.

Ticker frames rely on one row per (ticker, date), which :func:`keep_newest` guarantees: a ticker
then has at most one row per day, however large the table is. All ticker frames share one
partitioning and one sort, so a chain of them shuffles the rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.signals import zscore
from barloom.operators.spread import join_stats, per_day, rank_within


Entity = str | Sequence[str]

#: Rows of one ticker that a task frames at once when its rows are dealt out in blocks.
BLOCK_ROWS = 65_536


def along(entity: Entity = "ticker") -> WindowSpec:
    return Window.partitionBy(entity).orderBy("date")


def by_ticker(df: DataFrame, entity: str = "ticker") -> DataFrame:
    """Each ticker's rows in one partition, in date order."""
    return df.repartition(entity).sortWithinPartitions(entity, "date")


def in_blocks(
    df: DataFrame,
    frames: Callable[[DataFrame, Sequence[str]], DataFrame],
    before: int = 0,
    after: int = 0,
    entity: str = "ticker",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``frames`` to a panel whose tickers may have any number of rows.

    ``frames`` takes the rows and the columns its windows are partitioned by, and looks at most ``before``
    rows back and ``after`` rows ahead. Each ticker's rows are numbered and dealt out in blocks of ``rows``,
    and the rows near an end of a block are copied to the block next to it, so every block frames its own
    rows as if it saw them all. The result equals ``frames(df, entity)``; a single ticker keeps every task
    busy, for the price of one range sort. ``df`` has one row per (entity, date).
    """
    if rows < max(before, after, 1):
        raise ValueError("a block must cover the rows that its neighbours look at")
    numbered = rank_within(df, [entity], [F.asc("date")], "_n")
    home, within = F.floor((F.col("_n") - 1) / rows), (F.col("_n") - 1) % rows
    homes = F.array(
        home, F.when((within < after) & (home > 0), home - 1), F.when(within >= rows - before, home + 1)
    )
    copies = numbered.withColumn("_block", F.explode(F.array_compact(homes)))
    return frames(copies, [entity, "_block"]).filter(F.col("_block") == home).drop("_n", "_block")


def sort_bars(df: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    return df.orderBy(*keys)


def prev(df: DataFrame, cols: Sequence[str], entity: Entity = "ticker") -> DataFrame:
    """Value of each column on the ticker's previous row, as ``prev_<column>``."""
    return df.withColumns({f"prev_{c}": F.lag(c).over(along(entity)) for c in cols})


def next_low(df: DataFrame, entity: Entity = "ticker") -> DataFrame:
    return df.withColumn("next_low", F.lead("low").over(along(entity)))


def forward_peak(df: DataFrame, horizon: int, entity: Entity = "ticker") -> DataFrame:
    """Highest high of the next ``horizon`` rows; null unless all of them have one."""
    if horizon < 1:
        raise ValueError("horizon must be at least one bar")
    ahead = along(entity).rowsBetween(1, horizon)
    full = F.count("high").over(ahead) == horizon
    return df.withColumn("forward_peak", F.when(full, F.max("high").over(ahead)))


def forward_mfe(df: DataFrame, horizon: int, entity: Entity = "ticker") -> DataFrame:
    """Best gain over the next ``horizon`` rows for an entry at the next low, as ``raw_mfe``."""
    gain = F.try_divide(F.col("forward_peak").cast("double"), F.col("next_low").cast("double"))
    return (
        df.transform(next_low, entity)
        .transform(forward_peak, horizon, entity)
        .withColumn("raw_mfe", gain - 1.0)
        .drop("next_low", "forward_peak")
    )


def zscore_by(
    df: DataFrame,
    cols: Sequence[str],
    key: str = "date",
    names: Sequence[str] | None = None,
    how: str = "aggregate",
) -> DataFrame:
    """Sample z-score of each column within ``key``, as ``<column>_cs`` unless named.

    ``aggregate`` joins per-key statistics back and moves no rows; ``window`` shuffles the rows by
    ``key`` and is only fit for groups that fit one task.
    """
    names = names or [f"{c}_cs" for c in cols]
    mean, deviation = {c: f"_mean_{c}" for c in cols}, {c: f"_std_{c}" for c in cols}
    if how == "window":
        frame = Window.partitionBy(key)
        stats = {mean[c]: F.avg(c).over(frame) for c in cols}
        stats.update({deviation[c]: F.stddev_samp(c).over(frame) for c in cols})
        with_stats = df.withColumns(stats)
    elif how == "aggregate":
        aggs = [F.avg(c).alias(mean[c]) for c in cols]
        aggs += [F.stddev_samp(c).alias(deviation[c]) for c in cols]
        with_stats = join_stats(df, key, aggs)
    else:
        raise ValueError(f"unknown method {how!r}")
    scores = {n: zscore(F.col(c), F.col(mean[c]), F.col(deviation[c])) for c, n in zip(cols, names)}
    return with_stats.withColumns(scores).drop(*mean.values(), *deviation.values())


def normalise_to_first(df: DataFrame, col: str, key: str = "code") -> DataFrame:
    """``col`` over its first value per ``key``, as ``norm``."""
    first = F.first(col).over(along(key)).cast("double")
    return df.withColumn("norm", F.try_divide(F.col(col).cast("double"), first))


def day_table(df: DataFrame) -> DataFrame:
    """The dates that have any row, numbered from zero, with the last of them on every row.

    The global order runs over the distinct dates only, never over the rows.
    """
    days = df.select("date").distinct()
    whole = Window.partitionBy()
    return days.withColumns(
        {
            "day": F.row_number().over(Window.orderBy("date")) - 1,
            "last_day": (F.count(F.lit(1)).over(whole) - 1).cast("int"),
            "last_date": F.max("date").over(whole),
        }
    )


def with_day_index(df: DataFrame) -> DataFrame:
    """Number the dates that have any row, from zero."""
    return df.join(per_day(day_table(df).select("date", "day")), "date")


def lag_signal(bars: DataFrame, scores: DataFrame) -> DataFrame:
    """Price each row with the score of the ticker's previous row.

    Rows whose previous row has no score are dropped, and so are rows without four finite prices.
    """
    from barloom.operators.history import finite_ohlc

    scored = bars.join(scores.select("ticker", "date", "score"), ["ticker", "date"], "left")
    return lag_scored(scored).transform(finite_ohlc)


def lag_scored(scored: DataFrame, entity: Entity = "ticker") -> DataFrame:
    """:func:`lag_signal` for bars that already carry their score (null where there is none)."""
    return scored.withColumn("score", F.lag("score").over(along(entity))).filter(
        F.col("score").isNotNull()
    )
