"""History operators: filters, adjustment, deduplication and refresh bounds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.signals import is_finite, is_positive
from barloom.operators.spread import one_row, per_day
from barloom.schemas import BAR_COLUMNS, PRICES

KEYS = ("market", "code", "date")

# Listing type -> (symbol suffix, market). Types not named here are not fetched.
ROUTES = {"TWSE": ("TW", "tse"), "ETF": ("TW", "tse"), "OTC": ("TWO", "otc")}


def since(df: DataFrame, start: dt.date | str) -> DataFrame:
    """Rows on or after ``start``; with :func:`until` the two halves partition the table."""
    return df.filter(F.col("date") >= F.lit(start).cast("date"))


def until(df: DataFrame, end: dt.date | str) -> DataFrame:
    """Rows before ``end``."""
    return df.filter(F.col("date") < F.lit(end).cast("date"))


def between(df: DataFrame, lo: dt.date | str, hi: dt.date | str) -> DataFrame:
    """Rows from ``lo`` to ``hi``, both included."""
    return df.filter(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def recent(df: DataFrame, days: int) -> DataFrame:
    """Rows at most ``days`` calendar days older than the newest date of the table.

    The newest date is looked up first, so that the filter is a literal the scan can prune by.
    """
    newest = df.agg(F.date_sub(F.max("date"), days)).first()[0]
    return df.filter(F.col("date") >= F.lit(newest).cast("date"))


def last_date(df: DataFrame) -> DataFrame:
    return df.agg(F.max("date").alias("last_date"))


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def universe(df: DataFrame, entity: str = "ticker") -> DataFrame:
    return df.select(entity).distinct()


def project_bars(df: DataFrame, entity: str = "code") -> DataFrame:
    """The columns the features need, with ``entity`` renamed to ``ticker``."""
    return df.select(
        F.col(entity).cast("string").alias("ticker"),
        F.col("date").cast("date").alias("date"),
        *[F.col(name).cast("float").alias(name) for name in (*PRICES, "volume")],
    )


def positive_close(df: DataFrame) -> DataFrame:
    return df.filter(is_positive(F.col("close")))


def finite_ohlc(df: DataFrame) -> DataFrame:
    """Rows whose four prices are all finite."""
    return df.filter(reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in PRICES]))


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in ``cols``. ``na.drop`` would also drop NaN.

    Float columns are checked through their sum, which is null if any of them is: one short
    expression instead of a copy of every column's definition in the filter.
    """
    if all(isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) for c in cols):
        return df.filter(reduce(lambda a, b: a + b, [F.col(c) for c in cols]).isNotNull())
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def with_literals(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def canonical(df: DataFrame) -> DataFrame:
    """Bars in the stored column order."""
    return df.select(*BAR_COLUMNS)


def adjust(raw: DataFrame) -> DataFrame:
    """Fold the adjusted close into the prices; rows without a finite factor are dropped."""
    factor = F.try_divide(F.col("adjclose").cast("double"), F.col("close").cast("double"))
    scaled = {c: (F.col(c).cast("double") * factor).cast("float") for c in ("open", "high", "low")}
    return (
        raw.filter(is_finite(factor))
        .withColumns({**scaled, "close": F.col("adjclose").cast("float")})
        .drop("adjclose")
    )


def route_market(listing: DataFrame) -> DataFrame:
    """Symbol and market of each listed code; types without a route are dropped."""

    def pick(position: int) -> Column:
        cases = iter(ROUTES.items())
        kind, route = next(cases)
        out = F.when(F.col("type") == kind, route[position])
        for kind, route in cases:
            out = out.when(F.col("type") == kind, route[position])
        return out

    return listing.filter(F.col("type").isin(*ROUTES)).select(
        "code", pick(1).alias("market"), F.concat_ws(".", "code", pick(0)).alias("symbol")
    )


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames, oldest first, numbering their age in ``source_seq``."""
    tagged = [f.withColumn("source_seq", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged)


def keep_newest(
    df: DataFrame, keys: Sequence[str] = KEYS, seq: str | Sequence[str] = "source_seq"
) -> DataFrame:
    """One row per key: the one with the highest ``seq``.

    An aggregate, not a window: copies of one key collapse before the shuffle, so a key with very
    many copies costs no more than any other. With equal ``seq`` the larger row wins, so that the
    result never depends on arrival order.
    """
    seq = [seq] if isinstance(seq, str) else list(seq)
    rest = [c for c in df.columns if c not in keys and c not in seq]
    newest = F.max(F.struct(*seq, *rest)).alias("_newest")
    picked = df.groupBy(*keys).agg(newest)
    return picked.select(*[
        F.col(c) if c in keys else F.col(f"_newest.{c}").alias(c) for c in df.columns
    ])


def freshness(
    last: DataFrame, needed: DataFrame, allow_stale: bool = False
) -> DataFrame:
    """One row: newest stored date, the session it must reach, and whether it does.

    ``last`` has ``last_date``, ``needed`` has ``prior``; each is one row.
    """
    enough = F.coalesce(F.col("last_date") >= F.col("needed"), F.lit(False))
    return last.join(one_row(needed.select(F.col("prior").alias("needed")))).withColumn(
        "ok", enough | F.lit(allow_stale)
    )


def next_fetch(df: DataFrame, floor: dt.date | str, end: dt.date | str) -> DataFrame:
    """One row: first and last date the next refresh has to fetch, and whether it has to."""
    start = F.coalesce(F.date_add(F.max("date"), 1), F.lit(floor).cast("date"))
    return df.agg(start.alias("start"), F.lit(end).cast("date").alias("end")).withColumn(
        "pending", F.col("start") <= F.col("end")
    )


def missing_ranges(
    bars: DataFrame,
    entities: DataFrame,
    sessions: DataFrame,
    floor: dt.date | str,
    end: dt.date | str,
    keys: Sequence[str] = ("code",),
) -> DataFrame:
    """What a refresh has to fetch again: each entity's runs of sessions without a bar.

    ``sessions`` has the trading days as ``date``; those from ``floor`` to ``end`` count. The newest date of
    the whole table hides what a failed fetch left out of one entity; here each gap is found, also before
    the first bar and after the last, and an entity without any bar misses the whole span. Returns the keys,
    ``first`` and ``last`` session of each gap and their number, ``sessions``. Bars of other entities or on
    other days do not count. No (entity, session) grid is built: sessions are numbered, and a gap is a step
    of more than one between the bars of an entity.
    """
    spanned = between(sessions.select("date"), floor, end).filter("date is not null").distinct()
    # One row per calendar day, whatever the number of bars.
    days = spanned.withColumn("_n", F.row_number().over(Window.orderBy("date")))
    wanted = entities.select(*keys).distinct()
    held = bars.select(*keys, "date").join(per_day(days), "date").join(wanted, list(keys), "left_semi").select(*keys, "_n")
    marks = held.unionByName(wanted.withColumn("_n", F.lit(0)))
    total = days.agg(F.count(F.lit(1)).cast("int").alias("_total"))
    after = F.lead("_n").over(Window.partitionBy(*keys).orderBy("_n"))
    steps = marks.withColumn("_after", after).crossJoin(one_row(total))
    steps = steps.withColumn("_after", F.coalesce("_after", F.col("_total") + 1))
    gaps = steps.filter(F.col("_after") - F.col("_n") > 1)
    number = lambda name: F.broadcast(days.select(F.col("_n").alias(f"_{name}"), F.col("date").alias(name)))
    return (
        gaps.withColumns({"_first": F.col("_n") + 1, "_last": F.col("_after") - 1})
        .join(number("first"), "_first")
        .join(number("last"), "_last")
        .select(*keys, "first", "last", (F.col("_last") - F.col("_first") + 1).alias("sessions"))
    )


def split_cutoff(df: DataFrame, valid_days: int) -> DataFrame:
    """One row: date bounds and the first day of the validation side."""
    return date_bounds(df).withColumn("cutoff", F.date_sub("last_date", valid_days))
