"""Trading calendar: what each day is, and the sessions around it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.spread import per_day

# Orders before this local time count for the same day; search limit in days.
ORDER_CUTOFF = "13:00:00"
SEARCH_DAYS = 30
LOCAL_OFFSET_HOURS = 8


def classify_days(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """``kind`` of each date and, for named days, the schedule's ``desc``.

    The schedule outranks the weekday: a day it names as open trades even on a weekend.
    """
    named = holidays.groupBy("date").agg(
        F.max(F.struct("closed", "desc")).alias("_named")
    )
    weekend = F.weekday("date") >= 5
    kind = (
        F.when(F.col("_named.closed"), "holiday")
        .when(F.col("_named").isNotNull(), "trading")
        .when(weekend, "weekend")
        .otherwise("trading")
    )
    return (
        dates.join(per_day(named), "date", "left")
        .withColumn("kind", kind)
        .withColumn("desc", F.col("_named.desc"))
        .drop("_named")
    )


def calendar(holidays: DataFrame, first: dt.date | str, last: dt.date | str) -> DataFrame:
    """One row per calendar day with its kind and its neighbouring sessions.

    ``next_session`` is the nearest trading day strictly after, ``prev_session`` strictly before,
    each null when there is none within the search limit.
    """
    lo = F.date_sub(F.lit(first).cast("date"), SEARCH_DAYS + 1)
    hi = F.date_add(F.lit(last).cast("date"), SEARCH_DAYS + 1)
    spark = holidays.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("date"))
    kinds = classify_days(days, holidays)
    session = F.when(F.col("kind") == "trading", F.col("date"))
    order = Window.orderBy("date")  # one row per calendar day
    ahead, behind = order.rowsBetween(1, SEARCH_DAYS), order.rowsBetween(-SEARCH_DAYS, -1)
    return kinds.withColumns(
        {
            "next_session": F.first(session, ignorenulls=True).over(ahead),
            "prev_session": F.last(session, ignorenulls=True).over(behind),
        }
    )


def _one_per_date(days: DataFrame, value: str) -> DataFrame:
    """A caller's ``days`` may repeat dates; what is broadcast has one row for each."""
    return per_day(days.groupBy("date").agg(F.max(value).alias(value)))


def next_session(dates: DataFrame, days: DataFrame) -> DataFrame:
    return dates.join(_one_per_date(days, "next_session"), "date", "left")


def prev_session(dates: DataFrame, days: DataFrame) -> DataFrame:
    return dates.join(_one_per_date(days, "prev_session"), "date", "left")


def session_for(
    orders: DataFrame, days: DataFrame, at: str = "ts", cutoff: str = ORDER_CUTOFF
) -> DataFrame:
    """Session an order placed at the UTC instant ``at`` executes in, and the one before it."""
    local = _local_time(F.col(at))
    placed = orders.withColumn("_local", local).withColumn("date", F.to_date("_local"))
    today = days.groupBy("date").agg(F.max("kind").alias("kind"), F.max("next_session").alias("next_session"))
    in_time = F.date_format("_local", "HH:mm:ss") < cutoff
    session = F.when((F.col("kind") == "trading") & in_time, F.col("date")).otherwise(
        F.col("next_session")
    )
    before = days.groupBy(F.col("date").alias("session")).agg(F.max("prev_session").alias("prior"))
    return (
        placed.join(per_day(today), "date", "left")
        .withColumn("session", session)
        .drop("_local", "date", "kind", "next_session")
        .join(per_day(before, "session"), "session", "left")
    )


def _local_time(instant: Column) -> Column:
    """Wall-clock time at the exchange, which keeps a fixed offset all year."""
    return instant + F.make_dt_interval(F.lit(0), F.lit(LOCAL_OFFSET_HOURS))
