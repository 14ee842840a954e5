"""Metrics of scores, trades and equity curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.signals import correlation, huber
from barloom.operators.panel import normalise_to_first
from barloom.operators.spread import one_row
from barloom.schemas import EXIT_REASONS

ANNUAL_DAYS = 252
INFINITY = float("inf")


def ic(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Correlation of score and target over all rows."""
    return df.agg(correlation(F.col(score), F.col(target)).alias("ic"))


def ic_by_date(
    df: DataFrame, score: str = "score", target: str = "target", key: str = "date"
) -> DataFrame:
    return df.groupBy(key).agg(
        correlation(F.col(score), F.col(target)).alias("ic"), F.count(F.lit(1)).alias("n")
    )


def weighted_metric(df: DataFrame, metric: str, n: str = "n") -> DataFrame:
    """Mean of a per-group metric, weighted by the groups' sizes."""
    value = F.try_divide(F.sum(F.col(metric) * F.col(n)), F.sum(n))
    return df.agg(value.alias(metric))


def huber_loss(
    df: DataFrame, score: str = "score", target: str = "target", delta: float = 1.0
) -> DataFrame:
    return df.agg(F.avg(huber(F.col(score), F.col(target), delta)).alias("huber"))


def evaluate(scored: DataFrame, delta: float = 1.0) -> DataFrame:
    """Loss and correlation of each ``side`` of a scored frame, in one pass."""
    return scored.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(huber(F.col("score"), F.col("target"), delta)).alias("huber"),
        correlation(F.col("score"), F.col("target")).alias("ic"),
    )


def exit_tally(trades: DataFrame) -> DataFrame:
    """One row: number of trades per exit reason."""
    return trades.agg(*_tally())


def _tally() -> list[Column]:
    return [F.count_if(F.col("exit_reason") == r).alias(r) for r in EXIT_REASONS]


def _zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def trade_stats(trades: DataFrame) -> DataFrame:
    """One row: count, win rate, profit factor and mean returns of wins and losses."""
    return trades.agg(*_trade_stats())


def _trade_stats() -> list[Column]:
    won, lost = F.col("pnl") > 0, F.col("pnl") < 0
    gain = _zero_if_null(F.sum(F.when(won, F.col("pnl"))))
    loss = _zero_if_null(F.sum(F.when(lost, F.col("pnl"))))
    factor = F.when(loss < 0, F.try_divide(gain, -loss)).when(gain > 0, INFINITY).otherwise(0.0)
    return [
        F.count(F.lit(1)).alias("trade_count"),
        _zero_if_null(F.try_divide(F.count_if(won), F.count(F.lit(1)))).alias("win_rate"),
        factor.alias("profit_factor"),
        _zero_if_null(F.avg(F.when(won, F.col("return_pct")))).alias("avg_win_return"),
        _zero_if_null(F.avg(F.when(lost, F.col("return_pct")))).alias("avg_loss_return"),
    ]


def return_stats(equity: DataFrame, start_cash: float) -> DataFrame:
    """One row: final equity, cumulative return, linear annual return and day count."""
    return _with_returns(equity.agg(*_final_state(start_cash)), start_cash)


def _final_state(start_cash: float) -> list[Column]:
    final = F.coalesce(F.max_by("equity", "date"), F.lit(float(start_cash)))
    return [final.alias("final_equity"), F.count(F.lit(1)).alias("trading_days")]


def _with_returns(summary: DataFrame, start_cash: float) -> DataFrame:
    gain = (F.col("final_equity") - start_cash) / start_cash
    yearly = F.try_divide(F.col("cumulative_return"), F.col("trading_days")) * ANNUAL_DAYS
    return summary.withColumn("cumulative_return", gain).withColumn(
        "annualized_return", _zero_if_null(yearly)
    )


def daily_return(equity: DataFrame, series: str | None = None) -> DataFrame:
    """Return on the previous day, null on a curve's first. A curve has one row per day."""
    order = (Window.partitionBy(series) if series else Window).orderBy("date")
    ratio = F.try_divide(F.col("equity"), F.lag("equity").over(order))
    return equity.withColumn("daily_return", ratio - 1.0)


def sharpe(equity: DataFrame, days: int = ANNUAL_DAYS) -> DataFrame:
    """One row: annualised Sharpe ratio; zero for a flat curve or fewer than two days."""
    return daily_return(equity).agg(_sharpe(days))


def _sharpe(days: int = ANNUAL_DAYS) -> Column:
    spread = F.stddev_pop("daily_return")
    ratio = F.when(spread > 0, F.try_divide(F.avg("daily_return"), spread) * math.sqrt(days))
    return _zero_if_null(ratio).alias("sharpe")


def performance_report(trades: DataFrame, equity: DataFrame, start_cash: float) -> DataFrame:
    """All figures of one evaluation as one wide row: one pass over the trades and one over the curve."""
    curve = _with_returns(daily_return(equity).agg(*_final_state(start_cash), _sharpe()), start_cash)
    return trades.agg(*_trade_stats(), *_tally()).join(one_row(curve))


def priced_at_start(bars: DataFrame, start: object, entity: str = "code") -> DataFrame:
    """Bars of the names that have one on the first day."""
    first = bars.filter(F.col("date") == F.lit(start).cast("date")).select(entity).distinct()
    return bars.join(first, entity, "left_semi")


def baseline_curve(bars: DataFrame, start: object, end: object, cash: float) -> DataFrame:
    """Equal-weight buy-and-hold of the names priced on the first day."""
    from barloom.operators.history import between

    window = between(bars, start, end).select("code", "date", "close")
    held = priced_at_start(window, start).transform(normalise_to_first, "close", "code")
    return held.groupBy("date").agg((F.avg("norm") * cash).alias("equity"))


def final_returns(curves: DataFrame, start_cash: float) -> DataFrame:
    """Total return of each labelled curve."""
    last = F.max_by("equity", "date") / start_cash - 1.0
    return curves.groupBy("series").agg(last.alias("total_return"))


def plan_totals(sells: DataFrame, buys: DataFrame) -> DataFrame:
    """One row: order counts, proceeds and cost of a day's plan."""
    sold = sells.agg(
        F.count(F.lit(1)).alias("sells"), _zero_if_null(F.sum("proceeds")).alias("proceeds")
    )
    bought = buys.agg(
        F.count(F.lit(1)).alias("buys"), _zero_if_null(F.sum("cost")).alias("cost")
    )
    return sold.join(one_row(bought))


def quote_coverage(quotes: DataFrame) -> DataFrame:
    """One row: quotes fetched, and those whose session has opened."""
    return quotes.agg(
        F.count(F.lit(1)).alias("fetched"), F.count("open_price").alias("priced")
    )


def compare_curves(
    curves: DataFrame, bars: DataFrame, start_cash: float, baseline: str = "baseline"
) -> DataFrame:
    """Labelled curves plus the equal-weight baseline over the days they span.

    Every point carries its series' total return in ``total_return``, the baseline's included.
    """
    first, last = curves.agg(F.min("date"), F.max("date")).first()
    held = baseline_curve(bars, first, last, start_cash).withColumn("series", F.lit(baseline))
    points = curves.select("date", "equity", "series").unionByName(held)
    return points.join(final_returns(points, start_cash), "series").select("date", "equity", "series", "total_return")
