"""Trade evaluation: exits of independent entries, round trips, and the marked book.

A book's cash couples all trades, which is a sequential simulation. Here every rule is a set
operation: exits are judged per entry, and balances are running sums over given actions.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import pricing
from barloom.operators.panel import along, day_table
from barloom.operators.ranking import strongest_first
from barloom.operators.spread import per_day, running_last, running_total, top_in_group
from barloom.schemas import BUY, LOW_HIGH, SELL


#: Why an entry was left, in the order in which the reasons are tried on one bar.
REASONS = ("take_profit", "stop_loss", "time", "signal", "final")


def _doubled(values: np.ndarray, levels: int, pick: np.ufunc) -> list[np.ndarray]:
    """Tables of ``pick`` over the next 1, 2, 4, ... values; shorter at the end, where fewer are left."""
    tables = [values]
    for level in range(levels):
        last = tables[-1]
        tables.append(pick(last[: -(1 << level)], last[1 << level :]) if len(last) > 1 << level else last[:0])
    return tables


def first_exits(
    day: np.ndarray, high: np.ndarray, low: np.ndarray, score: np.ndarray, last_day: int,
    entries: np.ndarray, upper: np.ndarray, lower: np.ndarray, hold: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Row and reason of the first exit after each of ``entries``, rows of one ticker in date order.

    The row is -1 where none of the next ``hold`` rows settles it. Barriers are found by halving: the
    highest high and lowest low of the next 1, 2, 4, ... rows are tabled once, and an entry skips the
    longest stretches that cross neither, so the steps are the logarithm of ``hold``.
    """
    n = len(day)
    end = np.minimum(entries + hold, n - 1)  # last row that may settle the entry
    levels = int(hold).bit_length()
    highs, lows = _doubled(high, levels, np.maximum), _doubled(low, levels, np.minimum)
    at = entries + 1
    for level in range(levels, -1, -1):
        if not len(highs[level]):
            continue
        fits = at + (1 << level) - 1 <= end
        here = np.minimum(at, len(highs[level]) - 1)
        quiet = (highs[level][here] < upper) & (lows[level][here] > lower)
        at = np.where(fits & quiet, at + (1 << level), at)
    rows = np.arange(n)
    # The nearest row at or after each one whose score is negative; n where there is none.
    weak = np.minimum.accumulate(np.where(score < 0, rows, n)[::-1])[::-1]
    after = np.append(weak, n)[entries + 1]
    late = np.searchsorted(day, day[entries] + hold)
    final = np.where(entries < n - 1, n - 1, n) if day[-1] == last_day else n
    hit = np.minimum(np.minimum(at, after), np.minimum(late, final))
    settled = hit <= end
    hit = np.where(settled, hit, -1)
    why = np.select(
        [high[hit] >= upper, low[hit] <= lower, day[hit] - day[entries] >= hold, score[hit] < 0], [0, 1, 2, 3], 4
    )
    return hit, np.where(settled, why, 4)


def _barrier(buy: Column, gain: float) -> Column:
    """``buy`` moved by ``gain`` as written in decimals: ``1.0 - 0.8`` in doubles is short of 0.2, and a low
    right at a fifth of the price would pass the barrier."""
    return buy * float(1 + Decimal(str(gain)))


def exit_outcomes(
    day_bars: DataFrame,
    take_profit: float,
    stop_loss: float,
    hold: int,
    fill: str = LOW_HIGH,
    threshold: float = 0.0,
) -> DataFrame:
    """First exit of each independent entry.

    An entry is a row scoring above ``threshold`` before the last day. Its later rows are judged
    in order: the profit barrier wins over the loss barrier on the same bar, then the holding
    time, then a negative score, then the last day. A ticker's ``hold``-th row after the entry is
    at least ``hold`` days later, so that many rows always settle the exit; fewer remain only at
    the end of the ticker's data, where the last close is the exit if the last day has no bar.

    A ticker's rows, at most one per date, meet in a task in the partitioning the scores already have;
    prices are column expressions before and after it.
    """
    if hold < 1:
        raise ValueError("hold must be at least one day")
    indexed = day_bars.join(per_day(day_table(day_bars)), "date")
    buy = pricing.buy_price(fill)
    quoted = indexed.select(
        "ticker", "date", "day", "last_day", "last_date",
        *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "score")],
        ((F.col("score") > threshold) & ~F.isnan("score") & (F.col("day") < F.col("last_day"))).alias("entry"),
        buy.alias("buy"),
        _barrier(buy, take_profit).alias("upper"),
        _barrier(buy, -stop_loss).alias("lower"),
        pricing.sell_price(fill).alias("sell"),
    )

    def settle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        number = lambda c, missing: rows.column(c).fill_null(missing).to_numpy()
        entries = np.flatnonzero(number("entry", False))
        # A missing price crosses nothing; NaN sorts above all numbers, as in SQL.
        high, low = number("high", -np.inf), number("low", np.inf)
        high, low = np.where(np.isnan(high), np.inf, high), np.where(np.isnan(low), np.inf, low)
        upper, lower = number("upper", np.inf)[entries], number("lower", -np.inf)[entries]
        day, last_day = rows.column("day").to_numpy(), rows.column("last_day")[0].as_py()
        hit, why = first_exits(day, high, low, number("score", 0.0), last_day, entries, upper, lower, hold)
        own, exits = rows.take(entries), rows.take(pa.array(np.maximum(hit, 0), mask=hit < 0))
        mark = rows.column("close").take(np.minimum(entries + hold, len(day) - 1))
        columns = {c: own.column(c) for c in ("ticker", "date", "day", "last_day", "last_date", "buy", "upper", "lower")}
        columns |= {f"hit_{c}": exits.column(c) for c in ("date", "day", "close", "sell")}
        columns |= {"mark": mark, "why": pa.array(np.array(REASONS, object)[why], pa.string())}
        return pa.table(columns)

    schema = (
        "ticker string, date date, day int, last_day int, last_date date, buy double, upper double, lower double,"
        " hit_date date, hit_day int, hit_close double, hit_sell double, mark double, why string"
    )
    settled = quoted.groupBy("ticker").applyInArrow(settle, schema)
    why, closed = F.col("why"), F.col("hit_day").isNotNull()
    price = (
        F.when(why == "take_profit", pricing.tick_floor(F.col("upper")))
        .when(why == "stop_loss", pricing.tick_floor(F.col("lower")))
        .when(why == "time", pricing.tick_floor(F.col("hit_close")))
        .otherwise(F.col("hit_sell"))
    )
    return settled.select(
        "ticker",
        F.col("date").alias("entry_date"),
        F.coalesce("hit_date", "last_date").alias("exit_date"),
        F.col("buy").alias("entry_price"),
        F.when(closed, price).otherwise(F.col("mark")).alias("exit_price"),
        (F.coalesce("hit_day", "last_day") - F.col("day")).alias("days_held"),
        why.alias("exit_reason"),
    )


def trade_result(trades: DataFrame) -> DataFrame:
    """Fill cost, proceeds, pnl and return for trades with prices and ``shares``."""
    cost = pricing.gross_cost(F.col("entry_price") * F.col("shares"))
    proceeds = pricing.net_proceeds(F.col("exit_price") * F.col("shares"))
    return (
        trades.withColumns({"cost": cost, "proceeds": proceeds})
        .withColumn("pnl", F.col("proceeds") - F.col("cost"))
        .withColumn("return_pct", F.try_divide("pnl", "cost"))
    )


def round_trips(actions: DataFrame) -> DataFrame:
    """Closed trades: each buy with the ticker's next sell.

    A ticker has at most one open position. A sell and a new buy of the same ticker may share a
    day, in which case the sell comes first.
    """
    order = Window.partitionBy("ticker").orderBy("date", F.desc("side"))
    ahead = {
        "_side": F.lead("side").over(order),
        "exit_date": F.lead("date").over(order),
        "exit_price": F.lead("price").over(order),
        "exit_reason": F.lead("reason").over(order),
    }
    pairs = actions.withColumns(ahead).filter((F.col("side") == BUY) & (F.col("_side") == SELL))
    return trade_result(
        pairs.select(
            "ticker",
            F.col("date").alias("entry_date"),
            "exit_date",
            F.col("price").alias("entry_price"),
            "exit_price",
            "shares",
            "exit_reason",
        )
    )


def _flow() -> Column:
    amount = F.col("price") * F.col("shares")
    return F.when(F.col("side") == BUY, -pricing.gross_cost(amount)).otherwise(
        pricing.net_proceeds(amount)
    )


def book_days(actions: DataFrame, bars: DataFrame, start_cash: float, tasks: int | None = None) -> DataFrame:
    """One row per day of ``bars``: cash, unsettled proceeds and marked holdings.

    Each ticker's holding changes value only on its own rows, so the book's value is a running sum
    of those changes: no (ticker, day) grid is built, and a day without a bar keeps the last
    close. ``value_before_buys`` is the marked value once the day's sells are out and before its
    buys are in. Sales of a day settle on the next.
    """
    # Bars and orders as narrow rows of one shape: 0 for a bar with its close, 1 and -1 for a buy and a sell with its
    # flow and shares.
    orders = actions.select(
        "ticker",
        "date",
        F.when(F.col("side") == BUY, 1).otherwise(-1).alias("turn"),
        _flow().alias("amount"),
        F.col("shares").cast("double").alias("shares"),
    )
    marks = bars.select(
        "ticker",
        "date",
        F.lit(0).alias("turn"),
        F.col("close").cast("double").alias("amount"),
        F.lit(0.0).alias("shares"),
    )
    is_buy, is_sell = F.col("turn") == 1, F.col("turn") == -1
    # Placed and sorted by ticker and date once, which serves every frame below. A frame ends with its day, so all
    # rows of a day say the same, and the change since the row before is zero on all but the day's first.
    day_close = F.max(F.when(F.col("turn") == 0, F.col("amount"))).over(Window.partitionBy("ticker", "date"))
    so_far = along().rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.unionByName(orders)
    held = (
        (rows.repartition("ticker") if tasks is None else rows.repartition(tasks, "ticker"))
        .withColumn("close", day_close)
        .withColumns(
            {
                "held": F.sum(F.col("turn") * F.col("shares")).over(so_far),
                "mark": F.last("close", ignorenulls=True).over(so_far),
            }
        )
        .withColumn("value", F.coalesce(F.col("held") * F.col("mark"), F.lit(0.0)))
    )
    change = F.col("value") - F.lag("value", 1, 0.0).over(along())
    bought = F.when(is_buy, F.coalesce(F.col("shares") * F.col("mark"), F.lit(0.0))).otherwise(0.0)
    days = (
        held.withColumns({"change": change, "bought": bought})
        .groupBy("date")
        .agg(
            F.sum("change").alias("change"),
            F.sum(F.col("change") - F.col("bought")).alias("kept_change"),
            F.coalesce(F.sum(F.when(is_buy, F.col("amount"))), F.lit(0.0)).alias("paid"),
            F.coalesce(F.sum(F.when(is_sell, F.col("amount"))), F.lit(0.0)).alias("received"),
        )
    )
    # From here on one row per day.
    order = Window.orderBy("date")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = days.withColumns(
        {
            "value": F.sum("change").over(so_far),
            "value_before_buys": F.coalesce(F.sum("change").over(earlier), F.lit(0.0))
            + F.col("kept_change"),
            "cash_before_buys": F.lit(float(start_cash))
            + F.coalesce(F.sum(F.col("paid") + F.col("received")).over(earlier), F.lit(0.0)),
        }
    )
    return totals.select(
        "date",
        "cash_before_buys",
        (F.col("cash_before_buys") + F.col("paid")).alias("cash"),
        F.col("received").alias("pending"),
        "value",
        "value_before_buys",
    )


def mark_equity(actions: DataFrame, bars: DataFrame, start_cash: float, tasks: int | None = None) -> DataFrame:
    """Daily equity: cash, unsettled proceeds and holdings at their last close."""
    equity = F.col("cash") + F.col("pending") + F.col("value")
    return book_days(actions, bars, start_cash, tasks).select("date", equity.alias("equity"))


def equal_target(
    actions: DataFrame, bars: DataFrame, start_cash: float, slots: int, tasks: int | None = None
) -> DataFrame:
    """Per day, the equal share of one slot: settled cash and kept holdings over the slots."""
    share = (F.col("cash_before_buys") + F.col("value_before_buys")) / max(slots, 1)
    return book_days(actions, bars, start_cash, tasks).select("date", share.alias("target"))


def settle_cash(actions: DataFrame, days: DataFrame, start_cash: float) -> DataFrame:
    """Actions with the spendable cash after each.

    A sale leaves cash unchanged on its day; its proceeds arrive before the first action of the
    next day in ``days``. Within a day sells precede buys, and buys follow ``seq`` if given.
    """
    calendar = days.select("date").distinct()
    following = calendar.withColumn("_settles", F.lead("date").over(Window.orderBy("date")))
    seq = F.col("seq") if "seq" in actions.columns else F.lit(0)
    is_buy = F.col("side") == BUY
    booked = actions.join(per_day(following), "date", "left").withColumns(
        {"_flow": _flow(), "_seq": seq}
    )
    orders = booked.withColumns(
        {
            "_phase": F.when(is_buy, 2).otherwise(1),
            "_flow": F.when(is_buy, F.col("_flow")).otherwise(0.0),
        }
    )
    arrivals = (
        booked.filter(~is_buy & F.col("_settles").isNotNull())
        .withColumn("date", F.col("_settles"))
        .withColumn("_phase", F.lit(0))
    )
    order = [F.asc(c) for c in ("date", "_phase", "_seq", "ticker", "side")]
    totals = running_total(orders.unionByName(arrivals), [], order, "_flow", "_total")
    return (
        totals.filter(F.col("_phase") > 0)
        .withColumn("cash_after", F.col("_total") + float(start_cash))
        .drop("_flow", "_seq", "_phase", "_settles", "_total")
    )


def mark_to_last_close(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Value of dated positions at the day's close, or the last close before it.

    ``positions`` has ticker, date and shares; repeated rows stay. Bars and positions are sorted together,
    and each slice carries its last closes on to the next, so a ticker may hold any share of the rows.
    """
    closes = bars.select("ticker", "date", F.col("close").cast("double").alias("_close"), F.lit(0).alias("_kind"))
    # A day's close comes before the positions that it marks.
    both = positions.withColumn("_kind", F.lit(1)).unionByName(closes, allowMissingColumns=True)
    carried = running_last(both, ["ticker"], [F.asc("date"), F.asc("_kind")], "_close", "mark")
    return (
        carried.filter(F.col("_kind") == 1)
        .withColumn("value", F.col("mark") * F.col("shares"))
        .select(*positions.columns, "mark", "value")
    )


def not_held(bars: DataFrame, holdings: DataFrame) -> DataFrame:
    """Bars of names the book does not hold that day."""
    return bars.join(holdings, ["date", "ticker"], "left_anti")


def rotation_pairs(
    holdings: DataFrame, challengers: DataFrame, slots: int, hurdle: float = pricing.ROUND_TRIP
) -> DataFrame:
    """Per day with a full book: weakest held names against strongest challengers.

    ``holdings`` has date, ticker and score, null where the name has no bar that day; a book never
    holds more than ``slots`` names, so the first ``slots`` ranks of both sides hold every pair.
    Pairs count up to the first whose gain does not clear ``hurdle``.
    """
    book = holdings.groupBy("date").agg(F.count(F.lit(1)).alias("_held"))
    full = book.filter(F.col("_held") >= slots).select("date")
    priced = holdings.filter(F.col("score").isNotNull()).join(per_day(full), "date", "left_semi")
    weakest = top_in_group(priced, "date", [F.asc("score"), F.asc("ticker")], slots, "k")
    strongest = top_in_group(challengers, "date", strongest_first(), slots, "k")
    pairs = weakest.select(
        "date", "k", F.col("ticker").alias("held"), F.col("score").alias("held_score")
    ).join(
        strongest.select(
            "date", "k", F.col("ticker").alias("challenger"), F.col("score").alias("new_score")
        ),
        ["date", "k"],
    )
    run = Window.partitionBy("date").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    clears = (F.col("new_score").cast("double") - F.col("held_score").cast("double")) > hurdle
    return pairs.withColumn("_run", F.min(clears).over(run)).filter("_run").drop("_run")
