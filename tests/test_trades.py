import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, ranking, trades
from barloom.functions import pricing

BARS = "date date, ticker string, score double, open double, low double, high double, close double"
ACTIONS = "date date, ticker string, side string, reason string, price double, shares double"


def day(n):
    return dt.date(2026, 1, n)


def bars(spark, rows):
    """Rows of day, ticker, score, low, high, close; the open is the low."""
    return spark.createDataFrame(
        [(day(d), t, s, low, low, high, close) for d, t, s, low, high, close in rows], BARS
    )


def legal(price):
    """The price rounded down to the tick of its band."""
    tick = 0.05 if price < 50 else 0.1
    return math.floor(price / tick + 1e-9) * tick


@pytest.mark.parametrize(
    "low, high, close, profit, loss, hold, aim, reason",
    [
        (41.3, 47.9, 44.0, 0.13, 0.4, 6, 41.2 * 1.13, "take_profit"),
        (33.1, 42.0, 35.0, 0.3, 0.18, 6, 41.2 * 0.82, "stop_loss"),
        (40.2, 43.0, 41.73, 0.3, 0.3, 1, 41.73, "time"),
        (30.0, 55.0, 40.0, 0.27, 0.18, 6, 41.2 * 1.27, "take_profit"),
    ],
)
def test_one_barrier_at_a_time(spark, low, high, close, profit, loss, hold, aim, reason):
    df = bars(spark, [(4, "K", 0.7, 41.2, 43.5, 42.0), (6, "K", 0.4, low, high, close), (9, "K", 0.1, 39.0, 44.0, 41.0)])
    first = trades.exit_outcomes(df, profit, loss, hold).orderBy("entry_date").first()
    assert (first.exit_reason, first.exit_date, first.entry_price) == (reason, day(6), pytest.approx(41.2))
    assert first.exit_price == pytest.approx(legal(aim))


@pytest.mark.parametrize("hold", [1, 2, 7, 64, 500])
def test_halving_finds_the_first_row(hold):
    draw = np.random.default_rng(hold)
    n = 400
    dates = np.sort(draw.choice(700, n, replace=False))
    low = draw.integers(80, 110, n).astype(float)
    high = low + draw.integers(0, 30, n)
    score = draw.normal(1.5, 1.0, n)
    entries = np.flatnonzero(draw.random(n) < 0.7)
    upper, lower = draw.integers(112, 140, len(entries)) + 0.5, draw.integers(78, 90, len(entries)) + 0.5
    last = int(dates[-1])
    hit, why = trades.first_exits(dates, high, low, score, last, entries, upper, lower, hold)
    for e, (i, top, bottom) in enumerate(zip(entries, upper, lower, strict=True)):
        wanted = (-1, 4)
        for j in range(i + 1, min(i + hold, n - 1) + 1):
            tests = [high[j] >= top, low[j] <= bottom, dates[j] - dates[i] >= hold, score[j] < 0, dates[j] == last]
            if any(tests):
                wanted = (j, tests.index(True))
                break
        assert (hit[e], why[e]) == wanted


def test_missing_prices_settle_nothing(spark):
    df = bars(spark, [(1, "A", 0.5, 10.0, 10.0, 10.0), (2, "A", 0.5, None, None, None), (3, "A", None, 10.0, 13.0, 12.0),
                      (1, "B", 0.5, None, 10.0, 10.0), (4, "B", 0.1, 10.0, 10.0, None)])
    out = {(r.ticker, r.entry_date.day): r for r in trades.exit_outcomes(df, 0.1, 0.5, 9, threshold=0.2).collect()}
    assert out["A", 1].exit_reason == "take_profit" and out["A", 1].exit_date == day(3)
    assert out["B", 1].exit_reason == "final" and out["B", 1].exit_price == 10.0 and out["B", 1].entry_price is None


def test_signal_final_and_last_mark(spark):
    df = bars(spark, [
        (1, "A", 0.5, 10.0, 10.0, 10.0), (2, "A", -0.1, 10.0, 12.0, 11.0),
        (1, "B", 0.5, 10.0, 10.0, 10.0), (3, "B", 0.1, 10.0, 13.0, 11.0),
        (1, "C", 0.5, 10.0, 10.0, 10.5), (2, "C", 0.1, 10.0, 13.0, 12.5),
    ])
    out = {r.ticker: r for r in trades.exit_outcomes(df, 100.0, 0.99, 50, threshold=0.2).collect()}
    assert (out["A"].exit_reason, out["A"].exit_price) == ("signal", 12.0)
    assert (out["B"].exit_reason, out["B"].exit_price, out["B"].days_held) == ("final", 13.0, 2)
    assert (out["C"].exit_reason, out["C"].exit_price, out["C"].exit_date) == ("final", 12.5, day(3))


def test_a_low_at_the_barrier_stops_out(spark):
    # A fifth of 1730 is 346; 1.0 - 0.8 in doubles would put the barrier just below it.
    df = bars(spark, [(1, "A", 0.5, 1730.0, 1730.0, 1730.0), (2, "A", -0.1, 346.0, 900.0, 900.0),
                      (1, "B", 0.5, 1730.0, 1730.0, 1730.0), (2, "B", -0.1, 347.0, 900.0, 900.0)])
    out = trades.exit_outcomes(df, 3.0, 0.8, 6)
    got = {r.ticker: (r.exit_reason, r.exit_price) for r in out.filter("entry_date = date'2026-01-01'").collect()}
    assert got == {"A": ("stop_loss", 346.0), "B": ("signal", 900.0)}


def test_the_tally_counts_a_low_at_the_barrier(spark):
    df = bars(spark, [(1, "A", 0.5, 1385.0, 1385.0, 1385.0), (2, "A", -0.1, 277.0, 900.0, 900.0)])
    row = metrics.exit_tally(trades.exit_outcomes(df, 3.0, 0.8, 6)).first()
    assert (row.stop_loss, row.signal, row.final) == (1, 0, 0)


def test_threshold_gates_entries(spark):
    df = bars(spark, [(d, "A", 0.05, 10.0, 12.0, 11.0) for d in (1, 2, 3)])
    assert trades.exit_outcomes(df, 0.1, 0.1, 5, threshold=0.2).count() == 0


def slow_exit(rows, i, tp, sl, hold, last_day, index):
    """Walk one entry's later bars one by one."""
    entry = rows[i]
    price = entry[3]
    for later in rows[i + 1 :]:
        held = index[later[0]] - index[entry[0]]
        if later[4] >= price * (1 + tp):
            return "take_profit", later[0]
        if later[3] <= price * (1 - sl):
            return "stop_loss", later[0]
        if held >= hold:
            return "time", later[0]
        if later[2] < 0:
            return "signal", later[0]
        if later[0] == last_day:
            return "final", later[0]
    return "final", last_day


def test_exits_match_a_walk(spark):
    draw = random.Random(9)
    rows = []
    for ticker in "ABCDEF":
        for d in sorted(draw.sample(range(1, 29), draw.randint(5, 25))):
            low = round(draw.uniform(10, 20), 0)
            rows.append((d, ticker, round(draw.uniform(-0.2, 0.8), 2), low,
                         low + draw.randint(0, 4), low))
    days = sorted({r[0] for r in rows})
    index = {d: i for i, d in enumerate(days)}
    expected = {}
    for ticker in "ABCDEF":
        mine = [r for r in rows if r[1] == ticker]
        for i, r in enumerate(mine):
            if r[2] > 0 and r[0] != days[-1]:
                expected[(ticker, r[0])] = slow_exit(mine, i, 0.35, 0.3, 4, days[-1], index)
    out = trades.exit_outcomes(bars(spark, rows), 0.35, 0.3, 4).collect()
    got = {(r.ticker, r.entry_date.day): (r.exit_reason, r.exit_date.day) for r in out}
    assert got == expected
    assert len({v[0] for v in expected.values()}) >= 4


def paid(amount):
    """Cash for a buy: the amount and its commission, at least the minimum."""
    return amount + max(amount * 0.001425, 20.0)


def received(amount):
    """Cash from a sell: the amount less commission and tax."""
    return amount - max(amount * 0.001425, 20.0) - amount * 0.003


@pytest.fixture(scope="module")
def winning(spark):
    prices = bars(spark, [(1, "Q", 0.3, 24.0, 26.0, 25.5), (2, "Q", 0.2, 26.0, 29.0, 28.0),
                          (3, "Q", 0.1, 30.0, 33.0, 32.0)])
    actions = spark.createDataFrame(
        [(day(1), "Q", "Buy", "", 25.0, 7_000.0), (day(3), "Q", "Sell", "final", 32.5, 7_000.0)],
        ACTIONS,
    )
    return prices, actions


def test_winning_trade(spark, winning):
    prices, actions = winning
    cost, proceeds, cash = paid(25.0 * 7_000), received(32.5 * 7_000), 400_000.0
    expected = [cash - cost + 25.5 * 7_000, cash - cost + 28.0 * 7_000, cash - cost + proceeds]
    curve = trades.mark_equity(actions, prices, cash)
    assert [r.equity for r in curve.orderBy("date").collect()] == pytest.approx(expected)
    report = metrics.performance_report(trades.round_trips(actions), curve, cash).first()
    assert report.trade_count == 1 and report.trading_days == 3 and report.final == 1
    assert report.final_equity == pytest.approx(expected[-1])
    assert report.cumulative_return == pytest.approx(expected[-1] / cash - 1)
    assert report.win_rate == 1 and report.profit_factor == float("inf")
    assert report.avg_win_return == pytest.approx(proceeds / cost - 1)
    assert report.avg_loss_return == 0


def test_mixed_trades(spark):
    legs = {"V": (41.0, 52.0, 12_000.0), "W": (230.0, 211.5, 3_000.0)}
    rows = [(day(1), t, "Buy", "", buy, n) for t, (buy, _, n) in legs.items()]
    rows += [(day(2), t, "Sell", "signal", sell, n) for t, (_, sell, n) in legs.items()]
    actions = spark.createDataFrame(rows, ACTIONS)
    costs = {t: paid(buy * n) for t, (buy, _, n) in legs.items()}
    gains = {t: received(sell * n) - costs[t] for t, (_, sell, n) in legs.items()}
    assert gains["V"] > 0 > gains["W"]
    trips = trades.round_trips(actions)
    assert {r.ticker: r.pnl for r in trips.collect()} == pytest.approx(gains)
    stats = metrics.trade_stats(trips).first()
    assert stats.win_rate == 0.5
    assert stats.profit_factor == pytest.approx(gains["V"] / -gains["W"])
    assert stats.avg_loss_return == pytest.approx(gains["W"] / costs["W"])
    prices = bars(spark, [(d, t, 0.0, 1.0, 1.0, 1.0) for d in (1, 2) for t in legs])
    final = metrics.return_stats(trades.mark_equity(actions, prices, 3e6), 3e6).first()
    # All closed: the gain is the sum of the trades' pnl.
    assert final.final_equity == pytest.approx(3e6 + sum(gains.values()))


def test_days_without_a_bar_keep_the_mark(spark, winning):
    _, actions = winning
    prices = bars(spark, [(1, "Q", 0.3, 24.0, 26.0, 25.5), (2, "R", 0.2, 26.0, 29.0, 28.0),
                          (3, "Q", 0.1, 30.0, 33.0, 32.0)])
    held = 400_000.0 - paid(25.0 * 7_000)
    values = [r.equity for r in trades.mark_equity(actions, prices, 400_000.0).orderBy("date").collect()]
    assert values == pytest.approx([held + 25.5 * 7_000, held + 25.5 * 7_000, held + received(32.5 * 7_000)])
    dated = spark.createDataFrame([("Q", day(2), 10.0)], "ticker string, date date, shares double")
    row = trades.mark_to_last_close(dated, prices).first()
    assert (row.mark, row.value) == (25.5, 255.0)


def test_proceeds_settle_next_day(spark):
    actions = spark.createDataFrame(
        [(day(1), "A", "Buy", "", 10.0, 90_000.0), (day(2), "A", "Sell", "rotate", 12.0, 90_000.0),
         (day(3), "B", "Buy", "", 10.0, 50_000.0)],
        ACTIONS,
    )
    days = bars(spark, [(d, "A", 0.0, 1.0, 1.0, 1.0) for d in (1, 2, 3)])
    rows = trades.settle_cash(actions, days, 1e6).orderBy("date").collect()
    bought = 900_000 + 900_000 * 0.001425
    sold = 1_080_000 * (1 - 0.001425 - 0.003)
    left = 1e6 - bought
    assert [r.cash_after for r in rows] == pytest.approx(
        [left, left, left + sold - 500_000 * 1.001425]
    )
    targets = trades.equal_target(actions, days, 1e6, 2).orderBy("date").collect()
    assert [r.target for r in targets] == pytest.approx([5e5, left / 2, (left + sold) / 2])


SCORES = "date date, ticker string, score double"


def test_rotation(spark):
    held = spark.createDataFrame([(day(4), "M", -0.35)], SCORES)
    rival = spark.createDataFrame([(day(4), "N", 0.4)], SCORES)
    row = trades.rotation_pairs(held, rival, 1).first()
    assert (row.held, row.challenger) == ("M", "N")
    assert trades.rotation_pairs(held, rival, 2).count() == 0  # an open slot is left
    close = spark.createDataFrame([(day(4), "M", 0.11)], SCORES)
    near = spark.createDataFrame([(day(4), "N", 0.114)], SCORES)
    assert trades.rotation_pairs(close, near, 1).count() == 0


def test_rotation_stops_at_first_failure(spark):
    held = spark.createDataFrame(
        [(day(2), t, s) for t, s in (("A", 0.1), ("B", 0.3), ("C", None), ("D", 0.9))], SCORES
    )
    rivals = spark.createDataFrame(
        [(day(2), t, s) for t, s in (("X", 0.8), ("Y", 0.305), ("Z", 0.3))], SCORES
    )
    rows = trades.rotation_pairs(held, rivals, 4).collect()
    assert [(r.k, r.held, r.challenger) for r in rows] == [(1, "A", "X")]


def test_score_weights_and_targets(spark):
    df = spark.createDataFrame(
        [(day(1), "A", 1.0), (day(1), "B", 3.0), (day(2), "A", -1.0), (day(2), "B", -2.0)], SCORES
    )
    rows = ranking.score_weights(df).orderBy("date", "ticker").collect()
    assert [r.weight for r in rows] == pytest.approx([0.25, 0.75, 0.5, 0.5])
    targets = ranking.score_targets(df.withColumn("cash", F.lit(100.0)), 1).collect()
    assert {(r.date.day, r.ticker, r.target) for r in targets} == {(1, "B", 100.0), (2, "A", 100.0)}
    booked = df.withColumns({"cash": F.lit(100.0), "held": F.dayofmonth("date")})
    open_slots = ranking.score_targets(booked, 2, held="held").collect()
    assert {(r.date.day, r.ticker, r.target) for r in open_slots} == {(1, "B", 100.0)}


def test_sharpe(spark):
    def sharpe(values):
        df = spark.createDataFrame(
            [(day(i + 1), v) for i, v in enumerate(values)], "date date, equity double"
        )
        return metrics.sharpe(df).first().sharpe

    assert sharpe([100.0, 110.0, 99.0]) == pytest.approx(0, abs=1e-9)
    assert sharpe([100.0]) == 0 and sharpe([100.0, 100.0, 100.0]) == 0
    assert sharpe([100.0, 101.0, 104.0]) > 0


def test_empty_reports(spark):
    empty = spark.createDataFrame([], "pnl double, return_pct double, exit_reason string")
    row = metrics.trade_stats(empty).first()
    assert (row.trade_count, row.win_rate, row.profit_factor, row.avg_win_return) == (0, 0, 0, 0)
    curve = spark.createDataFrame([], "date date, equity double")
    row = metrics.return_stats(curve, 5.0).first()
    assert (row.final_equity, row.annualized_return) == (5.0, 0.0)


def test_hurdle_is_the_round_trip_cost():
    assert trades.rotation_pairs.__defaults__[-1] == pricing.ROUND_TRIP


def test_a_book_sorts_its_rows_once_and_groups_none_by_ticker(spark):
    priced = bars(spark, [(d, "A", 0.1, 10.0, 10.0, 10.0 + d) for d in (1, 2, 3)]).select("ticker", "date", "close")
    orders = spark.createDataFrame(
        [(day(2), "A", "Sell", "", 11.0, 1000.0), (day(2), "A", "Buy", "", 11.0, 2000.0), (day(1), "A", "Buy", "", 11.0, 1000.0),
         (day(4), "B", "Buy", "", 5.0, 1000.0)], ACTIONS)
    days = trades.book_days(orders, priced, 1e6)
    got = {r.date.day: (r.value, r.value_before_buys) for r in days.collect()}
    assert got == {1: (11000.0, 0.0), 2: (24000.0, 0.0), 3: (26000.0, 26000.0), 4: (26000.0, 26000.0)}
    plan = days._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [ticker" not in plan
    physical = days._jdf.queryExecution().sparkPlan().toString()
    before_days = physical[physical.index("HashAggregate"):]
    assert "keys=[ticker" not in before_days


def test_a_book_moves_narrow_rows(spark):
    priced = bars(spark, [(d, "A", 0.1, 10.0, 10.0, c) for d, c in ((2, 12.0), (2, 11.0), (3, 13.0))]).select("ticker", "date", "close")
    orders = spark.createDataFrame(
        [(day(1), "A", "Buy", "", 11.0, 1000.0), (day(3), "A", "Sell", "", 13.0, 1000.0), (day(3), "A", "Buy", "", 13.0, 2000.0)], ACTIONS)
    days = trades.book_days(orders, priced, 1e6)
    # Without a close nothing counts, of two closes the larger does, and a day's buys are not among what was kept.
    got = {r.date.day: (r.value, r.value_before_buys) for r in days.collect()}
    assert got == {1: (0.0, 0.0), 2: (12000.0, 12000.0), 3: (26000.0, 0.0)}

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    moved = [n.output().size() for n in nodes(days._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    assert moved == [5]


def test_a_book_is_shared_by_as_many_tasks_as_told(spark, winning):
    prices, actions = winning
    told = trades.book_days(actions, prices, 4e5, tasks=5)
    assert "RepartitionByExpression [ticker" in (plan := told._jdf.queryExecution().optimizedPlan().toString()) and "], 5" in plan
    assert sorted(told.collect()) == sorted(trades.book_days(actions, prices, 4e5).collect())
