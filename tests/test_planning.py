import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, orders
from barloom.plans import orders as plans

QUOTES = "symbol string, open_price double, high_price double, low_price double, last_price double"
WANTED = "account string, ticker string, rank int"


@pytest.fixture(scope="module")
def quotes(spark):
    return spark.createDataFrame(
        [("A", 10.0, 20.03, 9.0, None), ("B", 10.0, None, None, None), ("C", None, 5.0, 5.0, 5.0)],
        QUOTES,
    )


def test_usable_quotes(quotes):
    bar = orders.quote_bar(quotes).collect()
    assert [(r.symbol, r.close) for r in bar] == [("A", 10.0)]
    entries = {r.symbol: r.entry for r in orders.entry_quote(quotes).collect()}
    assert entries == {"A": 9.0, "B": 10.0, "C": 5.0}
    assert metrics.quote_coverage(quotes).first() == (3, 2)


def test_plan_sells(spark, quotes):
    held = spark.createDataFrame([("A", 50), ("B", 1), ("X", 1)], "stock_code_id string, shares long")
    row, = plans.plan_sells(held, quotes).collect()
    assert (row.code, row.lots, row.price) == ("A", 50, 20.0)
    assert row.proceeds == pytest.approx(995_575.0)


def slow_buys(names, budget, slots):
    left, out = budget, []
    for code, price in names:
        aim = min(budget / max(slots, 1), left)
        lots = int(aim // (price * 1000))
        while lots and lots * 1000 * price + max(lots * price * 1.425, 20) > left:
            lots -= 1
        if lots:
            cost = lots * 1000 * price + max(lots * price * 1.425, 20)
            left -= cost
            out.append((code, lots, round(cost, 4)))
    return out


@pytest.mark.parametrize("slots", [0, 1, 2, 3])
def test_plan_buys_draws_down(spark, slots):
    prices = [("D", 30.0), ("E", 8.0), ("F", 9.5), ("G", 49.95)]
    quoted = spark.createDataFrame([(c, p, p, p, p) for c, p in prices], QUOTES)
    wanted = spark.createDataFrame(
        [(a, c, i + 1) for a in ("x", "y") for i, (c, _) in enumerate(prices)], WANTED
    )
    plan = plans.plan_buys(wanted, quoted, F.lit(100_000.0), slots).collect()
    expected = slow_buys(prices, 100_000.0, slots)
    for account in ("x", "y"):
        got = [(r.code, r.lots, round(r.cost, 4)) for r in plan if r.account == account]
        assert sorted(got) == sorted(expected)
    assert expected


def test_a_long_list_streams_to_its_end(spark):
    n = 200_000
    names = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "y").otherwise("x").alias("account"),
        F.format_string("C%07d", "id").alias("ticker"), (F.col("id") + 1).cast("int").alias("rank"),
    )
    # Only the last name of each list is cheap enough.
    price = F.when(F.col("rank") > n - 3, 8.0).otherwise(9_000.0)
    quoted = names.select(F.col("ticker").alias("symbol"), *[price.alias(f"{c}_price") for c in ("open", "high", "low", "last")])
    plan = plans.plan_buys(names, quoted, F.lit(20_000.0), 1).collect()
    assert sorted((r.account, r.code, r.lots) for r in plan) == [("x", f"C{n - 3:07d}", 2), ("y", f"C{n - 2:07d}", 2)]


def test_prices_and_accounts_of_any_kind(spark):
    quoted = spark.createDataFrame([("A", 10.0, 10.0, 10.0, 10.0), ("B", 0.0, 0.0, 0.0, 0.0), ("C", *[float("nan")] * 4)], QUOTES)
    wanted = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "C", 3), (2, "B", 1), (3, "X", 1)], "account long, ticker string, rank int")
    plan = plans.plan_buys(wanted, quoted, F.when(F.col("account") == 1, 50_000.0).otherwise(1.0), 1)
    assert [(r.account, r.code, r.lots) for r in plan.collect()] == [(1, "A", 4)]
    assert plans.plan_buys(wanted.limit(0), quoted, F.lit(1.0), 1).count() == 0


def test_totals_and_symbols(spark, quotes):
    held = spark.createDataFrame([("A", 50), ("B", 1)], "stock_code_id string, shares long")
    wanted = spark.createDataFrame([("x", "A", 1), ("x", "C", 2)], WANTED)
    symbols = orders.symbols_to_quote(held, wanted).collect()
    assert sorted(r.symbol for r in symbols) == ["A", "B", "C"]
    sells = plans.plan_sells(held, quotes)
    buys = plans.plan_buys(wanted, quotes, F.lit(100_000.0), 2)
    row = metrics.plan_totals(sells, buys).first()
    assert (row.sells, row.buys) == (1, 2) and row.proceeds == pytest.approx(995_575.0)
    nothing = metrics.plan_totals(sells.limit(0), buys.limit(0)).first()
    assert tuple(nothing) == (0, 0.0, 0, 0.0)
