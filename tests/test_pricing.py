import random

import pytest
from pyspark.sql import functions as F

from barloom.catalog.registry import rounded
from barloom.functions import pricing


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [row[0] for row in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_tick_rounding(spark):
    floors = column(spark, [8.256, 34.271, 499.831, 1456.256], pricing.tick_floor)
    assert floors == pytest.approx([8.25, 34.25, 499.5, 1455.0], abs=1e-9)
    ceils = column(spark, [3.765, 66.256, 499.831, 1456.256], pricing.tick_ceil)
    assert ceils == pytest.approx([3.77, 66.3, 500.0, 1460.0], abs=1e-9)


def test_prices_that_are_not_finite_have_no_tick(spark):
    odd = [float("nan"), float("inf"), -float("inf"), None]
    assert column(spark, odd, pricing.tick_floor) == [None] * 4
    assert column(spark, odd, pricing.tick_ceil) == [None] * 4


def test_comparison_tells_odd_values_apart(spark):
    got = column(spark, [float("nan"), float("inf"), -float("inf"), 0.0, None], lambda v: rounded(v, 4))
    assert got[0] != got[0] and got[1:] == [float("inf"), -float("inf"), 0.0, None]


def test_legal_prices_stay(spark):
    legal = [9.99, 10.05, 49.95, 50.1, 99.9, 100.5, 500.0, 999.0, 1005.0]
    assert column(spark, legal, pricing.tick_floor) == pytest.approx(legal, abs=1e-9)
    assert column(spark, legal, pricing.tick_ceil) == pytest.approx(legal, abs=1e-9)


def test_costs(spark):
    assert column(spark, [500_000.0], pricing.gross_cost) == pytest.approx([500_712.5])
    assert column(spark, [1_000_000.0], pricing.net_proceeds) == pytest.approx([995_575.0])
    assert column(spark, [1_000.0], pricing.commission) == [20.0]
    assert pricing.ROUND_TRIP == pytest.approx(0.00585)


def brute_shares(budget, price, cash):
    lots = 0
    best = 0
    while (lots + 1) * 1000 * price <= budget:
        lots += 1
    for n in range(lots, 0, -1):
        amount = n * 1000 * price
        if amount + max(amount * 0.001425, 20) <= cash:
            best = n
            break
    return best * 1000.0


def test_affordable_shares_matches_brute_force(spark):
    draw = random.Random(3)
    cases = [(100_000.0, 10.0, 100_000.0), (5.0, 10.0, 5.0), (0.0, 10.0, 0.0)]
    for _ in range(3000):
        price = round(draw.uniform(0.5, 300), 2)
        budget = round(draw.uniform(0, 2_000_000), 2)
        cases.append((budget, price, round(budget * draw.uniform(0.9, 1.1), 2)))
    df = spark.createDataFrame(cases, "budget double, price double, cash double")
    shares = pricing.affordable_shares(F.col("budget"), F.col("price"), F.col("cash"))
    for row in df.withColumn("shares", shares).collect():
        assert row.shares == brute_shares(row.budget, row.price, row.cash), row
