import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import signals
from barloom.operators import panel
from barloom.plans.features import label_rank, raw_signals, standardize


def test_zscore_both_ways(spark):
    rows = [(d, str(i), v) for d, vs in ((1, (4.0, 7.5, 11.0)), (2, (-6.0, -5.75, -5.5)))
            for i, v in enumerate(vs)]
    df = spark.createDataFrame(
        [(dt.date(2026, 1, d), t, v) for d, t, v in rows], "date date, ticker string, x double"
    )
    for how in ("aggregate", "window"):
        out = panel.zscore_by(df, ["x"], how=how).orderBy("date", "ticker").collect()
        assert [r.x_cs for r in out] == pytest.approx([-1, 0, 1, -1, 0, 1], abs=1e-6)


def test_single_ticker_date_has_no_zscore(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), "a", 1.0)], "date date, ticker string, x double")
    assert panel.zscore_by(df, ["x"]).first().x_cs is None


def panel_bars(spark, values, start=dt.date(2026, 1, 1)):
    rows = [
        (code, start + dt.timedelta(days=i), *v) for code, vs in values.items()
        for i, v in enumerate(vs)
    ]
    return spark.createDataFrame(
        rows, "code string, date date, open float, high float, low float, close float, volume float"
    )


def test_standardize_drops_first_rows_but_counts_their_range(spark):
    a = [(10, 12, 9, 11, 0), (11, 13, 10, 12, 0), (12, 14, 11, 13, 5)]
    b = [(20, 22, 19, 21, 7), (21, 28, 20, 22, 8), (22, 24, 21, 23, 9)]
    c = [(30, 40, 29, 31, 1)]
    to_floats = lambda rows: [tuple(map(float, r)) for r in rows]
    early = panel_bars(spark, {"a": to_floats(a), "b": to_floats(b)})
    late = panel_bars(spark, {"c": to_floats(c)}, dt.date(2026, 1, 2))
    out = standardize(early.union(late)).orderBy("date", "ticker").collect()
    assert [(r.ticker, r.date.day) for r in out] == [("a", 2), ("b", 2), ("a", 3), ("b", 3)]
    first = out[0]
    assert len(first.feature) == 12
    assert first.feature[0] == pytest.approx(math.log(11 / 11), abs=1e-6)
    assert first.feature[4] == pytest.approx(0.0)  # no volume on either day
    # The newcomer has no return but its range is part of the day's statistics.
    ranges = [math.log(13 / 10), math.log(28 / 20), math.log(40 / 29)]
    mean = sum(ranges) / 3
    std = math.sqrt(sum((x - mean) ** 2 for x in ranges) / 2)
    assert first.feature[11] == pytest.approx((ranges[0] - mean) / (std + 1e-8), rel=1e-5)


def test_bad_price_nulls_only_its_own_signals(spark):
    good = [(10.0, 12.0, 9.0, 11.0, 1.0)] * 2
    bad = [(10.0, 12.0, 9.0, 11.0, 1.0), (float("nan"), 12.0, 0.0, 11.0, 1.0)]
    rows = raw_signals(panel_bars(spark, {"a": good, "b": bad})).filter("date = '2026-01-02'")
    got = {r.ticker: r for r in rows.collect()}
    assert got["b"].open_return is None and got["b"].range is None
    assert got["a"].open_return is not None and got["b"].close_return == 0.0


def test_forward_mfe(spark):
    values = [(10.0, 10.0), (11.0, 10.0), (13.0, 11.0), (12.0, 11.0)]
    rows = [("t", dt.date(2026, 1, i + 1), h, low) for i, (h, low) in enumerate(values)]
    df = spark.createDataFrame(rows, "ticker string, date date, high float, low float")
    out = [r.raw_mfe for r in panel.forward_mfe(df, 2).orderBy("date").collect()]
    assert out[:2] == pytest.approx([0.3, 13 / 11 - 1], abs=1e-6) and out[2:] == [None, None]
    with pytest.raises(ValueError):
        panel.forward_peak(df, 0)


def test_label_rank_is_centred(spark):
    highs = {"a": 11.0, "b": 14.0}
    rows = [
        (t, dt.date(2026, 1, i), [0.0] * 12, 10.0, h, 9.0, 10.0)
        for t, h in highs.items() for i in range(1, 5)
    ]
    std = spark.createDataFrame(
        rows,
        "ticker string, date date, feature array<float>, open float, high float, low float, close float",
    )
    out = label_rank(std, 2).orderBy("date", "ticker").collect()
    assert len(out) == 4 and "raw_mfe" not in out[0].asDict()
    assert [r.label for r in out[:2]] == pytest.approx([-0.70711, 0.70711], abs=1e-4)


def test_day_index_skips_gaps(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2026, 1, 1)), ("b", dt.date(2026, 1, 9)), ("a", dt.date(2026, 1, 9))],
        "ticker string, date date",
    )
    assert {(r.date.day, r.day) for r in panel.with_day_index(df).collect()} == {(1, 0), (9, 1)}


def test_lag_signal_uses_previous_row(spark):
    d = [dt.date(2026, 1, i) for i in (1, 5, 9)]
    bars = spark.createDataFrame(
        [("a", x, 1.0, 1.0, 1.0, 1.0) for x in d] + [("b", d[2], 1.0, 1.0, 1.0, 1.0)],
        "ticker string, date date, open double, low double, high double, close double",
    )
    scores = spark.createDataFrame([("a", d[0], 0.5)], "ticker string, date date, score double")
    rows = panel.lag_signal(bars, scores).collect()
    assert [(r.ticker, r.date, r.score) for r in rows] == [("a", d[1], 0.5)]


def test_one_shuffle_of_rows(spark):
    """Label features need one data shuffle; the rest of the exchanges carry per-date rows."""
    from barloom.catalog import tables

    df = tables.labelled(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1


def test_correlation_flat_and_exact(spark):
    def ic(pairs):
        df = spark.createDataFrame(pairs, "s double, t double")
        return df.agg(signals.correlation(F.col("s"), F.col("t"))).first()[0]

    up = [1.0, 2.0, 3.0, 4.0]
    assert ic([(x, 2 * x) for x in up]) == pytest.approx(1.0, abs=1e-4)
    assert ic(list(zip(up, reversed(up)))) == pytest.approx(-1.0, abs=1e-4)
    assert ic([(1.0, x) for x in up]) == 0.0


def test_features_are_rounded_in_one_place(spark):
    from barloom.catalog import QUERIES

    for name in ("standardize", "feature_array"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("floor(") <= 2
        assert dict(df.dtypes)["close_return_cs"] == "double"
