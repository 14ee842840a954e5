import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from barloom.operators import history, ranking, windows

EPOCH = dt.date(1970, 1, 1)


def synthetic(spark, tickers, rows):
    data = [
        (f"t{t}", EPOCH + dt.timedelta(days=i), [float(1000 * t + i)] * 12, float(i))
        for t in range(tickers)
        for i in range(rows)
    ]
    return spark.createDataFrame(
        data, "ticker string, date date, feature array<float>, label double"
    )


def first_channel(row):
    return [step[0] for step in row.window]


def test_all_windows(spark):
    df = synthetic(spark, 2, 6)
    assert windows.windows(df, 4).count() == 6
    assert {r.windows for r in windows.window_counts(df, 4).collect()} == {3}
    assert {r.windows for r in windows.window_counts(df, 9).collect()} == {0}


def test_window_values_and_targets(spark):
    rows = windows.window_target(synthetic(spark, 2, 10), 4).orderBy("ticker", "date").collect()
    assert first_channel(rows[0]) == [0, 1, 2, 3] and rows[0].target == 3
    assert first_channel(rows[8]) == [1001, 1002, 1003, 1004] and rows[8].target == 4


def test_latest_windows(spark):
    rows = windows.latest_windows(synthetic(spark, 3, 8), 4).orderBy("ticker").collect()
    assert len(rows) == 3
    assert first_channel(rows[0]) == [4, 5, 6, 7] and rows[0].date == dt.date(1970, 1, 8)
    assert windows.latest_windows(synthetic(spark, 3, 3), 4).count() == 0


def test_windows_since_reach_back(spark):
    rows = windows.windows_since(synthetic(spark, 1, 10), 4, "1970-01-06").orderBy("date").collect()
    assert len(rows) == 5 and first_channel(rows[0]) == [2, 3, 4, 5]


def test_split(spark):
    df = synthetic(spark, 3, 20)
    train, valid = windows.split(df, "1970-01-11", 4)
    assert (train.count(), valid.count()) == (30, 30)
    assert train.agg(F.max("date")).first()[0] == dt.date(1970, 1, 10)
    assert valid.agg(F.min("date")).first()[0] == dt.date(1970, 1, 11)
    assert history.date_bounds(df).first() == (dt.date(1970, 1, 1), dt.date(1970, 1, 20))
    with pytest.raises(ValueError):
        windows.split(df, "1970-01-03", 4)


def test_samples_repeat(spark):
    df = synthetic(spark, 12, 30)
    one, two = (sorted(ranking.sample_windows(df, 50, 7).select("ticker", "date").collect())
                for _ in range(2))
    assert one == two and len(one) == 50
    other = sorted(ranking.sample_windows(df, 50, 8).select("ticker", "date").collect())
    assert other != one
    assert ranking.sample_tickers(df, 3, 1).select("ticker").distinct().count() == 3
    assert ranking.sample_tickers(df, 99, 1).count() == df.count()


def smallest(keys, n, seed):
    draw = lambda key: hashlib.md5("|".join([*map(str, key), str(seed)]).encode()).hexdigest()
    return sorted(sorted(keys, key=lambda key: (draw(key), key))[:n])


@pytest.mark.parametrize(("digits", "few"), [(4, 10_000), (1, 3), (1, 0)])
def test_a_sample_is_the_smallest_draws(spark, monkeypatch, digits, few):
    monkeypatch.setattr(ranking, "DIGITS", digits)  # few digits and rows, so that bins are refined
    monkeypatch.setattr(ranking, "FEW", few)
    df = synthetic(spark, 6, 30)
    keys = [(r.ticker, r.date) for r in df.collect()]
    for n in (1, 40, 179, 180, 999):
        got = sorted((r.ticker, r.date) for r in ranking.sample_windows(df, n, 7).collect())
        assert got == smallest(keys, n, 7)
    tickers = {(f"t{t}",) for t in range(6)}
    got = {(r.ticker,) for r in ranking.sample_tickers(df, 2, 3).collect()}
    assert sorted(got) == smallest(tickers, 2, 3)
    assert ranking.sample_windows(df, 0, 7).count() == 0 == ranking.sample_windows(df.limit(0), 5, 7).count()


def test_samples_sort_nothing(spark):
    plan = ranking.sample_windows(synthetic(spark, 6, 30), 40, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Join" not in plan


def test_copies_of_a_key_are_drawn_together(spark):
    df = synthetic(spark, 1, 3)
    copies = df.unionByName(df).unionByName(df)
    got = sorted((r.ticker, r.date) for r in ranking.sample_windows(copies, 4, 7).collect())
    keys = sorted({(r.ticker, r.date) for r in df.collect()})
    assert got == sorted(smallest(keys, 2, 7) * 3)


def test_split_check_says_what_split_demands(spark):
    df = synthetic(spark, 3, 20)
    assert windows.split_check(df, "1970-01-11", 4).first() == (21, 21, True)
    assert windows.split_check(df, "1970-01-03", 4).first() == (0, 45, False)
    assert windows.split_check(df.limit(0), "1970-01-03", 4).first() == (0, 0, False)
