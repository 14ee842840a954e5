"""Skewed groups: a third of the rows or more under one key."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barloom.operators import panel, ranking, trades
from barloom.operators.spread import _sorted_positions, rank_within, running_total
from barloom.session import cut_lineage, scratch


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("date"),
        F.format_string("t%05d", (F.col("id") * 7919) % 6000).alias("ticker"),
        (F.hash("id") % 100 / 10).cast("double").alias("score"),
    ).repartition(7).cache()


def test_ranks_match_a_sort(spark, skewed):
    ranked = ranking.rank_by_score(skewed).collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r.date, []).append(r)
    assert sum(map(len, groups.values())) == 6000 and len(groups["hot"]) == 2000
    for rows in groups.values():
        ordered = sorted(rows, key=lambda r: (-r.score, r.ticker))
        assert [r["rank"] for r in ordered] == list(range(1, len(rows) + 1))


def test_hot_group_spans_slices(spark, skewed):
    """The range sort splits the hot group, and the ranks still come out whole."""
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # the fixture is tiny
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        placed = _sorted_positions(skewed, ["date"], ranking.strongest_first())
        assert placed.filter("date = 'hot'").select("_slice").distinct().count() > 1
        test_ranks_match_a_sort(spark, skewed)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_top_k_is_a_prefix_of_the_ranks(spark, skewed):
    whole = ranking.rank_by_score(skewed).filter("rank <= 5")
    assert sorted(whole.collect()) == sorted(ranking.rank_by_score(skewed, k=5).collect())
    df = ranking.rank_by_score(skewed, k=5)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_overall_top_k(spark, skewed):
    rows = ranking.top_k(skewed, 5.0, 7).collect()
    best = sorted(skewed.filter("score > 5").collect(), key=lambda r: (-r.score, r.ticker))[:7]
    assert [(r["rank"], r.ticker) for r in rows] == [(i + 1, r.ticker) for i, r in enumerate(best)]


def test_nan_and_null_scores_have_no_rank(spark):
    df = spark.createDataFrame(
        [("d", "a", 1.0), ("d", "b", float("nan")), ("d", "c", None)],
        "date string, ticker string, score double",
    )
    assert [r.ticker for r in ranking.rank_by_score(df).collect()] == ["a"]
    assert [r.ticker for r in ranking.above(df, 0.0).collect()] == ["a"]


def test_running_total_matches_a_loop(spark, skewed):
    for by in ([], ["date"]):
        out = running_total(skewed, by, [F.asc("ticker")], "score", "total").collect()
        assert len(out) == 6000
        sums = {}
        for r in sorted(out, key=lambda r: r.ticker):
            key = r.date if by else None
            sums[key] = sums.get(key, 0.0) + r.score
            assert r.total == pytest.approx(sums[key], abs=1e-6)


def test_empty_input(spark, skewed):
    assert rank_within(skewed.limit(0), ["date"], [F.asc("ticker")], "n").count() == 0


def test_scratch_goes_with_its_block(spark):
    with scratch(spark):
        cut = cut_lineage(spark.range(3))
        (folder,) = {os.path.dirname(f.removeprefix("file://")) for f in cut.inputFiles()}
        assert cut.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def hot_bars(spark, n=4000, hot=3):
    """Bars of one ticker with a third of the rows or more, and of many others; some prices are missing."""
    ids = spark.range(n)
    ticker = F.when(F.col("id") % hot == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 40))
    return ids.select(
        ticker.alias("ticker"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        *[F.when(F.hash("id", F.lit(c)) % 11 != 0, F.pmod(F.hash("id", F.lit(c)), F.lit(900)) / 10.0 + 10).cast("float").alias(c)
          for c in ("high", "low", "close", "score")],
    ).repartition(5)


@pytest.mark.parametrize("rows", [25, 26, 100, 65_536])
def test_blocks_frame_like_whole_tickers(spark, rows):
    df = hot_bars(spark)
    for frames, before, after in (
        (lambda d, e: panel.forward_mfe(d, 25, e), 0, 25),
        (lambda d, e: panel.prev(d, ["close"], e), 1, 0),
        (lambda d, e: panel.next_low(panel.prev(d, ["high"], e), e), 1, 1),
        (lambda d, e: panel.lag_scored(d, e), 1, 0),
    ):
        whole = frames(df, "ticker")
        split = panel.in_blocks(df, frames, before, after, rows=rows)
        assert split.columns == whole.columns
        key = lambda r: (r.ticker, r.date)
        assert sorted(split.collect(), key=key) == sorted(whole.collect(), key=key)
    with pytest.raises(ValueError):
        panel.in_blocks(df, lambda d, e: d, before=30, rows=25)


def test_a_hot_ticker_fills_all_blocks(spark):
    seen = panel.in_blocks(
        hot_bars(spark), lambda d, e: d.withColumn("place", F.col("_block")), before=1, rows=100
    )
    blocks = seen.filter("ticker = 'hot'").groupBy("place").count().collect()
    assert len(blocks) == 14 and max(r["count"] for r in blocks) == 100


def test_last_value_is_carried_over_slices(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        # The hot ticker has a price on its first day only, so that whole slices have none.
        bars = hot_bars(spark).withColumn(
            "close", F.when((F.col("ticker") != "hot") | (F.col("date") == "2000-01-01"), F.col("close"))
        )
        positions = bars.select("ticker", F.date_add("date", 1).alias("date"), F.lit(2.0).alias("shares"), F.lit("p").alias("note"))
        rows = [("none", dt.date(2001, 1, 1), 1.0, None), ("hot", dt.date(1999, 1, 1), 1.0, None)]
        early = spark.createDataFrame(rows, "ticker string, date date, shares double, note string")
        positions = cut_lineage(positions.unionByName(positions.filter("date < '2000-01-09'")).unionByName(early))
        got = trades.mark_to_last_close(positions, bars)
        assert got.columns == ["ticker", "date", "shares", "note", "mark", "value"]
        known = {}
        for r in bars.orderBy("ticker", "date").collect():
            if r.close is not None:
                known.setdefault(r.ticker, []).append((r.date, r.close))
        wanted = []
        for r in positions.collect():
            marks = [close for day, close in known.get(r.ticker, []) if day <= r.date]
            wanted.append((r.ticker, r.date, marks[-1] if marks else None))
        assert sorted(map(repr, wanted)) == sorted(repr((r.ticker, r.date, r.mark)) for r in got.collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_ranks_are_longs(spark, skewed):
    assert dict(ranking.rank_latest(skewed).dtypes)["rank"] == "bigint"
