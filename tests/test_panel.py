"""Bars stored by ticker: plans without a shuffle of stored rows, and the same results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import history
from barloom.plans.features import label_rank, standardize
from barloom.session import scratch_path
from barloom.sources.panel import SORTED_BUCKETS, panel_buckets, store_panel, upsert_panel

EPOCH = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    ids = spark.range(3000)
    price = lambda salt: (F.pmod(F.hash("id", F.lit(salt)), F.lit(500)) / 10.0 + 10).cast("float")
    return ids.select(
        F.lit("tse").alias("market"), F.concat(F.lit("C"), F.col("id") % 25).alias("code"),
        F.date_add(F.lit(EPOCH), (F.col("id") / 25).cast("int")).alias("date"),
        price(1).alias("open"), (price(2) + 60).cast("float").alias("high"), price(3).alias("low"), price(4).alias("close"),
        price(5).alias("volume"), F.lit(0).cast("long").alias("source_seq"),
    ).repartition(3)


@pytest.fixture
def plans(spark):
    settings = {"spark.sql.adaptive.enabled": "false", SORTED_BUCKETS: "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for key, value in before.items():
        spark.conf.set(key, value)


def stored(df, buckets=4):
    path = scratch_path(df.sparkSession, "panel")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    return name, store_panel(df, name, path, buckets)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_features_move_no_stored_row(spark, bars, plans):
    name, panel = stored(bars)
    assert panel_buckets(spark, name) == 4 and len(panel.inputFiles()) == 4
    std = standardize(panel)
    lines = plans(std).splitlines()
    # What is dealt out is one row per date and task, for the date's statistics.
    assert [line for line in lines if "Exchange hashpartitioning" in line] == [line for line in lines if "Exchange hashpartitioning(date" in line]
    assert not any("Sort [" in line for line in lines)
    assert rows(std.drop("feature")) == rows(standardize(bars).drop("feature"))
    labels = plans(label_rank(std, 5))
    assert "Exchange hashpartitioning(ticker" not in labels and "Exchange hashpartitioning(code" not in labels
    # Sums over a date may add up in another order.
    near = lambda df: {(r.ticker, r.date): pytest.approx(r.label, abs=1e-9) for r in df.collect()}
    assert near(label_rank(std, 5)) == {(r.ticker, r.date): r.label for r in label_rank(standardize(bars), 5).collect()}


def test_upserts_move_only_what_is_new(spark, bars, plans):
    name, _ = stored(bars)
    late = bars.filter(F.col("date") >= EPOCH + dt.timedelta(days=100))
    fresh = late.withColumns({"close": (F.col("close") * 2).cast("float"), "source_seq": F.lit(2).cast("long")})
    fresh = fresh.unionByName(late.withColumn("source_seq", F.lit(1).cast("long")))
    fresh = fresh.unionByName(fresh.limit(1).withColumn("code", F.lit("NEW")))
    merged = upsert_panel(spark, name, fresh)
    wanted = history.keep_newest(bars.unionByName(fresh))
    assert rows(merged) == rows(wanted) and merged.filter("code = 'NEW'").count() == 1
    plan = plans(merged)
    above = plan[: plan.index("Union")]
    assert "Exchange" not in above and plan.index("FileScan parquet") < plan.index("Exchange")
    again, panel = stored(merged)
    assert rows(panel) == rows(merged)
    older = upsert_panel(spark, again, late.withColumn("source_seq", F.lit(1).cast("long")))
    assert rows(older) == rows(merged)


def test_small_and_wrong_panels(spark, bars):
    name, panel = stored(bars.limit(0), 2)
    assert panel.count() == 0 and rows(upsert_panel(spark, name, bars)) == rows(bars)
    with pytest.raises(ValueError):
        store_panel(bars, "nothing", scratch_path(spark, "panel"), 0)
    bars.limit(1).createOrReplaceTempView("plain_bars")
    with pytest.raises(ValueError):
        panel_buckets(spark, "plain_bars")
