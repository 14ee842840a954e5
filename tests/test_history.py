import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from barloom.operators import history
from barloom.plans.features import consolidate
from barloom.schemas import BARS
from barloom.session import scratch_path
from barloom.sources.history import read_history, write_history
from barloom.streaming import bars as bars_module
from barloom.streaming.bars import by_file_time, compact, compact_periods, read_upserted, run_id, stream_upsert, upsert_batch
from barloom.streaming.snapshots import expire, snapshot, versions

RAW = "date date, open float, high float, low float, close float, volume float, adjclose float"


@pytest.fixture(scope="module")
def days(spark):
    rows = [(dt.date(2024, 1, i), float(i)) for i in range(1, 6)]
    return spark.createDataFrame(rows, "date date, close double")


def bar(code, day, close, market="tse"):
    return (market, code, day, close, close, close, close, 1000.0)


def test_since_and_until_partition(days):
    early, late = history.until(days, "2024-01-03"), history.since(days, "2024-01-03")
    assert (early.count(), late.count()) == (2, 3)
    assert late.agg(F.min("date")).first()[0] == dt.date(2024, 1, 3)
    assert history.last_date(days).first()[0] == dt.date(2024, 1, 5)
    assert history.recent(days, 2).count() == 3
    assert history.between(days, "2024-01-02", "2024-01-04").count() == 3


def test_next_fetch(days, spark):
    row = history.next_fetch(days, "2020-01-01", "2024-01-05").first()
    assert row.start == dt.date(2024, 1, 6) and not row.pending
    row = history.next_fetch(days.limit(0), "2020-01-01", "2024-01-05").first()
    assert row.start == dt.date(2020, 1, 1) and row.pending


def test_freshness(days, spark):
    last = history.last_date(days)
    for needed, ok in ((5, True), (6, False)):
        prior = spark.createDataFrame([(dt.date(2024, 1, needed),)], "prior date")
        assert history.freshness(last, prior).first().ok is ok
        assert history.freshness(last, prior, allow_stale=True).first().ok


def test_adjust(spark):
    raw = spark.createDataFrame(
        [
            (dt.date(2024, 1, 1), 100.0, 110.0, 90.0, 100.0, 1000.0, 90.0),
            (dt.date(2024, 1, 2), None, 50.0, 40.0, None, 500.0, None),
            (dt.date(2024, 1, 3), 1.0, 1.0, 1.0, 0.0, 1.0, 1.0),
        ],
        RAW,
    )
    rows = history.adjust(raw).collect()
    assert len(rows) == 1 and "adjclose" not in rows[0].asDict()
    row = rows[0]
    assert (row.open, row.high, row.low, row.close, row.volume) == pytest.approx(
        (90.0, 99.0, 81.0, 90.0, 1000.0)
    )


def test_filters_reject_nan(spark):
    rows = [(1.0,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)]
    df = spark.createDataFrame(rows, "close double")
    assert [r.close for r in history.positive_close(df).collect()] == [1.0]
    kept = history.drop_null_rows(df, ["close"])
    assert kept.count() == 5  # NaN is not null


def test_consolidate_keeps_newest(spark):
    d1, d2 = dt.date(2026, 1, 1), dt.date(2026, 1, 2)
    prior = spark.createDataFrame([bar("2330", d1, 100.0)], BARS)
    fresh = spark.createDataFrame([bar("2330", d1, 200.0), bar("2330", d2, 300.0)], BARS)
    rows = consolidate([prior, fresh]).collect()
    assert [(r.date, r.close) for r in rows] == [(d1, 200.0), (d2, 300.0)]


def test_hot_key_collapses(spark):
    """A third of all rows are copies of one key; the newest of them wins."""
    copies = spark.range(20_000).select(
        F.lit("tse").alias("market"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("code"),
        F.lit("2026-01-01").cast("date").alias("date"),
        F.col("id").cast("double").alias("close"),
        F.col("id").alias("source_seq"),
    )
    newest = history.keep_newest(copies)
    assert newest.count() == copies.select("code").distinct().count()
    assert newest.filter("code = 'hot'").first().close == 19_998.0


def test_round_trip_casts_and_pushes_filters(spark):
    path = scratch_path(spark, "history")
    rows = [bar("2330", dt.date(2026, 1, i), float(i)) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, BARS)
    assert write_history(df, path).count() == 3
    read = history.since(read_history(spark, path), "2026-01-02")
    assert read.count() == 2
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan


def land(spark, folder, rows):
    spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(folder)


def upsert(spark, folder, log, state):
    stream = by_file_time(spark.readStream.schema(BARS).parquet(folder))
    stream_upsert(stream, log, state).awaitTermination()


def stored(spark, log, since=None):
    return [(r.code, r.date, r.close) for r in read_upserted(spark, log, since).orderBy("code", "date").collect()]


def test_stream_upsert_replays(spark):
    d1, d2 = dt.date(2026, 1, 1), dt.date(2026, 1, 2)
    landing, log, state = (scratch_path(spark, n) for n in ("landing", "log", "state"))
    land(spark, landing, [bar("2330", d1, 100.0)])
    upsert(spark, landing, log, state)
    fresh = [bar("2330", d1, 80.0), bar("2330", d2, 300.0)]
    land(spark, landing, fresh)
    upsert(spark, landing, log, state)
    assert stored(spark, log) == [("2330", d1, 80.0), ("2330", d2, 300.0)]
    again = spark.createDataFrame(fresh, BARS).withColumn("source_seq", F.lit(1 << 60))
    upsert_batch(again, 1, log, run_id(spark, state))  # the same batch again
    assert stored(spark, log) == [("2330", d1, 80.0), ("2330", d2, 300.0)]
    target = scratch_path(spark, "compact")
    assert compact(spark, log, target).count() == 2


def test_later_file_wins_in_one_batch_and_a_new_checkpoint_keeps_the_log(spark):
    d1, d2 = dt.date(2025, 12, 31), dt.date(2026, 1, 2)
    landing, log = (scratch_path(spark, n) for n in ("landing", "log"))
    land(spark, landing, [bar("A", d1, 5.0), bar("B", d1, 1.0)])
    time.sleep(0.05)
    land(spark, landing, [bar("A", d1, 3.0)])
    upsert(spark, landing, log, scratch_path(spark, "state"))  # both files at once
    assert stored(spark, log) == [("A", d1, 3.0), ("B", d1, 1.0)]
    other = scratch_path(spark, "landing")
    time.sleep(0.05)
    land(spark, other, [bar("C", d2, 7.0), bar("B", d1, 0.5)])
    upsert(spark, other, log, scratch_path(spark, "state"))
    whole = [("A", d1, 3.0), ("B", d1, 0.5), ("C", d2, 7.0)]
    assert stored(spark, log) == whole
    tail = read_upserted(spark, log, since=d2)
    assert [r.code for r in tail.collect()] == ["C"]
    assert all("/period=2026/" in name for name in tail.inputFiles())


def merged(spark, log, batch, n, rows, run="r"):
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in BARS)}, source_seq long"
    upsert_batch(spark.createDataFrame([(*row, n) for row in rows], schema), batch, log, run)


def test_a_batch_rewrites_only_the_years_it_touches(spark):
    log = scratch_path(spark, "log")
    d1, d2, d3 = dt.date(2024, 5, 1), dt.date(2025, 5, 1), dt.date(2026, 5, 1)
    merged(spark, log, 0, 1, [bar("A", d, 1.0) for d in (d1, d2, d3)])
    first = snapshot(spark, log)
    old = read_upserted(spark, log)
    before = set(old.inputFiles())
    merged(spark, log, 1, 2, [bar("A", d2, 2.0), bar("B", d2, 3.0)])
    second = snapshot(spark, log)
    assert {p for p in second.periods if second.periods[p] != first.periods[p]} == {"2025"}
    now = read_upserted(spark, log)
    same = lambda names: {n for n in names if "period=2025" not in n}
    assert same(now.inputFiles()) == same(before) and len(same(before)) == 2
    assert stored(spark, log) == [("A", d1, 1.0), ("A", d2, 2.0), ("A", d3, 1.0), ("B", d2, 3.0)]
    # The frame read before the merge, and its version by number, stay what they were.
    assert sorted(r.close for r in old.collect()) == [1.0] * 3 == sorted(r.close for r in read_upserted(spark, log, version=1).collect())
    plan = now._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "Sort" not in plan


def test_older_copies_and_replayed_batches_change_nothing(spark):
    log, day = scratch_path(spark, "log"), dt.date(2026, 5, 1)
    merged(spark, log, 0, 5, [bar("A", day, 1.0)])
    merged(spark, log, 1, 4, [bar("A", day, 9.0)])  # an older copy in a later batch
    assert stored(spark, log) == [("A", day, 1.0)]
    version = snapshot(spark, log).version
    merged(spark, log, 1, 6, [bar("A", day, 7.0)])  # the batch again, with what must not count
    assert snapshot(spark, log).version == version and stored(spark, log) == [("A", day, 1.0)]
    merged(spark, log, 0, 6, [bar("A", day, 7.0)], run="other")
    assert stored(spark, log) == [("A", day, 7.0)]


def test_writers_that_meet_lose_nothing(spark, monkeypatch):
    log, d1, d2 = scratch_path(spark, "log"), dt.date(2025, 5, 1), dt.date(2026, 5, 1)
    merged(spark, log, 0, 1, [bar("A", d1, 1.0), bar("A", d2, 1.0)])
    write, met = bars_module._write_periods, []

    def slow(rows, path, grain):
        folder = write(rows, path, grain)
        if len(met) in (0, 2):  # another writer commits while this one is about to
            met.append("other")
            merged(spark, log, len(met), 2 + len(met), [bar("A", d2, 2.0 + len(met))], run="other")
        met.append("own")
        return folder

    monkeypatch.setattr(bars_module, "_write_periods", slow)
    merged(spark, log, 1, 2, [bar("A", d1, 2.0), bar("A", d2, 2.0), bar("B", d2, 2.0)])
    assert stored(spark, log) == [("A", d1, 2.0), ("A", d2, 3.0), ("B", d2, 2.0)]
    assert met == ["other", "own", "own", "own"]  # what the other changed was merged again
    del met[2:]
    compact_periods(spark, log, ["2025", "2026"])  # a batch commits while a compaction is under way
    assert stored(spark, log) == [("A", d1, 2.0), ("A", d2, 5.0), ("B", d2, 2.0)]
    assert snapshot(spark, log).applied == {"r": 1, "other": 3}


def test_compaction_and_expiry_keep_the_bars(spark):
    log, d1, d2 = scratch_path(spark, "log"), dt.date(2025, 5, 1), dt.date(2026, 5, 1)
    for n in range(4):
        merged(spark, log, n, n, [bar(f"C{n}", d1, 1.0), bar("A", d2, float(n + 1))])
    whole = stored(spark, log)
    pinned = read_upserted(spark, log)
    compact_periods(spark, log, ["2025", "1999"])
    assert stored(spark, log) == whole and pinned.count() == len(whole)
    expire(spark, log, keep=1)
    assert versions(spark, log) == [5] and stored(spark, log) == whole
    folders = sorted(os.listdir(os.path.join(log.removeprefix("file:"), "data")))
    live = {f.split("/")[1] for f in snapshot(spark, log).periods.values()}
    left = [f for f in folders if any(p.startswith("period=") for p in os.listdir(os.path.join(log.removeprefix("file:"), "data", f)))]
    assert set(left) == live


def test_an_empty_table_reads_as_no_bars(spark):
    log = scratch_path(spark, "log")
    assert read_upserted(spark, log).count() == 0
    merged(spark, log, 0, 1, [])
    assert snapshot(spark, log).version == 1 and read_upserted(spark, log).count() == 0


def test_a_stream_without_an_order_is_refused(spark):
    folder = scratch_path(spark, "landing")
    land(spark, folder, [bar("A", dt.date(2026, 1, 1), 1.0)])
    with pytest.raises(ValueError):
        stream_upsert(spark.readStream.schema(BARS).parquet(folder), scratch_path(spark, "log"), scratch_path(spark, "state"))


def test_route_market(spark):
    df = spark.createDataFrame(
        [("1", "TWSE"), ("2", "ETF"), ("3", "OTC"), ("4", "ESB")], "code string, type string"
    )
    rows = {r.code: (r.market, r.symbol) for r in history.route_market(df).collect()}
    assert rows == {"1": ("tse", "1.TW"), "2": ("tse", "2.TW"), "3": ("otc", "3.TWO")}


def ranges(df):
    return sorted((r.code, r.first.day, r["last"].day, r.sessions) for r in df.collect())


def test_missing_ranges(spark):
    day = lambda n: dt.date(2026, 1, n)
    sessions = spark.createDataFrame([(day(n),) for n in (1, 2, 5, 6, 7, 8, 9, 12, 12)], "date date")
    held = {"A": (1, 2, 5, 6, 7, 8, 9, 12), "B": (2, 2, 7), "C": (3, 4), "X": (1,)}
    bars = spark.createDataFrame([(c, day(n)) for c, ns in held.items() for n in ns], "code string, date date")
    codes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("B",)], "code string")
    whole = history.missing_ranges(bars, codes, sessions, "2026-01-01", "2026-01-12")
    assert ranges(whole) == [("B", 1, 1, 1), ("B", 5, 6, 2), ("B", 8, 12, 3), ("C", 1, 12, 8), ("D", 1, 12, 8)]
    part = history.missing_ranges(bars, codes, sessions, "2026-01-06", "2026-01-08")
    assert ranges(part) == [("B", 6, 6, 1), ("B", 8, 8, 1), ("C", 6, 8, 3), ("D", 6, 8, 3)]
    assert ranges(history.missing_ranges(bars.limit(0), codes, sessions.limit(0), "2026-01-06", "2026-01-08")) == []
    assert ranges(history.missing_ranges(bars, codes.limit(0), sessions, "2026-01-06", "2026-01-08")) == []
