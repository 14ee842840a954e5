"""History queries: scans, filters, adjustment, consolidation, streaming upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import tables as t
from barloom.catalog.registry import query, r, tidy
from barloom.operators import history as ops
from barloom.functions.signals import FEATURES
from barloom.plans.features import consolidate, standardize
from barloom.session import scratch_path
from barloom.sources.history import read_history, write_history
from barloom.sources.panel import store_panel, upsert_panel
from barloom.streaming.bars import by_file_time, compact, read_upserted, stream_adjust, stream_upsert

BAR_SQL = "market, code, date, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("open", "high", "low", "close", "volume")
)
NARROW_SQL = "code, date, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("open", "high", "low", "close", "volume")
)


@query("scan_history", "history", f"SELECT {BAR_SQL} FROM history")
def scan_history(spark, sf):
    path = scratch_path(spark, "scan")
    wide = t.history(spark, sf).withColumns(
        {"open": F.col("open").cast("double"), "extra": F.lit(1)}
    )
    wide.write.parquet(path)
    return tidy(read_history(spark, path))


@query("sink_history", "history", f"SELECT {BAR_SQL} FROM history")
def sink_history(spark, sf):
    return tidy(write_history(t.history(spark, sf), scratch_path(spark, "sink")))


@query("since", "history", f"SELECT {BAR_SQL} FROM history WHERE date >= DATE '{t.CUTOFF}'")
def since(spark, sf):
    return tidy(ops.since(t.history(spark, sf), t.CUTOFF))


@query("until", "history", f"SELECT {BAR_SQL} FROM history WHERE date < DATE '{t.CUTOFF}'")
def until(spark, sf):
    return tidy(ops.until(t.history(spark, sf), t.CUTOFF))


@query(
    "recent",
    "bars",
    f"SELECT {NARROW_SQL} FROM bars WHERE date >= (SELECT max(date) FROM bars) - 365",
)
def recent(spark, sf):
    return tidy(ops.recent(t.bars(spark, sf), 365))


@query(
    "project_bars",
    "bars",
    f"SELECT {NARROW_SQL.replace('code,', 'code AS ticker,', 1)} FROM bars",
)
def project_bars(spark, sf):
    return tidy(ops.project_bars(t.history(spark, sf)))


@query(
    "positive_close",
    "raw_bars",
    f"SELECT code, date, {r('close')} AS close FROM raw_bars WHERE close > 0",
)
def positive_close(spark, sf):
    return tidy(ops.positive_close(t.raw_bars(spark, sf)).select("code", "date", "close"))


@query(
    "adjust_bars",
    "raw_bars",
    "SELECT code, date, "
    + ", ".join(
        f"{r(f'CAST(CAST({c} AS DOUBLE) * (CAST(adjclose AS DOUBLE) / CAST(close AS DOUBLE)) AS FLOAT)', 3)} AS {c}"
        for c in ("open", "high", "low")
    )
    + f", {r('adjclose', 3)} AS close, {r('volume', 3)} AS volume FROM raw_bars"
    " WHERE close IS NOT NULL AND close <> 0 AND adjclose IS NOT NULL",
)
def adjust_bars(spark, sf):
    return tidy(ops.adjust(t.raw_bars(spark, sf)), 3)


@query("canonical_columns", "history", f"SELECT {BAR_SQL} FROM history")
def canonical_columns(spark, sf):
    shuffled = t.history(spark, sf).select(
        "volume", "close", "date", "low", "high", "open", "code", "market"
    )
    return tidy(ops.canonical(shuffled))


@query(
    "append_literals",
    "bars",
    f"SELECT {NARROW_SQL}, 'tse' AS market, '1d' AS \"interval\" FROM bars",
)
def append_literals(spark, sf):
    return tidy(ops.with_literals(t.bars(spark, sf), market="tse", interval="1d"))


@query(
    "drop_null_rows",
    "raw_bars",
    f"SELECT code, date, {r('close')} AS close, {r('adjclose')} AS adjclose FROM raw_bars"
    " WHERE close IS NOT NULL AND adjclose IS NOT NULL",
)
def drop_null_rows(spark, sf):
    kept = ops.drop_null_rows(t.raw_bars(spark, sf), ["close", "adjclose"])
    return tidy(kept.select("code", "date", "close", "adjclose"))


@query(
    "between_dates",
    "bars",
    f"SELECT {NARROW_SQL} FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'",
)
def between_dates(spark, sf):
    return tidy(ops.between(t.bars(spark, sf), "1997-01-01", "1999-12-31"))


@query(
    "finite_ohlc",
    "raw_bars",
    f"SELECT code, date, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low,"
    f" {r('close')} AS close FROM raw_bars WHERE close IS NOT NULL",
)
def finite_ohlc(spark, sf):
    kept = ops.finite_ohlc(t.raw_bars(spark, sf))
    return tidy(kept.select("code", "date", "open", "high", "low", "close"))


@query(
    "route_market",
    "",
    """SELECT code, market, code || '.' || suffix AS symbol FROM (
        SELECT 'S' || s_suppkey AS code,
        CASE WHEN n_regionkey IN (0, 1, 4) THEN 'tse' WHEN n_regionkey = 2 THEN 'otc' END AS market,
        CASE WHEN n_regionkey IN (0, 1, 4) THEN 'TW' WHEN n_regionkey = 2 THEN 'TWO' END AS suffix
        FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE market IS NOT NULL""",
)
def route_market(spark, sf):
    return ops.route_market(listing(spark, sf))


def listing(spark, sf):
    """Listing type of each supplier by its region."""
    kinds = F.get(
        F.array(*[F.lit(k) for k in ("TWSE", "ETF", "OTC", "ESB", "TWSE")]), F.col("n_regionkey")
    )
    nations = t.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    suppliers = t.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), "s_suppkey").alias("code"),
        kinds.alias("type"),
        F.col("s_name").alias("name"),
        "s_nationkey",
    )


@query(
    "freshness_start",
    "history",
    f"""SELECT start, DATE '2001-12-31' AS "end", start <= DATE '2001-12-31' AS pending FROM (
        SELECT coalesce(max(date) + 1, DATE '1990-01-01') AS start FROM history
        WHERE date < DATE '{t.STORED_UNTIL}')""",
)
def freshness_start(spark, sf):
    return ops.next_fetch(t.stored(spark, sf), "1990-01-01", "2001-12-31")


@query("last_date", "bars", "SELECT max(date) AS last_date FROM bars")
def last_date(spark, sf):
    return ops.last_date(t.bars(spark, sf))


@query("date_bounds", "bars", "SELECT min(date) AS first_date, max(date) AS last_date FROM bars")
def date_bounds(spark, sf):
    return ops.date_bounds(t.bars(spark, sf))


@query("universe", "bars", "SELECT DISTINCT code FROM bars")
def universe(spark, sf):
    return ops.universe(t.bars(spark, sf), "code")


@query(
    "split_cutoff",
    "bars",
    """SELECT min(date) AS first_date, max(date) AS last_date, max(date) - 365 AS cutoff
        FROM bars""",
)
def split_cutoff(spark, sf):
    return ops.split_cutoff(t.bars(spark, sf), 365)


@query("union_frames", "frames", f"SELECT {BAR_SQL}, source_seq FROM frames")
def union_frames(spark, sf):
    return tidy(ops.union_frames([t.stored(spark, sf), t.refetched(spark, sf)]))


@query("keep_newest", "newest", f"SELECT {BAR_SQL}, source_seq FROM newest")
def keep_newest(spark, sf):
    frames = ops.union_frames([t.stored(spark, sf), t.refetched(spark, sf)])
    return tidy(ops.keep_newest(frames))


@query("consolidate", "newest", f"SELECT {BAR_SQL} FROM newest")
def consolidated(spark, sf):
    return tidy(consolidate([t.stored(spark, sf), t.refetched(spark, sf)]))


def panel(df):
    """``df`` stored by ticker under a name of its own; returns the name."""
    path = scratch_path(df.sparkSession, "panel")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    store_panel(df, name, path, buckets=16)
    return name


@query("panel_upsert", "newest", f"SELECT {BAR_SQL} FROM newest")
def panel_upsert(spark, sf):
    """The stored part as a panel, with the later fetch merged in."""
    stored = panel(t.stored(spark, sf).withColumn("source_seq", F.lit(0)))
    fresh = t.refetched(spark, sf).withColumn("source_seq", F.lit(1))
    return tidy(upsert_panel(spark, stored, fresh).drop("source_seq"))


@query("panel_features", "std", f"SELECT ticker, date, {r('close_return')} AS close_return, {r('range_cs')} AS range_cs FROM std")
def panel_features(spark, sf):
    """Features from bars that are stored by ticker."""
    std = standardize(spark.table(panel(t.bars(spark, sf))))
    value = lambda name: F.get("feature", F.lit(FEATURES.index(name))).cast("double").alias(name)
    return tidy(std.select("ticker", "date", value("close_return"), value("range_cs")))


@query("stream_upsert", "newest", f"SELECT {BAR_SQL} FROM newest")
def upsert(spark, sf):
    """Two landed files, the later overlapping the earlier, streamed one per micro-batch."""
    landing, log = scratch_path(spark, "landing"), scratch_path(spark, "log")
    checkpoint = scratch_path(spark, "stream")
    schema = None
    for frame in (t.stored(spark, sf), t.refetched(spark, sf)):
        schema = frame.schema
        frame.write.mode("append").parquet(landing)
        stream = by_file_time(spark.readStream.schema(schema).parquet(landing))
        stream_upsert(stream, log, checkpoint).awaitTermination()
    return tidy(read_upserted(spark, log))


@query(
    "stream_adjust",
    "raw_bars markets",
    "SELECT market, code, date, "
    + ", ".join(
        f"{r(f'CAST(CAST({c} AS DOUBLE) * (CAST(adjclose AS DOUBLE) / CAST(close AS DOUBLE)) AS FLOAT)', 3)} AS {c}"
        for c in ("open", "high", "low")
    )
    + f", {r('adjclose', 3)} AS close, {r('volume', 3)} AS volume"
    " FROM raw_bars JOIN markets USING (code) WHERE close IS NOT NULL",
)
def adjust_stream(spark, sf):
    """Landed chart payloads adjusted on the stream and compacted to a history table."""
    from barloom.catalog.payloads import chart_payloads

    landing, log = scratch_path(spark, "charts"), scratch_path(spark, "log")
    payloads = chart_payloads(spark, sf).join(
        t.markets(spark, sf).select("code", "market"), "code"
    )
    payloads.write.parquet(landing)
    stream = by_file_time(spark.readStream.schema(payloads.schema).parquet(landing))
    stream_upsert(
        stream_adjust(stream), log, scratch_path(spark, "stream")
    ).awaitTermination()
    return tidy(compact(spark, log, scratch_path(spark, "history")), 3)
