"""Feature, label, window and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import tables as t
from barloom.catalog.registry import query, r, rounded, tidy
from barloom.functions import signals
from barloom.operators import panel, ranking, windows
from barloom.session import cut_lineage
from barloom.plans.features import label_rank, labelled_only, raw_signals
from barloom.schemas import PRICES

SIGNAL_SQL = ", ".join(f"{r(c, 6)} AS {c}" for c in signals.BASE_SIGNALS)
ZSCORE_SQL = ", ".join(f"{r(c + '_cs')} AS {c}_cs" for c in signals.BASE_SIGNALS)
PRICE_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PRICES)
FEATURE_SQL = ", ".join(f"{r(c)} AS {c}" for c in signals.FEATURES)


def spread_features(df):
    """The packed features as one column each."""
    items = [F.get("feature", F.lit(i)).alias(n) for i, n in enumerate(signals.FEATURES)]
    return df.select(*[c for c in df.columns if c != "feature"], *items)


def rounded_features(df):
    """The packed features rounded in place: rounded column by column, each would repeat its definition in code that
    grows too long to be compiled."""
    return df.withColumn("feature", F.transform("feature", lambda value: rounded(value, 4)))


@query(
    "prev_close_volume",
    "sig",
    f"SELECT ticker, date, {r('pc')} AS prev_close, {r('pv')} AS prev_volume FROM sig",
)
def prev_close_volume(spark, sf):
    df = panel.prev(t.ticker_bars(spark, sf), ["close", "volume"])
    return tidy(df.select("ticker", "date", "prev_close", "prev_volume"))


@query(
    "next_low",
    "bars",
    f"SELECT code AS ticker, date, {r('lead(low) OVER (PARTITION BY code ORDER BY date)')}"
    " AS next_low FROM bars",
)
def next_low(spark, sf):
    return tidy(panel.next_low(t.ticker_bars(spark, sf)).select("ticker", "date", "next_low"))


@query(
    "forward_peak",
    "bars",
    f"""SELECT code AS ticker, date, {r(f"CASE WHEN count(high) OVER f = {t.HORIZON} THEN max(high) OVER f END")}
        AS forward_peak FROM bars WINDOW f AS (PARTITION BY code ORDER BY date
        ROWS BETWEEN 1 FOLLOWING AND {t.HORIZON} FOLLOWING)""",
)
def forward_peak(spark, sf):
    df = panel.forward_peak(t.ticker_bars(spark, sf), t.HORIZON)
    return tidy(df.select("ticker", "date", "forward_peak"))


@query("forward_mfe", "mfe", f"SELECT ticker, date, {r('raw_mfe')} AS raw_mfe FROM mfe")
def forward_mfe(spark, sf):
    df = panel.forward_mfe(t.std(spark, sf), t.HORIZON)
    return tidy(df.select("ticker", "date", "raw_mfe"))


@query("forward_mfe_blocks", "mfe", f"SELECT ticker, date, {r('raw_mfe')} AS raw_mfe FROM mfe")
def forward_mfe_blocks(spark, sf):
    """The same with each ticker's rows dealt out in blocks, as for tickers that no task can hold."""
    frames = lambda df, entity: panel.forward_mfe(df, t.HORIZON, entity)
    df = panel.in_blocks(t.std(spark, sf).drop("feature"), frames, after=t.HORIZON, rows=256)
    return tidy(df.select("ticker", "date", "raw_mfe"))


@query("zscore_by_date", "z", f"SELECT ticker, date, {ZSCORE_SQL} FROM z")
def zscore_by_date(spark, sf):
    df = panel.zscore_by(raw_signals(t.bars(spark, sf)), signals.BASE_SIGNALS)
    return tidy(df.select("ticker", "date", *[f"{c}_cs" for c in signals.BASE_SIGNALS]))


@query(
    "price_returns",
    "sig",
    "SELECT ticker, date, "
    + ", ".join(f"{r(c, 6)} AS {c}" for c in signals.BASE_SIGNALS[:4])
    + " FROM sig",
)
def price_returns(spark, sf):
    df = panel.prev(t.ticker_bars(spark, sf), ["close"]).withColumns(signals.price_returns())
    return tidy(df.select("ticker", "date", *signals.BASE_SIGNALS[:4]), 6)


@query(
    "volume_return",
    "sig",
    f"SELECT ticker, date, {r('volume_return', 6)} AS volume_return FROM sig",
)
def volume_return(spark, sf):
    df = panel.prev(t.ticker_bars(spark, sf), ["volume"])
    return tidy(df.select("ticker", "date", signals.volume_return().alias("volume_return")), 6)


@query("range_signal", "bars", f"""SELECT code AS ticker, date,
    {r('ln(CAST(high AS DOUBLE) / CAST(low AS DOUBLE))', 6)} AS "range" FROM bars""")
def range_signal(spark, sf):
    df = t.ticker_bars(spark, sf)
    return tidy(df.select("ticker", "date", signals.range_signal().alias("range")), 6)


@query("feature_array", "std", f"SELECT ticker, date, 12 AS width, {FEATURE_SQL} FROM std")
def feature_array(spark, sf):
    df = t.std(spark, sf).select("ticker", "date", "feature", F.size("feature").alias("width"))
    return spread_features(rounded_features(df))


@query(
    "standardize",
    "std",
    f"SELECT ticker, date, {PRICE_SQL}, {FEATURE_SQL} FROM std",
)
def standardized(spark, sf):
    return spread_features(tidy(rounded_features(t.std(spark, sf)), **dict.fromkeys(PRICES)))


@query(
    "labelled_only",
    "mfe",
    f"""SELECT ticker, date, {r('raw_mfe')} AS label FROM mfe WHERE raw_mfe IS NOT NULL""",
)
def only_labelled(spark, sf):
    raw = panel.forward_mfe(t.std(spark, sf), t.HORIZON).withColumn("label", F.col("raw_mfe"))
    return tidy(labelled_only(raw).select("ticker", "date", "label"))


@query(
    "label_rank", "lab", f"SELECT ticker, date, {r('close')} AS close, {r('label')} AS label FROM lab"
)
def labels(spark, sf):
    df = label_rank(t.std(spark, sf), t.HORIZON)
    return tidy(df.select("ticker", "date", "close", "label"))


@query(
    "normalise_to_first",
    "bars",
    f"""SELECT code, date, {r('CAST(close AS DOUBLE) / CAST(first_value(close) OVER (PARTITION BY code ORDER BY date) AS DOUBLE)')}
        AS norm FROM bars""",
)
def normalise_to_first(spark, sf):
    df = panel.normalise_to_first(t.bars(spark, sf), "close", "code")
    return tidy(df.select("code", "date", "norm"))


WINDOW_SQL = f"""SELECT ticker, date, {r('list_sum(list_transform(w, lambda x: x[1]))')} AS returns,
    {r('w[1][2]')} AS first_range, len(w) AS size FROM (
    SELECT ticker, date, list([close_return, range_cs]) OVER f AS w, row_number() OVER o AS n
    FROM std WINDOW o AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date
    ROWS BETWEEN {t.STEPS - 1} PRECEDING AND CURRENT ROW)) WHERE n >= {t.STEPS}"""


def window_digest(df):
    """What identifies a window's content: its return sum, its first row and its length."""
    close, wide = signals.FEATURES.index("close_return"), signals.FEATURES.index("range_cs")
    returns = F.aggregate(
        "window", F.lit(0.0), lambda acc, row: acc + F.get(row, F.lit(close)).cast("double")
    )
    first = F.get(F.get("window", F.lit(0)), F.lit(wide))
    return df.select(
        "ticker",
        "date",
        returns.alias("returns"),
        first.alias("first_range"),
        F.size("window").cast("long").alias("size"),
    )


@query("sliding_windows", "std", WINDOW_SQL)
def sliding_windows(spark, sf):
    return tidy(window_digest(windows.windows(t.std(spark, sf), t.STEPS)))


@query("windows_since", "std", WINDOW_SQL + f" AND date >= DATE '{t.CUTOFF}'")
def windows_since(spark, sf):
    return tidy(window_digest(windows.windows_since(t.std(spark, sf), t.STEPS, t.CUTOFF)))


@query(
    "latest_windows",
    "std",
    WINDOW_SQL + " QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1",
)
def latest_windows(spark, sf):
    return tidy(window_digest(windows.latest_windows(t.std(spark, sf), t.STEPS)))


@query(
    "window_target",
    "lab",
    f"""SELECT ticker, date, {r('label')} AS target FROM lab
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date) >= {t.STEPS}""",
)
def window_target(spark, sf):
    df = windows.window_target(t.labelled(spark, sf), t.STEPS)
    return tidy(df.select("ticker", "date", "target"))


@query(
    "window_counts",
    "std",
    f"SELECT ticker, greatest(count(*) - {t.STEPS - 1}, 0) AS windows FROM std GROUP BY ticker",
)
def window_counts(spark, sf):
    return windows.window_counts(t.std(spark, sf), t.STEPS)


@query(
    "train_valid_split",
    "lab",
    f"""SELECT ticker, date, side, {r('label')} AS label FROM (
        SELECT *, CASE WHEN date < DATE '{t.CUTOFF}' THEN 'train' ELSE 'valid' END AS side FROM lab)
        QUALIFY count(*) OVER (PARTITION BY ticker, side) >= {t.STEPS}""",
)
def train_valid_split(spark, sf):
    df = windows.tagged_split(t.labelled(spark, sf), t.CUTOFF, t.STEPS)
    return tidy(df.select("ticker", "date", "side", "label"))


@query(
    "split_check",
    "lab",
    f"""SELECT *, train_windows > 0 AND valid_windows > 0 AS ok FROM (
        SELECT CAST(coalesce(sum(n) FILTER (date < DATE '{t.CUTOFF}'), 0) AS BIGINT) AS train_windows,
            CAST(coalesce(sum(n) FILTER (date >= DATE '{t.CUTOFF}'), 0) AS BIGINT) AS valid_windows FROM (
        SELECT date, CASE WHEN row_number() OVER (PARTITION BY ticker, date < DATE '{t.CUTOFF}' ORDER BY date)
            >= {t.STEPS} THEN 1 ELSE 0 END AS n FROM lab))""",
)
def split_check(spark, sf):
    """Whether the cutoff leaves windows on both sides, without which training is refused."""
    return windows.split_check(t.labelled(spark, sf), t.CUTOFF, t.STEPS)


@query(
    "sort_bars",
    "history",
    f"SELECT market, code, date, {r('close')} AS close FROM history ORDER BY market, code, date",
)
def sort_bars(spark, sf):
    df = t.history(spark, sf).select("market", "code", "date", "close")
    return tidy(panel.sort_bars(df, ("market", "code", "date")))


@query("partition_by_ticker", "bars", "SELECT code AS ticker, 1 AS places, count(*) AS rows FROM bars GROUP BY code")
def partition_by_ticker(spark, sf):
    """Every ticker's rows end up in one partition, and none is lost."""
    placed = panel.by_ticker(t.ticker_bars(spark, sf)).withColumn("_p", F.spark_partition_id())
    return placed.groupBy("ticker").agg(
        F.count_distinct("_p").cast("int").alias("places"), F.count(F.lit(1)).alias("rows")
    )


SAMPLE_SEED = 7


@query(
    "sample_tickers",
    "bars",
    f"""SELECT code AS ticker, date, {r('close')} AS close FROM bars WHERE code IN (
        SELECT code FROM (SELECT DISTINCT code FROM bars)
        ORDER BY md5(code || '|{SAMPLE_SEED}'), code LIMIT 8)""",
)
def sample_tickers(spark, sf):
    df = t.ticker_bars(spark, sf).select("ticker", "date", "close")
    return tidy(ranking.sample_tickers(df, 8, SAMPLE_SEED))


@query(
    "subsample_windows",
    "scored",
    f"""SELECT ticker, date, {r('score')} AS score FROM scored
        ORDER BY md5(ticker || '|' || CAST(date AS VARCHAR) || '|{SAMPLE_SEED}'), ticker, date
        LIMIT 12000""",
)
def subsample_windows(spark, sf):
    df = cut_lineage(t.scored(spark, sf).select("ticker", "date", "score"))  # its keys are read again and again
    return tidy(ranking.sample_windows(df, 12_000, SAMPLE_SEED))
