"""Scoring, ranking and score evaluation queries."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from barloom.catalog import tables as t
from barloom.catalog.registry import query, r, tidy
from barloom.functions.signals import FEATURES
from barloom.operators import metrics, panel, ranking, windows
from barloom.operators.history import until
from barloom.plans import regression, scoring
from barloom.plans.features import label_gains, standardize
from barloom.session import cut_lineage, kept

SCORED_SQL = f"SELECT ticker, date, {r('score', 6)} AS score FROM scored"


def int_rank(df):
    """Ranks are longs; the compared form has them as integers."""
    return df.withColumn("rank", F.col("rank").cast("int"))


@query("score_linear", "scored", SCORED_SQL)
def score_linear(spark, sf):
    return tidy(t.scored(spark, sf).select("ticker", "date", "score"), 6)


@query("score", "scored", SCORED_SQL + f" WHERE date >= DATE '{t.CUTOFF}'")
def score_since(spark, sf):
    df = scoring.score(t.std(spark, sf), t.SCORER, t.STEPS, since=t.CUTOFF)
    return tidy(df.select("ticker", "date", "score"), 6)


@query(
    "score_windows_keyed",
    "scored",
    f"SELECT ticker, date, {r('close')} AS close, {r('score')} AS score FROM scored",
)
def score_windows_keyed(spark, sf):
    """Scores arrive keyed by ticker and date next to the prices of their row."""
    return tidy(t.scored(spark, sf).select("ticker", "date", "close", "score"))


@query("score_gru")
def score_gru(spark, sf):
    scorer = scoring.GruScorer(scoring.gru_weights(seed=11))
    # The prices stay out of what the workers pass on.
    std = t.std(spark, sf).select("ticker", "date", "feature")
    return tidy(scoring.score(std, scorer, t.STEPS))


def training(labelled):
    """Labelled rows before the cutoff, of tickers with enough of them for a window."""
    train = windows.tagged_split(labelled, t.CUTOFF, t.STEPS)
    return train.filter(F.col("side") == "train").drop("side")


@contextmanager
def early(spark, sf):
    """Labelled rows before the cutoff; a ticker with too few of them for a window has none. The lines move once: bars and
    gains are kept in order while the block runs, and the statistics of the dates read them again."""
    with kept(t.bars_in_order(spark, sf)) as bars:
        gains = until(panel.forward_mfe(standardize(bars), t.HORIZON), t.CUTOFF)
        with kept(gains.select("ticker", "date", "feature", "raw_mfe")) as stored:
            yield label_gains(stored)


def fitted(spark, sf):
    with early(spark, sf) as train:
        return scoring.fit_huber(train, t.STEPS)


t.CTES["train"] = (
    "lab",
    f"""SELECT * FROM lab WHERE date < DATE '{t.CUTOFF}'
        QUALIFY count(*) OVER (PARTITION BY ticker) >= {t.STEPS}""",
)
# Least squares under weights that fall with the error, repeated: three normal equations by Cramer's rule.
t.CTES["huber"] = (
    "train",
    """SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c
        UNION ALL
        SELECT step, (sy * (suu * svv - suv * suv) - su * (suy * svv - suv * svy) + sv * (suy * suv - suu * svy)) / d,
            (s * (suy * svv - suv * svy) - sy * (su * svv - suv * sv) + sv * (su * svy - suy * sv)) / d,
            (s * (suu * svy - suy * suv) - su * (su * svy - suy * sv) + sy * (su * suv - suu * sv)) / d
        FROM (SELECT *, s * (suu * svv - suv * suv) - su * (su * svv - suv * sv) + sv * (su * suv - suu * sv) AS d
            FROM (SELECT any_value(step) AS step, sum(w) AS s, sum(w * u) AS su, sum(w * v) AS sv, sum(w * y) AS sy,
                sum(w * u * u) AS suu, sum(w * u * v) AS suv, sum(w * v * v) AS svv, sum(w * u * y) AS suy,
                sum(w * v * y) AS svy
            FROM (SELECT h.step + 1 AS step, close_return_cs AS u, range_cs AS v, label AS y,
                CASE WHEN h.step = 0 THEN 1 ELSE
                1 / greatest(1, abs(label - h.a - h.b * close_return_cs - h.c * range_cs)) END AS w
                FROM huber h, train WHERE h.step < 60)))
        WHERE step IS NOT NULL""",
)
PAIR = [FEATURES.index("close_return_cs"), FEATURES.index("range_cs")]


def pairs(spark, sf):
    """Each bar's relative return and range and its best forward gain, written once: the frames along a ticker are not
    made again for the label's statistics, the fit and the scores."""
    pair = F.array(*[F.get("feature", F.lit(i)) for i in PAIR])
    priced = t.std(spark, sf).select("ticker", "date", pair.alias("feature"), "high", "low")
    return cut_lineage(panel.forward_mfe(priced, t.HORIZON).drop("high", "low"))


def fitted_pair(stored):
    """The label as a linear function of the day's relative return and range."""
    return regression.fit_windows(training(label_gains(stored)), 1)


@query(
    "fit_huber",
    "train huber",
    f"""SELECT name, {r('value', 6)} AS coefficient, n FROM (
        UNPIVOT (SELECT a AS intercept, b AS close_return_cs, c AS range_cs FROM huber WHERE step = 60)
        ON intercept, close_return_cs, range_cs INTO NAME name VALUE value), (SELECT count(*) AS n FROM train)""",
    recursive=True,
)
def fit_huber(spark, sf):
    """Coefficients at a threshold of one, and the rows they were fitted on."""
    model = fitted_pair(pairs(spark, sf))
    names = ["intercept", *[FEATURES[i] for i in PAIR]]
    values = [model.intercept, *model.coefficients.tolist()]
    rows = [(name, value, model.n) for name, value in zip(names, values, strict=True)]
    return tidy(spark.createDataFrame(rows, "name string, coefficient double, n bigint"), 6)


@query(
    "score_huber",
    "std huber",
    f"""SELECT ticker, date, {r('a + b * close_return_cs + c * range_cs', 6)} AS score
        FROM std, huber WHERE step = 60""",
    recursive=True,
)
def score_huber(spark, sf):
    """Every bar by the fitted function of its relative return and range, scored where its pair was written."""
    stored = pairs(spark, sf)
    model = fitted_pair(stored)
    df = scoring.score(stored, scoring.LinearScorer(model.step_weights(1), model.intercept), 1)
    return tidy(df.select("ticker", "date", "score"), 6)


@query(
    "fit_huber_windows",
    "train",
    f"""SELECT position, n, CAST(0 AS DOUBLE) AS slope FROM
        (SELECT unnest(range(-1, {t.STEPS * len(FEATURES)}))::INTEGER AS position),
        (SELECT count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM train)
            WHERE k >= {t.STEPS})""",
)
def fit_huber_windows(spark, sf):
    """The fit on whole windows; at the least loss the slope in every coefficient is zero."""
    with early(spark, sf) as train:
        packed = regression.pack(train, t.STEPS)
    slopes = regression.packed_stationarity(packed, regression.fit_packed(packed))
    # Zero has no sign here.
    return tidy(slopes, 6).withColumn("slope", F.col("slope") + F.lit(0.0))


@query("score_ml")
def score_ml(spark, sf):
    df = scoring.score(t.std(spark, sf), scoring.MLScorer(fitted(spark, sf)), t.STEPS)
    return tidy(df.select("ticker", "date", "score"))


IC = """covar_pop(score, target) / (stddev_pop(score) * stddev_pop(target) + 1e-12)"""
HUBER = """avg(CASE WHEN abs(score - target) <= 1 THEN 0.5 * (score - target) * (score - target)
    ELSE abs(score - target) - 0.5 END)"""


@query("score_ic", "scored_labels", f"SELECT {r(IC)} AS ic FROM scored_labels")
def score_ic(spark, sf):
    return tidy(metrics.ic(t.scored_labels(spark, sf)))


@query(
    "ic_by_date",
    "scored_labels",
    f"SELECT date, {r(IC)} AS ic, count(*) AS n FROM scored_labels GROUP BY date",
)
def ic_by_date(spark, sf):
    return tidy(metrics.ic_by_date(t.scored_labels(spark, sf)))


@query(
    "weighted_metric",
    "scored_labels",
    f"""SELECT {r('sum(ic * n) / sum(n)')} AS ic FROM (
        SELECT {IC} AS ic, count(*) AS n FROM scored_labels GROUP BY date)""",
)
def weighted_metric(spark, sf):
    return tidy(metrics.weighted_metric(metrics.ic_by_date(t.scored_labels(spark, sf)), "ic"))


@query("huber_loss", "scored_labels", f"SELECT {r(HUBER)} AS huber FROM scored_labels")
def huber_loss(spark, sf):
    return tidy(metrics.huber_loss(t.scored_labels(spark, sf)))


@query(
    "evaluate",
    "scored_labels",
    f"""SELECT side, count(*) AS n, {r(HUBER)} AS huber, {r(IC)} AS ic FROM (
        SELECT *, CASE WHEN date < DATE '{t.CUTOFF}' THEN 'train' ELSE 'valid' END AS side
        FROM scored_labels) GROUP BY side""",
)
def evaluate(spark, sf):
    side = F.when(F.col("date") < F.lit(t.CUTOFF).cast("date"), "train").otherwise("valid")
    return tidy(metrics.evaluate(t.scored_labels(spark, sf).withColumn("side", side)))


@query(
    "lag_signal_to_next_bar",
    "day_bars",
    f"""SELECT date, ticker, {r('score', 6)} AS score, {r('open', 6)} AS open, {r('low', 6)} AS low,
        {r('high', 6)} AS high, {r('close', 6)} AS close FROM day_bars""",
)
def lag_signal(spark, sf):
    """The join form: bars on one side, scores keyed by (ticker, date) on the other."""
    bars = t.std(spark, sf).select("date", "ticker", "open", "low", "high", "close")
    priced = panel.lag_signal(bars, t.scored(spark, sf))
    return tidy(priced.select("date", "ticker", "score", "open", "low", "high", "close"), 6)


@query(
    "day_bars",
    "day_bars",
    f"""SELECT date, ticker, {r('score', 6)} AS score, {r('open', 6)} AS open, {r('low', 6)} AS low,
        {r('high', 6)} AS high, {r('close', 6)} AS close FROM day_bars""",
)
def day_bars(spark, sf):
    return tidy(t.day_bars(spark, sf), 6)


@query(
    "day_index",
    "day_bars day_index",
    "SELECT b.ticker, b.date, CAST(d.day AS INTEGER) AS day FROM day_bars b JOIN day_index d USING (date)",
)
def day_index(spark, sf):
    return panel.with_day_index(t.written_day_bars(spark, sf).select("ticker", "date")).select(
        "ticker", "date", "day"
    )


@query(
    "rank_by_score",
    "day_bars",
    f"""SELECT date, ticker, {r('score', 6)} AS score, CAST(row_number() OVER
        (PARTITION BY date ORDER BY score DESC, ticker) AS INTEGER) AS rank FROM day_bars""",
)
def rank_by_score(spark, sf):
    df = t.written_day_bars(spark, sf).select("date", "ticker", "score")
    return tidy(int_rank(ranking.rank_by_score(df)), 6)


@query(
    "above_threshold",
    "day_bars",
    f"SELECT date, ticker, {r('score', 6)} AS score FROM day_bars WHERE score > {t.THRESHOLD}",
)
def above_threshold(spark, sf):
    df = t.day_bars(spark, sf).select("date", "ticker", "score")
    return tidy(ranking.above(df, t.THRESHOLD), 6)


@query(
    "top_candidates",
    "day_bars",
    f"""SELECT * FROM (SELECT date, ticker, {r('score', 6)} AS score, CAST(row_number() OVER
        (PARTITION BY date ORDER BY score DESC, ticker) AS INTEGER) AS rank FROM day_bars
        WHERE score > {t.THRESHOLD}) WHERE rank <= {t.SLOTS}""",
)
def top_candidates(spark, sf):
    df = t.day_bars(spark, sf).select("date", "ticker", "score")
    return tidy(ranking.top_k(df, t.THRESHOLD, t.SLOTS, by="date"), 6)


@query(
    "rank_latest",
    "keyed",
    f"""SELECT ticker, date, {r('score', 6)} AS score,
        CAST(row_number() OVER (ORDER BY score DESC, ticker) AS INTEGER) AS rank FROM (
        SELECT * FROM keyed WHERE score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)""",
)
def rank_latest(spark, sf):
    newest = t.scored(spark, sf).groupBy("ticker").agg(
        F.max("date").alias("date"), F.max_by("score", "date").alias("score")
    )
    return tidy(int_rank(ranking.rank_latest(newest)), 6)


@query(
    "rank",
    "latest",
    f"""SELECT ticker, date, {r('score', 6)} AS score,
        CAST(row_number() OVER (ORDER BY score DESC, ticker) AS INTEGER) AS rank FROM latest""",
)
def rank(spark, sf):
    return tidy(int_rank(scoring.rank(t.bars(spark, sf), t.SCORER, t.STEPS, lookback_days=t.RANK_DAYS)), 6)
