"""Ranks, top-k and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.signals import is_positive
from barloom.operators.spread import join_stats, rank_within, top_in_group


def strongest_first() -> list[Column]:
    """Score descending, ticker ascending among equals."""
    return [F.desc("score"), F.asc("ticker")]


def above(df: DataFrame, threshold: float) -> DataFrame:
    """Rows scoring strictly above ``threshold``; NaN never does."""
    return df.filter((F.col("score") > threshold) & ~F.isnan("score"))


def rank_by_score(df: DataFrame, by: str = "date", k: int | None = None) -> DataFrame:
    """Rank in each group, strongest first; only the first ``k`` when given."""
    usable = df.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    if k is None:
        return rank_within(usable, [by], strongest_first(), "rank")
    return top_in_group(usable, by, strongest_first(), k, "rank")


def rank_latest(scored: DataFrame) -> DataFrame:
    """All tickers with their overall rank."""
    return rank_within(scored, [], strongest_first(), "rank")


def top_k(scored: DataFrame, threshold: float, k: int, by: str | None = None) -> DataFrame:
    """The ``k`` strongest rows above ``threshold`` with their rank, per group if ``by`` is given."""
    usable = above(scored, threshold)
    if by is None:
        strongest = usable.orderBy(*strongest_first()).limit(k)
        order = Window.orderBy(*strongest_first())  # over the k rows left
        return strongest.withColumn("rank", F.row_number().over(order))
    return top_in_group(usable, by, strongest_first(), k, "rank")


def score_weights(df: DataFrame, by: str = "date") -> DataFrame:
    """Share of each group's positive score, as ``weight``; equal shares if none is positive."""
    positive = F.greatest(F.col("score").cast("double"), F.lit(0.0))
    stats = [F.sum(positive).alias("_total"), F.count(F.lit(1)).alias("_n")]
    weight = F.when(is_positive(F.col("_total")), positive / F.col("_total")).otherwise(
        1.0 / F.col("_n")
    )
    return join_stats(df, by, stats).withColumn("weight", weight).drop("_total", "_n")


def score_targets(candidates: DataFrame, slots: int, held: str | None = None) -> DataFrame:
    """Cash target of the strongest candidates of each date, in proportion to score.

    ``candidates`` carries the ``cash`` of its date and, in the column ``held``, how many of the
    ``slots`` positions are taken that day; without it all are open. Names beyond the open slots have no
    target, and a full book has none at all.
    """
    chosen = top_in_group(candidates, "date", strongest_first(), slots, "rank")
    if held is not None:
        chosen = chosen.filter(F.col("rank") <= slots - F.coalesce(held, F.lit(0)))
    return score_weights(chosen).withColumn("target", F.col("cash") * F.col("weight"))


def _lottery(*keys: str, seed: int) -> Column:
    """A reproducible draw per key: the same seed gives the same order on any cluster."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


#: Hexadecimal digits of a draw that one histogram resolves, and the rows few enough to be sorted.
DIGITS, FEW = 4, 10_000


def _among_first(keys: DataFrame, draw: Column, n: int) -> Column:
    """Whether a row's draw, ties by its keys, is among the ``n`` smallest of ``keys``.

    A histogram of the draws' leading digits, at most ``16 ** DIGITS`` counts, tells which bin the
    ``n``-th row is in. All bins before it are taken whole; the bin is counted by its next digits, until
    few rows are left or the draw has no digits more. Only those are sorted, and only the ``n``-th is
    fetched: the result is a filter on the row itself, and nothing is shuffled but counts.
    """
    names, drawn = keys.columns, keys.withColumn("_draw", draw)
    if n < 1:
        return F.lit(False)
    prefix, left = "", n
    while True:
        inside = drawn.filter(F.col("_draw").startswith(prefix))
        upto = len(prefix) + DIGITS
        bins = inside.groupBy(F.substring("_draw", 1, upto).alias("_bin")).count()
        for own, count in sorted(tuple(row) for row in bins.collect()):
            if left <= count:
                break
            left -= count
        else:
            return F.lit(True)  # there are no more rows than n
        prefix = own
        if count <= FEW or upto >= 32:
            break
    order = [F.asc("_draw"), *[F.asc(name) for name in names]]
    last = drawn.filter(F.col("_draw").startswith(prefix)).orderBy(*order).limit(left).tail(1)[0]
    same = F.lit(True)
    for name in reversed(names):
        same = (F.col(name) < F.lit(last[name])) | ((F.col(name) == F.lit(last[name])) & same)
    return (draw < last["_draw"]) | ((draw == last["_draw"]) & same)


def sample_tickers(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Rows of ``n`` tickers drawn by ``seed``; all rows when there are no more tickers than that."""
    tickers = df.select("ticker").filter("ticker is not null").distinct()
    return df.filter(_among_first(tickers, _lottery("ticker", seed=seed), n))


def sample_windows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` windows drawn by ``seed`` from the rows that end one."""
    keys = df.select("ticker", "date").filter("ticker is not null and date is not null")
    return df.filter(_among_first(keys, _lottery("ticker", "date", seed=seed), n))
