"""Target-distribution importance resampling on hashed word n-grams.

Texts are bags of hashed features. How much likelier a bucket is in the target than in the corpus is its
gain, and an array of gains is all that scoring a text needs. The highest weights after adding Gumbel noise
are a draw without replacement. Where they end is found without sorting the corpus: a quantile sketch
brackets the cutoff, exact counts outside the bracket confirm it, and only the bracket is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from barloom.llm.common import require, sorted_slices
from barloom.operators.spread import rank_within
from barloom.session import cut_lineage

BUCKETS = 10_000
#: Accuracy of the quantile sketch; its bracket starts so many of its steps wide on either side.
ACCURACY, MARGIN = 2_000, 2
#: Features that a task holds before it adds them up.
HELD = 1 << 18
#: A-Z become a-z; digits, letters and bytes of other characters stay; all else separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def features(text: bytes, longest: int) -> tuple[int, list[int]]:
    """Number of words of a text in UTF-8, and the crc32 of every run of one to ``longest`` words."""
    words = text.translate(_WORD_BYTES).split()
    runs = list(map(crc32, words))
    found, joined = list(runs), [b" " + word for word in words]
    for n in range(1, min(longest, len(words))):
        # A checksum goes on from where that of the shorter run stopped.
        runs = list(map(crc32, joined[n:], runs))
        found += runs
    return len(words), found


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def bucket_counts(docs: DataFrame, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: how many features of all texts fall into each bucket. A task sends one row per
    bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(buckets, np.int64), []

        def add() -> None:
            np.add(total, np.bincount(np.array(held, np.int64) % buckets, minlength=buckets), out=total)
            held.clear()

        for batch in batches:
            for text in _texts(batch, 0):
                held += features(text, longest)[1]
                if len(held) >= HELD:
                    add()
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths of a natural logarithm, from two tables of ``bucket_counts``.

    The driver sees one count per bucket.
    """

    def array(counts: DataFrame) -> np.ndarray:
        found = np.zeros(buckets)
        for bucket, n in counts.collect():
            found[bucket] = n
        return found

    own, wanted = array(corpus), array(target)
    ratio = (wanted + 1) * (own.sum() + buckets) / ((own + 1) * (wanted.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 2) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of its features, for
    every document; 0 for one without words."""
    require(docs, ["doc_id", "text"])
    buckets = len(gain)
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "n_words", "n_features", "weight")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, sums, held, starts = [], [], [], [], []

            def add() -> None:
                if held:
                    own = gain[np.array(held, np.int64) % buckets]
                    sums.extend(np.add.reduceat(own, starts).tolist())
                    held.clear()
                    starts.clear()

            for text in _texts(batch, 1):
                n, found = features(text, longest)
                words.append(n)
                sizes.append(len(found))
                if found:
                    starts.append(len(held))
                    held += found
                    if len(held) >= HELD:
                        add()
            add()
            total = iter(sums)
            means = [next(total) // size if size else 0 for size in sizes]
            columns = [batch.column(0), pa.array(words), pa.array(sizes), pa.array(means, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], schema=schema)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the hash of seed and id; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def _order() -> list[Column]:
    """Higher scores first, then smaller ids, null ids last; of rows that share both, fewer features."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]


def _upto(row: Row) -> Column:
    """Rows that do not come after ``row`` in that order."""
    score, doc_id, last = F.col("score"), F.col("doc_id"), F.lit(row["doc_id"]).cast("bigint")
    before = doc_id.isNotNull() if row["doc_id"] is None else F.coalesce(doc_id < last, F.lit(False))
    same = doc_id.eqNullSafe(last) & (F.col("n_features") <= row["n_features"])
    return (score > row["score"]) | ((score == row["score"]) & (before | same))


def cutoff(pool: DataFrame, n: int) -> Row:
    """The ``n``-th row of ``pool`` by score, id and features, 1 <= n <= its rows; only a bracket is sorted.

    The sketch gives two scores around the wanted share. Exact counts above and within tell whether the row
    lies between them; if not, the bracket is widened, in the end to all rows.
    """
    total = pool.count()
    margin = MARGIN / ACCURACY
    while True:
        wanted = 1 - n / total
        ends = [max(0.0, wanted - margin), min(1.0, wanted + margin)]
        low, high = pool.agg(F.percentile_approx("score", ends, ACCURACY)).first()[0]
        reach = F.lit(True)
        if ends[0] > 0:
            reach = reach & (F.col("score") >= low)
        if ends[1] < 1:
            reach = reach & (F.col("score") <= high)
        above, within = pool.agg(
            F.count_if(~reach & (F.col("score") > high)).alias("above"), F.count_if(reach).alias("within")
        ).first()
        if above < n <= above + within:
            break
        margin *= 8
    placed = sorted_slices(pool.filter(reach).select("score", "doc_id", "n_features"), *_order())
    left = n - above
    for part, size in sorted(placed.groupBy("_slice").count().collect()):
        if left <= size:
            return placed.filter(F.col("_pos") == (part << 33) + left - 1).first()
        left -= size
    raise AssertionError("counts and rows disagree")


def draw(scored: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20) -> DataFrame:
    """Add ``rank`` to documents with ``score``: 1 for the first drawn, null for the others.

    Of the documents with at least ``least_words`` words, floor(share) are drawn, the highest scores first,
    ties by smaller id (null ids last), then by fewer features; rows that agree in all three are told apart
    by their place only, and exactly as many are drawn. ``scored`` is written to the shared folder.
    """
    scored = cut_lineage(scored)
    may = F.col("n_words") >= least_words
    pool = scored.filter(may)
    n = share[0] * pool.count() // share[1]
    if not n:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    taken = may & _upto(cutoff(pool, n))
    ranked = rank_within(scored.filter(taken), [], _order(), "rank").withColumn("rank", F.col("rank").cast("bigint"))
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return drawn.unionByName(scored.filter(~taken).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, seed: int = 7) -> DataFrame:
    """Draw documents whose word runs are like those of ``target``.

    Returns ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` for every row of
    ``docs``. Null and empty texts have no features and weight 0; repeated rows stay; an empty ``docs``
    gives no rows, and an empty ``target`` is like a uniform one. Columns besides ``doc_id`` and ``text``
    are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(scored, share, least_words)
