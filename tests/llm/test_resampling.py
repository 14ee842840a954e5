"""Importance resampling against a plain loop over texts, and the cutoff against a full sort."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from barloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(docs, target, share=25):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    bucket = lambda run: crc32(run.encode()) % 10_000
    bags = [(i, *runs(text)) for i, text in docs]
    own = Counter(bucket(run) for _, _, bag in bags for run in bag)
    wanted = Counter(bucket(run) for text in target for run in runs(text)[1])
    s, t = sum(own.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n_words, bag in bags:
        weight = sum(gain[bucket(run)] for run in bag) // len(bag) if bag else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(bag), weight, score, n_words >= 20))
    last = lambda i: (i is None, i or 0)
    pool = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], last(r[0]), r[1]))
    drawn = pool[: share * len(pool) // 100]
    out = [(*r[:4], n) for n, r in enumerate(drawn, 1)]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return out + [(*r, None) for r in left.elements()]


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_equals_the_definition(spark, hard):
    rng = random.Random(4)
    words = ["Alpha", "beta", "gamma2", "çà", "DELTA", "x", "the", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + ".") for i in range(300)]
    docs += [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    docs += [docs[5]] * 7
    target = ["alpha beta beta-gamma2", None, "", "ALPHA the of çà"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("rank", F.lit(1))
    out = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows_of(out) == sorted(brute(docs, target), key=repr)


def test_no_rows_and_no_target(spark, empty):
    texts = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, texts).count() == 0
    docs = [(i, "one two three " * i) for i in range(12)]
    out = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), texts.limit(0))
    assert rows_of(out) == sorted(brute(docs, []), key=repr)


def test_longer_runs():
    words, found = resampling.features(b"A bb, C9 d", 3)
    wanted = [b"a", b"bb", b"c9", b"d", b"a bb", b"bb c9", b"c9 d", b"a bb c9", b"bb c9 d"]
    assert words == 4 and found == [crc32(run) for run in wanted]


@pytest.mark.parametrize("n", [1, 2, 2500, 4999, 5000])
def test_cutoff_is_the_nth_row_of_a_sort(spark, monkeypatch, n):
    monkeypatch.setattr(resampling, "ACCURACY", 50)  # a coarse sketch, so that brackets have to widen
    monkeypatch.setattr(resampling, "MARGIN", 0.05)
    rows = spark.range(5000).select(
        F.when(F.col("id") % 97 != 0, F.col("id")).alias("doc_id"), (F.col("id") % 7).alias("n_features"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.hash("id"), F.lit(1000))).cast("long").alias("score"),
    )
    ordered = sorted(rows.collect(), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0, r.n_features))
    found, wanted = resampling.cutoff(rows, n), ordered[n - 1]
    assert [found[c] for c in ("score", "doc_id", "n_features")] == [wanted[c] for c in ("score", "doc_id", "n_features")]
