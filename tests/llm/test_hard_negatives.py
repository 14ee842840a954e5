"""Hard negatives against a plain search over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, score string"
LAST = (math.inf,)


def brute(rows, is_anchor, positives=5, negatives=10, window=(30, 90)):
    """All pairs with Python integers; ``rows`` are (vec_id, label, embedding)."""
    usable = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (anchor, label, vec) in enumerate(usable):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = [(-sum(a * b for a, b in zip(vec, own, strict=False)), i if i is not None else math.inf, m, other)
                  for m, (i, other, own) in enumerate(usable) if m != n]
        scored.sort()
        for score, positive, _, _ in [s for s in scored if s[3] == label][:positives]:
            low, high = window[0] * -score, window[1] * -score
            fits = [s for s in scored if s[3] != label and low <= 100 * -s[0] <= high][:negatives]
            out += [(anchor, positive, place, i, -score, -s) for place, (s, i, _, _) in enumerate(fits, 1)]
    return sorted((*(math.inf if x is None else x for x in row),) for row in out)


def mined(spark, rows, is_anchor=lambda i: i % 10 == 0, **options):
    df = spark.createDataFrame([(*r, "r", None) for r in rows], SCHEMA)
    found = hard_negatives.mine(df, F.expr("vec_id % 10 = 0"), **options).collect()
    return sorted((*(math.inf if x is None else x for x in row),) for row in found)


def vectors(n, seed, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    own = centres[rng.integers(0, 6, n)] + 0.8 * rng.normal(size=(n, width))
    own *= rng.uniform(0.2, 2, (n, 1)) / np.sqrt(width)
    return [(i, int(rng.integers(0, 4)), v) for i, v in enumerate(own.astype(np.float32).tolist())]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = vectors(400, seed)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_other_windows_and_a_hot_label(spark):
    rows = [(i, 1 if i % 3 else label, v) for i, label, v in vectors(300, 3)]
    options = {"positives": 3, "negatives": 4, "window": (50, 100)}
    assert mined(spark, rows, **options) == brute(rows, lambda i: i % 10 == 0, **options)


def test_hard_rows(spark):
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [2.0]), (2, 2, [1.0, 0.25]), (2, 2, [1.0, 0.25]), (3, 2, [0.8, 0.0]),
        (None, 2, [0.9, 0.1]), (None, 1, [0.1, 0.1]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [math.nan, 1.0]),
        (7, 2, [1.0, None]), (8, 2, [math.inf, 1.0]), (9, 2, []), (10, 3, [1.0, 1.0]), (20, 2, [0.0, 0.0]), (30, 2, [-1.0, -1.0]),
        (40, 1, [0.7, 0.1, 9.0]),
    ]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 2), (v * 1e5).tolist()) for i, v in enumerate(rng.normal(size=(40, 3)).astype(np.float32))]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("share", [0.9, 0.5, 0.1, -1.0])
def test_no_pair_above_a_threshold_is_lost(share):
    rng = np.random.default_rng(7)
    vecs = np.floor(256 * rng.normal(size=(500, 40)) * np.linspace(2, 0.05, 40))
    n = np.arange(500)
    block = hard_negatives._Block(n, np.ma.MaskedArray(n), n, vecs)
    probes = vecs[:50] + np.floor(100 * rng.normal(size=(50, 40)))
    scores = probes @ vecs.T
    at = share * scores.max(axis=1)
    probe, row, score = block.pairs(probes, at)
    wanted = np.nonzero(scores >= at[:, None])
    assert sorted(zip(probe, row, score, strict=True)) == sorted(zip(*wanted, scores[wanted], strict=True))
