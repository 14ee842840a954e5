"""Targets, draws, permutations and the words that the mix takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing


def test_targets_fill_up_by_weight():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    # The first stops at 30; the others share the rest by weight.
    assert mixing.targets([10, 500, 490], [8, 1, 1]) == [30, 485, 485]
    assert mixing.targets([0, 60], [1, 1]) == [0, 60]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.targets([], []) == []


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000])
def test_permutation_hits_every_place_once(size):
    at = np.arange(size)
    for key in (0, 7):
        out = mixing.permuted(at, np.full(size, size), np.full(size, key))
        assert sorted(out.tolist()) == at.tolist()
    other = mixing.permuted(at, np.full(size, size), np.full(size, 8))
    assert size < 64 or (other != out).any()


def corpus(spark):
    return spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.expr("array_join(transform(sequence(1, 1 + id % 97), x -> concat('w', x)), ' ')").alias("text"),
        F.expr("case when id < 140 then 'a' when id < 240 then 'b' when id < 320 then null else concat('s', id % 3) end").alias("source"),
    )


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = corpus(spark)
    first, again = (mixing.mixed_sizes(docs).orderBy("doc_id").collect() for _ in range(2))
    assert first == again and len(first) == 400
    by_source = {}
    for row, source in zip(first, docs.orderBy("doc_id").select("source").collect(), strict=True):
        assert row.size == 1 + row.doc_id % 97 and 0 <= row.taken <= 3 * row.size
        by_source.setdefault(source.source, []).append(row)
    weights = dict(zip(["a", "b", "s0", "s1", "s2", None], [1, 2, 3, 1, 2, 3], strict=True))
    sizes = {s: sum(r.size for r in rows) for s, rows in by_source.items()}
    order = list(weights)
    expected = dict(zip(order, mixing.targets([sizes[s] for s in order], list(weights.values())), strict=True))
    for source, rows in by_source.items():
        assert rows[0].source_size == sizes[source]
        assert rows[0].target == pytest.approx(expected[source])
        assert abs(sum(r.taken for r in rows) - expected[source]) <= 2 * mixing.BLOCK


def test_documents_of_the_mix_are_what_was_taken(spark):
    docs = corpus(spark).withColumn("n_chars", F.length("text"))
    taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect()}
    whole = {r.doc_id: r.text.split() for r in docs.collect()}
    words = {}
    for row in mixing.mixed_documents(docs).collect():
        own = row.text.split()
        assert set(own) <= set(whole[row.doc_id]) and row.n_chars == len(row.text)
        words[row.doc_id] = words.get(row.doc_id, 0) + len(own)
    assert words == {d: n for d, n in taken.items() if n}


def test_hard_rows(hard, empty):
    rows = mixing.mixed_sizes(hard).collect()
    assert len(rows) == hard.count()
    assert {r.taken for r in rows if r.size == 0} == {0}
    assert mixing.mixed_sizes(empty).count() == 0
    assert mixing.mixed_documents(hard).columns == [c for c in hard.columns if c != "row"]
    assert mixing.mixed_documents(empty).count() == 0


def test_taken_words_are_those_of_the_drawn_blocks(spark):
    """Lay a source's words out one by one, cut them into blocks, and count the words of every drawn block."""
    docs = corpus(spark)
    sized = mixing.sized(docs)
    parts = mixing.shares(sized)
    drawn = mixing.draw_blocks(spark, parts).collect()
    assert len({(r.number, r.slot) for r in drawn}) == len(drawn) == sum(p.slots for p in parts)
    words = {p.number: [] for p in parts}
    number = {p.source: p.number for p in parts}
    for row in sized.orderBy("doc_id").collect():
        words[number[row.source]] += [row.doc_id] * row.size
    taken, passes = {}, set()
    for r in drawn:
        assert (r.number, r.block, r["pass"]) not in passes  # once in a pass
        passes.add((r.number, r.block, r["pass"]))
        block = parts[r.number].block
        for doc in words[r.number][r.block * block : (r.block + 1) * block]:
            taken[doc] = taken.get(doc, 0) + 1
    assert {r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect() if r.taken} == taken


def test_shards_draw_every_slot_of_a_source_once(spark):
    parts = [mixing.Share(0, "a", 640_000, 640_000.0, 10_000, 10_000), mixing.Share(1, "b", 64_000, 64_000.0, 1000, 2000)]
    rows = mixing.draw_blocks(spark, parts, per_shard=512).groupBy("number").agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")
    ).collect()
    assert sorted((r.number, r.n, r.slots, r["last"]) for r in rows) == [(0, 10_000, 10_000, 9_999), (1, 2000, 2000, 1999)]


def test_small_sources_come_near_their_targets(spark):
    """One large source and many of a few dozen words, whose targets are below half a block of the large one."""
    rows = [(0, "word " * 40_000, "a")] + [(i, "tiny " * (5 + i % 60), f"s{i:03d}") for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed_sizes(docs).collect()
    for row in found:
        block = max(1, min(mixing.BLOCK, row.source_size // mixing.LEAST_BLOCKS))
        assert abs(row.taken - row.target) <= 2 * block and row.taken <= 3 * row.size
    assert all(row.taken > 0 for row in found if row.target >= 1)
