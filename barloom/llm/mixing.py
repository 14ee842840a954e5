"""Mixing sources to target weights.

The words of a source, in the order of its documents, are packed into blocks of a fixed length, shorter in
sources of few words, so that rounding to whole blocks takes little from any source. Output
shards draw how many blocks they take from each source from a multinomial, slots of a source are numbered
over the shards, and a pseudorandom permutation per source and pass maps a slot's number to a block. Slots
and blocks are then joined by the block's number.

One row per source comes to the driver; more than ``MAX_SOURCES`` sources are an error. Everything that
grows with the documents is a join or an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, require, sorted_slices
from barloom.session import cut_lineage

#: Words of a block; blocks of an output shard; the most often that a word may be taken.
BLOCK, SHARD, MOST = 64, 4096, 3
#: A source has this many blocks at least, if it has as many words.
LEAST_BLOCKS = 32
MAX_SOURCES = 100_000
SEED = 20_240_601


@dataclass(frozen=True)
class Share:
    """A source's number, name, words, target in words, blocks, slots to fill, and words of a block."""

    number: int
    source: str | None
    size: int
    target: float
    blocks: int
    slots: int
    block: int = BLOCK


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Split the sum of ``sizes`` by weight, but give none more than ``most`` times its size.

    What is above goes to the others by weight, until none is above.
    """
    total = float(sum(sizes))
    capped: set[int] = set()
    while True:
        rest = sum(w for i, w in enumerate(weights) if i not in capped)
        level = (total - sum(most * sizes[i] for i in capped)) / rest if rest else 0.0
        above = {i for i, w in enumerate(weights) if i not in capped and level * w > most * sizes[i]}
        if not above:
            return [float(most * sizes[i]) if i in capped else level * w for i, w in enumerate(weights)]
        capped |= above


def shares(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), block: int = BLOCK) -> list[Share]:
    """The sources of ``sized`` (``source``, ``size``) by code point, null last, with repeating weights."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda row: (row.source is None, row.source or ""))
    sizes = [int(row["size"]) for row in totals]
    wanted = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))])
    out = []
    for i, (row, size, target) in enumerate(zip(totals, sizes, wanted, strict=True)):
        own = max(1, min(block, size // LEAST_BLOCKS))
        blocks = -(-size // own)
        passes = int(target // size) if size else 0
        rest = round((target - passes * size) / own) if size else 0
        out.append(Share(i, row.source, size, target, blocks, passes * blocks + min(rest, blocks), own))
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network on the next even number of
    bits, walked until it falls below ``size``."""
    half = np.ones_like(size, dtype=np.uint64)
    while (small := (np.uint64(1) << (half * np.uint64(2))) < size.astype(np.uint64)).any():
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            mixed = (right + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _draws(spark: SparkSession, parts: list[Share], per_shard: int, seed: int) -> DataFrame:
    """Slots of each shard and source: ``shard``, ``number``, ``first`` (of the source's slots), ``taken``.

    Each shard draws from a multinomial with the sources' slots as weights. A source that has drawn all
    its slots takes no more, and closing shards hold what sources have not drawn, so that every source
    fills exactly its slots.
    """
    total = sum(x.slots for x in parts)
    full = -(-total // per_shard)
    odds = np.array([x.slots / total for x in parts]) if total else np.zeros(len(parts))
    quotas = np.array([x.slots for x in parts], np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                size = min(per_shard, total - shard * per_shard)
                counts = np.random.default_rng([seed, shard]).multinomial(size, odds)
                number = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(number), shard)), pa.array(number), pa.array(counts[number]), pa.array(quotas[number])],
                    names=["shard", "number", "drawn", "quota"],
                )

    drawn = spark.range(full).mapInArrow(draw, "shard bigint, number bigint, drawn bigint, quota bigint")
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut_lineage(drawn).withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    within = numbered.withColumn("taken", F.least("drawn", F.col("quota") - F.col("first"))).filter("taken > 0")
    quota = spark.createDataFrame([(x.number, x.slots) for x in parts], "number bigint, quota bigint")
    so_far = within.groupBy("number").agg(F.sum("taken").alias("first"))
    closing = (
        quota.join(so_far, "number", "left")
        .withColumn("first", F.coalesce("first", F.lit(0)))
        .withColumn("taken", F.col("quota") - F.col("first"))
        .filter("taken > 0")
        .withColumn("shard", F.lit(full) + F.col("number"))
    )
    names = ["shard", "number", "first", "taken"]
    return within.select(names).union(closing.select(names))


def draw_blocks(spark: SparkSession, parts: list[Share], per_shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix as slots: ``shard``, ``number`` (of the source), ``slot``, ``block`` and ``pass``."""
    blocks = {x.number: x.blocks for x in parts}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, number, first, taken = (c.to_numpy() for c in batch.columns)
            for a in range(0, len(shard), 64):
                own = slice(a, a + 64)
                rows = np.repeat(np.arange(a, min(a + 64, len(shard))), taken[own])
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(taken[own]) - taken[own], taken[own])
                slot = first[rows] + nth
                size = np.array([blocks[n] for n in number[own].tolist()])[rows - a]
                turn = slot // size
                key = (number[rows] * 8 + turn + seed).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (shard[rows], number[rows], slot, permuted(slot % size, size, key), turn)],
                    names=["shard", "number", "slot", "block", "pass"],
                )

    return _draws(spark, parts, per_shard, seed).mapInArrow(
        place, "shard bigint, number bigint, slot bigint, block bigint, pass bigint"
    )


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words of the text; a null text has none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint")))


def segments(rows: DataFrame, parts: list[Share]) -> DataFrame:
    """Where each row's words lie: ``row``, ``number``, ``block``, ``start`` (word of the row), ``words``.

    ``rows`` has ``row`` (unique), ``doc_id``, ``source`` and ``size``; a source's rows follow each other by
    ``doc_id`` and row. The running sum is over range-sorted slices, so a source may hold any share.
    """
    names = rows.sparkSession.createDataFrame([(x.number, x.source, x.block) for x in parts], "number bigint, _source string, _words bigint")
    known = rows.filter("size > 0").join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source")))
    placed = sorted_slices(known.select("row", "number", "doc_id", "size", "_words"), "number", "doc_id", "row")
    slices = placed.groupBy("number", "_slice").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("number").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("number", "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("number", "_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("_own", F.sum("size").over(upto)).join(offsets, ["number", "_slice"]).select(
        "row", "number", "size", "_words", (F.col("_own") + F.col("_before")).alias("end")
    )
    begin, size = F.col("end") - F.col("size"), F.col("_words")
    cut = ends.withColumn("begin", begin).select(
        "row", "number", "_words", "begin", "end",
        F.explode(F.sequence(F.floor(begin / size), F.floor((F.col("end") - 1) / size))).alias("block"),
    )
    low = F.greatest("begin", F.col("block") * size)
    high = F.least("end", (F.col("block") + 1) * size)
    return cut.select("row", "number", "block", (low - F.col("begin")).alias("start"), (high - low).alias("words"))


def mix(rows: DataFrame, parts: list[Share]) -> DataFrame:
    """The mixed words: ``shard``, ``slot``, ``pass``, and the part of a row (``row``, ``start``, ``words``)
    that fills it. A block that spans rows gives a line for each; no block is taken more than three times."""
    slots = draw_blocks(rows.sparkSession, parts)
    return slots.join(segments(rows, parts), ["number", "block"]).select(
        "shard", "number", "slot", "pass", "row", "start", "words"
    )


def identified(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to the shared folder with ``row``, a number for each row, so that repeated ids stay
    apart and every later pass sees the same numbers."""
    return cut_lineage(docs.withColumn("row", F.monotonically_increasing_id()))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every row of ``docs``.

    ``taken`` are the words that the mix takes from the row, repeats counted: at most three times its size,
    and 0 for texts without words. Sources share the sum of all sizes by the repeating weights 1, 2, 3 in
    code point order, null last. Reruns over the same rows agree.
    """
    require(docs, ["doc_id", "text", "source"])
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    rows = identified(sized(own).drop("text"))
    parts = shares(rows)
    taken = mix(rows, parts).groupBy("row").agg(F.sum("words").alias("taken"))
    table = rows.sparkSession.createDataFrame(
        [(x.source, x.size, x.target) for x in parts], "_source string, source_size bigint, target double"
    )
    return (
        rows.join(taken, "row", "left")
        .join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each pass that takes words of a row.

    A row that a pass takes whole keeps its text; otherwise the text is the taken words, joined by
    spaces, in their order. ``n_chars``, if there, is that of the new text. Rows without words are in no
    block and so in no mix.
    """
    require(docs, ["doc_id", "text", "source"])
    clean = docs.drop("row", "size")
    rows = identified(sized(clean))
    parts = shares(rows)
    part = F.struct("start", "words")
    taken = mix(rows.select("row", "doc_id", F.col("source").cast("string").alias("source"), "size"), parts).groupBy(
        "row", "pass"
    ).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(part)).alias("parts"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = F.array_join(
        F.flatten(F.transform("parts", lambda p: F.slice(F.col("_words"), p["start"].cast("int") + 1, p["words"].cast("int")))), " "
    )
    joined = rows.join(taken, "row").withColumn("_words", F.when(F.col("taken") < F.col("size"), words))
    mixed = joined.withColumn("text", F.when(F.col("taken") < F.col("size"), chosen).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*clean.columns)
