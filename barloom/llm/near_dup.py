"""Near-duplicate documents: circulant MinHash, banding and exact verification on word shingles.

Two fixed permutations give all signature coordinates: one scatters the shingles over a circle of 2^32
places, the other, turned by one place for each coordinate, ranks them. Documents that agree on all
rows of a band share a bucket.

Buckets are resolved without emitting their pairs. Documents with equal shingle sets collapse to the
one with the smallest id. Then each bucket's pivot, the member that shares buckets with the most
documents, is compared with the others, which settles a bucket of near copies. Where a bucket's other members are in several
components, these members are compared across components wherever their rarest shingles meet, which
misses no pair above the threshold and meets few below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import require
from barloom.llm.components import connect
from barloom.session import cut_lineage

#: Words of a shingle, and bands x rows of the signature. Two documents at the threshold of 0.75 share
#: no band with a probability of (1 - 0.75^4)^32, about 5 in a million.
SHINGLE, BANDS, ROWS = 5, 32, 4
#: Shingles hashed at a time.
BLOCK = 1 << 15
U64 = np.uint64
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F], dtype=U64)


def _mix64(x: np.ndarray, a: int = 0xFF51AFD7ED558CCD, b: int = 0xC4CEB9FE1A85EC53) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * U64(a)
    x = x ^ (x >> U64(29))
    x = x * U64(b)
    return x ^ (x >> U64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles, A-Z lower-cased.

    A text of fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    hashed = np.fromiter(map(xxh3_64_intdigest, words), U64, len(words))
    n = len(words) - SHINGLE + 1
    if n < 1:
        mixed = (hashed * _WEIGHTS[: len(words)]).sum(dtype=U64) + U64(len(words))
        return _mix64(np.array([mixed], U64))
    total = np.zeros(n, U64)
    for i in range(SHINGLE):
        total += _mix64(hashed[i : i + n] + _WEIGHTS[i])
        total *= _WEIGHTS[0]
    return np.unique(_mix64(total))


def _circulant_minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signature of each set: rows are the BANDS x ROWS coordinates."""
    scattered = _mix64(shingles, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93).astype(np.uint32)
    minima = np.empty((BANDS * ROWS, len(starts)), np.uint32)
    x, y = np.empty_like(scattered), np.empty_like(scattered)
    for turn in range(BANDS * ROWS):
        # The second permutation, turned: it ranks place + turn on the circle.
        np.add(scattered, np.uint32(turn), out=x)
        for shift, factor in ((16, 0x21F0AAAD), (15, 0xD35A2D97)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        minima[turn] = np.minimum.reduceat(x, starts)
    return minima


def _band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.empty((minima.shape[1], BANDS), U64)
    for band in range(BANDS):
        key = np.full(minima.shape[1], band + 1, U64)
        for row in range(ROWS):
            key = _mix64(key * _WEIGHTS[1] + minima[band * ROWS + row].astype(U64) + _WEIGHTS[2])
        keys[:, band] = key
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(ids: list, sets: list) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        keys = np.zeros((len(sets), BANDS), U64)
        digests = np.zeros((len(sets), 2), U64)
        full = np.flatnonzero(sizes)
        if len(full):
            joined = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            keys[full] = _band_keys(_circulant_minima(joined, starts))
            digests[full, 0] = np.add.reduceat(_mix64(joined + _WEIGHTS[3]), starts)
            digests[full, 1] = np.add.reduceat(_mix64(joined + _WEIGHTS[4]), starts)
        offsets = np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests[:, 0].view(np.int64)),
             pa.array(digests[:, 1].view(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))],
            names=["doc_id", "n_shingles", "d1", "d2", "bands"],
        )

    for batch in batches:
        ids: list = []
        sets: list = []
        held = 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            sets.append(shingle_set(text.as_py()))
            held += len(sets[-1])
            if held >= BLOCK:
                yield flush(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            own = shingle_set(text.as_py()).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_id.as_py()], pa.int64()), pa.ListArray.from_arrays([0, len(own)], pa.array(own))],
                names=["id", "shingles"],
            )


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (``u``, ``v``) whose full shingle sets (``id``, ``shingles``) are similar enough."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    union = F.size("a") + F.size("b") - F.col("common")
    return (
        pairs.join(left, "u")
        .join(right, "v")
        .withColumn("common", F.size(F.array_intersect("a", "b")))
        .filter(100 * F.col("common") >= 75 * union)
        .select("u", "v")
    )


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components that ``links`` between their members join. ``labels`` has ``id``, ``label``."""
    by_u = labels.select(F.col("id").alias("u"), F.col("label").alias("a"))
    by_v = labels.select(F.col("id").alias("v"), F.col("label").alias("b"))
    between = links.join(by_u, "u").join(by_v, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connect(between).select(F.col("u").alias("label"), F.col("v").alias("root"))
    return cut_lineage(labels.join(roots, "label", "left").select("id", F.coalesce("root", "label").alias("label")))


def _similar_size(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= 75 * F.greatest(n, m)


def _prefix_pairs(live: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ``live`` documents (``id``, ``label``) of different components that can be similar enough.

    Of two documents above the threshold, each has at least one of the other's rarest quarter of shingles
    among its own rarest quarter, by one common order. Shingles that no other document has lead nowhere, so
    documents that are a quarter their own drop out unseen. For each shingle, the holders outside its most
    frequent component meet all holders, so members of one component don't meet.
    """
    held = live.join(sets, "id").select("id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = held.groupBy("s").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    ranked = (
        held.join(often, "s")
        .groupBy("id", "label", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("shared"))
    )
    # The rarest quarter, less the shingles that are a document's own and come first.
    own = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(0.75 * F.col("n")).cast("int") + 1 - own
    prefix = cut_lineage(
        ranked.filter(length > 0)
        .select("id", "label", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), length)).alias("at", "x"))
        .select("id", "label", "n", F.col("x.s").alias("s"), (F.col("n") - F.col("own") - F.col("at")).alias("left"))
    )
    by_label = prefix.groupBy("s", "label").agg(F.count(F.lit(1)).alias("held"))
    mixed = (
        by_label.groupBy("s")
        .agg(F.min("label").alias("lowest"), F.max("label").alias("highest"), F.max_by("label", "held").alias("main"))
        .filter("lowest <> highest")
        .select("s", "main")
    )
    few = prefix.join(mixed, "s").filter("label <> main").select(
        "s", F.col("id").alias("p"), F.col("label").alias("pl"), F.col("n").alias("pn"), F.col("left").alias("pleft")
    )
    # From the first shingle that a pair shares, no more can follow than either has left.
    reachable = 7 * F.least("left", "pleft") >= 3 * (F.col("n") + F.col("pn"))
    return (
        few.join(prefix, "s")
        .filter((F.col("label") != F.col("pl")) & reachable & _similar_size(F.col("n"), F.col("pn")))
        .select(F.greatest("p", "id").alias("u"), F.least("p", "id").alias("v"))
        .distinct()
    )


def _components(members: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """Labels (``id``, ``label``) of the representatives that share a bucket with another.

    ``members`` has ``bucket``, ``rep`` and ``n``; ``known`` has links that need no check.
    """
    shared = members.groupBy("bucket").agg(
        F.min("rep").alias("lowest"), F.max("rep").alias("highest"), F.count(F.lit(1)).alias("held")
    )
    met = cut_lineage(
        members.join(shared.filter("lowest <> highest"), "bucket").select("bucket", "rep", "n", "held")
    )
    # The member that shares buckets with the most documents is the least changed copy.
    central = met.groupBy("rep").agg(F.sum("held").alias("met"))
    pivots = met.join(central, "rep").groupBy("bucket").agg(F.max_by("rep", "met").alias("pivot"))
    rows = cut_lineage(met.join(pivots, "bucket").select("bucket", "rep", "n", "pivot"))
    sizes = rows.filter("rep = pivot").select("bucket", F.col("n").alias("pn")).distinct()
    pairs = cut_lineage(
        rows.filter("rep <> pivot").join(sizes, "bucket").filter(_similar_size(F.col("n"), F.col("pn")))
        .select(F.greatest("rep", "pivot").alias("u"), F.least("rep", "pivot").alias("v"))
        .distinct()
    )
    involved = rows.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut_lineage(
        docs.join(involved, "doc_id", "left_semi").mapInArrow(_sets, "id bigint, shingles array<bigint>")
    )
    ids = involved.select(F.col("doc_id").alias("id")).union(known.select("u")).union(known.select("v")).distinct()
    labels = _relabel(
        ids.withColumn("label", F.col("id")), _confirmed(pairs, sets).union(known.select("u", "v"))
    )
    # The pivot has met its bucket. The others have something left to meet if they are in several components.
    others = rows.filter("rep <> pivot").select("bucket", F.col("rep").alias("id")).join(labels, "id")
    unsettled = others.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    live = cut_lineage(others.join(unsettled, "bucket", "left_semi").select("id", "label").distinct())
    return _relabel(labels, _confirmed(cut_lineage(_prefix_pairs(live, sets)), sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Documents are linked if their shingle sets have a Jaccard similarity of at least 0.75, checked on
    the full sets; ``component_id`` is the smallest id that can be reached over links, and the document
    that bears it is ``kept``. Texts without words, null ones included, have no shingles and no links.
    Rows with words that share an id share a component. A row with a null id is in none and is kept.
    """
    require(docs, ["doc_id", "text"])
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = cut_lineage(
        docs.mapInArrow(_sketch, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")
    )
    has_words = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    digest = ["n_shingles", "d1", "d2"]
    found = sketch.filter(has_words)
    first = found.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    ids = cut_lineage(found.select("doc_id", *digest).join(first, digest).select("doc_id", "n_shingles", "rep"))
    # An id with several texts links the groups that they are in.
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("highest")).filter("v <> highest")
    known = ids.join(several, "doc_id").select(F.col("rep").alias("u"), "v").filter("u <> v")
    members = (
        found.withColumnRenamed("doc_id", "rep")
        .join(first, [*digest, "rep"], "left_semi")
        .dropDuplicates([*digest, "rep"])
        .select("rep", F.explode("bands").alias("bucket"), F.col("n_shingles").alias("n"))
    )
    labels = _components(members, docs, known)
    with_words = ids.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id")
    )
    alone = sketch.filter(~F.coalesce(has_words, F.lit(False))).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return with_words.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns; of several rows with one id,
    one. Rows with a null id stay."""
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return one.union(docs.filter("doc_id is null"))
