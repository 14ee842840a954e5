"""Hard negatives by threshold joins: rows of another label that score close to a positive, but not closer.

A join finds all rows whose inner product with an anchor reaches the anchor's threshold. Dimensions are
taken in turn, the strongest first. A row is in the index of a dimension only if its norm from there on,
times the anchors', still reaches the lowest threshold; partial scores add up over the index, and pairs
whose remaining norms cannot lift them to the threshold are dropped before the rest is scored exactly.
Thresholds start high. Anchors whose windows have filled leave; the others go on with lower ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import require
from barloom.operators.spread import one_row
from barloom.session import cut_lineage

#: Thresholds of the rounds, as shares of the way from a window's lower to its upper end.
LEVELS = (0.75, 0.6, 0.0)
#: Rows of a block, at most about and, but for the last, at least: every anchor meets every block, so larger
#: blocks move fewer anchors, and smaller ones keep more tasks busy.
MOST_ROWS, LEAST_ROWS = 65_536, 1024
#: Dimensions added between two prunings; cells of partial scores, and components of pairs, held at once.
STRIDE, CELLS, GATHERED = 8, 1 << 22, 1 << 22
#: Once so small a share of the pairs is left, they are scored one by one.
FEW = 0.1
#: Doubles add whole numbers exactly below this.
EXACT = float(1 << 53)

_WINDOW = "struct<key:bigint,positive_id:bigint,positive_score:bigint,low:bigint,high:bigint,at:bigint>"
_HIT = "anchor bigint, key bigint, other bigint, other_id bigint, score bigint"


def vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``_row``, ``vec_id``, ``label``, ``vec`` (each component x as floor(scale * x)) and ``norm`` of the
    rows that have a label and only finite components, written to the shared folder."""
    require(rows, ["vec_id", "label", "embedding"])
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    kept = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return cut_lineage(
        kept.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("label").cast("bigint").alias("label"),
            whole.alias("vec"),
        ).withColumn("norm", norm)
    )


class _Block:
    """Rows of a block, their dimensions sorted by strength, with the norm of each row from each one on."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        self.rows, self.ids, self.labels = rows, ids, labels
        self.order = np.argsort(-np.abs(vecs).sum(axis=0), kind="stable") if vecs.size else np.arange(vecs.shape[1])
        self.vecs = np.ascontiguousarray(vecs[:, self.order])
        self.rest = _rest(self.vecs)

    def pairs(self, probes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, row, score) of all pairs whose inner product is at least the probe's threshold."""
        width = max(probes.shape[1], len(self.order))
        probes = np.pad(probes, [(0, 0), (0, width - probes.shape[1])])
        probes = np.concatenate([probes[:, self.order], probes[:, len(self.order) :]], axis=1)
        if not len(self.rows) or not len(probes):
            return tuple(np.zeros((3, 0), np.int64))
        if self.rest.max() * _rest(probes).max() >= EXACT:
            return self._plain(probes, at)
        probes = probes[:, : len(self.order)]
        rest, n_dims = _rest(probes), len(self.order)
        # Omit a row from the dimensions that cannot lift it to any threshold by themselves.
        indexed = (self.rest[:, :-1] * rest[:, :-1].max(axis=0) * (1 + 1e-9) + 1e-6 >= at.min()).sum(axis=1)
        indexed = np.minimum(-(-indexed // STRIDE) * STRIDE, n_dims)
        by_length = np.argsort(-indexed, kind="stable")
        lengths, vecs, norms = indexed[by_length], self.vecs[by_length], self.rest[by_length]
        partial = np.zeros((len(probes), len(vecs)))
        found: list[tuple] = []

        def reach(first: int, last: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
            bound = partial[:, first:last] + rest[:, dim, None] * norms[first:last, dim] * (1 + 1e-9) + 1e-6
            probe, row = np.nonzero(bound >= at[:, None])
            return probe, row + first

        left = int(np.searchsorted(-lengths, 0, side="left"))
        found.append(reach(left, len(vecs), 0))
        for dim in range(0, n_dims, STRIDE):
            stop = min(dim + STRIDE, n_dims)
            partial[:, :left] += probes[:, dim:stop] @ vecs[:left, dim:stop].T
            still = int(np.searchsorted(-lengths, -stop, side="left"))
            found.append(reach(still, left, stop))
            left = still
            alive = reach(0, left, stop)
            if len(alive[0]) <= FEW * len(probes) * left:
                found.append(alive)
                break
        probe, row = (np.concatenate(part) for part in zip(*found, strict=True))
        score = np.empty(len(probe))
        step = max(1, GATHERED // max(1, n_dims))
        for i in range(0, len(probe), step):
            own = slice(i, i + step)
            score[own] = np.einsum("ij,ij->i", probes[probe[own]], vecs[row[own]])
        keep = score >= at[probe]
        return probe[keep], by_length[row[keep]], score[keep].astype(np.int64)

    def _plain(self, probes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Whole numbers of any size; a score beyond 64 bits is an error.
        own = np.array([[int(x) for x in v] for v in self.vecs], object).reshape(len(self.rows), -1)
        wide = np.array([[int(x) for x in v] for v in probes], object).reshape(len(probes), -1)
        scores = wide[:, : own.shape[1]].dot(own.T)
        probe, row = np.nonzero(scores >= at.astype(object)[:, None])
        return probe, row, np.array([int(s) for s in scores[probe, row]], np.int64)


def _rest(vecs: np.ndarray) -> np.ndarray:
    """Norm of each row from each dimension on; the last column is 0."""
    squares = np.cumsum((vecs.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(vecs), 1))], axis=1))


def _matrix(column: pa.Array) -> np.ndarray:
    """List column as a matrix of doubles, or of Python integers where doubles can't hold them; shorter
    lists end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(object) if len(flat) and max(abs(int(flat.max())), abs(int(flat.min()))) >= EXACT else flat.astype(float)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(part.shape[1] for part in parts)
    return np.concatenate([np.pad(part, [(0, 0), (0, width - part.shape[1])]) for part in parts])


def _best(hits: tuple, block: _Block, anchors: pa.RecordBatch, labels: np.ndarray, same: bool, k: int) -> list[tuple]:
    """The first ``k`` hits of the block in each window of each anchor."""
    probe, row, score = hits
    own = anchors.column("_row").to_numpy()
    fits = (block.labels[row] == labels[probe]) == same
    fits &= block.rows[row] != own[probe]
    probe, row, score = probe[fits], row[fits], score[fits]
    order = np.lexsort((block.rows[row], block.ids[row], np.ma.getmaskarray(block.ids)[row], -score, probe))
    probe, row, score = probe[order], row[order], score[order]
    ends = np.searchsorted(probe, np.arange(len(own) + 1))
    out: list[tuple] = []
    for i in np.flatnonzero(np.diff(ends)).tolist():
        scores = score[ends[i] : ends[i + 1]]
        for window in anchors.column("windows")[i].as_py():
            first = int(np.searchsorted(-scores, -window["high"], side="left"))
            for j in range(first, min(first + k, len(scores))):
                if scores[j] < window["at"]:
                    break
                at = int(row[ends[i] + j])
                name = None if np.ma.getmaskarray(block.ids)[at] else int(block.ids[at])
                out.append((int(own[i]), window["key"], int(block.rows[at]), name, int(scores[j])))
    return out


def _ids(column: pa.Array) -> np.ma.MaskedArray:
    return np.ma.MaskedArray(column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False))


def _hits(rows: DataFrame, anchors: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """Rows of ``_HIT``: for each window the first ``k`` rows of each block between ``at`` and ``high``.

    Each block is one sorted run: its rows, which a task holds, and then all anchors, which pass by.
    """
    ddl = _HIT
    columns = [pa.int64()] * 5
    names = [part.split()[0] for part in _HIT.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column("block").to_numpy(), batch.column("kind").to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if current != key[a, 0]:
                    current, parts, block = key[a, 0], [], None
                if key[a, 1] == 0:
                    parts.append((part.column("_row").to_numpy(), _ids(part.column("vec_id")), part.column("label").to_numpy(), _matrix(part.column("vec"))))
                    continue
                if block is None:
                    if not parts:
                        continue
                    rows_, ids, labels, vecs = zip(*parts, strict=True)
                    block = _Block(np.concatenate(rows_), np.ma.concatenate(ids), np.concatenate(labels), _stacked(list(vecs)))
                    parts = [(block.rows, block.ids, block.labels, block.vecs)]
                yield from met(block, part)

    def met(block: _Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(block.rows))
        for i in range(0, len(part), step):
            some = part.slice(i, step)
            at = np.array([min(w["at"] for w in windows) for windows in some.column("windows").to_pylist()], float)
            labels = some.column("label").to_numpy()
            found = _best(block.pairs(_matrix(some.column("vec")), at), block, some, labels, same, k)
            if found:
                arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    shared = ["block", "kind", "_row", "vec_id", "label", "vec", "windows"]
    held = rows.select(
        F.pmod(F.xxhash64("_row"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "_row", "vec_id", "label", "vec",
        F.lit(None).cast(f"array<{_WINDOW}>").alias("windows"),
    )
    passing = anchors.withColumn("kind", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = held.unionByName(passing.select(F.col("block").cast("bigint").alias("block"), *shared[1:]))
    dealt = both.repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(search, ddl)


def _placed(hits: DataFrame, k: int) -> DataFrame:
    """Place of each hit in its window, up to ``k``."""
    order = [F.col("score").desc(), F.col("other_id").asc_nulls_last(), F.col("other").asc()]
    frame = Window.partitionBy("anchor", "key").orderBy(*order)
    return hits.withColumn("place", F.row_number().over(frame)).filter(F.col("place") <= k)


def nearest_in_windows(rows: DataFrame, anchors: DataFrame, same: bool, k: int, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """The first ``k`` rows by score, ties by smaller id, in every window of every anchor.

    ``rows`` and ``anchors`` come from ``vectors``; ``anchors`` has ``windows`` besides, an array of structs
    with ``key``, ``low`` and ``high`` among others. ``same`` asks for rows of the anchor's label (without
    itself) or of others. The result has ``anchor``, ``key``, ``other``, ``other_id``, ``score`` and
    ``place`` and is exact: the last threshold is the window's lower end.
    """
    n_rows = rows.count()
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_rows // MOST_ROWS), min(wanted, -(-n_rows // LEAST_ROWS)))
    pending, done = anchors, []
    for level in levels:
        at = lambda w: w["low"] + ((w["high"] - w["low"]) * F.lit(level)).cast("bigint")  # noqa: B023, E731
        leveled = pending.withColumn("windows", F.transform("windows", lambda w: w.withField("at", at(w))))  # noqa: B023
        best = cut_lineage(_placed(_hits(rows, leveled, blocks, same, k), k))
        if level == 0:
            done.append(best)
            break
        full = best.groupBy("anchor", "key").count().filter(F.col("count") >= k)
        done.append(best.join(full, ["anchor", "key"], "left_semi"))
        gone = full.groupBy(F.col("anchor").alias("_row")).agg(F.collect_set("key").alias("_full"))
        left = F.filter("windows", lambda w: F.coalesce(~F.array_contains("_full", w["key"]), F.lit(True)))
        pending = pending.join(gone, "_row", "left").withColumn("windows", left).drop("_full").filter(F.size("windows") > 0)
        pending = cut_lineage(pending)
        if pending.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _window(key: Column, positive_id: Column, positive_score: Column, low: Column, high: Column) -> Column:
    at = F.lit(0).cast("bigint")
    named = zip(("key", "positive_id", "positive_score", "low", "high", "at"), (key, positive_id, positive_score, low, high, at), strict=True)
    return F.struct(*[value.cast("bigint").alias(name) for name, value in named])


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256
) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` holds.

    ``rows`` has ``vec_id``, ``label`` and ``embedding``. The score of two rows is the integer inner product
    of their components times ``scale``, rounded down. An anchor's positives are its first ``positives``
    other rows of the same label; for each, the first ``negatives`` rows of other labels are returned whose
    score is within ``window`` hundredths of the positive's: ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score``, ``negative_score``. Higher scores come first, ties by smaller id,
    null ids last, and then by the place of the row.

    Rows with a null label, vector or component, or one that isn't finite, take no part. Vectors of
    different lengths are compared as if the shorter ended in zeros; empty ones score 0. Repeated rows are
    rows of their own, as anchors, positives and negatives. A null ``vec_id`` is no anchor if the condition
    is null for it. Anchors without positives, and positives without rows in their window, give no rows;
    an empty table gives none. Scores beyond 61 bits are an error. Other columns are ignored.
    """
    own = vectors(rows, scale)
    longest = own.agg(F.coalesce(F.ceil(F.max("norm")), F.lit(0)).alias("_longest"))
    chosen = own.filter(anchor).crossJoin(one_row(longest))
    bound = F.ceil(F.col("norm") * F.col("_longest") * (1 + 1e-9)) + 1
    none = F.lit(None)
    whole = F.array(_window(F.lit(0), none, none, -bound, bound))
    anchors = cut_lineage(chosen.select("_row", "vec_id", "label", "vec", whole.alias("windows")))
    found = nearest_in_windows(own, anchors, True, positives)

    low, high = window
    # Scores are whole numbers, so the ends of a window are rounded inwards.
    ends = _window(
        F.col("place"), F.col("other_id"), F.col("score"),
        F.expr(f"-((-{low} * score) div 100)") + F.when(F.expr(f"pmod({low} * score, 100L) > 0"), 1).otherwise(0),
        F.expr(f"({high} * score) div 100"),
    )
    open_ = found.filter("score >= 0").groupBy("anchor").agg(F.collect_list(ends).alias("windows"))
    pairs = cut_lineage(anchors.drop("windows").join(open_, F.col("_row") == F.col("anchor")).drop("anchor"))
    near = nearest_in_windows(own, pairs, False, negatives)
    windows = pairs.select(F.col("_row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.inline("windows"))
    return near.join(windows, ["anchor", "key"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
