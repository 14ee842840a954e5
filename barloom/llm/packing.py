"""Packing token sequences into fixed-size training sequences.

Texts become token pieces of at most the capacity. How to fill sequences depends only on how many
pieces there are of each length, and there are at most ``capacity`` lengths: the driver solves the
configuration linear program over that histogram, rounds it to a plan, and the plan is joined back to
the pieces by their number within their length. Tokens never leave the tasks.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import require
from barloom.session import cut_lineage

#: Multiplicative weights: how sharply prices fall as a length gets covered, how much more than in proportion
#: long pieces are worth, the share of the tokens that may stay uncovered, and about how many steps a solve takes.
SHARPNESS, LONGER, UNCOVERED, RESOLUTION = 1.0, 0.3, 0.1, 1000
#: The least and the most of a length that one step covers.
STEPS = (0.02, 1.0)
#: Solves of the program, each on what rounding left over, before best fit takes the rest.
ROUNDS = 3


@lru_cache(maxsize=2)
def tokenizer(folder: str | None = None) -> Callable[[str], bytes]:
    """Ids of the public 50k byte-level BPE, as little-endian unsigned 32-bit bytes.

    ``folder`` holds the vocabulary; by default it is the installed package's. The vocabulary is read as
    ranks, which give the ids of its JSON form several times faster. As there, the text of the special
    token counts as that token.
    """
    import public_tokenizers as public
    import tiktoken

    path = f"{folder}/byte_bpe_50k.tiktoken" if folder else public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = "<|endoftext|>"
    encoding = tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={special: 50256}
    )

    def encode(text: str) -> bytes:
        ids = encoding.encode(text, allowed_special="all") if special in text else encoding.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    return encode


def token_pieces(
    docs: DataFrame, capacity: int = 1024, end_id: int = 2, with_ids: bool = True, folder: str | None = None
) -> DataFrame:
    """Token pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``
    and, with ``with_ids``, ``ids`` as little-endian unsigned 32-bit bytes.

    A document is the ids of its whole text and then ``end_id``; a null or empty text is ``end_id``
    alone. Longer ones than ``capacity`` are cut so that all pieces but the first are full. Repeated
    rows give repeated pieces; a null ``doc_id`` stays null.
    """
    require(docs, ["doc_id", "text"])
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(folder), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                begin, stop = 0, (n - 1) % capacity + 1
                piece = 0
                while begin < n:
                    own = ids[4 * begin : 4 * stop]
                    row = (doc_id.as_py(), piece, begin, stop - begin, zlib.crc32(own))
                    rows.append((*row, own) if with_ids else row)
                    begin, stop, piece = stop, stop + capacity, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                    schema=schema,
                )

    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, ddl + ", ids binary" * with_ids)


def _priced(
    lengths: np.ndarray, values: np.ndarray, counts: np.ndarray, capacity: int
) -> tuple[dict[int, int], float]:
    """The most valuable filling of one sequence: a knapsack by dynamic programming over the capacity.

    Returns position in ``lengths`` -> pieces, and the value. A length that has too few pieces for the
    filling is cut back to what it has; the value is that of the filling before.
    """
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = upto[room]
        if k:
            gains = best[room - lengths[:k]] + values[:k]
            top = int(gains.argmax())
            if gains[top] > best[room]:
                best[room], taken[room] = gains[top], top
    filling: dict[int, int] = {}
    room = capacity
    while room > 0:
        top = int(taken[room])
        if top < 0:
            room -= 1
            continue
        if filling.get(top, 0) < counts[top]:
            filling[top] = filling.get(top, 0) + 1
        room -= int(lengths[top])
    return filling, float(best[capacity])


def _topped_up(filling: dict[int, int], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Fill the room that is left with the longest pieces that fit."""
    room = capacity - sum(int(lengths[i]) * m for i, m in filling.items())
    i = int(np.searchsorted(lengths, room, side="right")) - 1
    while i >= 0 and room >= lengths[0]:
        more = min(int(counts[i]) - filling.get(i, 0), room // int(lengths[i]))
        if more > 0:
            filling[i] = filling.get(i, 0) + more
            room -= more * int(lengths[i])
        i = min(i - 1, int(np.searchsorted(lengths, room, side="right")) - 1)
    return filling


def fractional_fillings(
    lengths: np.ndarray, counts: np.ndarray, capacity: int
) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A near-optimal solution of the configuration program, fillings and how often each is used, and a
    number of sequences that no packing goes below.

    Multiplicative weights: prices start a little above proportion for long pieces, so that these are
    covered first and short ones remain, and fall as a length gets covered. Each step takes the filling of
    the highest total price and uses it until some length's cover has grown by a step; fewer lengths get
    smaller steps. Prices divided by those of the dearest filling solve the dual program, whose value bounds
    the number of sequences from below.
    """
    step = min(max(len(lengths) / RESOLUTION, STEPS[0]), STEPS[1])
    covered, tokens = np.zeros(len(lengths)), counts * lengths
    used: dict[tuple, float] = {}
    least = tokens.sum() / capacity
    while (tokens * np.clip(1 - covered, 0, 1)).sum() > UNCOVERED * tokens.sum():
        worth = lengths * (1 + LONGER * lengths / capacity) * np.exp(-SHARPNESS * (covered - covered.min()))
        prices = np.where(covered < 1, worth, 0)
        filling, value = _priced(lengths, prices, counts, capacity)
        least = max(least, float(prices @ counts) / value)
        filling = _topped_up(filling, lengths, counts, capacity)
        at, times = np.array(list(filling)), np.array(list(filling.values()), float)
        amount = step * float((counts[at] / times).min())
        covered[at] += amount * times / counts[at]
        key = tuple(sorted(filling.items()))
        used[key] = used.get(key, 0.0) + amount
    return [(dict(key), amount) for key, amount in used.items()], least


def _best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over counts of equal lengths."""
    plan, left = [], counts.copy()
    for i in range(len(lengths) - 1, -1, -1):
        while left[i] > 0:
            filling = _topped_up({i: 1}, lengths, left, capacity)
            times = int(min(left[j] // m for j, m in filling.items()))
            for j, m in filling.items():
                left[j] -= times * m
            plan.append((filling, times))
    return plan


@dataclass
class Plan:
    """Fillings, as lists of (length, pieces), with the number of sequences that use each; the sequences that
    no packing goes below; and the pieces that best fit placed."""

    fillings: list[tuple[list[tuple[int, int]], int]]
    least: float
    by_best_fit: int


def plan_sequences(histogram: dict[int, int], capacity: int) -> Plan:
    """A plan that places every piece of the histogram exactly once.

    The fractional solution is rounded down, but every filling that still fits is used once at least, those
    with the longest pieces first. The program is solved again for what is left, and best fit places the
    rest, mostly short pieces.
    """
    lengths = np.array(sorted(histogram), int)
    left = np.array([histogram[n] for n in lengths.tolist()], int)
    plan: list[tuple[dict[int, int], int]] = []
    least = 0.0
    for turn in range(ROUNDS):
        keep = np.flatnonzero(left)
        if not len(keep):
            break
        part, bound = fractional_fillings(lengths[keep], left[keep].astype(float), capacity)
        least = bound if turn == 0 else least
        for filling, amount in sorted(part, key=lambda x: (-max(x[0]), -x[1])):
            own = {int(keep[i]): m for i, m in filling.items()}
            times = min(max(1, int(amount)), *(int(left[i]) // m for i, m in own.items()))
            if times > 0:
                for i, m in own.items():
                    left[i] -= times * m
                plan.append((own, times))
    rest = int(left.sum())
    plan += _best_fit(lengths, left, capacity)
    return Plan([([(int(lengths[i]), m) for i, m in sorted(f.items())], times) for f, times in plan], least, rest)


def _places(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, per, sequence, offset): pieces first..last of a length fill
    ``per`` neighbouring places from ``offset`` in the sequences from ``sequence`` on."""
    rows, sequence, given = [], 0, {}
    for filling, times in plan:
        offset = 0
        for length, per in filling:
            first = given.get(length, 0) + 1
            given[length] = first + per * times - 1
            rows.append((length, first, given[length], per, sequence, offset))
            offset += per * length
        sequence += times
    return rows


def place_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``length``.

    The pieces are written to the shared folder once, each with its number among those of its length in the
    task that wrote it; counts per task and length turn that into a number among all of the length, so
    nothing is sorted. The lengths are counted, the plan is made on the driver from at most ``capacity``
    counts, and the plan's rows are broadcast: each is a length in a filling, and the fillings number at most
    a few thousand for any input. An empty table gives an empty table.
    """
    names = [*pieces.columns, "_task", "_nth"]
    schema = T.StructType([*pieces.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            sizes = np.bincount(length, minlength=capacity + 1)
            firsts = np.cumsum(sizes) - sizes
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - firsts[length[order]] + seen[length[order]] + 1
            seen += sizes
            tasks = pa.array(np.full(len(length), task, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, tasks, pa.array(nth)], names=names)

    numbered = cut_lineage(pieces.mapInArrow(number, schema))
    counts = cut_lineage(numbered.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {int(n): int(c) for n, c in counts.groupBy("length").agg(F.sum("_n")).collect()}
    rows = _places(plan_sequences(histogram, capacity).fillings)
    schema = "_length bigint, _first bigint, _last bigint, _per bigint, _sequence bigint, _offset bigint"
    places = pieces.sparkSession.createDataFrame(rows, schema)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = numbered.join(offsets, ["_task", "length"]).withColumn("_rank", F.col("_nth") + F.col("_before"))
    fits = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    nth = F.col("_rank") - F.col("_first")
    return (
        ranked.join(F.broadcast(places), fits)
        .withColumn("sequence_id", F.col("_sequence") + F.expr("(_rank - _first) div _per"))
        .withColumn("offset", F.col("_offset") + F.pmod(nth, F.col("_per")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece."""
    return place_pieces(token_pieces(docs, capacity, end_id, with_ids), capacity)
