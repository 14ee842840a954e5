"""Document fingerprints by Order MinHash, which notices moved and replaced text.

The k-mers of a text are numbered by occurrence. Each coordinate takes the few that its hash ranks lowest,
puts them back into the order of the text and hashes the tuple: two texts agree on a coordinate if they
share those k-mers in the same order, the more often the fewer edits lie between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import require

#: Characters of a k-mer, k-mers of a tuple, coordinates.
KMER, TUPLE, COORDINATES = 8, 2, 64
#: k-mers ranked at a time.
BLOCK = 2048
#: Most ranges of ids.
MOST_RANGES = 20_000

U64 = np.uint64
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_LAST = np.iinfo(np.uint32).max
_ROWS = np.arange(COORDINATES)
_RANKS = np.empty((COORDINATES, BLOCK), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def numbered_kmers(text: str) -> np.ndarray:
    """A 64-bit hash of each k-mer and its occurrence number, in the order of the text.

    A text shorter than a k-mer is one k-mer; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    if not len(codes):
        return np.empty(0, U64)
    k = min(KMER, len(codes))
    rolled, width = codes + U64(1), 1
    while 2 * width <= k:  # pairs of neighbours, of pairs, ...
        rolled = rolled[:-width] * U64(0x9E3779B97F4A7C15) + (rolled[width:] ^ (rolled[width:] >> U64(31)))
        width *= 2
    if width < k:  # two overlapping windows
        rolled = rolled[: width - k] * U64(0xC2B2AE3D27D4EB4F) + rolled[k - width :]
    kmers = _mix(rolled + U64(k))
    ranked = np.sort(kmers)
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(again):
        marks = np.zeros(1 << 16, bool)  # most k-mers are ruled out by 16 bits
        marks[again & U64(0xFFFF)] = True
        where = np.flatnonzero(marks[kmers & U64(0xFFFF)])
        near = np.minimum(np.searchsorted(again, kmers[where]), len(again) - 1)
        where = where[again[near] == kmers[where]]
        order = where[np.argsort(kmers[where], kind="stable")]
        starts = np.flatnonzero(np.diff(kmers[order], prepend=~kmers[order[0]]))
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        later = order[nth > 0]
        kmers[later] = _mix(kmers[later] + nth[nth > 0].astype(U64) * U64(0x9E3779B97F4A7C15))
    return kmers


class Minima:
    """The lowest k-mers of each coordinate over a beginning of a text, and where they are."""

    def __init__(self) -> None:
        self.at = np.full((TUPLE, COORDINATES), -1, np.int64)
        self.low = np.full((TUPLE, COORDINATES), _LAST, np.uint32)
        self.done = 0

    def copy(self) -> Minima:
        other = Minima()
        other.at, other.low, other.done = self.at.copy(), self.low.copy(), self.done
        return other

    def extend(self, kmers: np.ndarray, upto: int | None = None) -> Minima:
        """Take in ``kmers`` from where it stands."""
        places = (kmers[self.done : upto] >> U64(32)).astype(np.uint32)
        at, low = self.at, self.low
        for start in range(0, len(places), BLOCK):
            own = places[start : start + BLOCK]
            ranks = np.multiply(own, _FACTORS[:, None], out=_RANKS[:, : len(own)])
            ranks += _SHIFTS[:, None]
            for _ in range(min(TUPLE, len(own))):
                best = ranks.argmin(axis=1)
                value, place = ranks[_ROWS, best], best + (start + self.done)
                ranks[_ROWS, best] = _LAST
                for slot in range(TUPLE):  # insert, and carry on what it displaces
                    better = (place >= 0) & ((at[slot] < 0) | (value < low[slot]))
                    low[slot], value = np.where(better, value, low[slot]), np.where(better, low[slot], value)
                    at[slot], place = np.where(better, place, at[slot]), np.where(better, at[slot], place)
        self.done += len(places)
        return self

    def hashes(self, kmers: np.ndarray) -> np.ndarray:
        """The tuples in the order of the text, hashed to 32 bits; missing k-mers count as 0."""
        hashed = np.zeros(COORDINATES, U64)
        for place in np.sort(self.at, axis=0):
            part = np.where(place >= 0, kmers[np.maximum(place, 0)] if len(kmers) else U64(0), U64(0))
            hashed = _mix(hashed * U64(0x9E3779B97F4A7C15) + part + U64(1))
        return (hashed >> U64(32)).astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    """The 32-bit hashes of the coordinates' tuples. Texts without k-mers have hashes of empty tuples."""
    kmers = numbered_kmers(text)
    return Minima().extend(kmers).hashes(kmers)


def fingerprint_and_beginning(text: str) -> tuple[np.ndarray, Minima]:
    """The fingerprint, and the minima over the k-mers that lie in the part an edit leaves alone."""
    kmers = numbered_kmers(text)
    stays = len(text) - len(text) // 3 - KMER + 1
    minima = Minima().extend(kmers, max(0, stays))
    return minima.copy().extend(kmers).hashes(kmers), minima


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the coordinates that agree."""
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_following(docs: DataFrame) -> DataFrame:
    """Spread ``docs`` so that each document and the next one, by descending id, are in one partition.

    Ids fall into ranges of about equal row counts. Each range is a partition, sorted, with a guest at its
    end: the first document of the range that follows, or of the first range after the last. The texts
    move once; ranges' bounds and guests are at most ``MOST_RANGES`` rows. Null ids come last.
    """
    spark = docs.sparkSession
    ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", [float(c) for c in cuts], 10_000).alias("cuts")).first().cuts
    bounds = sorted(set(found or []))
    ranged = docs.withColumn(
        "bucket",
        F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id"))), F.lit(0))
        if bounds else F.lit(0),
    )
    ranged = ranged.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("bucket") + 1))
    firsts = {r.bucket: r.first for r in ranged.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()}
    held = sorted(firsts, reverse=True)
    guests = [(firsts[after], bucket) for bucket, after in zip(held, held[1:] + held[:1], strict=True)]
    visiting: dict = {}
    for doc_id, bucket in guests:
        visiting.setdefault(doc_id, []).append(bucket)
    known = spark.createDataFrame(list(visiting.items()), "_guest bigint, _visits array<int>")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    calls = F.transform(F.coalesce("_visits", F.array().cast("array<int>")), lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("guest")))
    return (
        ranged.join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("_guest")), "left")
        .select("doc_id", "text", F.explode(F.concat(F.array(own), calls)).alias("place"))
        .select("place.bucket", "place.guest", "doc_id", "text")
        .repartitionById(max(held, default=0) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    )


_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(own: tuple, after: tuple) -> tuple:
        doc_id, text, print_, beginning = own
        changed = edited(text, after[1])
        if changed == text:
            other = print_
        else:
            kmers = numbered_kmers(changed)
            other = beginning.extend(kmers).hashes(kmers)
        return (
            doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            print_.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(),
            likeness(print_, other), likeness(print_, after[2]),
        )

    waiting, bucket_of = None, None
    for batch in batches:
        rows = []
        for bucket, guest, doc_id, text in zip(*batch.columns, strict=True):
            if waiting is None and guest.as_py():
                continue  # repeated guests
            whole = text.as_py() or ""
            now = (doc_id.as_py(), whole, *fingerprint_and_beginning(whole))
            if waiting is not None and bucket_of == bucket.as_py():
                rows.append(row(waiting, now))
            waiting, bucket_of = (None if guest.as_py() else now), bucket.as_py()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _FIELDS, strict=True)],
                names=[name for name, _ in _FIELDS],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    Columns: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``, the likeness to the edited text and to the next document. The next
    one is that with the next smaller id; the first follows the last. Null texts count as empty, rows with
    equal ids follow each other by descending text, and null ids come last. A lone document is its own
    next.
    """
    require(docs, ["doc_id", "text"])
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_following(own).mapInArrow(
        _fingerprinted,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
