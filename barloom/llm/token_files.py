"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A file holds the ids of its documents one after another in two or four bytes each. Where a document starts
is a rising sequence, and so are the ids of the documents; both are stored in about two bits a document
more than their spread needs, and a directory of 32-bit counts finds any entry without reading the others.
Documents are sorted by id over all files; a table beside the files lists those that belong to the result.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import require
from barloom.operators.spread import running_total
from barloom.session import scratch_path

MAGIC = b"BLTOKEN1"
#: magic, bytes an id, documents, ids, documents without an id, smallest document id, lengths of the two indexes
HEADER = struct.Struct("<8sIQQQqQQ")
#: low bits an entry, entries, bits of the high part
INDEX = struct.Struct("<IQQ")
#: The directory counts the entries before each block of so many bits.
BLOCK_BITS = 512
#: Distinct pieces of text whose ids a worker remembers, and the characters it encodes at once.
REMEMBERED, AT_ONCE = 700_000, 1 << 20
#: Ids in one Arrow batch, unless one document has more.
BATCH_IDS = 1 << 20
SPECIAL = "<|endoftext|>"
# The vocabulary's splitting pattern, with the letters and digits there are up to Latin Extended-B.
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
)
#: Characters beyond those, and control characters that count as white space in one library only.
OTHER = re.compile("[^\x00-\x1b\x20-ɏ]")


@dataclass
class EliasFano:
    """A rising sequence of non-negative integers: ``low`` bits of each as they are, the rest in unary."""

    bits: int
    n: int
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        own = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        blocks = ((int(at[-1]) if n else 0) // BLOCK_BITS) + 1
        high = np.zeros(blocks * BLOCK_BITS, np.uint8)
        high[at] = 1
        ones = high.reshape(blocks, BLOCK_BITS).sum(axis=1)
        counts = (np.cumsum(ones) - ones).astype("<u4")
        pack = np.packbits
        return cls(bits, n, pack(own.astype(np.uint8).ravel(), bitorder="little"), pack(high, bitorder="little"), counts)

    def to_bytes(self) -> bytes:
        head = INDEX.pack(self.bits, self.n, 8 * len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.counts.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        bits, n, high_bits = INDEX.unpack_from(data)
        low_end = INDEX.size + (bits * n + 7) // 8
        high_end = low_end + high_bits // 8
        part = lambda a, b: np.frombuffer(data, np.uint8, b - a, a)
        counts = np.frombuffer(data, "<u4", high_bits // BLOCK_BITS, high_end)
        return cls(bits, n, part(INDEX.size, low_end), part(low_end, high_end), counts)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        values = np.zeros(len(i), np.uint64)
        for bit in range(self.bits):
            at = i * self.bits + bit
            values |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(bit)
        return values

    def select(self, i: np.ndarray | Sequence[int]) -> np.ndarray:
        """Entries at the positions ``i``: the directory names the block, whose bits are then counted."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.counts, i, side="right") - 1
        stored = self.high.reshape(-1, BLOCK_BITS // 8)[block]
        nth = np.cumsum(np.unpackbits(stored, axis=1, bitorder="little"), axis=1, dtype=np.int32)
        within = (nth <= (i - self.counts[block])[:, None]).sum(axis=1)
        highs = (block * BLOCK_BITS + within - i).astype(np.uint64)
        return (highs << np.uint64(self.bits)) | self._lows(i)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        i = np.arange(self.n)
        highs = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - i
        return (highs.astype(np.uint64) << np.uint64(self.bits)) | self._lows(i)


def encode_file(doc_ids: Sequence[int | None], ids: Sequence[bytes]) -> bytes:
    """A file of documents: their ids, rising with nulls last, and their token ids as little-endian u32."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    names = EliasFano.of(known.astype(np.uint64) - np.uint64(first % 2**64)).to_bytes()
    ends = EliasFano.of(np.cumsum([0] + [len(own) // 4 for own in ids])).to_bytes()
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    head = HEADER.pack(MAGIC, width, len(ids), len(flat), len(ids) - len(known), first, len(ends), len(names))
    return head + ends + names + flat.astype(f"<u{width}").tobytes()


class TokenFile:
    """Random access to one file. ``opened`` is any binary file that can seek."""

    def __init__(self, opened) -> None:
        self._file = opened
        magic, self.width, self.n_docs, self.n_ids, self._nulls, self._first, ends, names = HEADER.unpack(
            opened.read(HEADER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends = EliasFano.from_bytes(opened.read(ends))
        self.names = EliasFano.from_bytes(opened.read(names))
        self._begin = HEADER.size + ends + names

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` of the concatenation."""
        self._file.seek(self._begin + start * self.width)
        return np.frombuffer(self._file.read((stop - start) * self.width), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of the ``i``-th document."""
        start, stop = self.ends.select([i, i + 1]).tolist()
        return self.ids(start, stop)

    def doc_ids(self) -> list[int | None]:
        known = (self.names.all() + np.uint64(self._first % 2**64)).astype(np.int64).tolist()
        return known + [None] * self._nulls


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None) -> Callable[[list[str]], list[bytes]]:
    """Token ids of texts by a byte-level BPE of the tokenizers library, as little-endian u32 bytes.

    A byte-level BPE encodes the pieces of its splitting pattern one by one, so each distinct piece is
    encoded once and remembered. Texts with characters that the pattern here does not cover, and texts that
    hold the special token, are encoded whole.
    """
    import public_tokenizers as public
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(vocabulary or public.path("byte_bpe_50k.json"))
    known: dict[str, bytes] = {}

    def learn(missing: list[str]) -> None:
        found = bpe.encode(missing, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        at = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(missing) + 1))).tolist()
        known.update((piece, ids[a:b]) for piece, a, b in zip(missing, at, at[1:], strict=False))

    def encode(texts: list[str]) -> list[bytes]:
        whole = [SPECIAL in text or OTHER.search(text) is not None for text in texts]
        split = [[] if other else PIECES.findall(text) for text, other in zip(texts, whole, strict=True)]
        if len(known) > REMEMBERED:
            known.clear()
        missing = set(chain.from_iterable(split)).difference(known)
        if missing:
            learn(list(missing))
        ids = known.__getitem__
        return [
            np.array(bpe.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if other else b"".join(map(ids, own))
            for text, other, own in zip(texts, whole, split, strict=True)
        ]

    return encode


def _at_once(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``AT_ONCE`` characters."""
    start = size = 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= AT_ONCE or i == len(texts):
            yield slice(start, i)
            start, size = i, 0


def _opened(folder: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


MANIFEST = "part int, seq int, name string, n_docs bigint, n_ids bigint"


def write_token_files(
    docs: DataFrame, folder: str, end_id: int = 0, ids_per_file: int = 1 << 22, vocabulary: str | None = None
) -> None:
    """Encode every whole text, append ``end_id`` and write files of about ``ids_per_file`` ids to ``folder``.

    Documents stand in ascending order of ``doc_id``; those without one come last, and rows of one id in
    the order of their text's hash. A null text is empty; repeated rows are repeated documents; an empty
    table gives no files. Other columns are ignored. The rows are range-sorted once, so that any share of
    them may have one id. Every attempt of a task writes files of its own name; ``folder/manifest``, a
    Parquet table, names those of the attempts that counted.
    """
    require(docs, ["doc_id", "text"])
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        storage, path = _opened(folder)
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tokens"
            with storage.open_output_stream(f"{path}/{name}") as out:
                out.write(encode_file(doc_ids, ids))
            row = [part], [seq], [name], [len(ids)], [held]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for run in _at_once(texts):
                for doc_id, own in zip(names[run], encode(texts[run]), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(own + end)
                    held += len(own) // 4 + 1
                    if held >= ids_per_file:
                        yield flush()
                        doc_ids, ids, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    storage, path = _opened(folder)
    storage.create_dir(path, recursive=True)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = source.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
    placed.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files of ``folder``: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` as little-endian unsigned 32-bit bytes."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    total = running_total(manifest, [], [F.col("part"), F.col("seq")], "n_ids", "stop")
    files = total.select("name", (F.col("stop") - F.col("n_ids")).alias("base"))
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, path = _opened(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with storage.open_input_file(f"{path}/{name}") as opened:
                    yield from documents(TokenFile(opened), base)

    def documents(file: TokenFile, base: int) -> Iterator[pa.RecordBatch]:
        ends, doc_ids, i = file.ends.all().astype(np.int64), file.doc_ids(), 0
        while i < file.n_docs:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + BATCH_IDS, side="right")) - 1)
            own = file.ids(int(ends[i]), int(ends[j])).tobytes()
            at = (4 * (ends[i : j + 1] - ends[i])).tolist()
            columns = [
                pa.array(doc_ids[i:j], pa.int64()),
                pa.array(base + ends[i:j]),
                pa.array(np.diff(ends[i : j + 1])),
                pa.array([own[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)
            i = j

    # One file to a task, however few rows name them.
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def encoded(docs: DataFrame, end_id: int = 0) -> DataFrame:
    """Write the documents to files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, end_id)
    return read_token_files(docs.sparkSession, folder)
