"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds the vectors of its letters, each
permuted by its place, and a text's vector bundles those of its trigrams. Languages are the bundles of
their texts, and a text is of the language whose bundle has the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import require

#: Dimensions, languages at most, trigrams whose vectors a task remembers.
DIMENSIONS, MOST_LANGUAGES, REMEMBERED = 1024, 10_000, 30_000
UNKNOWN = "und"
_GAP = 32


@dataclass(frozen=True)
class LanguageModel:
    """Language names and their unit vectors, less what all languages share."""

    names: list[str]
    profiles: np.ndarray
    shared: np.ndarray


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the lower-cased text and their counts; a gap stands for what is no letter.

    A text without letters has none.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.concatenate([[_GAP], np.where(letter, codes, _GAP), [_GAP]]).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _GAP) | (codes[:-1] != _GAP)
    codes = codes[keep]
    grams = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return np.unique(grams, return_counts=True)


class Vectors:
    """Trigram vectors, made on demand from the code points alone, so that all tasks agree."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((REMEMBERED, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([11, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = bits * np.int8(2) - np.int8(1)
        return self.letters[code]

    def bound(self, gram: int) -> np.ndarray:
        first, second, third = (self.letter((gram >> shift) & 0x1FFFFF) for shift in (42, 21, 0))
        return np.roll(first, 2) * np.roll(second, 1) * third

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors times their counts, exact for counts below 2^24 in all."""
        total = np.zeros(self.dimensions, np.float64)
        for start in range(0, len(grams), 4096):
            own = grams[start : start + 4096].tolist()
            if len(self.rows) + len(own) > REMEMBERED:
                self.rows.clear()
            at = np.empty(len(own), np.int64)
            for i, gram in enumerate(own):
                row = self.rows.get(gram)
                if row is None:
                    row = self.rows[gram] = len(self.rows)
                    self.table[row] = self.bound(gram)
                at[i] = row
            total += counts[start : start + 4096].astype(np.float32) @ self.table[at].astype(np.float32)
        return total


@lru_cache(maxsize=1)
def _vectors() -> Vectors:
    return Vectors()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language, sent on whenever many are held."""
    held: dict[tuple[str, int], int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in held], pa.string()), pa.array([g for _, g in held], pa.int64()),
             pa.array(list(held.values()), pa.int64())],
            names=["lang", "gram", "n"],
        )

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py()
            for gram, n in zip(*(x.tolist() for x in trigrams(text.as_py() or "")), strict=True):
                held[name, gram] = held.get((name, gram), 0) + n
            if len(held) > 200_000:
                yield out()
                held.clear()
    if held:
        yield out()


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundle what each task has of a language: one row per language and dimension."""
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        grams = batch.column(1).to_numpy().astype(np.uint64)
        counts = batch.column(2).to_numpy()
        for name in sorted(set(names.tolist())):
            own = names == name
            total = np.zeros(DIMENSIONS, np.int64)
            for start in range(0, int(own.sum()), 4096):
                part = slice(start, start + 4096)
                vectors = np.array([_vectors().bound(int(g)) for g in grams[own][part]], np.int64)
                total += counts[own][part] @ vectors
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS, pa.string()), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)],
                names=["lang", "dimension", "value"],
            )


def fit(docs: DataFrame) -> LanguageModel:
    """Bundle the texts of each language of ``docs`` (``text``, ``lang``), all of them and whole.

    Counts of trigrams are added up before they are bundled, in whole numbers, so that reruns agree. Rows
    without a language or without letters teach nothing. The profiles come to the driver, one per
    language, at most ``MOST_LANGUAGES``.
    """
    require(docs, ["text", "lang"])
    rows = docs.filter("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    bundles = (
        counts.mapInArrow(_bundled, "lang string, dimension int, value bigint")
        .groupBy("lang", "dimension")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "value"))), lambda x: x["value"]).alias("bundle"))
        .limit(MOST_LANGUAGES + 1)
        .collect()
    )
    if len(bundles) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    bundles.sort(key=lambda row: row.lang)
    if not bundles:
        return LanguageModel([], np.empty((0, DIMENSIONS)), np.zeros(DIMENSIONS))
    raw = np.array([row.bundle for row in bundles], float)
    unit = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    # What all languages have in common says nothing; a single language keeps its bundle.
    shared = unit.mean(axis=0) if len(unit) > 1 else np.zeros(DIMENSIONS)
    rest = unit - shared
    return LanguageModel(
        [row.lang for row in bundles], rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12), shared
    )


def classify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the cosine, from 0 to 1) to every row of ``docs``.

    The whole text counts. Null texts, texts without letters, and all texts under a model without
    languages, are ``und`` with score 0. Ties go to the first language by name. Existing columns of these
    names are replaced.
    """
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index("text")
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _vectors()
        for batch in batches:
            names, scores = [], []
            for text in batch.column(at):
                grams, counts = trigrams(text.as_py() or "")
                name, cosine = UNKNOWN, 0.0
                if len(grams) and model.names:
                    own = vectors.bundle(grams, counts)
                    own /= max(float(np.linalg.norm(own)), 1e-12)
                    own -= model.shared
                    near = model.profiles @ (own / max(float(np.linalg.norm(own)), 1e-12))
                    best = int(near.argmax())
                    name, cosine = model.names[best], min(1.0, max(0.0, float(near[best])))
                names.append(name)
                scores.append(cosine)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return rest.mapInArrow(run, schema)
