"""Toxicity by multiple-instance learning: sentences are scored, only documents are labelled.

A document's score is the noisy-or of its sentences' scores, so training on document labels makes the
sentences that explain a toxic label score high, and scoring then points at them. A sentence is
described by its words and their first letters; the features are those that the labels make suspicious.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import require

#: Bounds of the training sample (labelled documents, drawn by a hash of the id) and of the features.
SAMPLE_ROWS, FEATURES = 20_000, 4096
#: A feature needs this many toxic documents and this much evidence (likelihood ratio, G).
LEAST_TOXIC, LEAST_EVIDENCE = 3, 12.0
STEPS, RATE, PRIOR = 400, 0.1, 3.0
PREFIXES = (4, 5)

_SENTENCES = re.compile(r"[.!?\n\r]+")
_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """Log-odds that each feature adds to a sentence's, and the log-odds of a sentence that has any."""

    weights: dict[str, float]
    bias: float


def sentence_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the pieces between full stops, exclamation and question marks and line ends."""
    start = 0
    for mark in _SENTENCES.finditer(text):
        if mark.start() > start:
            yield start, mark.start()
        start = mark.end()
    if start < len(text):
        yield start, len(text)


def features(sentence: str) -> Iterator[str]:
    """Lower-cased words, and the beginnings of longer ones with a star."""
    for word in _WORDS.findall(sentence.lower()):
        yield word
        for n in PREFIXES:
            if len(word) > n:
                yield word[:n] + "*"


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each feature, and toxic ones; sent on whenever many features are held."""
    every, toxic = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = list(every)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([every[x] for x in names], pa.int64()),
             pa.array([toxic[x] for x in names], pa.int64())],
            names=["feature", "docs", "toxic"],
        )

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            own = set(features(text.as_py() or ""))
            every.update(own)
            if label.as_py():
                toxic.update(own)
            if len(every) > 200_000:
                yield out()
                every, toxic = Counter(), Counter()
    if every:
        yield out()


def _patterns(known: dict[str, int]):
    """Per document: its label and its distinct sentences as lists of known features, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, bags, counts = [], [], []
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                whole, bag = text.as_py() or "", Counter()
                for start, end in sentence_spans(whole):
                    own = tuple(sorted({known[x] for x in features(whole[start:end]) if x in known}))
                    if own:
                        bag[own] += 1
                labels.append(int(bool(label.as_py())))
                bags.append([list(x) for x in bag])
                counts.append(list(bag.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.int32()))),
                 pa.array(counts, pa.list_(pa.int64()))],
                names=["toxic", "sentences", "times"],
            )

    return run


def _suspicious(counts: DataFrame, docs: int, toxic: int) -> list[str]:
    """Features that toxic documents have more often than others, the strongest evidence first."""

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, n = F.col("toxic"), F.col("docs")
    share = toxic / docs
    # Likelihood ratio of the four-fold table of feature and label.
    g = 2 * (
        term(a, n * share) + term(n - a, n * (1 - share))
        + term(toxic - a, (docs - n) * share) + term(docs - toxic - n + a, (docs - n) * (1 - share))
    )
    chosen = (
        counts.filter((a >= LEAST_TOXIC) & (a > n * share))
        .withColumn("g", F.when(n == docs, 0.0).otherwise(g))
        .filter(F.col("g") >= LEAST_EVIDENCE)
        .orderBy(F.desc("g"), "feature")
        .limit(FEATURES)
    )
    return [row.feature for row in chosen.select("feature").collect()]


def _noisy_or_fit(rows: list, size: int) -> tuple[np.ndarray, float]:
    """Weights that maximise the likelihood of the document labels, by Adam over all documents."""
    doc_of, times, sent_of, feat_of, labels = [], [], [], [], []
    for row in rows:
        if not row.sentences:
            continue  # nothing to learn from
        for own, n in zip(row.sentences, row.times, strict=True):
            feat_of += own
            sent_of += [len(doc_of)] * len(own)
            doc_of.append(len(labels))
            times.append(n)
        labels.append(row.toxic)
    weights, bias = np.zeros(size), 0.0
    if not labels:
        return weights, bias
    doc, sent, feat = np.array(doc_of), np.array(sent_of), np.array(feat_of)
    repeat, y = np.array(times, float), np.array(labels, bool)
    m = v = np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sent, weights[feat], len(doc))
        clean = np.bincount(doc, repeat * -np.logaddexp(0, z), len(y))  # log of no sentence offending
        p = 1 / (1 + np.exp(-z))
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        slope = np.where(y, -np.exp(clean) / toxic, 1.0)[doc] * p * repeat
        grad = np.append(np.bincount(feat, slope[sent], size) + weights / PRIOR**2, slope.sum() + bias / PRIOR**2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Train on the documents of ``docs`` (``doc_id``, ``text``) that ``labels`` (``doc_id``, ``toxic``) marks.

    At most about ``sample_rows`` labelled documents are used, drawn by a hash of the id; their ids and
    labels are broadcast. Whole texts are read. Null ids and labels are ignored; a document with
    several labels is toxic if one says so. Without any toxic or any clean document the model knows no
    feature and scores everything 0.
    """
    require(docs, ["doc_id", "text"])
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = marked.count()
    share = min(1.0, sample_rows / held) if held else 0.0
    drawn = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("toxic").alias("toxic")).first()
    if not total.docs or not total.toxic or total.toxic == total.docs:
        return ToxicityModel({}, 0.0)
    counts = rows.mapInArrow(_count_features, "feature string, docs bigint, toxic bigint")
    known = _suspicious(counts.groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")),
                        int(total.docs), int(total.toxic))
    bags = rows.mapInArrow(
        _patterns({name: i for i, name in enumerate(known)}),
        "toxic int, sentences array<array<int>>, times array<bigint>",
    ).filter(F.size("sentences") > 0)
    weights, bias = _noisy_or_fit(bags.collect(), len(known))
    return ToxicityModel(dict(zip(known, weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``score`` (0 to 1) and ``offending`` (start, end and score of each sentence of 0.5 or more).

    The sentences of the whole text are scored; one without a known feature scores 0, so null and
    empty texts do, too. Existing columns of these names are replaced; all rows are kept.
    """
    rest = docs.drop("score", "offending")
    at = rest.columns.index("text")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = T.StructType(rest.schema.fields + [
        T.StructField("score", T.DoubleType()),
        T.StructField("offending", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
            T.StructField("score", T.DoubleType())]))),
    ])
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for text in batch.column(at):
                whole, clean, spans = text.as_py() or "", 0.0, []
                for start, end in sentence_spans(whole):
                    own = {x for x in features(whole[start:end]) if x in weights}
                    if own:
                        z = bias + sum(weights[x] for x in sorted(own))
                        clean -= float(np.logaddexp(0, z))
                        if z >= 0:
                            spans.append({"start": start, "end": end, "score": float(1 / (1 + np.exp(-z)))})
                scores.append(max(0.0, float(-np.expm1(clean))))
                found.append(spans)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(found, pa.list_(span))],
                names=[*batch.schema.names, "score", "offending"],
            )

    return rest.mapInArrow(run, schema)
