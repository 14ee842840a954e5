"""From raw documents to packed training sequences, as stages that each rewrite the corpus.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All stages but the last return the columns of documents.

A stage's result reads files that the stage left in the shared folder. They go when the next stage is
called, which is after the result has been written; so one pipeline runs at a time in a process.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import mixing, near_dup, packing, pii, toxicity
from barloom.llm.common import table
from barloom.llm.queries import toxicity_model
from barloom.session import cut_lineage, remove, tracked

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the latest stage left in the shared folder.
_left: list[str] = []


def stage(fn: Stage) -> Stage:
    """Track what a stage leaves; a stage that follows another removes what that one left."""

    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if fn.__name__ != STAGES[0][1].__name__:
            remove(spark, _left)
        with tracked() as paths:
            result = fn(spark, docs, sf_dir)
        _left[:] = paths
        return result

    return call


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; the model learns from the labels of these documents."""
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.filter("score < 0.5").select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.drop_near_duplicates(docs)


@stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, that the mix of sources takes; once for each pass."""
    return mixing.mixed_documents(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their tokens, and their places in training sequences."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, pseudorandom draws and token ids have no SQL form; tests compare the stages with
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, written = table(spark, sf_dir, "documents"), []
    for _, apply in STAGES[:-1]:
        with tracked() as paths:
            docs = cut_lineage(apply(spark, docs, sf_dir))
        remove(spark, written)  # the stage before has been read to its end
        written = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
