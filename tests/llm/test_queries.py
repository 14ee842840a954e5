"""Registered queries against their SQL, the contract's columns, and the pipeline's stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from barloom.llm import ORACLES, QUERIES
from barloom.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op2_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op4_pack": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op5_order_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_licences": {"doc_id", "digest", "licence", "notices"},
    "op7_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_judge_urls": {"page_id", "host", "path", "rule", "verdict"},
    "op9_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"},
    "op10_nearest": {"query_id", "rank", "vec_id", "score"},
    "op11_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op12_resample": {"doc_id", "n_features", "weight", "score", "rank"},
    "op13_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
}


def test_one_query_per_operator():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    result = [row.asDict() for row in df.collect()]
    assert COLUMNS[name] <= set(df.columns) and result
    if name in ORACLES:
        con = duckdb.connect()
        for file in os.listdir(SF):
            con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
        found = con.sql(ORACLES[name])
        wanted = [dict(zip(found.columns, row, strict=True)) for row in found.fetchall()]
        assert sorted(found.columns) == sorted(df.columns)
        as_rows = lambda rows: sorted(repr(sorted(row.items())) for row in rows)
        assert as_rows(result) == as_rows(wanted)


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(n))
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    every, clean, single, redacted = counts[:4]
    assert every > clean > single == redacted and counts[-1] > 0
    assert {"sequence_id", "offset", "ids_crc32"} <= set(docs.columns)
