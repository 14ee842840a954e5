"""Token files: the Elias-Fano index, exact round trips and ids against the tokenizer itself."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import token_files
from barloom.session import scratch_path


@given(st.lists(st.integers(0, 2**40), max_size=300), st.integers(0, 20))
@settings(max_examples=60, deadline=None)
def test_index_holds_any_rising_sequence(values, repeats):
    values = sorted(values + values[:1] * repeats)
    index = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert index.all().tolist() == values
    if values:
        assert index.select(np.arange(len(values))).tolist() == values
        assert index.select([len(values) - 1, 0]).tolist() == [values[-1], values[0]]


def test_index_is_small():
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 1000, 100_000))
    size = len(token_files.EliasFano.of(ends).to_bytes())
    least = np.log2(ends[-1] / len(ends)) + 2  # bits an entry in theory
    assert size * 8 / len(ends) < 1.1 * least


def test_documents_by_place():
    ids = [np.array(v, "<u4") for v in ([1, 2, 3], [], [70_000], [9])]
    for some, width in ((ids, 4), ([v % 60_000 for v in ids], 2)):
        file = token_files.TokenFile(io.BytesIO(token_files.encode_file([-5, 2**40, None, None], [v.tobytes() for v in some])))
        assert (file.width, file.n_docs, file.n_ids) == (width, 4, 5)
        assert [file.document(i).tolist() for i in range(4)] == [v.tolist() for v in some]
        assert file.doc_ids() == [-5, 2**40, None, None]
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(b"x" * 100))


def own_ids(text, end_id):
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*bpe.encode(text or "", add_special_tokens=False).ids, end_id]


def test_pieces_are_those_of_the_tokenizer():
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(3)
    letters, common = [chr(i) for i in range(0x250)], " \n\t'abS1.,_²½\x85\xa0\x1bsdt"
    texts = ["".join(draw.choice(letters if draw.random() < 0.4 else common) for _ in range(14)) for _ in range(4000)]
    covered = [text for text in texts if not token_files.OTHER.search(text)]
    assert len(covered) > 3000
    for text in covered:
        assert token_files.PIECES.findall(text) == [text[a:b] for _, (a, b) in bpe.pre_tokenizer.pre_tokenize_str(text)]
    encode = token_files.encoder()
    own = [np.frombuffer(ids, "<u4").tolist() for ids in encode(texts)]
    assert own == [bpe.encode(text, add_special_tokens=False).ids for text in texts]


def test_round_trip(spark, hard):
    folder = scratch_path(spark, "tokens")
    docs = hard.unionByName(spark.createDataFrame([(-3, "it's <|endoftext|> 日本語 \x85\x1c don't  end  ")], "doc_id long, text string"), True)
    token_files.write_token_files(docs.withColumn("ids", F.lit(1)), folder, end_id=5, ids_per_file=300)
    assert spark.read.parquet(f"{folder}/manifest").count() > 2
    out = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    key = lambda i: (i is None, i or 0)
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in docs.collect()), key=key)
    start = 0
    for row in out:
        assert row.start == start and row.n_tokens * 4 == len(row.ids)
        start += row.n_tokens
    wanted = sorted((r.doc_id, own_ids(r.text, 5)) for r in docs.collect() if r.doc_id is not None)
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in out if r.doc_id is not None) == wanted


def test_retried_tasks_leave_files_that_do_not_count(spark):
    folder = scratch_path(spark, "tokens")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    token_files.write_token_files(docs, folder)
    storage, path = token_files._opened(folder)
    with storage.open_output_stream(f"{path}/000000-000000-lost.tokens") as out:
        out.write(token_files.encode_file([1], [b"\1\0\0\0"]))
    assert token_files.read_token_files(spark, folder).count() == 20


def test_query_digest(spark):
    from barloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    wanted, start = [], 0
    for row in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = own_ids(row.text, 0)
        wanted.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op13_token_files"](spark, sf).collect())) == wanted


def test_no_documents(spark, empty):
    assert token_files.encoded(empty).count() == 0
