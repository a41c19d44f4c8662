"""Encoding and decoding against the public library, on the given documents and on odd texts."""

import hashlib
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, catalog

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "Hello World's 12 <|endoftext|> foo", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ İstanbul ß é é a\x1cb a\x85b ²Ⅷ", "中文 ̀x 👩‍👩‍👧", "a" * 30_000, "ab" * 9_000, "don't 'S x_y 1234"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_odd_texts(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").repartition(3)
    shared = bpe.share_vocabulary(spark, PATH)
    rows = docs.select("doc_id", bpe.encode(F.col("text"), shared).alias("ids")).select("*", bpe.decode(F.col("ids"), shared).alias("back")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.back == library.decode(want, skip_special_tokens=False)


def test_query_over_given_documents(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.op3_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(" ".join(map(str, ids)))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_null_ids_decode_to_empty(spark):
    shared = bpe.share_vocabulary(spark, PATH)
    df = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(bpe.decode(F.col("ids"), shared)).collect()] == ["", ""]


def test_other_vocabulary_kinds_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_results_of_a_batch_are_given_back_in_parts(spark, library, prose):
    """A worker holds the texts of a batch, but lists, ids and decoded texts of some rows only."""
    shared = bpe.share_vocabulary(spark, PATH)
    texts = [prose(i % 40, 400) for i in range(4_000)]
    batch = pa.array(texts, pa.string())
    shared.encoder().encode(" ".join(texts[:40]))
    held, rows = pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for part in bpe.in_parts(iter([batch, batch.slice(0, 0)]), bpe._both, shared):
        assert len(part) <= bpe.ROWS_AT_ONCE
        first = part[0].as_py()
        assert first["ids"] == library.encode(texts[rows], add_special_tokens=False).ids
        assert first["decoded"] == library.decode(first["ids"], skip_special_tokens=False)
        rows += len(part)
        assert pa.total_allocated_bytes() - held < batch.nbytes
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < batch.nbytes


def test_rows_of_large_batches_keep_their_place(spark, library):
    df = spark.range(0, 3_000, 1, 1).select("id", F.concat(F.lit("row "), F.col("id")).alias("text"))
    shared = bpe.share_vocabulary(spark, PATH)
    for r in df.select("text", bpe.round_trip(F.col("text"), shared).alias("r")).where("id % 97 = 0").collect():
        assert r.r.ids == library.encode(r.text, add_special_tokens=False).ids
