"""Byte-level ids by a table of different chunks against the tokenizers library; odd rows of both ways."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe
from corvane.llm.queries import tokenizer_path
from corvane.session import table
from tests.oracle import SF

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_shared_chunks(spark, library):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.token_ids for r in bpe.encode_shared(docs, PATH).collect()}
    assert got == {i: library(t) for i, t in texts.items()}


def test_unsafe_joins_and_odd_rows(spark, library):
    r = random.Random(4)
    run = "".join(r.choice("abcdefgh0123456789+/") for _ in range(40_000))  # no place where a cut is safe
    rows = [(1, run), (1, run), (2, run[:20_000] + " " + run), (None, "a passage"), (None, None), (3, ""), (4, "é漢" * 9000), (5, "one two " * 4000)]
    clash = {c: F.lit("x") for c in ("key", "row", "k", "chunk", "digest", "ids", "n", "parts", "odd", "safe")}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(clash)
    want = sorted((str(i), library(t)) for i, t in rows)
    assert sorted((str(x.doc_id), x.token_ids) for x in bpe.encode_shared(docs, PATH).collect()) == want
    assert sorted((str(x.doc_id), x.token_ids) for x in bpe.encode(docs, PATH).collect()) == want
    none = docs.where("false")
    assert bpe.encode_shared(none, PATH).collect() == bpe.encode(none, PATH).collect() == bpe.encode_digest(none, PATH).collect() == []
