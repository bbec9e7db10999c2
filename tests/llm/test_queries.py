"""The operators' queries on the smallest tables: SQL where it can express them, else plain versions."""

import hashlib
import zlib

import numpy as np
import pytest

from corvane.llm import queries
from corvane.session import table
from tests.llm.test_neardup import brute
from tests.llm.test_secrets_quality import base_spans
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_oracle(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def run(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}


def test_secrets(spark, texts):
    got = run(spark, "op3_secret_scan")
    assert {i: r["base_sha256"] for i, r in got.items()} == {i: hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest() for i, t in texts.items()}


def test_byte_ids(spark, texts):
    from tokenizers import Tokenizer

    t, got = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), run(spark, "op6_bpe_roundtrip")
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_word_ids(spark, texts):
    from tokenizers import Tokenizer

    t, got, start = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), run(spark, "op10_token_output"), 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_near_duplicates(spark, texts):
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in run(spark, "op9_minhash_dedup").items()} == brute(texts)


@pytest.mark.parametrize("name", ["op1_language_id", "op5_quote_linking", "op7_media_columns"])
def test_whole_tables_come_back(spark, name):
    want = {"op1_language_id": ("documents", "pages"), "op5_quote_linking": ("conversations",), "op7_media_columns": ("documents",)}[name]
    assert queries.queries()[name](spark, SF).count() == sum(table(spark, SF, t).count() for t in want)
