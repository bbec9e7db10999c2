"""Repeated rows, null keys and clashing names: every operator has a defined result."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, license_scan, media, neardup, quality, secret_scan, token_output
from corvane.llm.queries import tokenizer_path

TEXT = "Released under the MIT License.\ntoken=abcdef12"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, TEXT), (1, TEXT), (2, "one two three four five six"), (2, "one two three four five six"), (None, TEXT), (3, None), (4, ""), (5, "one two three four five six")]
    clash = {c: F.lit("x") for c in ("key", "spans", "found", "score", "part", "line", "n", "node", "start", "hash", "kept", "media", "licence", "is_hot", "spread", "source", "lang")}
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(clash)


def test_secrets(odd):
    got = secret_scan.digest(secret_scan.secrets(odd)).collect()
    want = hashlib.sha256(b"assign:32:46").hexdigest()
    assert len(got) == 8 and [r.n_assign for r in got if r.doc_id == 1] == [1, 1] and all(r.base_sha256 == want for r in got if r.doc_id == 1)
    assert [(r.n_assign, r.base_sha256) for r in got if r.doc_id is None] == [(1, want)]
    texts = [r.text for r in secret_scan.masked(odd, secret_scan.secrets(odd)).collect()]
    assert len(texts) == 8 and sum("ASSIGN" in (t or "") for t in texts) == 3 and not any("abcdef12" in (t or "") for t in texts)


@pytest.mark.parametrize("bound", [secret_scan.BROADCAST_SPANS, 0])
def test_secrets_by_row(spark, monkeypatch, bound):
    """Null keys, and keys that different texts share: each text has its own spans, and only those are masked."""
    monkeypatch.setattr(secret_scan, "BROADCAST_SPANS", bound)
    key = "AKIA" + "Q" * 16
    rows = [(None, f"a null key {key}", "s1"), (7, "a completely clean text of the same id", "s2"), (7, f"x {key} y", "s3"), (7, f"x {key} y", "s4"), (None, "clean", "s5"), (8, None, "s6")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, source string, lang string")
    found = secret_scan.secrets(docs)
    got = sorted((r.doc_id or 0, r.n_access, r.spans, r.n_copied) for r in secret_scan.digest(found).collect())
    assert got == [(0, 0, "", 0), (0, 1, "access:11:31", 1), (7, 0, "", 0), (7, 1, "access:2:22", 1), (7, 1, "access:2:22", 1), (8, 0, "", 0)]
    texts = sorted(r.text or "" for r in secret_scan.masked(docs, found).collect())
    assert texts == sorted(["a null key <EXAMPLE_ACCESS>", "a completely clean text of the same id", "x <EXAMPLE_ACCESS> y", "x <EXAMPLE_ACCESS> y", "clean", ""])
    none = secret_scan.secrets(docs.where("false"))
    assert secret_scan.digest(none).collect() == [] and secret_scan.masked(docs.where("false"), none).collect() == []


def test_licences(odd):
    got = license_scan.licences(odd).collect()
    assert len(got) == 8 and [r.n_matches for r in got if r.doc_id == 1] == [2, 2]  # the line, and the whole text


def test_near_duplicates(odd):
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 2, True), (False, 2, 2, True), (False, 3, 3, True), (False, 4, 4, True), (False, 5, 2, False), (True, None, 1, False)]
    assert neardup.deduplicated(odd).columns == odd.columns


def test_row_by_row_operators(spark, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    assert media.telephony(odd).count() == bpe.encode_digest(odd, path).count() == 8
    ids = bpe.encode(odd.where("doc_id = 2"), path).collect()
    assert [r.decoded for r in ids] == ["one two three four five six"] * 2 and len(ids[0].token_ids) == 6
    got = token_output.read_shards(token_output.write_shards(odd, tokenizer_path("word_bpe_49k.json"))).collect()
    assert len(got) == 8 and len({r.start for r in got}) == 8
    model = quality.train(odd, spark.createDataFrame([(1, 1), (1, 1), (None, 0)], "doc_id bigint, quality int"))
    assert quality.scored(odd, model, name="own_score").count() == 8
