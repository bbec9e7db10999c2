"""Ids by ranks against the rank library: whole texts, small chunks, characters on which Unicode versions differ, odd rows."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, rank_bpe
from corvane.session import table
from tests.oracle import SF


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(queries.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=queries.tokenizer_pattern(), mergeable_ranks=pairs, special_tokens={})


def files():
    return queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.tokenizer_pattern()


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_rank_bpe(spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    assert got == want


def test_classes_are_the_library_s(library):
    classes = rank_bpe.Classes(queries.tokenizer_pattern())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 5000):
        text = "a".join(every[k : k + 5000])
        assert classes.pieces(text) == plain_pieces(library, text)


def plain_pieces(library, text):
    """The library's own pre-tokens: with every byte a token of its own and no merges, matches can't be told apart, so each class is asked for."""
    import regex
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    kind = {}
    for name, rx in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s")):
        kind |= dict.fromkeys(bytes(tiktoken.Encoding(name, pat_str=rx, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode(), name)
    shown = "".join("a" if c == "a" else {"L": "b", "N": "1", "s": c if c == " " else "\n"}.get(kind.get(c), c if c == "'" else "#") for c in text)
    out, at = [], 0
    for p in regex.findall(queries.tokenizer_pattern(), shown):
        out.append(text[at : at + len(p)])
        at += len(p)
    return out


ALPHABET = ["a", "st", "re", "'", "'ll", " ", "  ", "\n", "\n\n", "\t", "7", "42", "é", "漢字", "😀", "-", "...", "Ᲊ", " ", "\x1c", "<|endoftext|>"]


def test_small_chunks_agree(spark, library):
    r = random.Random(11)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 400))) for _ in range(150)]
    # Pre-tokens far longer than the overlap: letters, white space, digits, and several after one another.
    texts += ["x" * 500, " " * 300 + "word" + "\n" * 90, "ab " * 30 + "q" * 200 + " " * 50 + "9" * 170 + " tail's end" * 9, "é" * 130 + "'re" * 40, "", "a", "word " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(40)  # more than `written` leaves
    for chunk, overlap in ((40, 12), (64, 9)):
        got = {x.doc_id: x for x in rank_bpe.encode(docs, *files(), chunk=chunk, overlap=overlap).collect()}
        short = {x.doc_id: x for x in rank_bpe.encode_digest(docs, *files(), chunk=chunk, overlap=overlap).collect()}
        for i, t in enumerate(texts):
            ids = library.encode_ordinary(t)
            assert got[i].token_ids == ids and bytes(got[i].decoded) == t.encode()
            assert short[i].n_tokens == len(ids) and short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert short[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_default_chunks_of_a_long_text(spark, library):
    r = random.Random(5)
    text = "".join(r.choice(ALPHABET) for _ in range(60_000)) + "z" * 2000 + " end " * 10_000
    docs = spark.createDataFrame([(1, text), (1, text + "!"), (None, text)], "doc_id bigint, text string")
    got = sorted(x.n_tokens for x in rank_bpe.encode_digest(docs, *files()).collect())
    assert got == sorted([len(library.encode_ordinary(text))] * 2 + [len(library.encode_ordinary(text + "!"))])


def test_odd_rows(spark):
    clash = {c: F.lit("x") for c in ("key", "row", "lead", "k", "ids", "body", "since", "n_tokens")}
    rows = [(1, "same"), (1, "same"), (None, "a b"), (None, None), (2, ""), (3, "y" * 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(clash)
    got = rank_bpe.encode_digest(docs, *files(), chunk=50, overlap=10)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect())[:4] == [(0, 0), (0, 2), (1, 1), (1, 1)]
    assert {r.ids_sha256 for r in got.collect() if not r.n_tokens} == {empty}
    none = rank_bpe.encode(docs.limit(0), *files()).collect() + rank_bpe.encode_digest(docs.where("false"), *files()).collect()
    assert none == []
