"""Near duplicates against all pairs, and the components algorithm against union-find."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import neardup


def roots(n, pairs):
    up = {i: i for i in n}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {i: find(i) for i in n}


def brute(texts):
    """doc_id -> (set size, smallest reachable id), by plain Python over all pairs."""
    sets = {}
    for i, t in texts.items():
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            lower = lower.replace(c, " ")
        w = [x for x in lower.split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    up = roots(ids, pairs)
    return {i: (len(sets[i]), up[i]) for i in ids}


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    texts = {}
    base = [[r.choice(vocab) for _ in range(r.choice([4, 30, 80, 150]))] for _ in range(8)]
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts[3 * i + 1] = r.choice([" ", "\n", " \t"]).join(w)
    return texts | {2: None, 5: "", 8: " \n ", 11: "a b c", 14: "A  b\tC", 17: "a b c d", 20: "\xa0a b c", 9001: "x " * 20000, 9002: "x " * 15000}


@pytest.mark.parametrize("small, block", [(6, 512), (2, 16), (1000, 1)])
def test_as_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus(5, 260)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, key string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    want = brute(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert {r["doc_id"] for r in neardup.deduplicated(docs).collect()} == {i for i, (_, c) in want.items() if i == c}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(docs).count() == 0


def test_components_as_union_find(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in neardup.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != v}


def test_signatures_tell_the_similarity():
    r = np.random.default_rng(3)
    off = []
    for j in (0.3, 0.6, 0.75, 0.9):
        for _ in range(30):
            common, n = r.integers(0, 2**63, 600).astype(np.uint64), int(600 * (1 - j) / j / 2)
            a, b = (np.concatenate([common, r.integers(0, 2**63, n).astype(np.uint64)]) for _ in range(2))
            off.append((neardup.signature(a) == neardup.signature(b)).mean() - len(common) / (len(common) + 2 * n))
    assert abs(np.mean(off)) < 0.02 and max(map(abs, off)) < 0.17


def test_arrow_slices_of_texts():
    column = pa.array(["one two", None, "three four five six seven eight"]).slice(1, 2)
    assert [len(s) for s in neardup.shingle_sets(column)] == [0, 2]
