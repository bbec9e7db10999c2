"""Licences, quotations and decontamination on small cases with known answers, and against plain versions."""

import hashlib
import re

from pyspark.sql import functions as F

from corvane.llm import decontaminate, license_scan, quote_linking


def test_decontamination_cases(spark):
    item = "The quick brown Fox jumps over the lazy dog again and once more"
    bench = spark.createDataFrame([(1, item), (10, "tiny Item"), (2, None), (3, "..."), (4, item)], "item_id bigint, text string")
    texts = [
        (0, f"Well, {item.upper()}!"),
        (1, None),
        (2, ""),
        (3, "a tiny, item here tiny item"),
        (4, "the quick brown fox jumps over the lazy dog"),
        (5, "x " * 30000 + item),
        (5, "x " * 30000 + item),
        (6, "é É " * 20),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for few in (100_000, 0):
        got = sorted(decontaminate.digest(decontaminate.contamination(docs, bench, broadcast_windows=few)).collect())
        assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got] == [(0, 14, 13, 2), (1, 0, 0, 0), (2, 0, 0, 0), (3, 6, 4, 1), (4, 9, 0, 0), (5, 30013, 13, 2), (5, 30013, 13, 2), (6, 40, 0, 0)]
        assert got[0].items_sha256 == hashlib.sha256(b"1,4").hexdigest() and got[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    some = docs.where("doc_id <> 5").withColumn("places", F.lit("own"))
    assert sorted(r.doc_id for r in decontaminate.without_documents(some, bench).collect()) == [1, 2, 4, 6]
    cut = {r.doc_id: (r.text, r.places) for r in decontaminate.without_spans(docs.where("doc_id <> 5").withColumn("places", F.lit("own")), bench).collect()}
    assert cut[0] == ("Well!", "own") and cut[3] == ("a here", "own") and cut[4][0] == texts[4][1] and cut[1] == (None, "own")
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, empty).collect())
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_licences(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    broken = mit.replace(", ", ",\n").replace("free of charge", "at no charge")
    docs = spark.createDataFrame([(1, "Some text\nReleased under the MIT License!\nmore"), (2, broken), (3, None), (4, ""), (5, "word " * 50000), (6, "Licensed under CC BY-NC 4.0."), (7, "mit")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.licences(docs).collect()}
    assert (got[1].n_matches, got[1].licences, got[1].best, got[1].best_permille) == (1, "MIT", "MIT", 1000)
    assert got[2].best == "MIT-text" and 900 < got[2].best_permille < 1000
    assert got[6].licences == "CC-BY-NC-4.0"
    assert [(got[i].n_matches, got[i].licences, got[i].best) for i in (3, 4, 5, 7)] == [(0, "", None)] * 4
    assert license_scan.licences(docs.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    for m in range(1, 60):
        lo, hi = license_scan.bounds(m)
        for n in range(1, 200):
            if 2000 * min(n, m) >= license_scan.LEAST * (n + m):
                assert lo <= n <= hi


def test_quotes(spark):
    a, b, c = "How do I sort a list in place?", "Use the sort method of the list.\nIt takes a key function too.", "And how do I sort it backwards then?"
    rows = [
        (1, 0, "user", a),
        (1, 1, "assistant", f"> {a}\n{b}"),
        (1, 2, "user", "Something else entirely, by the way."),
        (1, 3, "user", f"> > {a}\n> Use   the SORT method of the list.\n> It takes a key function too.\n{c}"),
        (1, 4, "assistant", f">{c}\nSet reverse to true."),
        (1, 5, "user", "> nothing that was said here before\nwhat?"),
        (2, 0, "user", f"> {a}\nSame here."),
        (2, 1, None, None),
        (3, 0, "user", ""),
        (None, 0, "user", a),
        (4, 7, "user", "> ok\nok"),
        (4, 7, "user", "> ok\nok"),
    ]
    chats = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, hash string")
    got = [(r.conv_id, r.turn, r.source_conv, r.source_turn, r.n_levels, r.n_linked, r.root_turn, r.depth, r.text) for r in quote_linking.threads(chats).orderBy("conv_id", "root_turn", "turn").collect() if r.conv_id is not None]
    assert got == [
        (1, 0, None, None, 0, 0, 0, 0, a),
        (1, 1, 1, 0, 1, 1, 0, 1, b),
        (1, 3, 1, 1, 2, 2, 0, 2, c),
        (1, 4, 1, 3, 1, 1, 0, 3, "Set reverse to true."),
        (1, 2, None, None, 0, 0, 2, 0, "Something else entirely, by the way."),
        (1, 5, None, None, 1, 0, 5, 0, "what?"),
        (2, 0, 1, 0, 1, 1, 0, 0, "Same here."),
        (2, 1, None, None, 0, 0, 1, 0, ""),
        (3, 0, None, None, 0, 0, 0, 0, ""),
        (4, 7, None, None, 1, 0, 7, 0, "ok"),
        (4, 7, None, None, 1, 0, 7, 0, "ok"),
    ]
    assert quote_linking.threads(chats.limit(0)).count() == 0


def test_long_threads(spark):
    n = 40
    said = [f"message number {k} of a long thread" for k in range(n)]
    rows = [(9, k, "user", said[k] if not k else f"> {said[k - 1]}\n{said[k]}") for k in range(n)]
    got = {r.turn: r for r in quote_linking.threads(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert all(got[k].depth == k and got[k].root_turn == 0 and not re.search(">", got[k].text) for k in range(n))
