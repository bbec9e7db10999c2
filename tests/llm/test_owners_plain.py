"""Ownership of secrets over a whole table against plain Python, and odd rows of the native operators and of the pipeline's stages."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontaminate, license_scan, queries, secret_scan
from corvane.session import table

#: Ten times the smallest tables: enough secrets of several owners.
MORE = "/root/testdata/sf0.01"


def test_live_and_copied(spark):
    docs = table(spark, MORE, "documents").collect()
    found = [(d, secret_scan.found(d.text or "")) for d in docs]
    owners, places = defaultdict(set), defaultdict(set)
    for d, spans in found:
        for *_, secret in spans:
            if d.source is not None:
                owners[secret].add(d.source)
            places[secret].add((d.source, "/".join(x for x in (d.source, d.lang) if x is not None)))
    copied = {s for s in places if len(owners[s]) >= 3 or len(places[s]) >= 5}
    names = secret_scan.BASE + secret_scan.ADDED
    want = {d.doc_id: (",".join(f"{names[k]}:{a}:{b}" for a, b, k, _ in spans), sum(s not in copied for *_, s in spans), sum(s in copied for *_, s in spans)) for d, spans in found}
    got = {r.doc_id: (r.spans, r.n_live, r.n_copied) for r in queries.op3_secret_scan(spark, MORE).collect()}
    assert got == want and sum(x[1] + x[2] for x in want.values()) > 20


ODD = [(1, "Released under the MIT License.\nalpha beta"), (1, "something else"), (None, "Released under the MIT License."), (2, None), (3, ""), (4, "word " * 30_000), (4, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    clash = {c: F.lit("x") for c in ("key", "own", "c0", "places", "n", "size", "window", "licence", "part", "line", "score", "bad_key", "item_id", "signature")}
    return spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns(clash)


def test_licences_of_odd_rows(odd):
    got = sorted((r.doc_id or 0, r.n_matches > 0) for r in license_scan.licences(odd).collect())
    assert got == [(0, True), (1, False), (1, True), (2, False), (3, False), (4, False), (4, False)]
    assert license_scan.licences(odd.where("false")).collect() == []


def test_contamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "alpha beta"), (None, "something else")], "item_id bigint, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.digest(decontaminate.contamination(odd, bench)).collect())
    assert got == Counter([(1, 7, 2), (1, 2, 2), (None, 5, 0), (2, 0, 0), (3, 0, 0), (4, 30_000, 0), (4, 30_000, 0)])
    assert decontaminate.digest(decontaminate.contamination(odd.where("false"), bench)).collect() == []
    assert {r.n_hit for r in decontaminate.digest(decontaminate.contamination(odd, bench.where("false"))).collect()} == {0}
    assert decontaminate.without_documents(odd, bench).columns == odd.columns


def test_stages_with_odd_rows_and_empty_tables(spark, tmp_path):
    """Null and repeated ids, null sources and texts, a long text, further columns: no stage fails, no secret stays, columns are those of docs."""
    key = "AKIA" + "Z" * 16
    rows = [(i, f"a plain sentence about number {i} and the house next to it", "en", "s") for i in range(40)]
    rows += [(None, f"of a null id {key} indeed", "en", None), (7, f"the same id {key} again", None, "s"), (None, None, None, None), (8, "", "en", "s"), (9, "long words here " * 20_000, "en", "s"), (9, "long words here " * 20_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({"n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint"), "found": F.lit(1), "key": F.lit("x"), "row": F.lit(2), "spans": F.lit("y"), "gone_key": F.lit(3)})
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this stands there at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    texts = [r.text for r in now.collect()]
    assert not any(key in (t or "") for t in texts) and sum("_ACCESS>" in (t or "") for t in texts) == 2
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path)).count() == len(texts)
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == [], name
