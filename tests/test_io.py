"""Readers, writers and streams on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators.gates import GateError
from corvane.sources import readers, sinks
from corvane.streaming import incremental


def test_score_shards(spark, tmp_path):
    item = {"meta": {"problem_id": 1, "trajectory_id": 2, "seed": 42, "is_correct": True, "answer": "None"}, "score": 0.5}
    (tmp_path / "s_0.json").write_text(json.dumps({"items": [item, item | {"score": 1.5}]}, indent=1))
    (tmp_path / "s_1.json").write_text(json.dumps({"items": []}))
    rows = readers.item_scores(spark, f"{tmp_path}/s_*.json").collect()
    assert [(r.pid, r.tid, r.answer, r.score, r.pos) for r in rows] == [(1, 2, None, 0.5, 0), (1, 2, None, 1.5, 1)]
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"pid": 1, "tid": 2, "step": 3, "mr": 0.0, "score": 1.0, "final_correct": True}, {"pid": 1, "tid": 2, "step": 2, "mr": 0.1, "score": 2.0, "final_correct": True}]}))
    assert [r.score for r in readers.result_scores(spark, f"{tmp_path}/r.json", 0.0).collect()] == [1.0]


def test_state_records_fail_on_bad_lines(spark, tmp_path):
    good = json.dumps({"state_id": "s", "problem_id": "p", "mask_ratio": 0.5})
    (tmp_path / "a.jsonl").write_text(good + "\n\n" + good + "\n")
    assert readers.state_records(spark, f"{tmp_path}/a.jsonl").count() == 2
    (tmp_path / "b.jsonl").write_text(good + "\n{broken\n")
    with pytest.raises(Exception):
        readers.state_records(spark, f"{tmp_path}/b.jsonl").collect()


def test_shards_by_file_name(spark, tmp_path):
    for name in ("t_seed42_shard0", "t_seed42_partial", "t_seed43_shard0", "merged_seed42"):
        spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/w")
        next((tmp_path / "w").glob("part-*")).rename(tmp_path / f"{name}.parquet")
        import shutil

        shutil.rmtree(tmp_path / "w")
    assert readers.shard_files(spark, f"{tmp_path}/*.parquet", "seed42").count() == 2
    named = readers.with_file_config(readers.shard_files(spark, f"{tmp_path}/*.parquet"), text.file_config(F.col("_metadata.file_name")))
    assert {r.seed for r in named.collect()} == {42, 43}


def test_problem_sets(spark):
    rows = spark.createDataFrame([("a", "q1", "work #### 1,200 "), ("b", "q2", "no mark")], "k string, question string, answer string")
    assert [(r.global_problem_id, r.gold_answer) for r in readers.problems(rows, "k").orderBy("global_problem_id").collect()] == [(0, "1200"), (1, "no mark")]
    parts = {"y": rows, "x": rows.limit(1)}
    got = readers.union_of_configs(parts, "k", {"y:train:1": "0"}, readers.gold_of(F.col("answer")), {"x": 1, "y": 2}).orderBy("problem_ordinal").collect()
    assert [(r.global_problem_id, r.problem_ordinal, r.gold_answer) for r in got] == [("x:train:0", 0, "1200"), ("y:train:0", 1, "1200"), ("y:train:1", 2, "0")]
    with pytest.raises(ValueError):
        readers.union_of_configs(parts, "k", {}, F.col("answer"), {"x": 2, "y": 2})
    assert readers.duplicates(rows.unionByName(rows.limit(1)), "k").count() == 1


def test_samples_of_any_shape(spark, tmp_path):
    samples = [{"filter": "strict", "exact_match": 0.0, "filtered_resps": ["[invalid]"], "resps": [["#### 5"]], "target": "#### 5"}, {"filter": "flexible-extract", "exact_match": 1.0, "filtered_resps": [["5"]], "resps": ["x"]}]
    (tmp_path / "r.json").write_text(json.dumps({"accuracies": {}, "samples": {"gsm8k": samples}}))
    rows = readers.lm_samples(spark, f"{tmp_path}/r.json", "gsm8k")
    assert [(r.pos, r.filtered, r.response, r.is_correct) for r in rows.orderBy("pos").collect()] == [(0, "[invalid]", "#### 5", False), (1, "5", "x", True)]
    assert [r.filter for r in readers.prefer_flexible(rows).collect()] == ["flexible-extract"]
    assert readers.checkpoint_source(["best.pt", "model.safetensors"]) == "model.safetensors"


def test_payloads_and_atomic_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, 2, "b"), (0, 1, None), (1, 5, "c")], "shard int, pid int, a string")
    got = {r.shard: json.loads(r.payload) for r in sinks.payloads(rows, "shard", "pid", {"seed": 42}).collect()}
    assert [x["pid"] for x in got[0]["per_problem"]] == [1, 2] and got[0]["per_problem"][0]["a"] is None and got[1]["num_rows"] == 1
    with_summary = {r.shard: json.loads(r.payload)["summary"] for r in sinks.payloads(rows, "shard", "pid", {}, {"named": F.count("a"), "highest": F.max("pid")}).collect()}
    assert with_summary == {0: {"named": 1, "highest": 2}, 1: {"named": 1, "highest": 5}}
    for value in ({"b": 1, "a": "é"}, {"c": 2}):
        sinks.write_json_atomic(spark, value, f"{tmp_path}/out.json")
        assert json.loads((tmp_path / "out.json").read_text()) == value
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".out.json.") and not p.name.endswith(".crc")]
    sinks.write_partitioned(rows, f"{tmp_path}/t", "shard")
    sinks.write_partitioned(rows.where("shard = 1"), f"{tmp_path}/t", "shard")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert sinks.shard_name("s", 1, 4) == "s_shard00001of00004.json" and "pid" in sinks.report(rows, "rows")


def test_stream_takes_each_row_once_over_restarts(spark, tmp_path):
    base = spark.createDataFrame([(i, i % 3) for i in range(30)], "id bigint, k int").withColumn("ts", (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("id") * 60).cast("timestamp"))
    src = f"{tmp_path}/in"
    base.where("id < 20").coalesce(1).write.parquet(src)
    for rows in (None, base.where("id >= 10")):
        if rows is not None:
            rows.coalesce(1).write.mode("append").parquet(src)
        stream = incremental.once_each(incremental.arriving(spark, src), ["id"], "ts", "10 days")
        incremental.appended(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == list(range(30))
    incremental.replaced(incremental.sessions(incremental.arriving(spark, src), "ts", "90 seconds", ["k"]), f"{tmp_path}/s", f"{tmp_path}/state2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s").agg(F.sum("n")).first()[0] == 40


def test_pinned_sets(spark):
    texts = [f"What is {k} + {k}?" for k in range(25)]
    rows = spark.createDataFrame([(f"test/{k:03d}.json", t, k) for k, t in enumerate(texts)], "unique_id string, problem string, row int").repartition(4)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = [{"global_problem_id": f"test/{k:03d}.json", "problem_sha256": sha(t)} for k, t in enumerate(texts)]
    pins = {"revision": "r1", "count": 25, "question_list_sha256": sha(json.dumps(listed, sort_keys=True, separators=(",", ":"), ensure_ascii=False))}
    for order in ("row", "unique_id"):
        got = readers.pinned(rows, order, pins, revision="r1").orderBy("problem_ordinal").collect()
        assert [(r.global_problem_id, r.problem_sha256) for r in got] == [tuple(x.values()) for x in listed]
    for pin, value in (("revision", "r2"), ("count", 24), ("question_list_sha256", "0" * 64)):
        with pytest.raises(GateError):
            readers.pinned(rows, "row", pins | {pin: value}, revision="r1")
    some = rows.withColumn("unique_id", F.when(F.col("row") != 3, F.col("unique_id")))
    assert "test:3" in {r.global_problem_id for r in readers.pinned(some, "row", {}).collect()}
    with pytest.raises(GateError, match="without an id"):
        readers.pinned(some, "row", {"count": 25})
    with pytest.raises(GateError, match="repeated"):
        readers.pinned(rows.union(rows.limit(1)), "row", {})
