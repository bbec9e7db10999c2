"""Records, selections by id, lookups that must succeed, nested comparisons, artifacts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.operators import records
from corvane.operators.gates import GateError


def test_records_and_ties(spark):
    rows = [(1, 0, None, "9", 5.0), (1, 1, "9", "9", 10.0), (1, 2, "8", "9", 7.0), (2, 0, "9", "9", 5.0), (2, 1, "8", "9", 5.0)]
    pool = spark.createDataFrame(rows, "problem_id int, sample_id int, answer string, gold string, orm double").withColumn("correct", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)))
    got = {r.problem_id: r for r in records.analysis_records(pool, ["orm"]).collect()}
    assert got[1].orm.sample_id == 1 and got[2].orm.sample_id == 0 and got[1].scores[2]["orm"] == 7.0 and got[1].oracle


def test_selection_by_id(spark):
    rows = spark.range(10)
    assert sorted(r.id for r in records.select_ids(rows, "id", [7, 2, 5], 2).collect()) == [2, 7]
    assert records.select_ids(rows, "id", most=3).count() == 3
    for bad in ([], [1, 1]):
        with pytest.raises(ValueError):
            records.select_ids(rows, "id", bad)
    with pytest.raises(GateError):
        records.select_ids(rows, "id", [3, 99])


def test_lookups_raise(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b")], "id bigint, name string")
    assert records.lookup_or_raise(spark.range(2), names, "id").count() == 2
    with pytest.raises(GateError):
        records.lookup_or_raise(spark.range(3), names, "id")


def test_state_sequences(spark):
    rows = [("p", "s", None, [1, 2], [3], None, 1.0), ("p", "t", [7, 8], None, None, 1, 0.25), ("p", "u", [7], None, None, 1, 3.0)]
    got = records.state_sequences(spark.createDataFrame(rows, "problem_id string, state_id string, input_ids array<int>, prompt_ids array<int>, gen_ids array<int>, prompt_len int, y double"), "y").collect()
    assert [(r.ids, r.prompt_len, r.label) for r in got] == [([1, 2, 3], 2, 1.0), ([7, 8], 1, 0.25)]


def test_differences_and_pins():
    assert records.differences({"a": {"b": 1, "c": None}, "d": 1}, {"a": {"b": 2}, "d": True}) == [("a.b", 1, 2), ("d", 1, True)]
    assert records.version_violations({"x": "1", "y": "2"}, {"x": "1"}) == [("y", "2", None)]


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.bin").select("path", "content")
    path = files.first().path
    good = spark.createDataFrame([(path, hashlib.sha256(b"abc").hexdigest())], "path string, sha256 string")
    assert records.artifact_violations(good, files).count() == 0
    assert records.artifact_violations(good.unionByName(spark.createDataFrame([("gone", "x")], "path string, sha256 string")), files).count() == 1


def test_subsample_is_stable(spark):
    a = {r.id for r in records.subsample(spark.range(500), "id", 20, 1).collect()}
    assert a == {r.id for r in records.subsample(spark.range(500).repartition(9), "id", 20, 1).collect()} and len(a) == 20
