"""Atomic files and tables, observed gates, the shard source and its faults, digests against plain Python."""

import hashlib
import json
import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import compare
from corvane.operators.gates import GateError
from corvane.session import ship
from corvane.sources import digests, sinks
from corvane.sources.shards import ShardSource
from corvane.streaming import incremental, pools


def test_a_reader_never_misses_the_file(spark, tmp_path):
    path, seen, stop = f"{tmp_path}/state.json", [], threading.Event()
    sinks.write_json_atomic(spark, {"n": 0}, path)

    def read():
        while not stop.is_set():
            with open(path) as f:
                seen.append(json.load(f)["n"])

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 60):
        sinks.write_json_atomic(spark, {"n": n}, path)
    stop.set()
    reader.join()
    assert len(seen) > 20 and seen == sorted(seen) and not [x for x in os.listdir(tmp_path) if x != "state.json"]
    assert json.loads(spark.read.text(path).first()[0]) == {"n": 59}


def test_published_tables(spark, tmp_path):
    path, rows = f"{tmp_path}/t", spark.range(10).withColumn("score", F.when(F.col("id") > 2, F.col("id")))
    gates = {"negative": F.col("score") < 0}
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    assert sinks.publish(rows, path, {"missing": F.count_if(F.col("score").isNull())}, gates) == {"rows": 10, "missing": 3}
    first, _ = sinks.published(spark, path)
    with pytest.raises(GateError, match="negative"):
        sinks.publish(rows.withColumn("score", -F.col("score")), path, {}, gates)
    assert sinks.published(spark, path)[0].count() == 10
    sinks.publish(rows.limit(4), path, {}, gates)
    assert first.count() == 10 and sinks.published(spark, path)[0].count() == 4  # who began with the old one still reads it
    assert sinks.publish(rows.limit(0), path, {}, gates) == {"rows": 0}
    assert sorted(x[:2] for x in os.listdir(path)) == ["cu", "v-", "v-"]


@pytest.fixture
def shards(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(ShardSource)
    rows = spark.range(100).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 0.5).alias("score"), F.array(F.col("id"), F.lit(None)).alias("ids"), F.lit("é").alias("t"))
    path = f"{tmp_path}/shards"
    rows.repartition(4, "id").write.format("pool_shards").option("path", path).option("shards", "4").option("identity", "a").mode("append").save()
    return spark, rows, path


def read(spark, rows, path, **options):
    return spark.read.format("pool_shards").schema(rows.schema).option("path", path).options(**options).load()


def test_shards_come_back(shards):
    spark, rows, path = shards
    assert sorted(os.listdir(path)) == [f"pool_shard0000{k}of00004.jsonl" for k in range(4)]
    back = read(spark, rows, path, identity="a")
    assert sorted(back.collect()) == sorted(rows.collect()) and back.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="there are shards"):
        rows.repartition(4).write.format("pool_shards").option("path", path).option("shards", "4").mode("append").save()
    rows.limit(5).coalesce(1).write.format("pool_shards").option("path", path).option("shards", "1").mode("overwrite").save()
    assert read(spark, rows, path).count() == 5 and len(os.listdir(path)) == 1


def lines_of(path):
    return Path(path).read_text().splitlines()


FAULTS = {
    "line": (lambda x: [*x[:3], x[3][:-4], *x[4:]], r"of00004.jsonl:4: JSONDecodeError"),
    "kind": (lambda x: [*x[:2], x[2].replace('"id": ', '"id": "x') .replace(', "score"', '", "score"'), *x[3:]], r":3: TypeError"),
    "short": (lambda x: x[:-1], r"rows, the manifest says"),
    "manifest": (lambda x: x[1:], r":1: no manifest"),
    "place": (lambda x: [x[0].replace('"shard": 1', '"shard": 2'), *x[1:]], r":1: the manifest is of shard 2"),
    "identity": (lambda x: [x[0].replace('"identity": "a"', '"identity": "b"'), *x[1:]], r":1: identity b, not a"),
    "unfinished": (lambda x: [x[0].replace('"complete": true', '"complete": false'), *x[1:]], r":1: the shard isn't complete"),
}


@pytest.mark.parametrize("fault", sorted(FAULTS))
def test_planted_faults_raise(shards, fault):
    spark, rows, path = shards
    change, says = FAULTS[fault]
    file = Path(path, "pool_shard00001of00004.jsonl")
    file.write_text("\n".join(change(lines_of(file))) + "\n")
    with pytest.raises(Exception, match=says):
        read(spark, rows, path, identity="a").collect()


def test_missing_shards(shards):
    spark, rows, path = shards
    os.remove(f"{path}/pool_shard00002of00004.jsonl")
    with pytest.raises(Exception, match=r"shards \[2\] of 4 are missing"):
        read(spark, rows, path).collect()
    n = sum(len(lines_of(f"{path}/{f}")) - 1 for f in os.listdir(path))
    assert read(spark, rows, path, missing="skip").count() == n
    Path(path, "pool_shard00000of00005.jsonl").write_text("x")
    with pytest.raises(Exception, match="different sets"):
        read(spark, rows, path).collect()


def plain_chain(records):
    digest = hashlib.sha256()
    for r in records:
        digest.update(len(r).to_bytes(8, "big") + r)
    return digest.hexdigest()


def test_digests(spark, tmp_path):
    root = tmp_path / "d"
    for name, content in {"b/x.txt": b"one", "b-c/y.txt": b"", "a.jsonl": b"\x00\xff" * 900, "b/z é.jsonl": b"two"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    files = sorted(p for p in root.rglob("*") if p.is_file())
    sha = lambda p: hashlib.sha256(p.read_bytes()).hexdigest()
    want = plain_chain(json.dumps([p.relative_to(root).as_posix(), sha(p)], ensure_ascii=False, separators=(",", ":")).encode() for p in files)
    assert digests.directory_digest(spark, str(root)) == digests.directory_digest(spark, f"file://{root}") == want
    got = digests.shard_set_digest(spark, str(root), "*.jsonl").first()
    assert (got.n, got.sha256) == (1, plain_chain([json.dumps({"name": "a.jsonl", "sha256": sha(root / "a.jsonl"), "size_bytes": 1800}, sort_keys=True, separators=(",", ":")).encode()]))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no file"):
        digests.directory_digest(spark, str(tmp_path / "none"))


def test_nested_differences(spark):
    pairs = [
        ('{"a": 1, "b": [1, {"c": null}], "e": {}}', '{"a": 1.0, "b": [1, {"c": 2}, 3], "e": []}'),
        ('{"x.y": 5, "q\'r": "s"}', '{"x.y": 5.0005, "q\'r": "S"}'),
        ("1", "1"), (None, "2"), ("[]", None), (None, None),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    side = lambda c: rows.select("k", F.parse_json(c).alias("v"))
    got = sorted((r.k, r.path, r.difference, r.expected, r.actual) for r in compare.differences(side("a"), side("b"), "k", "v", relative=1e-3).collect())
    assert got == [(0, "$.b[1].c", "type", "null", "2"), (0, "$.b[2]", "extra", None, "3"), (0, "$.e", "type", None, None), (1, "$['q\\'r']", "value", '"s"', '"S"'), (3, "$", "extra", None, "2"), (4, "$", "missing", None, None)]
    exact = compare.differences(side("a"), side("b"), "k", "v").where("path LIKE '%x.y%'").collect()
    assert [(r.path, r.difference) for r in exact] == [("$['x.y']", "value")]
    assert compare.differences(side("a").where("false"), side("b").where("false"), "k", "v").collect() == []


def test_pools_stop_at_another_identity(spark, tmp_path):
    kind = "problem_id bigint, sample_id bigint, answer string, correct boolean, identity string"
    add = lambda rows: spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: pools.kept(pools.readouts(incremental.arriving(spark, f"{tmp_path}/in", kind)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    add([(1, 0, "a", True, "p"), (1, 3, "b", False, "p"), (2, 0, None, False, "p")])
    run()
    add([(1, 1, "b", True, "p"), (1, 0, "a", True, "p")])
    run()
    got = {r.problem_id: (r.num_candidates, r.answer, r.votes, r.sample_id, r.correct) for r in pools.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {1: (3, "b", 2, 1, True), 2: (1, None, 0, None, False)}
    add([(2, 1, "c", True, "other")])
    with pytest.raises(Exception, match="a shard of other"):
        run()


def test_pools_of_many_problems_need_no_python(spark, tmp_path):
    """One call of Python per problem and batch was too slow; votes, ties and repeats against a plain version."""
    rows = [(p, s, [None, "a", "b", "c"][(p * 7 + s * s) % 4], (p + s) % 2 == 0, "p") for p in range(3000) for s in range(p % 9 + 1)]
    kind = "problem_id bigint, sample_id bigint, answer string, correct boolean, identity string"
    for part in (0, 1, 0):
        spark.createDataFrame([r for r in rows if r[1] % 2 == part], kind).write.mode("append").parquet(f"{tmp_path}/in")
        stream = pools.readouts(incremental.arriving(spark, f"{tmp_path}/in", kind))
        pools.kept(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan and "FlatMapGroups" not in plan
    want, per = {}, {}
    for p, s, a, ok, _ in rows:
        per.setdefault(p, []).append((s, a, ok))
    for p, cs in per.items():
        votes = {a: (sum(x[1] == a for x in cs), -min(x[0] for x in cs if x[1] == a)) for _, a, _ in cs if a is not None}
        best = max(votes, key=votes.get, default=None)
        low = -votes[best][1] if votes else None
        want[p] = (len(cs), best, votes[best][0] if votes else 0, low, next((x[2] for x in cs if x[0] == low), False), sum(x[0] % 2 == 0 for x in cs))
    got = {r.problem_id: (r.num_candidates, r.answer, r.votes, r.sample_id, r.correct, r.repeated) for r in pools.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == want


@pytest.mark.parametrize("again", [(1, 0, "b", True, "p"), (1, 0, "a", False, "p"), (1, 0, "a", True, None), (1, None, "a", True, "p")])
def test_pools_stop_at_a_candidate_that_changed(spark, tmp_path, again):
    kind = "problem_id bigint, sample_id bigint, answer string, correct boolean, identity string"
    for rows in ([(1, 0, "a", True, "p")], [again]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
        query = pools.kept(pools.readouts(incremental.arriving(spark, f"{tmp_path}/in", kind)), f"{tmp_path}/out", f"{tmp_path}/state")
        if rows[0] is not again:
            query.awaitTermination()
    with pytest.raises(Exception, match="problem 1: a (candidate|shard)"):
        query.awaitTermination()
