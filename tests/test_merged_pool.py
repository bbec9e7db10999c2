"""Shards as one pool with its gates, frozen splits, and the gates of trajectories."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import gates
from corvane.operators.gates import GateError

KEYS = ["problem_id", "sample_id"]


def test_merged_pool(spark):
    rows = spark.createDataFrame([(p, s, p % 4) for p in range(12) for s in range(2)], "problem_id bigint, sample_id int, shard int")
    said = [(k, 4, True, 42) for k in range(4)]
    shards = lambda x: spark.createDataFrame(x, "shard int, num_shards int, complete boolean, seed int")
    pool, lacking = gates.merged_pool(rows, shards(said), KEYS, ["seed"], problems=12)
    assert (pool.count(), lacking) == (24, [])
    less = [said[0], said[1], (2, 4, False, 42)]
    with pytest.raises(GateError, match="missing or incomplete"):
        gates.merged_pool(rows, shards(less), KEYS, ["seed"])
    pool, lacking = gates.merged_pool(rows, shards(less), KEYS, ["seed"], missing="skip")
    assert (pool.count(), lacking) == (12, [2, 3])
    for wrong, says in (([*said, said[1]], "shards"), ([*said[:3], (9, 4, True, 42)], "shards"), ([*said[:3], (3, 5, True, 42)], "num_shards"), ([*said[:3], (3, 4, True, 43)], "identity"), ([], "num_shards")):
        with pytest.raises(GateError, match=says):
            gates.merged_pool(rows, shards(wrong), KEYS, ["seed"], missing="skip")
    with pytest.raises(GateError, match="repeated"):
        gates.merged_pool(rows.union(rows.limit(1)), shards(said), KEYS)
    with pytest.raises(GateError, match="problems"):
        gates.merged_pool(rows, shards(said), KEYS, problems=13)


def test_frozen_split(spark):
    kind = "id string, split string"
    frozen = spark.createDataFrame([("a", "fit"), ("b", "fit"), ("c", "validation")], kind)
    assert gates.frozen_split(frozen, frozen, "id").collect() == []
    mine = spark.createDataFrame([("a", "validation"), ("c", "validation"), ("c", "validation"), ("d", "fit"), (None, "fit")], kind)
    got = sorted((r.check, str(r.key)) for r in gates.frozen_split(mine, frozen, "id").collect())
    assert got == [("missing", "b"), ("repeated", "c"), ("side", "a"), ("unknown", "None"), ("unknown", "d")]


def test_trajectory_ranges_and_weights(spark):
    kind = "problem_id bigint, trajectory_id int, snapshot_steps array<int>, mask_ratios array<double>, generated_token_ids array<int>, graded boolean, is_correct boolean, calls int, prompt_ids array<int>, prompt_sha256 string"
    good = (1, 0, [0, 2], [0.5, 0.0], [7], True, True, 2, [3, 4], None)
    rows = spark.createDataFrame([good, (1, 5, [0, 3], [0.5, 0.6, 1.2], [7, 8], True, None, 3, [], None)], kind).withColumn("prompt_sha256", gates.token_hash("prompt_ids"))
    got = sorted((r.check, r.key) for r in gates.trajectory(rows, [0, 2], 1, samples=5, steps=2, prompts=True).collect())
    assert got == [(c, "1/5") for c in ("calls", "falling", "label", "prompt", "range", "ratios", "steps", "tokens", "trajectory")]
    w = spark.createDataFrame([(1, 0.5), (1, -1.0), (2, None), (3, 0.0), (4, float("nan")), (5, 1.0)], "problem_id int, w double")
    assert sorted((r.check, r.key) for r in gates.weights(w, "w").collect()) == [("sum", "1"), ("sum", "2"), ("sum", "3"), ("weight", "1"), ("weight", "2"), ("weight", "4")]
    none = spark.createDataFrame([], "shard int, n int, complete boolean")
    assert [r.check for r in gates.contiguous_shards(none, "shard", "n", "complete").collect()] == ["shards"]
