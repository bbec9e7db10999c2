"""Selection on the fixtures of the survey, and properties that need no oracle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import resample, select, stats, summary
from corvane.operators.order import numbered, running, with_part

POOL = "problem_id bigint, sample_id int, answer string, gold string"


def pool(spark, rows):
    df = spark.createDataFrame(rows, POOL)
    return df.withColumn("correct", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)))


def test_readout_with_invalid_answers(spark):
    rows = [(1, 0, None, "7"), (1, 1, None, "7"), (1, 2, "7", "7"), (1, 3, "8", "7"), (2, 7, None, None), (2, 2, None, None)]
    got = {r.problem_id: r for r in select.majority_readout(pool(spark, rows)).collect()}
    a, b = got[1], got[2]
    assert (a.selected_answer, a.selected_sample_id, a.is_correct, a.num_valid, a.num_invalid, a.invalid_rate, a.unique_answers, a.entropy_bits, a.fallback_used) == ("7", 2, True, 2, 2, 0.5, 2, 1.0, False)
    assert (b.selected_answer, b.selected_sample_id, b.is_correct, b.unique_answers, b.entropy_bits, b.fallback_used) == (None, 2, False, 0, 0.0, True)
    assert {r.answer for r in select.clusters(pool(spark, rows)).collect()} == {"7", "8"}


def test_majorities_differ(spark):
    rows = [(1, 0, None, "7"), (1, 1, None, "7"), (1, 2, None, "7"), (1, 3, "7", "7"), (1, 4, "7", "7")]
    p = pool(spark, rows)
    assert select.majority_bon(p).first().is_correct is True
    null = select.majority_with_null_class(p).first()
    assert null.answer is None and null.is_correct is False
    assert select.majority_strict(p).first().is_correct is False
    assert select.majority_canonical(p, F.lower("answer")).first().is_correct is True


def test_ties_go_to_the_lowest_position(spark):
    p = pool(spark, [(1, 0, "b", "a"), (1, 1, "a", "a"), (1, 2, "a", "a"), (1, 3, "b", "a")]).withColumn("s", F.when(F.col("sample_id") < 2, 5.0).otherwise(1.0))
    assert select.majority_bon(p).first().answer == "b"
    assert select.rerank(p, "s").first().sample_id == 0


def test_rerank_filters_after_the_cut_and_skips_nan(spark):
    p = pool(spark, [(1, 0, "a", "a"), (1, 1, "b", "a"), (1, 2, "a", "a")]).withColumn("s", F.when(F.col("sample_id") == 0, F.lit(None)).when(F.col("sample_id") == 1, float("nan")).otherwise(9.0))
    assert select.rerank(select.first_n(p, 2), "s").count() == 0
    assert select.rerank(p, "s").first().sample_id == 2


def test_equivalence_is_transitive(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 9.0), (1, 2, 3.0), (1, 3, 5.0), (2, 0, 1.0)], "problem_id bigint, sample_id int, value double")
    got = {(r.problem_id, r.sample_id): r.class_id for r in select.equivalence_classes(rows, 2.0).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (1, 3): 0, (2, 0): 0}
    nulls = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, 5.0)], "problem_id bigint, sample_id int, value double")
    assert {r.sample_id: r.class_id for r in select.equivalence_classes(nulls, 2.0).collect()} == {0: None, 1: None, 2: 2}


@pytest.fixture(scope="module")
def random_pool(spark):
    r = random.Random(1)
    return pool(spark, [(p, k, r.choice(["1", "2", "3", None]), str(1 + p % 2)) for p in range(60) for k in range(r.randrange(1, 9))]).withColumn("s", F.crc32(F.concat_ws("-", "problem_id", "sample_id")) % 5 / 1.0).cache()


def test_properties(spark, random_pool):
    ns = (1, 2, 4, 8)
    b = select.budgets(random_pool, ns)
    keys = ("problem_id", "n")
    acc = {}
    for name, df in {"oracle": select.oracle(b, *keys), "majority": select.majority_with_null_class(b, *keys), "rerank": select.rerank(b, "s", *keys)}.items():
        acc[name] = {r.n: r.accuracy for r in select.accuracy(df, "n").collect()}
    one = {r.n: r for r in select.outcomes(b, ("s",), *keys).groupBy("n").agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in ("oracle", "majority", "s")]).collect()}
    assert all((one[n].oracle, one[n].majority, one[n].s) == pytest.approx((acc["oracle"][n], acc["majority"][n], acc["rerank"][n])) for n in ns)
    assert acc["oracle"][1] == acc["majority"][1] == acc["rerank"][1]
    assert all(acc["oracle"][n] >= max(acc["majority"][n], acc["rerank"][n]) for n in ns)
    assert [acc["oracle"][n] for n in ns] == sorted(acc["oracle"].values())
    mixed = random_pool.orderBy(F.rand(3)).repartition(7)
    assert sorted(select.majority_readout(mixed).collect()) == sorted(select.majority_readout(random_pool).collect())
    assert all(0 <= r.entropy_bits <= math.log2(max(1, r.unique_answers)) + 1e-9 for r in select.majority_readout(random_pool).collect())
    assert summary.pool_summary(random_pool.withColumn("q", F.lit(1)), "q").first().num_problems == 60


def test_weighted_vote_and_fallback(spark):
    p = pool(spark, [(1, 0, "a", "a"), (1, 1, "b", "a"), (1, 2, None, "a"), (2, 0, None, "a")]).withColumn("w", F.lit(1.0))
    got = {r.problem_id: r for r in select.weighted_vote(p, "w").collect()}
    assert got[1].answer == "a" and got[1].is_correct and abs(got[1].share - 1 / 3) < 1e-5 and got[1].valid_share == 0.5
    assert got[2].answer is None and not got[2].is_correct and got[2].fallback_used and got[2].fallback_sample_id == 0 and got[2].share == got[2].invalid_mass == 1.0
    heavy = pool(spark, [(1, 0, None, "a"), (1, 1, None, "a"), (1, 2, None, "a")]).withColumn("w", F.when(F.col("sample_id") > 0, 0.4).otherwise(0.2))
    assert select.weighted_vote(heavy, "w").first().fallback_sample_id == 1


def test_auc_against_all_pairs(spark):
    r = random.Random(4)
    rows = [(float(r.randrange(20)), int(r.random() < 0.4), g) for g in "ab" for _ in range(150)]
    got = {x.g: x.auc for x in stats.auc(spark.createDataFrame(rows, "v double, y int, g string"), ["g"], "v", "y").collect()}
    for g in "ab":
        pos, neg = ([v for v, y, h in rows if h == g and y == k] for k in (1, 0))
        assert abs(got[g] - sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) < 1e-12
    one = spark.createDataFrame([(1.0, 1, "a")] * 20 + [(1.0, 0, "b")] * 3 + [(2.0, 1, "b")] * 3, "v double, y int, g string")
    assert {x.g: x.auc for x in stats.auc(one, ["g"], "v", "y").collect()} == {"a": None, "b": None}


def test_gamma_leaves_ties_out(spark):
    rows = spark.createDataFrame([(1, 1.0, True), (1, 1.0, False), (1, 2.0, True), (1, 0.5, False), (2, 1.0, True)], "p int, s double, c boolean")
    assert [(r.p, r.gamma) for r in stats.gamma(rows, "p", "s", "c").collect()] == [(1, 1.0)]


def test_buckets_by_both_rules(spark):
    got = spark.createDataFrame([(0.3,), (0.0,), (1.0,)], "r double").select(stats.decile("r").alias("a"), stats.decile_by_division("r").alias("b"), stats.range_bucket("r").alias("c")).collect()
    assert [tuple(x) for x in got] == [(3, 2, "0.3-0.50"), (0, 0, "0.0-0.10"), (9, 9, "0.9-1.01")]


def test_numbers_and_running_sums_over_parts(spark):
    r = random.Random(3)
    values = [r.random() for _ in range(500)] + [0.5] * 50
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").repartition(6)
    got = [x.i for x in numbered(rows, "v", "i").orderBy("ordinal").collect()]
    assert got == [i for _, i in sorted((v, i) for i, v in enumerate(values))]
    assert [x.i for x in numbered(rows.withColumn("v", F.when(F.col("i") % 3 > 0, F.col("v"))), "v", "i").orderBy("ordinal").collect()] == [i for _, i in sorted((-1 if i % 3 == 0 else v, i) for i, v in enumerate(values))]
    one = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    before, total = {}, 0
    for x in sorted(one.collect()):
        before[x.v], total = total, total + x.n
    assert {x.v: x.b for x in running(one.withColumn("g", F.lit(1)), ["g"], "v", {"b": "n"}).collect()} == before


def test_paired_delta_is_the_difference_of_points(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0, i % 3 == 0) for i in range(90)], "problem_id bigint, a boolean, b boolean")
    points = {r.method: r.point for r in resample.bootstrap(rows, ["a", "b"], 40).collect()}
    pair = resample.paired_bootstrap(rows, [("a", "b")], 40).first()
    assert abs(pair.delta - (points["a"] - points["b"])) < 1e-12 and pair.lo <= pair.delta <= pair.hi


def test_seed_is_the_documented_hash(spark):
    import hashlib
    import json

    row = spark.createDataFrame([(42, 17, 3, "smc_stage1")], "b int, p int, k int, s string").select(resample.derive_seed("b", "p", "k", "s")).first()[0]
    assert row == int.from_bytes(hashlib.sha256(json.dumps([42, 17, 3, "smc_stage1"], separators=(",", ":")).encode()).digest()[:8], "big") & ((1 << 63) - 1)


@pytest.mark.parametrize("kind", ["constant", "third", "null"])
def test_one_value_goes_to_all_tasks(spark, kind):
    """A value of many rows is dealt out by its ties: numbers, or texts with a long beginning in common."""
    value = {"constant": F.lit(7), "third": F.when(F.col("i") % 3 == 0, 50).otherwise(F.col("i") % 100), "null": F.when(F.col("i") % 2 == 0, F.col("i"))}[kind]
    rows = spark.range(4000).select(F.col("id").alias("i")).withColumns({"v": value.cast("int"), "name": F.format_string("train_example_%06d", F.col("i") * 7919 % 4001)}).repartition(7)
    for tie in ("i", "name"):
        dealt = with_part(rows, "v", 8, (tie,)).groupBy("_part").count().collect()
        assert max(r["count"] for r in dealt) < 1100 and len(dealt) >= 6
        got = [(x.v, x[tie]) for x in numbered(rows, "v", tie).orderBy("ordinal").collect()]
        assert got == sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_random_rerank_with_gaps(spark):
    rows = [(p, s, s == 90) for p in range(60) for s in (3, 17, 90)]
    df = spark.createDataFrame(rows, "problem_id bigint, sample_id bigint, correct boolean")
    got = [r.accuracy for r in resample.random_rerank(df, 12).collect()]
    assert len(got) == 12 and 0.2 < sum(got) / 12 < 0.47
