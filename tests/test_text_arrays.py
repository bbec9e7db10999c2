"""Texts, arrays, particles, gates, lineage on the survey's fixtures."""

import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text, udf
from corvane.operators import arrays, denoise, gates, joins, lineage, particles, resample, stats


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<int>' if isinstance(v, list) and all(isinstance(x, int) for x in v) else 'array<double>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


@pytest.mark.parametrize(
    "value, bon, generator, guided",
    [("$1,234.50", "1234.500000", "1234.500000", "$1234.50"), ("3.9", "3.900000", "3.900000", "3"), ("7d", "7d", "7d", "7d"), ("", None, "", ""), (" Yes ", "yes", "yes", "Yes"), ("-0.0", "0", "0", "0"), ("1e20", "100000000000000000000", "1e20", "100000000000000000000"), ("12%", "12", "12", "12%"), ("inf", "inf", "inf", "inf"), ("-3.7", "-3.700000", "-3.700000", "-3"), ("0.1234565", "0.123456", "0.123456", "0"), ("-0.3", "-0.300000", "-0.300000", "0"), ("1e23", "99999999999999991611392", "1e23", "99999999999999991611392"), ("9007199254740993", "9007199254740992", "9007199254740993", "9007199254740992")],
)
def test_normal_forms(spark, value, bon, generator, guided):
    got = spark.createDataFrame([(value,)], "s string").select(text.normalize_bon(F.col("s")), text.normalize_generator(F.col("s")), text.normalize_guided(F.col("s"))).first()
    assert tuple(got) == (bon, generator, guided)


def test_six_decimals_are_those_of_the_binary_value(spark):
    r = random.Random(8)
    values = [r.choice([-1, 1]) * r.uniform(0, 10.0 ** r.randrange(-8, 17)) for _ in range(4000)]
    values += [round(r.uniform(0, 1000), 6) + 5e-7 for _ in range(4000)] + [k / 128 for k in range(-500, 500)] + [0.9999995, 0.99999949999, 1e-9, -1e-9, 5e-7, 1.5e-6, 2.0**53 + 2, 123456789012345.67, 8e36]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed6(F.col("v")).alias("t")).collect()
    assert [x.t for x in rows] == [f"{x.v:.6f}" for x in rows]


def test_null_forms(spark):
    got = spark.createDataFrame([(None,)], "s string").select(text.normalize_bon(F.col("s")), text.normalize_generator(F.col("s")), text.normalize_guided(F.col("s")), text.extract_generator(F.col("s")), text.extract_guided(F.col("s"))).first()
    assert tuple(got) == (None, "none", None, None, None)


@pytest.mark.parametrize(
    "value, generator, guided",
    [("x #### 5 then #### 6", "5", "6"), ("The ANSWER is: 1,000.", "1000", "1000."), (r"so \boxed{42} and 7", "42", "7"), ("first 3, last -4.5", "-4.500000", "-4.5"), ("none", None, None), ("#### .", ".", None)],
)
def test_extraction(spark, value, generator, guided):
    got = spark.createDataFrame([(value,)], "s string").select(text.extract_generator(F.col("s")), text.extract_guided(F.col("s"))).first()
    assert tuple(got) == (generator, guided)


@pytest.mark.parametrize(
    "value, want",
    [(r"first \boxed{wrong}; then \boxed{\left(3, \frac{\pi}{2}\right)}.", r"\left(3, \frac{\pi}{2}\right)"), (r"answer $\boxed 17$ done", "17"), (r"answer \fbox{\frac{2}{3}}", r"\frac{2}{3}"), ("no final answer", None), (r"\boxed{unclosed", None), (r"\boxed{}", None), (None, None)],
)
def test_last_boxed(value, want):
    assert udf.last_boxed(value) == want


def test_batch_functions_keep_nulls(spark):
    rows = spark.createDataFrame([("Ａ  B\nC",), (None,)], "s string").select(udf.column(udf.normal_text, T.StringType(), "s").alias("s")).collect()
    assert [r.s for r in rows] == ["A B C", None]


def test_math_forms(spark):
    forms = {" $1e16$ ": "1e+16", r"\text{ab}  c": "ab c", "\u00a0$$ x\ty $\n": "x y", "1_000": "1000.0", "-.5": "-0.5", "1/2": "1/2", "": "", "$": "", "NaN": "nan", "-inf": "-inf", "0.00001": "1e-05", "1__0": "1__0", "5.": "5.0", None: None}
    got = spark.createDataFrame([(x,) for x in forms], "s string").select("s", udf.math_form(F.col("s")).alias("f")).collect()
    assert {r.s: r.f for r in got} == forms
    pairs = {("0.5", "1/2"): False, (r"\text{ab} c", "ab c"): True, ("0.5000000001", "0.5"): True, (None, "1"): False, (None, None): False, ("5", "{5.0}"): True, ("inf", "inf"): True, ("1", "2"): False, (r"\frac{1}{2}", r"\frac 12"): True, ("nan", "NaN"): True}
    rows = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", udf.math_form(F.col("a")).alias("x"), udf.math_form(F.col("b")).alias("y"))
    assert {(r.a, r.b): r.e for r in rows.select("a", "b", udf.math_equal(F.col("x"), F.col("y")).alias("e")).collect()} == pairs


def grade(a, b):
    if a == "raise":
        raise RuntimeError("bad\nline")
    if a == "timeout":
        raise TimeoutError("late")
    if a == "exit":
        os._exit(3)
    while a == "hang":
        time.sleep(1000)
    return float(a == b)


def test_grades_have_a_status():
    own = udf.Grader(grade, 5.0)
    assert [own.run(a, "x")["status"] for a in ("x", "y", "raise", "timeout", "exit", "x")] == ["ok", "ok", "error", "timeout", "error", "ok"]
    assert own.run("x", "x")["correct"] and not own.run("17", "18")["correct"] and own.run("raise", "x")["error_message"] == "bad line"
    assert own.run(None, None)["correct"] and own.run("exit", "x")["error_type"] == "ChildProcessError"
    process = own.process
    own.close()
    assert process is None or not process._popen or own.process is None
    with pytest.raises(ValueError, match="positive"):
        udf.Grader(grade, 0)


def test_a_grader_that_hangs_is_killed(spark):
    began = time.monotonic()
    own = udf.Grader(grade, 0.5)
    assert own.run("hang", "x")["status"] == "timeout" and time.monotonic() - began < 1.5
    assert own.run("x", "x")["status"] == "ok"
    own.close()
    rows = spark.createDataFrame([("hang", "x"), ("x", "x"), (None, "x"), ("hang", "y"), ("y", "y")], "a string, b string").coalesce(1)
    got = [(r.grade.status, r.grade.correct) for r in udf.grade_status(rows, "a", "b", grade, 0.5).collect()]
    assert got == [("timeout", False), ("ok", True), ("ok", False), ("timeout", False), ("ok", True)]


def test_file_names(spark):
    rows = spark.createDataFrame([("a/vanilla_t_steps128_temp0.7_at0.1_tp0.9_seed43_bon_c2.json",), ("vanilla_t_steps128_seed1.json",)], "n string").select(*text.file_config(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(0.7, 0.1, 0.9, 43, "c2"), (0.2, 0.0, 0.95, 1, None)]


def test_methods_and_prompts(spark):
    assert text.parse_methods("prm,orm") == ["majority", "oracle", "prm", "orm"]
    with pytest.raises(ValueError):
        text.parse_methods("best")
    assert one(spark, text.few_shot_prompt(F.col("q"), [("a", "b")]), q="c") == "Question: a\nAnswer: b\n\nQuestion: c\nAnswer:"
    assert one(spark, text.conclusion(F.col("a"), F.col("b")), a=0.5, b=0.6) == "fails to recover (gap=+0.100)"


def test_arrays(spark):
    ids = F.col("x")
    assert one(spark, arrays.strip_padding(ids, 9), x=[1, 9, 2, 9, 9]) == [1, 9, 2]
    assert one(spark, arrays.strip_padding(ids, 9), x=[9, 9]) == [9]
    assert one(spark, arrays.until_end(ids, 5, 7), x=[1, 7, 2, 5, 3]) == [1, 2]
    assert one(spark, arrays.until_end(ids, 5, 7), x=[5, 1]) == []
    assert one(spark, arrays.mask_right_half(ids, 0), x=[1, 2, 3]) == [1, 0, 0]
    assert one(spark, arrays.share_of(ids, 1), x=[1, 2, 1, 1]) == 0.75
    assert one(spark, arrays.reverse_generated(F.array(F.lit(8)), ids), x=[1, 2]) == [8, 2, 1]
    assert one(spark, arrays.masked_mean(F.col("v"), ids, F.lit(1), 5, 7), v=[9.0, 1.0, 3.0, 5.0, 7.0], x=[1, 2, 7, 2, 5]) == 3.0
    assert one(spark, arrays.masked_mean(F.col("v"), ids, F.lit(1), 5, 7), v=[9.0, 1.0], x=[1, 5]) == 0.0
    assert arrays.capture_schedule(128, 6) == [-1, *range(0, 127, 6), 127] and len(arrays.capture_schedule(128, 6)) == 24
    assert one(spark, F.size(arrays.sinusoidal(F.col("r"), 7)), r=0.5) == 7
    rows = spark.createDataFrame([(1, [0, 1, 2], [[1], [2]], [1.0, 0.5, 0.0])], "t int, steps array<int>, states array<array<int>>, ratios array<double>")
    assert [(r.step, r.mask_ratio) for r in arrays.flatten_snapshots(rows, "steps", "states", "ratios", 0.5, 1.0).collect()] == [(0, 1.0), (1, 0.5)]


def test_particles(spark):
    rows = spark.createDataFrame([(1, k, s, w) for k, (s, w) in enumerate(zip([0.5, 0.7, 0.7, -1.0], [1.0, 0.0, 2.0, 1.0]))], "problem_id int, sample_id int, s double, w double")
    assert [r.sample_id for r in particles.top_m(rows, "s", 3).orderBy("place").collect()] == [1, 2, 0]
    assert [(r.child, r.parent) for r in particles.expanded(particles.top_m(rows, "s", 2), 4, 2).orderBy("child").collect()] == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert particles.non_finite(rows.withColumn("s", F.when(F.col("sample_id") == 1, float("nan")).otherwise(F.col("s"))), "s").count() == 1
    assert particles.ess(rows, "w").first().ess == pytest.approx(16 / 6)
    got = sorted((r.slot, r.ancestor) for r in particles.systematic_resample(rows, "w", F.lit(0.5)).collect())
    assert got == [(0, 0), (1, 2), (2, 2), (3, 3)]
    beta = particles.tempering(rows.withColumn("h", particles.probability(F.col("s"))), "h", 4.0).first()
    assert beta.beta == 0.0
    weights = particles.final_weights(rows.withColumns({"v": F.lit(0.25), "h": F.lit(0.5), "g": F.col("s") + 2}), "v", "h", "g", 0.5)
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    assert one(spark, particles.transfer_count(F.lit(10), F.col("s"), 4), s=3) == 10


def test_gates(spark):
    rows = spark.createDataFrame([(1, 0, "7", "7", True), (1, 1, None, "7", False), (2, 0, "8", "7", True), (2, 2, None, None, True)], "problem_id int, sample_id int, answer string, gold string, correct boolean")
    bad = gates.candidate_set(rows, 2)
    assert sorted((r.check, r.key) for r in bad.collect()) == [("correct", "2/0"), ("correct", "2/2"), ("ids", "2")]
    with pytest.raises(gates.GateError):
        gates.require("candidates", bad)
    gates.require("candidates", gates.candidate_set(rows.where("problem_id = 1"), 2))
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 1, float("inf")), (1, 5, 2.0)], "problem_id int, sample_id int, score double")
    assert sorted(r.check for r in gates.score_vector(rows.where("problem_id = 1"), scores).collect()) == ["finite", "unknown"]
    assert gates.config({"k": 4, "m": 3}, {"k": lambda k: k > 0, "m": lambda m: 4 % m == 0, "z": bool}) == ["m", "z"]
    assert gates.pool_spec(42, 8, {(42, 8)}) and not gates.pool_spec(43, 8, {(42, 8)})


def test_overlap_and_cover(spark):
    key = F.sha2(udf.column(udf.normal_text, T.StringType(), "t"), 256)
    left = spark.createDataFrame([("a", "Find  x + 1"), ("b", "other")], "id string, t string").withColumn("k", key)
    right = spark.createDataFrame([("e", "Find x + 1")], "id string, t string").withColumn("k", key)
    assert [(r.left_ids, r.right_ids) for r in joins.overlap(left, right, "k").collect()] == [("a", "e")]
    ids = spark.createDataFrame([(i,) for i in range(4)], "id int")
    parts = {"fit": ids.where("id < 2"), "validation": spark.createDataFrame([(1,), (2,), (9,)], "id int")}
    assert sorted((r.violation, r.id) for r in joins.cover_violations(ids, parts, "id").collect()) == [("missing", 3), ("overlap", 1), ("unknown", 9)]


def test_lineage(spark):
    import random

    for ids in ([str(i) for i in range(20)], ["same-head-" + str(i) for i in range(30)] + ["", "é", "same-head"], ["one"]):
        want = sorted(ids)
        random.Random(42).shuffle(want)
        n = max(1, int(len(ids) * 0.1))
        rows = spark.createDataFrame([(i,) for i in ids], "id string")
        got = lineage.problem_split(rows, "id", 42).collect()
        assert sorted(r.id for r in got if r.split == "validation") == sorted(want[:n]) and sorted(r.id for r in got if r.split == "fit") == sorted(want[n:])
    with pytest.raises(ValueError):
        lineage.problem_split(rows.union(rows), "id", 1)
    with pytest.raises(ValueError):
        lineage.problem_split(rows, "id", 1, share=1.0)
    assert lineage.problem_split(rows.where("false"), "id", 1).collect() == []
    assert lineage.canonical_json({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    assert math.isclose(len(lineage.sha256_text("x")), 64)


def test_positions_and_prefixes(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 3, 11)], "problem_id int, o int, value int")
    b = spark.createDataFrame([(1, 5, 20)], "problem_id int, o int, value int")
    assert sorted(map(tuple, joins.aligned(a, b, "o").collect())) == [(1, 0, 10, 20), (1, 1, 11, None)]
    pool = spark.createDataFrame([(1, 0), (1, 1)], "problem_id int, sample_id int")
    assert [r.reused for r in joins.prefix_extended(pool, 4).orderBy("sample_id").collect()] == [True, True, False, False]


def test_denoising_resumes_and_ignores_order(spark):
    rows = [(i, [49] * 12 + [1, 2], 0, 100 + i) for i in range(6)]
    schema = "id int, x array<int>, next_step int, seed bigint"
    kernel = denoise.toy_kernel(40)
    whole = {r.id: r.x for r in denoise.run(spark.createDataFrame(rows, schema), 8, 49, kernel).collect()}
    assert all(49 not in x and x[12:] == [1, 2] for x in whole.values())
    for cut in (1, 3, 6):
        half = denoise.run(spark.createDataFrame(rows[::-1], schema), 8, 49, kernel, cut)
        assert {r.id: r.x for r in denoise.run(half, 8, 49, kernel).collect()} == whole
    other = {r.id: r.x for r in denoise.run(spark.createDataFrame([(i, x, s, seed + 1000) for i, x, s, seed in rows], schema), 8, 49, kernel).collect()}
    assert other != whole


def test_denoising_by_a_model():
    import numpy as np

    scores = np.log(np.array([[0.5, 0.3, 0.2], [0.1, 0.8, 0.1], [0.4, 0.35, 0.25]]))
    got = {kind: denoise.model_kernel(lambda ids, at: scores, kind)(np.zeros(3), 0, 1) for kind in denoise.CONFIDENCE}
    assert all(taken.tolist() == [0, 1, 0] for taken, _ in got.values())
    assert got["probability"][1] == pytest.approx([0.5, 0.8, 0.4]) and got["margin"][1] == pytest.approx([0.2, 0.7, 0.05])
    assert got["entropy"][1] == pytest.approx((np.exp(scores) * scores).sum(axis=1))
    assert np.isinf(denoise.nucleus(scores, 0.6)).tolist() == [[False, False, True], [True, False, True], [False, False, True]]
    assert np.isinf(denoise.nucleus(scores, 1.0, 1)).sum() == 6
    draw = denoise.model_kernel(lambda ids, at: np.repeat(scores[:1], 20000, axis=0), temperature=1.0)
    taken, _ = draw(np.zeros(20000), 3, 7)
    assert np.bincount(taken) / 20000 == pytest.approx([0.5, 0.3, 0.2], abs=0.02) and (draw(np.zeros(20000), 3, 7)[0] == taken).all()
    with pytest.raises(FloatingPointError):
        denoise.model_kernel(lambda ids, at: np.full((1, 3), np.nan))(np.zeros(1), 0, 1)
    # With heat each step's places are drawn: the surest place first in proportion to exp(confidence / heat).
    sure = lambda ids, at, seed: (np.zeros(4, np.int64), np.array([np.log(4.0), 0.0, 0.0, 0.0]))
    steps = [denoise.step(np.full(4, 9), 0, 2, 9, seed, sure, heat=1.0) for seed in range(3000)]
    assert {int((x == 0).sum()) for x in steps} == {1} and np.mean([x[0] == 0 for x in steps]) == pytest.approx(4 / 7, abs=0.04)


def test_sequential_bootstrap_and_p_values():
    import random

    y = [1, 0, 1, 1, 0, 1, 0, 1, 1, 1]
    stream = random.Random(7)
    means = sorted(sum(y[stream.randrange(10)] for _ in range(10)) / 10 for _ in range(200))
    assert resample.sequential(y, 200, 7) == (0.7, means[5], means[195])
    assert resample.sequential([], 10, 1) == (0.0, 0.0, 0.0)
    assert stats.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and stats.t_tail(0.5, 3) == pytest.approx(0.65145, abs=1e-4)
    assert stats.t_tail(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert stats.spearman_p(1.0, 5) == 0.0 and stats.spearman_p(0.5, 2) is None and stats.spearman_p(None, 9) is None
