"""The readout by a pluggable comparison against all pairs with union-find."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.equivalence import equivalence_readout


def near(a, b):
    """Neither transitive nor always able to compare; z is not even equal to itself, nor to y."""
    if "z" in (a, b) or a == b == "y":
        return False
    if "y" in (a, b):
        return "1" in (a, b)
    if "x" in (a, b):
        raise ValueError("can't\ncompare")
    return abs(int(a) - int(b)) <= 1


def brute(members):
    """Every pair of valid candidates, one by one."""
    valid = [(s, a, c) for s, a, c in sorted(members) if a is not None]
    up = list(range(len(valid)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    errors = []
    for i in range(len(valid)):
        for j in range(i + 1, len(valid)):
            try:
                same = near(valid[i][1], valid[j][1])
            except ValueError:
                errors.append((valid[i][0], valid[j][0]))
                continue
            if same:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    groups = {}
    for i, (s, _, _) in enumerate(valid):
        groups.setdefault(find(i), []).append(s)
    clusters = sorted(groups.values())
    if not clusters:
        return None, 0, min(members)[0], False, [], errors, 0.0
    best = max(clusters, key=lambda g: (len(g), -g[0]))
    own = next(v for v in valid if v[0] == best[0])
    n = len(valid)
    return own[1], len(best), best[0], bool(own[2]), clusters, errors, -sum(len(g) / n * math.log2(len(g) / n) for g in clusters)


def test_as_all_pairs(spark):
    r = random.Random(6)
    problems = {p: [(s, r.choice(["1", "2", "3", "5", "6", "9", "x", "y", "z", None]), r.choice([True, False, None])) for s in r.sample(range(20), r.randrange(1, 9))] for p in range(80)}
    problems[100] = [(3, None, True), (1, None, True)]
    rows = [(p, s, a, c) for p, m in problems.items() for s, a, c in m]
    frame = spark.createDataFrame(rows, "problem_id bigint, sample_id int, answer string, correct boolean").repartition(5)
    got = {x.problem_id: x for x in equivalence_readout(frame, near).collect()}
    assert got.keys() == problems.keys()
    for p, members in problems.items():
        x, want = got[p], brute(members)
        assert (x.selected_answer, x.selected_count, x.selected_sample_id, x.correct) == want[:4], p
        assert [c.sample_ids for c in x.clusters] == want[4] and x.entropy_bits == pytest.approx(want[6])
        assert sorted((e.left_sample_id, e.right_sample_id) for e in x.errors) == want[5] and x.error_count == len(want[5])
        n = sum(a is not None for _, a, _ in members)
        assert (x.num_valid, x.num_invalid, x.comparison_count, x.fallback_used) == (n, len(members) - n, n * (n - 1) // 2, n == 0)
    assert got[100].fallback_sample_id == 1 and got[100].invalid_sample_ids == [1, 3]
    assert all(e.error_message == "can't compare" for x in got.values() for e in x.errors)


def test_empty(spark):
    none = spark.createDataFrame([], "problem_id bigint, sample_id int, answer string, correct boolean")
    assert equivalence_readout(none, near).count() == 0
    assert equivalence_readout(none.withColumn("other", F.lit(1)), near).columns[0] == "problem_id"
