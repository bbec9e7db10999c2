"""The registered bootstraps against 1,000 resamples drawn and ordered in Python."""

import numpy as np
import pytest

from corvane.operators import resample
from corvane.plans import QUERIES
from corvane.plans.stat_queries import _outcomes
from tests.oracle import SF


def mixed(x):
    """The draws' 64-bit mixing function in whole numbers."""
    z = (x + 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def test_a_thousand_resamples_at_places_25_and_975(spark):
    rows = sorted(_outcomes(spark, SF).collect(), key=lambda r: (r.oracle, r.orm, r.prm))  # places go to classes of outcomes in their order
    y, n = {m: np.array([r[m] for r in rows], np.int64) for m in ("oracle", "orm", "prm")}, len(rows)
    draws = np.array([[mixed(b << 40 | i) % n for i in range(n)] for b in range(1000)])
    means = {m: v[draws].sum(1) / n for m, v in y.items()}
    for r in QUERIES["bootstrap_ci"](spark, SF).collect():
        m = np.sort(means[r.method])
        assert (r.point, r.lo, r.hi) == (y[r.method].sum() / n, m[25], m[975])
    for r in QUERIES["paired_bootstrap"](spark, SF).collect():
        d = np.sort(means[r["left"]] - means[r["right"]])
        assert (r.lo, r.hi) == (round(d[25], 9), round(d[975], 9))


def test_small_and_empty(spark):
    kind = "problem_id int, a boolean, b boolean"
    assert resample.bootstrap(spark.createDataFrame([], kind), ["a", "b"], 8).collect() == []
    same = resample.bootstrap(spark.createDataFrame([(i, True, None) for i in range(5)], kind), ["a", "b"], 9)
    assert sorted((r.method, r.point, r.lo, r.hi) for r in same.collect()) == [("a", 1.0, 1.0, 1.0), ("b", None, 0.0, 0.0)]
    means = resample.resampled_means(spark.createDataFrame([(i, i % 2 == 0, i % 3 == 0) for i in range(30)], kind), ["a", "b"], 10).collect()
    assert sorted(r.resample for r in means) == list(range(10)) and all(0 <= r.a <= 1 for r in means)
    with pytest.raises(ValueError, match="0 or 1"):
        resample.resampled_means(spark.range(20), ["id"], 4, most=8)
