"""Clustering and whitening against plain Python and numpy: exact rows, bounds that skip scans, odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import clustering, queries, vectors, whitening
from corvane.session import table
from tests.oracle import SF

NAN, INF = float("nan"), float("inf")


def plain_clusters(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    hashed = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [x for _, x in sorted(kept, key=lambda r: (*hashed(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for r in range(rounds + 1):
        own = [min((far(x, c), j) for j, c in enumerate(centres)) for _, x in kept]
        if r == rounds:
            break
        for j in range(len(centres)):
            mine = [x for (_, x), (_, o) in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    sums = {j: sum(d for d, o in own if o == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(str(i), j, d, sums[j], sum(sums.values()), sha[j]) for (i, _), (d, j) in zip(kept, own)])


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def groups(r, n, size):
    middles = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    return [[c + r.gauss(0, 0.05) for c in r.choice(middles)] for _ in range(n)]


def test_clusters_and_skipped_scans(spark):
    r = random.Random(3)
    rows = list(enumerate(groups(r, 400, 6)))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = clustering.clusters(df, k=5, rounds=8, size=6)
    assert rows_of(got) == plain_clusters(rows, 5, 8, 6, 1024)
    assert sum(x.scans for x in got.collect()) < 400 * 9 * 0.7  # bounds spare full scans


def test_clusters_of_odd_rows(spark):
    one = [0.25, -0.5]
    rows = [(1, one), (1, one), (2, one), (None, [1.0, 1.0]), (None, one), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [NAN, 1.0]), (8, [1.0, -INF]), (9, [3.0, 3.0]), (10, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("x") for c in ("key", "x", "cluster", "distance", "h", "before", "label")})
    for k in (1, 3, 50):
        assert rows_of(clustering.clusters(df, k=k, rounds=4, size=2)) == plain_clusters(rows, k, 4, 2, 1024)
    none = clustering.clusters(df.where("false"))
    assert none.collect() == [] and "centroid_sha256" in none.columns
    with pytest.raises(Exception, match="bits"):
        clustering.clusters(spark.createDataFrame([(1, [1e9])], "vec_id int, embedding array<double>"), size=1).collect()


def plain_components(rows, m):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:m], u[:, ::-1][:, :m]
    return [i for i, _ in kept], ((n * x - s) ** 2).sum(1), c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def check(df, rows, m):
    ids, deviation, want, share = plain_components(rows, m)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids)
    mine = np.array([[got[i][j + 1].whitened for j in range(m)] for i in ids])
    signs = np.sign((mine * want).sum(0))
    assert np.abs(mine - want * signs).max() < 1e-6
    any_row = got[ids[0]]
    assert [any_row[j + 1].explained for j in range(m)] == pytest.approx(share.tolist(), rel=1e-6)
    assert [int(got[i][1].deviation) for i in ids] == deviation.tolist()
    assert all(r.n == len(ids) and r.identity_error < 1e-9 for v in got.values() for r in v.values())


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    check(queries.op13_embedding_whitening(spark, SF), rows, 32)


def test_sketch_settles_where_eigenvalues_fall(spark):
    """40 dimensions of which few matter: the sketch's residuals pass, and agree with the full decomposition."""
    r = np.random.default_rng(1)
    x = (r.standard_normal((300, 3)) * [20.0, 9.0, 4.0]) @ np.linalg.qr(r.standard_normal((40, 3)))[0].T
    rows = [(i, v.tolist()) for i, v in enumerate(x + r.standard_normal(x.shape) * 0.01)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    check(whitening.whitened(df, components=3), rows, 3)
    seen = []
    real = whitening.products
    whitening.products = lambda x, centre, basis: seen.append(basis.shape) or real(x, centre, basis)
    try:
        check(whitening.whitened(df, components=3), rows, 3)
        assert {s[1] for s in seen} == {13}
        del seen[:]
        check(whitening.whitened(df, components=30), rows, 30)
        assert seen[-1] == (40, 40)
    finally:
        whitening.products = real


def test_whitening_of_odd_rows(spark):
    r = random.Random(2)
    good = [[r.uniform(-1, 1) for _ in range(3)] for _ in range(20)]
    rows = [*enumerate(good), (100, None), (101, [1.0, None, 0.0]), (102, [NAN, 0.0, 0.0]), (103, [INF, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("key", "x", "n", "component", "cell", "v")})
    check(whitening.whitened(df), rows, 3)
    again = df.union(df.where("vec_id = 3")).union(df.where("vec_id = 3").withColumn("vec_id", F.lit(None).cast("bigint")))
    assert whitening.whitened(again).count() == 22 * 3
    assert whitening.whitened(df.where("false")).collect() == [] and whitening.whitened(df.where("vec_id = 1")).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id int, embedding array<double>")
    assert {x.component for x in whitening.whitened(flat).collect()} == {1}  # no variance in the others
    with pytest.raises(ValueError, match="lengths"):
        whitening.whitened(df.union(df.limit(1).withColumn("embedding", F.array(F.lit(1.0)))))


def test_deviation_beyond_64_bits():
    centre = whitening.Centre(1 << 33, [5, -(1 << 40)])
    y = np.array([[1 << 30, -7], [0, 3]], np.int64)
    assert [int(v) for v in centre.deviation(y).to_pylist()] == [sum((centre.n * int(a) - s) ** 2 for a, s in zip(row, centre.sums)) for row in y]
    assert vectors.whole_sum(np.full((4, 1), 1 << 61, np.int64)).tolist() == [4 << 61]


def test_sums_take_jobs_that_dont_grow_with_partitions(spark):
    """toLocalIterator ran a job per shuffle partition, 211 a round on check_h."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id bigint, embedding array<double>")
    x = vectors.packed(df, "vec_id", "embedding", 1, 20).select("x")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("summed", "summed")
        got = vectors.summed(x, lambda b: vectors.whole_sum(vectors.matrix(b.column("x"), 2)), (2,), exact=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.tolist() == [435, 30]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("summed")) <= 4
