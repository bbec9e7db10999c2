"""Centroid clustering by exact integers, with Hamerly's bounds kept for every vector."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import dropped, giving_back, python_ready, written
from corvane.llm.vectors import matrix, packed, summed, whole_sum

#: A component has fewer bits than this, so a squared distance of 64 components is below 2^62.
BITS = 27
#: Bounds are doubles: each is moved outwards by this share, more than the rounding of the steps that made it.
SLACK = 2.0**-49


def scan(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre (the smaller number of equals), its squared distance and that of the second nearest: exact integers."""
    squares = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
    best = squares.argmin(1)
    rows = np.arange(len(x))
    own = squares[rows, best]
    squares[rows, best] = np.iinfo(np.int64).max
    return best, own, squares.min(1)


class Round:
    """Centres of one assignment, how far each came since the last, and half the way to its nearest other one."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None) -> None:
        self.centres = centres
        far = lambda a, b: math.sqrt(int(((a - b) ** 2).sum()))
        k = len(centres)
        self.half = np.array([min([far(centres[i], centres[j]) for j in range(k) if j != i], default=math.inf) / 2 for i in range(k)]) * (1 - SLACK)
        self.drift = np.zeros(k) if before is None else np.array([far(a, b) for a, b in zip(centres, before, strict=True)]) * (1 + SLACK)
        # The most that any other centre than a vector's own has moved.
        self.others = np.array([max([d for j, d in enumerate(self.drift) if j != i], default=0.0) for i in range(k)])

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bring cluster, upper and lower up to date in place; which vectors had to be scanned."""
        known = cluster >= 0
        own = np.where(known, cluster, 0)
        upper += self.drift[own]
        upper *= 1 + SLACK
        fall = self.others[own]
        lower -= fall + (np.abs(lower) + fall) * SLACK
        doubtful = ~known | ~(upper < np.maximum(lower, self.half[own]))
        if doubtful.any():
            best, first, second = scan(x[doubtful], self.centres)
            cluster[doubtful] = best
            upper[doubtful] = np.sqrt(first.astype(float)) * (1 + SLACK)
            lower[doubtful] = np.sqrt(second.astype(float)) * (1 - SLACK) if len(self.centres) > 1 else np.inf
        return doubtful


_STATE = "x binary, cluster int, before int, upper double, lower double, scans int, distance bigint"


def _assigned(state: DataFrame, now: Round, size: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), size)
            before = batch.column("cluster").to_numpy()
            cluster, upper, lower = before.copy(), batch.column("upper").to_numpy().copy(), batch.column("lower").to_numpy().copy()
            doubtful = now.assign(x, cluster, upper, lower)
            distance = ((x - now.centres[cluster]) ** 2).sum(1) if last else np.zeros(len(x), np.int64)
            scans = batch.column("scans").to_numpy() + doubtful.astype(np.int32)
            made = [batch.column("key"), batch.column("x"), *map(pa.array, (cluster, before, upper, lower, scans, distance))]
            yield pa.RecordBatch.from_arrays(made, ["key", "x", "cluster", "before", "upper", "lower", "scans", "distance"])

    return state.mapInArrow(giving_back(run), f"key {state.schema['key'].dataType.simpleString()}, {_STATE}")


def _moves(state: DataFrame, k: int, size: int) -> np.ndarray:
    """What the vectors that changed their cluster add to each cluster's sums (last column: its count), exactly."""

    def made(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("x"), size)
        x = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
        out = np.zeros((k, size + 1), object)
        for sign, name in ((1, "cluster"), (-1, "before")):
            of = batch.column(name).to_numpy()
            for c in np.unique(of[of >= 0]).tolist():
                out[c] += sign * whole_sum(x[of == c])
        return out

    return summed(state.where("cluster != before").select("x", "cluster", "before"), made, (k, size + 1), exact=True)


def clusters(df: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per kept vector: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scans.

    Kept are vectors of `size` entries without a null or non-finite one; each row counts, whatever its key.
    Entries become floor(scale * entry). The first centres are the k kept vectors of the smallest SHA-256 of
    seed + key, null keys last, equal hashes in the order of the vectors' bytes; with fewer vectors there are
    fewer clusters, without any no rows. A round assigns every vector to the nearest centre (ties: the smaller
    number) and moves each centre that has vectors to the floor of their mean; after the last round vectors
    are assigned once more. All of this is exact: integers, and bounds that only ever err to the safe side.

    The table of vectors with their cluster, upper bound and lower bound is written once a round to the shared
    folder and the one before deleted. Where the upper bound, loosened by the own centre's way, stays under the
    lower one, loosened by the longest way of the others (or under half the way to the nearest centre), the cluster stays
    without looking at the vector; all others get a full scan of the centres (`scans` counts them). Sums
    change by the vectors that moved only. A task sends k x (size + 1) sums, whatever its rows; nothing is shuffled by
    cluster, so a cluster of a third of all vectors is like any other. An entry of 131,072 or more stops
    the job: squared distances wouldn't fit 64 bits.
    """
    spark = df.sparkSession
    python_ready(spark)
    base = written(packed(df, key, vector, scale, BITS, size), "vectors")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")), 256)
    first = base.select("x", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centres = np.array([np.frombuffer(r["x"], "<i4") for r in first], np.int64).reshape(len(first), size)
    k, before = len(first), None
    start = {"cluster": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0), "scans": F.lit(0)}
    state, old, sums = base.withColumns(start), base, np.zeros((k, size + 1), object)
    for r in range(rounds + 1 if k else 0):
        state = written(_assigned(state, Round(centres, before), size, r == rounds), "clusters")
        dropped(old)
        old = state
        if r < rounds:
            sums = sums + _moves(state, k, size)
            before = centres
            centres = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else own.tolist() for row, own in zip(sums, centres, strict=True)], np.int64)
    if not k:
        kind = df.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, scans int")
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashes[c]) for c in range(k)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = state.join(F.broadcast(known), "cluster")  # k rows
    return joined.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def oracle(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """The same rows without scans, every distance of every round computed."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        f"WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {size})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1 AS INTEGER) AS k, x AS c FROM v ORDER BY sha256('{seed}' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        squares = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, min({{'d': CAST({squares} AS BIGINT), 'k': k}}) AS m FROM v, c{r} GROUP BY r)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT m.k AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (r), range(1, {size + 1}) t(i) GROUP BY ALL)")
            parts.append(f"n{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (k))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, m.k AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.k = m.k"
    )
