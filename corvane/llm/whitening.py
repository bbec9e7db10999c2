"""Embedding whitening: a randomised range finder over all centred rows, and Rayleigh-Ritz."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import giving_back, python_ready, written
from corvane.llm.vectors import matrix, packed, summed, whole_sum

#: Integers of fewer bits than this fit the packed table.
BITS = 31
#: Directions above those asked for; passes before the sketch is widened to the full dimension; what a residual may be of the largest eigenvalue.
OVERSAMPLING, PASSES, RESIDUAL = 10, 4, 1e-12


class Centre:
    """Exact column sums of n rows; rows are centred by the mean's whole part, then by the rest of it."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def rows(self, y: np.ndarray) -> np.ndarray:
        return (y - self.whole).astype(float) - self.rest

    def deviation(self, y: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * y - sum)^2 of each row, exact."""
        kind = pa.decimal128(38, 0)
        most = max(map(abs, self.sums), default=0) + self.n * (int(np.abs(y).max()) if y.size else 0)
        if most * most * max(1, y.shape[1]) < 1 << 63:
            return pa.array(((self.n * y - np.array(self.sums, np.int64)) ** 2).sum(1)).cast(kind)
        exact = ((self.n * y.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return pa.array([Decimal(int(v)) for v in exact], kind)


def products(x: DataFrame, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """The covariance times the basis in one pass: each block of centred rows meets the basis, then itself; d x l sums a task."""
    size = len(centre.sums)

    def made(batch: pa.RecordBatch) -> np.ndarray:
        c = centre.rows(matrix(batch.column("x"), size))
        return c.T @ (c @ basis)

    return summed(x.select("x"), made, basis.shape) / centre.n


def ritz(basis: np.ndarray, image: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, vectors and the largest residual of the `wanted` first by Rayleigh-Ritz; image is the covariance times the basis."""
    inner = basis.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
    vectors = basis @ turn
    far = np.linalg.norm(image @ turn - vectors * values, axis=0)
    return values, vectors, float(far.max(initial=0.0))


def principal(x: DataFrame, centre: Centre, wanted: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, residual: float = RESIDUAL, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance, the `wanted` largest.

    A random basis of wanted + oversampling directions goes through the covariance again and again, each time over all rows
    and made orthonormal after it. The pass itself gives the residuals; once the largest is below
    `residual` times the largest eigenvalue it is done. If that isn't so after `passes` the basis is filled
    up to the full dimension, where one more pass and Rayleigh-Ritz are exact.
    """
    d = len(centre.sums)
    wide = min(d, wanted + oversampling)
    random = np.random.default_rng(seed)
    basis = np.linalg.qr(random.standard_normal((d, wide)))[0]
    for _ in range(passes if wide < d else 0):
        image = products(x, centre, basis)
        values, vectors, far = ritz(basis, image, wanted)
        if far <= residual * max(values[0], 0.0):
            return values, vectors
        basis = np.linalg.qr(image)[0]
    if wide < d:  # the sketch didn't settle: all directions, the old ones first
        fill = random.standard_normal((d, d - wide))
        for _ in range(2):
            fill -= basis @ (basis.T @ fill)
        basis = np.linalg.qr(np.concatenate([basis, fill], 1))[0]
    values, vectors, _ = ritz(basis, products(x, centre, basis), wanted)
    return values, vectors / np.linalg.norm(vectors, axis=0)


def whitened(df: DataFrame, components: int = 32, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component: key, component, n, deviation (decimal), whitened, explained, identity_error.

    Left out are rows whose vector is null or holds a null or non-finite entry; every other row counts, whatever its key or however often it occurs.
    Entries become floor(scale * entry); a constant added to all of them changes nothing here. Vectors of
    different lengths stop the job, as does an entry of 2^31 or more after scaling. Components have positive
    variance: fewer than asked for come back where the vectors span fewer dimensions, and no rows
    where all are equal or there are none.

    Passes: exact sums and squares; up to PASSES + 1 of `principal`; one that measures the whitened rows'
    covariance; the result. Each reads a packed table in the shared folder and sends d x l numbers a task at most; no row
    is shuffled.
    """
    spark = df.sparkSession
    python_ready(spark)
    x = written(packed(df, key, vector, scale, BITS), "vectors")
    seen = x.agg(F.count(F.lit(1)).alias("n"), F.min(F.length("x")).alias("a"), F.max(F.length("x")).alias("b")).first()
    if seen["a"] != seen["b"]:
        raise ValueError("vectors of different lengths have no covariance")
    n, d = seen["n"], (seen["b"] or 0) // 4
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n or not d:
        return spark.createDataFrame([], schema)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        y = matrix(batch.column("x"), d)
        return np.stack([whole_sum(y), whole_sum(y * y)])

    sums, squares = summed(x.select("x"), moments, (2, d), exact=True).tolist()
    trace = float(sum(Fraction(n * q - s * s, n * n) for s, q in zip(sums, squares, strict=True)))
    if not trace:
        return spark.createDataFrame([], schema)
    centre = Centre(n, sums)
    values, vectors = principal(x, centre, min(components, d))
    real = values > trace * d * 1e-14
    values, vectors = values[real], vectors[:, real]
    turn, share, m = vectors / np.sqrt(values), values / trace, len(values)

    def outer(batch: pa.RecordBatch) -> np.ndarray:
        w = centre.rows(matrix(batch.column("x"), d)) @ turn
        return w.T @ w

    error = float(np.abs(summed(x.select("x"), outer, (m, m)) / n - np.eye(m)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix(batch.column("x"), d)
            at = pa.array(np.repeat(np.arange(len(y)), m))
            made = [batch.column("key").take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(y))), centre.deviation(y).take(at)]
            made += [pa.array((centre.rows(y) @ turn).reshape(-1)), pa.array(np.tile(share, len(y)))]
            yield pa.RecordBatch.from_arrays(made, ["key", "component", "deviation", "whitened", "explained"])

    rows = x.mapInArrow(giving_back(run), f"key {kind}, component int, deviation decimal(38,0), whitened double, explained double")
    return rows.select(F.col("key").alias(key), "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
