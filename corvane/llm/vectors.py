"""Vectors as rows of 32-bit integers in one binary column, and sums over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import giving_back, python_ready


def usable(vector: str, size: int | None = None) -> Column:
    """Whether the vector is there, has no null or non-finite entry, and `size` entries if that is given."""
    finite = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col(vector).isNotNull() & finite
    return F.coalesce(ok if size is None else ok & (F.size(vector) == size), F.lit(False))


def packed(df: DataFrame, key: str, vector: str, scale: int, bits: int, size: int | None = None) -> DataFrame:
    """key and x: floor(scale * entry) of every usable vector, as little-endian 32-bit integers. No shuffle.

    An integer of more than `bits` bits stops the job: sums of squares further on would leave 64 bits.
    """
    python_ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            whole = np.floor(scale * flat)
            if len(whole) and np.abs(whole).max() >= 2.0**bits:
                raise ValueError(f"an entry times {scale} has more than {bits} bits")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(whole.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column("key"), data], ["key", "x"])

    kind = df.schema[key].dataType.simpleString()
    kept = df.where(usable(vector, size)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return kept.mapInArrow(giving_back(run), f"key {kind}, x binary")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a packed column as 64-bit integers."""
    at, data = np.frombuffer(column.buffers()[1], np.int32), column.buffers()[2]
    if not len(column) or not size:
        return np.empty((len(column), size), np.int64)
    first, last = int(at[column.offset]), int(at[column.offset + len(column)])
    return np.frombuffer(data, "<i4", (last - first) // 4, first).reshape(len(column), size).astype(np.int64)


def summed(df: DataFrame, made: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], exact: bool = False) -> np.ndarray:
    """The sum over all batches of made(batch), an array of a fixed small shape, exact integers or doubles.

    A task adds up its own batches and sends one value a cell; Spark adds those up, and the driver gets the
    cells, whose number doesn't grow with the rows.
    """
    cells = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(shape, object if exact else float), False
        for batch in batches:
            if batch.num_rows:
                total, any_rows = total + made(batch), True
        if any_rows:
            flat = total.reshape(-1)
            values = pa.array([str(v) for v in flat.tolist()] if exact else flat, pa.string() if exact else pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), values], ["cell", "v"])

    rows = df.mapInArrow(giving_back(run), f"cell bigint, v {'string' if exact else 'double'}")
    value = F.sum(F.col("v").cast("decimal(38,0)")) if exact else F.sum("v")
    out = np.zeros(cells, object if exact else float)
    for r in rows.groupBy("cell").agg(value.alias("v")).collect():  # cells alone, in one job; toLocalIterator runs a job a partition
        out[r["cell"]] = int(r["v"]) if exact else r["v"]
    return out.reshape(shape)


def whole_sum(values: np.ndarray) -> np.ndarray:
    """Exact sums of the columns of an array of 64-bit integers, whatever their size."""
    most = int(np.abs(values).max()) if values.size else 0
    return (values if most * max(1, len(values)) < 1 << 62 else values.astype(object)).sum(0).astype(object)
