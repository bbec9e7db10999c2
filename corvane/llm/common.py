"""Shared pieces: the shared folder, Arrow batch limits, text buffers, skew-safe look-ups."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import ship

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory whatever the partition's size.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20
#: Used where a session on one machine (local[...]) names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def python_ready(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, and let workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
    return (named or LOCAL_SHARED).rstrip("/")


def written(df: DataFrame, name: str, per_core: int = 4) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again; `per_core` files a core at most."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    compact(df, per_core).write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` returned, once everything that reads them is written itself."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def compact(df: DataFrame, per_core: int = 4) -> DataFrame:
    """df in `per_core` partitions a core at most: fewer and larger files, without a shuffle."""
    return df.coalesce(max(1, per_core * df.sparkSession.sparkContext.defaultParallelism))


def fresh(columns: list[str], name: str) -> str:
    """name, or with so many underscores that no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_keys(docs: DataFrame, key: str, gone: DataFrame, name: str, most: int = 2_000_000) -> DataFrame:
    """The rows of docs whose key isn't among gone's column `name`; a null one there removes null keys.

    Up to `most` keys (about 100 MB as a hash table) are broadcast, so that docs aren't shuffled; more are joined by a shuffle.
    """
    own = fresh(docs.columns, "gone_key")
    gone = written(gone.select(F.col(name).alias(own)).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(side, F.col(key).eqNullSafe(F.col(own)), "left_anti").select(*docs.columns)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function over a task's batches; at its end the worker gives freed memory back to the system.

    Spark uses a worker again for other stages and keeps it beside the executor's JVM meanwhile.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library has no such call
                pass

    return task


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes, joined, and the n + 1 offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of the column each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = buffers(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def lookup(big: DataFrame, small: DataFrame, key: str, weight: str, share: int = 256) -> DataFrame:
    """big LEFT JOIN small on key, where small has one row per key and its number of rows in big.

    Keys with more than 1/share of the weight are fewer than `share`, so their rows are broadcast;
    all the other keys are joined by a shuffle, in which no key is large. small is read twice: pass a
    written or kept table. The weight column is dropped from the result.
    """
    values = [c for c in small.columns if c not in (key, weight)]
    size = small.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t"), F.coalesce(F.max(weight), F.lit(0)).alias("m")).first()
    if size["m"] * share <= size["t"]:  # no key is large
        return big.join(small.drop(weight), key, "left").select(*big.columns, *values)
    is_hot = F.col(weight) * share > F.lit(size["t"])
    hot = small.where(is_hot).drop(weight).withColumnsRenamed({c: f"hot_{c}" for c in values}).withColumn("is_hot", F.lit(True))
    # 0, but no literal: the optimizer would turn an equality with one into a filter, and the key would be lost.
    rest = small.where(~is_hot).withColumn("spread", F.pmod(F.col(weight).cast("bigint"), F.lit(1).cast("bigint"))).drop(weight)
    # A hot row needs no partner in the second join: a number of its own spreads it.
    first = big.join(F.broadcast(hot), key, "left").withColumn("spread", F.when(F.col("is_hot"), 1 + F.monotonically_increasing_id()).otherwise(F.lit(0).cast("bigint")))
    second = first.join(rest, [key, "spread"], "left")
    return second.select(*big.columns, *[F.coalesce(F.col(f"hot_{c}"), F.col(c)).alias(c) for c in values])
