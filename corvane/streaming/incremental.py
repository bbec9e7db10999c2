"""Incremental shards as streams: arriving candidates, once each, and windowed counts with late data.

An extension: the batch answer is the specification. State is bounded by watermarks, and a restart
resumes from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str | None = None, files: int = 16) -> DataFrame:
    """A stream of Parquet files under a path or glob, some files a batch."""
    kind = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", str(files)).parquet(path)


def once_each(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Rows whose keys were not seen before; the state forgets keys once they are later than the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, width: str, keys: list[str], late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Counts, and sums of a value, by tumbling window and keys."""
    sums = [F.sum(value).alias("total")] if value else []
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), *sums).select(F.col("window.start").alias("start"), *keys, "n", *(["total"] if value else []))


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts by session: rows of the keys with no gap longer than `gap`."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now to a Parquet table, each row exactly once over any number of restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replaced(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a whole result at a path: each batch overwrites it."""
    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
