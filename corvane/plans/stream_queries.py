"""Queries over streams; what they leave equals the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.registry import query
from corvane.session import own_dir
from corvane.streaming import incremental


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A glob, so that the table may be one file or a folder of them.
    return incremental.arriving(spark, f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = own_dir(spark, "stream")
    incremental.replaced(incremental.windowed(_events(spark, sf_dir), "ts", "6 hours", ["event_type"], value="value"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("total", F.round("total", 6))


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY 1")
def stream_incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events twice over, appended once each, in two runs that share a checkpoint."""
    at = own_dir(spark, "stream")
    for _ in range(2):
        twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
        incremental.appended(incremental.once_each(twice, ["event_id"], "ts", "3650 days"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("distinct_events"))
