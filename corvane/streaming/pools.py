"""Pools whose shards arrive one after the other: votes per problem as state, the same answer as over all shards at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: State lies on the executors' disks, in memory that is bounded for all of a process's partitions; a restart keeps what the checkpoint was made with.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def _majority(candidates: Column) -> Column:
    """votes, other (the bits of the lowest candidate's id, inverted), answer and grade that win, null without a valid answer: one pass over candidates sorted by answer and id."""

    def step(acc: Column, c: Column) -> Column:
        own = acc["own"]
        more = F.struct((own["votes"] + 1).alias("votes"), own["other"].alias("other"), own["answer"].alias("answer"), own["correct"].alias("correct"))
        first = F.struct(F.lit(1).cast("bigint").alias("votes"), F.bitwise_not(c["sample_id"]).alias("other"), c["answer"].alias("answer"), c["correct"].alias("correct"))
        now = F.when(own["answer"] == c["answer"], more).otherwise(first)
        return F.struct(now.alias("own"), F.greatest(acc["best"], now).alias("best"))

    none = F.lit(None).cast("struct<votes:bigint,other:bigint,answer:string,correct:boolean>")
    valid = F.sort_array(F.filter(candidates, lambda c: c["answer"].isNotNull()))
    return F.aggregate(valid, F.struct(none.alias("own"), none.alias("best")), step, lambda acc: acc["best"])


def readouts(stream: DataFrame) -> DataFrame:
    """The majority of every problem that a batch touches, over all that has come so far.

    stream: problem_id (bigint), sample_id, answer (null: invalid), correct and identity, a text that all shards of one pool
    share. A candidate counts once however often it arrives (`repeated` counts the other times, so far); the most votes
    win, ties go to the answer of the lowest candidate. Rows of another identity stop the stream, and so does a restart with
    them: the identity is part of the state. A candidate that comes again with another answer or grade stops it
    too. State is one row per problem, as large as its candidates; built-in aggregates only.
    """
    candidate = F.struct("answer", F.col("sample_id").cast("bigint").alias("sample_id"), F.coalesce(F.col("correct").cast("boolean"), F.lit(False)).alias("correct"))
    own = F.coalesce("identity", F.lit("no identity"))
    per = stream.groupBy(F.col("problem_id").cast("bigint").alias("problem_id")).agg(F.collect_set(candidate).alias("candidates"), F.count(F.lit(1)).alias("rows"), F.min(own).alias("low"), F.max(own).alias("high"))
    ids = F.col("candidates.sample_id")
    which = F.concat(F.lit("problem "), F.coalesce(F.col("problem_id").cast("string"), F.lit("null")))
    checked = (
        F.when(F.col("low") != F.col("high"), F.raise_error(F.concat(which, F.lit(": a shard of "), "low", F.lit(" and a shard of "), "high", F.lit(" in one pool"))))
        .when(F.exists(ids, lambda i: i.isNull()), F.raise_error(F.concat(which, F.lit(": a candidate without an id"))))
        .when(F.size(F.array_distinct(ids)) < F.size(ids), F.raise_error(F.concat(which, F.lit(": a candidate came again with another answer or grade"))))
        .otherwise(F.lit(True))
    )
    n = F.size("candidates").cast("bigint")
    best = per.where(checked).select("problem_id", n.alias("num_candidates"), _majority(F.col("candidates")).alias("b"), (F.col("rows") - n).alias("repeated"))
    won = [F.col("b.answer").alias("answer"), F.coalesce("b.votes", F.lit(0).cast("bigint")).alias("votes"), F.bitwise_not("b.other").alias("sample_id"), F.coalesce("b.correct", F.lit(False)).alias("correct")]
    return best.select("problem_id", "num_candidates", *won, "repeated")


def kept(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every update with its batch's number; a batch that runs again replaces its own rows."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:  # a query takes the settings as it starts
        for k, v in STORE.items():
            spark.conf.set(k, v)
        return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest(updates: DataFrame) -> DataFrame:
    """The last update of every problem."""
    names = [c for c in updates.columns if c not in ("problem_id", "batch")]
    return updates.groupBy("problem_id").agg(F.max_by(F.struct(*names), "batch").alias("last")).select("problem_id", "last.*")
