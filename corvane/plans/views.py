"""The driver's tables in the roles of candidates, problems, snapshots, scored documents and vectors.

Each view exists twice: as a DataFrame, and as SQL for the oracle. Row numbers always have a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import table

GOLDS = ("A", "N", "R")
TERMINAL = ("purchase", "signup")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate answer of a problem: order lines, numbered from 0 inside their order.

    The key gets its name before the window, so that later groupings by problem reuse the window's exchange.
    """
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey")
    answer = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), None).otherwise(F.col("l_returnflag"))
    gold = F.element_at(F.array(*map(F.lit, GOLDS)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    rows = line.join(order, line["l_orderkey"] == order["o_orderkey"]).select(
        F.col("l_orderkey").alias("problem_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        answer.alias("answer"),
        gold.alias("gold"),
        F.col("l_extendedprice").alias("orm_score"),
        F.col("l_discount").alias("prm_score"),
        (42 + F.col("l_suppkey") % 4).alias("base_seed"),
        F.coalesce(answer == gold, F.lit(False)).alias("correct"),
        F.col("l_quantity").alias("quantity"),
    )
    place = Window.partitionBy("problem_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "orm_score")
    return rows.withColumn("sample_id", (F.row_number().over(place) - 1).cast("bigint")).select("problem_id", "sample_id", "answer", "gold", "orm_score", "prm_score", "base_seed", "correct", "quantity")


CANDIDATES = """
c AS (SELECT problem_id, sample_id, answer, gold, orm_score, prm_score, base_seed, coalesce(answer = gold, false) AS correct, quantity FROM (
  SELECT l_orderkey AS problem_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sample_id,
         CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE l_returnflag END AS answer,
         ['A', 'N', 'R'][CAST(l_orderkey % 3 + 1 AS INT)] AS gold, l_extendedprice AS orm_score, l_discount AS prm_score,
         42 + l_suppkey % 4 AS base_seed, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step of a trajectory: a user's events in order; the mask ratio falls to 0 at the last."""
    own = Window.partitionBy("trajectory_id")
    order = own.orderBy("ts", "event_id")
    terminal = F.last(F.col("event_type").isin(*TERMINAL)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trajectory_id"), "ts", F.col("value").alias("score"), "event_type", "event_id")
    rows = rows.withColumns({"step": (F.row_number().over(order) - 1).cast("bigint"), "n": F.count(F.lit(1)).over(own), "final_correct": terminal})
    return rows.select("trajectory_id", "step", "n", "score", "final_correct", "event_type", "event_id", (1 - (F.col("step") + 1) / F.col("n")).alias("mask_ratio"))


SNAPSHOTS = """
s AS (SELECT *, 1 - (step + 1) / n AS mask_ratio FROM (
  SELECT user_id AS trajectory_id, row_number() OVER w - 1 AS step, count(*) OVER (PARTITION BY user_id) AS n, value AS score,
         last_value(event_type IN ('purchase', 'signup')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_correct,
         event_type, event_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an outcome and four scores of it, of which one is constant."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        "doc_id",
        F.col("quality").alias("y"),
        (F.col("n_chars") % 97).cast("double").alias("s_fwd"),
        F.lit(0.5).alias("s_const"),
        F.length(F.regexp_replace("text", "[^a-z]", "")).cast("double").alias("s_letters"),
        (F.col("n_chars") % 10 / 10.0).alias("ratio"),
        (F.col("doc_id") % 7 - 3).cast("double").alias("logit"),
    )


SCORED = """
d AS (SELECT doc_id, quality AS y, CAST(n_chars % 97 AS DOUBLE) AS s_fwd, CAST(0.5 AS DOUBLE) AS s_const,
             CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) AS DOUBLE) AS s_letters, CAST(n_chars % 10 AS DOUBLE) / 10 AS ratio, CAST(doc_id % 7 - 3 AS DOUBLE) AS logit
      FROM documents JOIN labels USING (doc_id))"""
