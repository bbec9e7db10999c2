"""Queries of joins, set operations, shards and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import joins
from corvane.operators.order import numbered
from corvane.plans.registry import query
from corvane.plans.views import CANDIDATES, candidates
from corvane.session import table

_ALIGN = "row_number() OVER (PARTITION BY problem_id ORDER BY sample_id) - 1"


@query(
    f"""WITH {CANDIDATES}, k AS (SELECT problem_id, sample_id, max_by(prm_score, sample_id) AS score FROM c WHERE quantity > 10 GROUP BY problem_id, sample_id)
SELECT problem_id, count(*) AS n, count(score) AS covered, max(score) AS best FROM c LEFT JOIN k USING (problem_id, sample_id) GROUP BY problem_id"""
)
def score_left_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = candidates(spark, sf_dir)
    scores = pool.where("quantity > 10").select("problem_id", "sample_id", F.col("prm_score").alias("score"))
    joined = joins.with_scores(pool.select("problem_id", "sample_id"), scores, ["problem_id", "sample_id"])
    return joined.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("covered"), F.max("score").alias("best"))


@query("SELECT l_orderkey, l_linenumber, max_by(l_extendedprice, (l_partkey, l_suppkey, l_extendedprice)) AS score FROM lineitem GROUP BY l_orderkey, l_linenumber")
def score_dup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("score"))
    return joins.last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "score"]).select("l_orderkey", "l_linenumber", "score")


@query(
    f"""WITH {CANDIDATES}, a AS (SELECT problem_id, {_ALIGN} AS pos, orm_score AS a FROM c WHERE base_seed <= 43), b AS (SELECT problem_id, {_ALIGN} AS pos, orm_score AS b FROM c WHERE base_seed > 43)
SELECT problem_id, pos, a, b FROM a FULL JOIN b USING (problem_id, pos)"""
)
def positional_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = candidates(spark, sf_dir).withColumn("value", F.col("orm_score"))
    return joins.aligned(pool.where("base_seed <= 43"), pool.where("base_seed > 43"), "sample_id")


@query(f"WITH {CANDIDATES} SELECT problem_id, sample_id FROM c WHERE (problem_id, sample_id) NOT IN (SELECT problem_id, sample_id FROM c WHERE correct)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = candidates(spark, sf_dir)
    return joins.remaining(pool.select("problem_id", "sample_id"), pool.where("correct"), ["problem_id", "sample_id"])


@query(f"WITH {CANDIDATES} SELECT CASE WHEN o_orderpriority IS NULL THEN 'fit' ELSE 'validation' END AS split, count(*) AS n, count(*) FILTER (correct) AS k FROM c LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON problem_id = o_orderkey GROUP BY 1")
def semi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = candidates(spark, sf_dir)
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("problem_id"))
    measured = lambda df, name: df.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"))
    return measured(pool.join(ids, "problem_id", "left_anti"), "fit").unionByName(measured(pool.join(ids, "problem_id", "left_semi"), "validation"))


@query(
    """WITH a AS (SELECT o_orderkey AS id FROM orders), f AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity < 25), v AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 40)
SELECT 'missing' AS violation, id FROM a WHERE id NOT IN (SELECT id FROM f) AND id NOT IN (SELECT id FROM v) UNION ALL SELECT 'overlap', id FROM f JOIN v USING (id) JOIN a USING (id)
UNION ALL SELECT 'unknown', id FROM (SELECT id FROM f UNION SELECT id FROM v) WHERE id NOT IN (SELECT id FROM a)"""
)
def cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    ids = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return joins.cover_violations(ids, {"fit": lines.where("l_quantity < 25"), "validation": lines.where("l_quantity > 40")}, "id")


_KEY = "sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')))"


@query(
    f"""WITH k AS (SELECT doc_id AS id, source, {_KEY} AS sha FROM documents),
l AS (SELECT sha, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS left_ids FROM k WHERE source < 'src2' GROUP BY sha), r AS (SELECT sha, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS right_ids FROM k WHERE source >= 'src2' GROUP BY sha)
SELECT sha, left_ids, right_ids FROM l JOIN r USING (sha)"""
)
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two groups of sources share, by the hash of their normal form."""
    sha = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " ")), 256)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", sha.alias("sha"))
    return joins.overlap(docs.where("source < 'src2'"), docs.where("source >= 'src2'"), "sha")


@query(f"WITH {CANDIDATES}, w AS (SELECT problem_id, i AS sample_id FROM (SELECT DISTINCT problem_id FROM c), range(0, 8) r(i)) SELECT w.problem_id, w.sample_id, c.problem_id IS NOT NULL AS reused FROM w LEFT JOIN c ON w.problem_id = c.problem_id AND w.sample_id = c.sample_id")
def prefix_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.prefix_extended(candidates(spark, sf_dir).select("problem_id", "sample_id"), 8)


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def shard_union_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.merged_shards([rows.where(F.col("l_suppkey") % 4 == k) for k in range(4)], ["l_orderkey", "l_linenumber"])


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT CAST(floor(prm_score * 100) AS BIGINT) AS bucket, avg(CAST(correct AS INT)) AS acc FROM c GROUP BY 1), o AS (SELECT CAST(floor(prm_score * 100) AS BIGINT) AS bucket, avg(CAST(correct AS INT)) AS acc FROM c WHERE orm_score > 50000 AND prm_score < 0.05 GROUP BY 1)
SELECT bucket, p.acc AS prm_acc, coalesce(o.acc, 0) AS orm_acc, round(p.acc - coalesce(o.acc, 0), 9) AS delta FROM p LEFT JOIN o USING (bucket)"""
)
def bucket_delta_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = candidates(spark, sf_dir).withColumn("bucket", F.floor(F.col("prm_score") * 100))
    acc = lambda df, name: df.groupBy("bucket").agg(F.avg(F.col("correct").cast("int")).alias(name))
    joined = acc(pool, "prm_acc").join(acc(pool.where("orm_score > 50000 AND prm_score < 0.05"), "orm_acc"), "bucket", "left")
    return joined.withColumn("orm_acc", F.coalesce("orm_acc", F.lit(0.0))).withColumn("delta", F.round(F.col("prm_acc") - F.col("orm_acc"), 9))


@query("SELECT o_orderkey, CAST(o - 1 AS BIGINT) AS ordinal, CAST((o - 1) % 16 AS BIGINT) AS strided, CAST(floor((o - 1) / ceil(n / 16)) AS BIGINT) AS contiguous FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS o, count(*) OVER () AS n FROM orders)")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of the problems in id order. Ordinals come from counts by range, so no task sees all rows."""
    return joins.shard_of(numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), 16).select("o_orderkey", "ordinal", "strided", "contiguous")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query(f"WITH {CANDIDATES} SELECT child.problem_id, child.sample_id, parent.sample_id AS ancestor, parent.orm_score AS ancestor_score FROM c child JOIN c parent ON child.problem_id = parent.problem_id AND parent.sample_id = child.sample_id // 2")
def ancestor_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate with the state of its parent, candidate id // 2: one shuffle by problem serves both sides."""
    pool = candidates(spark, sf_dir).select("problem_id", "sample_id", "orm_score")
    parent = pool.select("problem_id", F.col("sample_id").alias("ancestor"), F.col("orm_score").alias("ancestor_score"))
    child = pool.select("problem_id", "sample_id", F.floor(F.col("sample_id") / 2).cast("bigint").alias("ancestor"))
    return child.join(parent, ["problem_id", "ancestor"])


@query(f"WITH {CANDIDATES} SELECT problem_id, count(*) AS \"left\", count(*) FILTER (quantity < 40) AS \"right\" FROM c GROUP BY problem_id HAVING count(*) <> count(*) FILTER (quantity < 40)")
def unpaired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of outcomes that should pair, one of which lacks some rows."""
    pool = candidates(spark, sf_dir)
    return joins.unpaired(pool, pool.where("quantity < 40"), ["problem_id"])


@query(f"WITH {CANDIDATES} SELECT DISTINCT problem_id, 'base_seed' AS field FROM c WHERE base_seed <> 42")
def prefix_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reused pool's fields against those of the run that extends it."""
    pool = candidates(spark, sf_dir).withColumns({"task": F.lit("t"), "split": F.lit("test"), "protocol": F.lit("p")})
    return joins.prefix_violations(pool, {"task": "t", "split": "test", "protocol": "p", "base_seed": 42})
