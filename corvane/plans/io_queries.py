"""Queries that write and read back: published tables, shard sets, digests, comparisons of nested records, pools as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import compare
from corvane.plans.registry import query
from corvane.plans.views import CANDIDATES, candidates
from corvane.session import own_dir, ship, table
from corvane.sources import digests, sinks
from corvane.sources.shards import ShardSource
from corvane.streaming import incremental, pools


@query(
    f"""WITH {CANDIDATES}, j AS (SELECT base_seed, CASE WHEN prm_score > 0.02 THEN orm_score END AS score FROM c)
SELECT base_seed, count(*) AS n, count(score) AS scored, (SELECT count(*) FROM j) AS all_rows, (SELECT count(*) FROM j WHERE score IS NULL) AS all_missing FROM j GROUP BY 1"""
)
def published_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their scores, published twice; how many have none is counted by the pass that writes them."""
    pool = candidates(spark, sf_dir)
    scores = pool.where("prm_score > 0.02").select("problem_id", "sample_id", F.col("orm_score").alias("score"))
    joined = pool.select("problem_id", "sample_id", "base_seed").join(scores, ["problem_id", "sample_id"], "left")
    at = own_dir(spark, "published")
    for _ in range(2):
        sinks.publish(joined, at, {"missing": F.count_if(F.col("score").isNull())}, {"score not above 0": F.col("score") <= 0})
    now, counted = sinks.published(spark, at)
    per = now.groupBy("base_seed").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))
    return per.select("*", F.lit(counted["rows"]).cast("bigint").alias("all_rows"), F.lit(counted["missing"]).cast("bigint").alias("all_missing"))


@query(f"WITH {CANDIDATES} SELECT base_seed, count(*) AS n, count(answer) AS valid, count(*) FILTER (correct) AS n_correct, CAST(sum(sample_id) AS BIGINT) AS ids, round(sum(orm_score), 2) AS score FROM c GROUP BY 1")
def shard_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written as eight shards and read back by the data source, which checks each file as it reads it."""
    ship(spark)
    spark.dataSource.register(ShardSource)
    pool = candidates(spark, sf_dir).select("problem_id", "sample_id", "base_seed", "answer", "correct", "orm_score")
    at = own_dir(spark, "shards")
    pool.repartition(8, "problem_id").write.format("pool_shards").option("path", at).option("shards", "8").option("identity", "pool-a").mode("append").save()
    rows = spark.read.format("pool_shards").schema(pool.schema).option("path", at).option("identity", "pool-a").load()
    return rows.groupBy("base_seed").agg(F.count(F.lit(1)).alias("n"), F.count("answer").alias("valid"), F.count_if("correct").alias("n_correct"), F.sum("sample_id").alias("ids"), F.round(F.sum("orm_score"), 2).alias("score"))


_RECORD = """'{{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}}'"""


@query(f"SELECT c_nationkey, count(*) AS n, sha256(unhex(string_agg(printf('%016X', octet_length(encode(r))) || hex(r), '' ORDER BY c_custkey))) AS sha256 FROM (SELECT c_nationkey, c_custkey, {_RECORD.format()} AS r FROM customer) GROUP BY 1")
def record_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every nation's customers behind their lengths, hashed in order."""
    record = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return digests.chained(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"], record)


#: Two sets of records as JSON: a number that moves by less or more than the tolerance, a leaf that turns into text, one that
#: goes, one that comes, a null in place of a missing key, a shorter list, a record that is only on one side.
_BASE = """'"id": ' || c_custkey || ', "seg": "' || c_mktsegment || '", "n": {"bal": ' || c_acctbal || ', "nation": ' || c_nationkey || '}'"""
_TAGS = """'"tags": [1, ' || c_nationkey || ']'"""
_LEFT = f"""'{{' || {_BASE} || ', ' || {_TAGS} || ', "odd key": true}}'"""
_RIGHT = f"""CASE c_custkey % 9 WHEN 0 THEN replace({_LEFT}, '"bal": ', '"bal": 1') WHEN 1 THEN replace({_LEFT}, '"nation": ', '"nation": 0.0000001e0, "country": ')
WHEN 2 THEN replace({_LEFT}, '"id": ' || c_custkey, '"id": "' || c_custkey || '"') WHEN 3 THEN replace({_LEFT}, ', "odd key": true', '') WHEN 4 THEN replace({_LEFT}, '"odd key": true', '"odd key": null')
WHEN 5 THEN replace({_LEFT}, ', ' || c_nationkey || ']', ']') WHEN 6 THEN replace({_LEFT}, '"tags": [1', '"tags": [1.0000001') ELSE {_LEFT} END"""
_DIFFERENT = """SELECT c_custkey, '$.n.bal' AS path, 'value' AS difference, regexp_replace(CAST(c_acctbal AS VARCHAR), '[.]0$', '') AS e, regexp_replace('1' || c_acctbal, '[.]0$', '') AS a FROM customer WHERE c_custkey % 9 = 0 AND c_acctbal >= 0
UNION ALL SELECT c_custkey, '$.n.country', 'extra', NULL, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 9 = 1
UNION ALL SELECT c_custkey, '$.n.nation', 'value', CAST(c_nationkey AS VARCHAR), '1.0E-7' FROM customer WHERE c_custkey % 9 = 1 AND c_nationkey > 0
UNION ALL SELECT c_custkey, '$.id', 'type', CAST(c_custkey AS VARCHAR), '"' || c_custkey || '"' FROM customer WHERE c_custkey % 9 = 2
UNION ALL SELECT c_custkey, '$[''odd key'']', 'missing', 'true', NULL FROM customer WHERE c_custkey % 9 = 3
UNION ALL SELECT c_custkey, '$[''odd key'']', 'type', 'true', 'null' FROM customer WHERE c_custkey % 9 = 4
UNION ALL SELECT c_custkey, '$.tags[1]', 'missing', CAST(c_nationkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 9 = 5
UNION ALL SELECT c_custkey, '$', 'missing', NULL, NULL FROM customer WHERE c_custkey % 9 = 7
UNION ALL SELECT -c_custkey, '$', 'extra', NULL, NULL FROM customer WHERE c_custkey % 9 = 7"""


@query(f"SELECT c_custkey, path, difference, e AS expected, a AS actual FROM ({_DIFFERENT})")
def record_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of difference between two sets of nested records; of records on one side only the root is shown."""
    rows = table(spark, sf_dir, "customer").where("c_custkey % 9 != 0 OR c_acctbal >= 0")
    left = rows.select("c_custkey", F.parse_json(F.expr(_LEFT)).alias("v"))
    key = F.when(F.col("c_custkey") % 9 == 7, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    right = rows.select(key.alias("c_custkey"), F.parse_json(F.expr(_RIGHT)).alias("v"))
    found = compare.differences(left, right, "c_custkey", "v", absolute=1e-6)
    one_side = F.abs(F.col("c_custkey")) % 9 == 7
    return found.where(~one_side | (F.col("path") == "$"))


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT l.*, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS s FROM lineitem l),
a AS (SELECT l_partkey, CASE WHEN l_linenumber % 5 > 0 THEN l_returnflag END AS answer, count(*) AS votes, min(s) AS lowest FROM p GROUP BY ALL),
b AS (SELECT l_partkey, max_by(answer, (votes, -lowest)) AS answer, max(votes) AS votes, max_by(lowest, (votes, -lowest)) AS sample_id FROM a WHERE answer IS NOT NULL GROUP BY 1)
SELECT l_partkey AS problem_id, count(*) AS num_candidates, any_value(b.answer) AS answer, coalesce(any_value(b.votes), 0) AS votes, any_value(b.sample_id) AS sample_id, coalesce(any_value(b.answer) = 'N', false) AS correct FROM p LEFT JOIN b USING (l_partkey) GROUP BY 1"""
)
def stream_vote_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of a part's order lines: three shards in three runs of one stream, the first shard twice; equals the vote over all of them."""
    from pyspark.sql import Window

    place = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    answer = F.when(F.col("l_linenumber") % 5 > 0, F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").withColumn("sample_id", (F.row_number().over(place) - 1).cast("bigint"))
    pool = rows.select(F.col("l_partkey").alias("problem_id"), "sample_id", answer.alias("answer"), (F.col("l_returnflag") == "N").alias("correct"), F.lit("pool-a").alias("identity"))
    at = own_dir(spark, "pools")
    pool.withColumn("shard", F.col("sample_id") % 3).write.partitionBy("shard").parquet(f"{at}/shards")  # places are numbered once
    for shard in (0, 1, 2):
        for arrives in (1, 0) if shard == 1 else (shard,):
            spark.read.schema(pool.schema).parquet(f"{at}/shards/shard={arrives}").write.mode("append").parquet(f"{at}/in")
        pools.kept(pools.readouts(incremental.arriving(spark, f"{at}/in", files=64)), f"{at}/out", f"{at}/state").awaitTermination()
    return pools.latest(spark.read.parquet(f"{at}/out")).drop("repeated")
