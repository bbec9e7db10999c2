"""Queries of problem records, weighted votes by score functions, sweeps and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import particles, records, select, stats
from corvane.plans.array_queries import _TRAJ, END, MASK, trajectories
from corvane.plans.registry import query
from corvane.plans.views import CANDIDATES, SCORED, SNAPSHOTS, candidates, scored_documents, snapshots
from corvane.session import table


@query(
    f"""WITH {CANDIDATES} SELECT problem_id, min(gold) AS gold, bool_or(correct) AS oracle, max_by(sample_id, (orm_score, -sample_id)) AS orm_sample, max_by(correct, (orm_score, -sample_id)) AS orm_correct,
max_by(sample_id, (prm_score, -sample_id)) AS prm_sample, max_by(correct, (prm_score, -sample_id)) AS prm_correct, count(*) AS n_scores, max(prm_score) FILTER (sample_id = 0) AS first_prm FROM c GROUP BY problem_id"""
)
def analysis_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = records.analysis_records(candidates(spark, sf_dir), ["orm_score", "prm_score"])
    return made.select("problem_id", "gold", "oracle", F.col("orm_score.sample_id").alias("orm_sample"), F.col("orm_score.correct").alias("orm_correct"), F.col("prm_score.sample_id").alias("prm_sample"), F.col("prm_score.correct").alias("prm_correct"), F.size("scores").cast("bigint").alias("n_scores"), F.col("scores")[0]["prm_score"].alias("first_prm"))


_W = {"raw": "prm_score", "sigmoid": "greatest(least(1 / (1 + exp(-prm_score)), 1 - 1e-6), 1e-6)", "exp": "exp(prm_score)"}


@query(
    f"WITH {CANDIDATES}, u AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, problem_id, answer, gold, sample_id, {w} AS w FROM c" for k, w in _W.items())
    + """), v AS (SELECT kind, problem_id, answer, min(gold) AS gold, round(sum(w), 9) AS w, min(sample_id) AS f FROM u WHERE answer IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT kind, problem_id, answer = gold AS ok FROM v QUALIFY row_number() OVER (PARTITION BY kind, problem_id ORDER BY w DESC, f) = 1)
SELECT kind, (SELECT count(DISTINCT problem_id) FROM c) AS num_problems, count(*) FILTER (ok) AS num_correct FROM t GROUP BY kind"""
)
def weighted_vote_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score-weighted majority with raw, sigmoid and exponential weights, from one grouping."""
    per = select.weighted_outcomes(candidates(spark, sf_dir), {k: particles.weights_of(F.col("prm_score"), k) for k in _W})
    counted = per.agg(F.count(F.lit(1)).alias("num_problems"), *[F.count_if(k).alias(k) for k in _W])
    return counted.unpivot("num_problems", list(_W), "kind", "num_correct").select("kind", "num_problems", "num_correct")


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT n, base_seed, problem_id, max_by(correct, (orm_score, -sample_id)) AS ok FROM c, (VALUES (1), (2), (4), (8)) t(n) WHERE sample_id < n GROUP BY ALL),
a AS (SELECT n, base_seed, count(*) FILTER (ok) / count(*) AS acc FROM p GROUP BY ALL) SELECT n, count(*) AS n_seeds, round(avg(acc), 9) AS mean, round(stddev_pop(acc), 9) AS population_std FROM a GROUP BY n"""
)
def budget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over seeds and population deviation for each budget."""
    pool = select.budgets(candidates(spark, sf_dir), (1, 2, 4, 8))
    acc = select.accuracy(select.rerank(pool, "orm_score", "problem_id", "n", "base_seed"), "n", "base_seed")
    return acc.groupBy("n").agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("accuracy"), 9).alias("mean"), F.round(F.stddev_pop("accuracy"), 9).alias("population_std"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42-' || o_orderkey), o_orderkey LIMIT 100")
def validation_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.subsample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 42)


@query(
    f"""WITH {_TRAJ}, e AS (SELECT *, list_position(ids[6:], {END}) AS pos FROM t), k AS (SELECT trajectory_id, unnest(range(1, len(ids) + 1)) AS i, ids, scores, CASE WHEN pos > 0 THEN 5 + pos - 1 ELSE len(ids) END AS fin FROM e)
SELECT trajectory_id, coalesce(max(i - 1) FILTER (i > 5 AND i <= fin AND ids[i] <> {MASK}), 4) AS place FROM k GROUP BY trajectory_id"""
)
def last_token_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = records.last_token_place(F.col("ids"), F.lit(5), END, MASK)
    return trajectories(spark, sf_dir).select("trajectory_id", place.cast("bigint").alias("place"))


@query("SELECT source, count(*) AS n, count(*) FILTER (quality >= 0.5) AS positives, avg(quality) AS mean_target FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return records.label_balance(docs, "quality", "source")


@query(f"WITH {SCORED}, l AS (SELECT least(CAST(floor(ratio * 10) AS BIGINT), 9) AS bucket, y, s_letters AS v FROM d) SELECT bucket, count(*) AS n, round(corr(v, y), 6) AS pearson FROM l GROUP BY bucket HAVING count(DISTINCT y) > 1")
def pearson_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir).withColumn("bucket", stats.decile("ratio"))
    both = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(stats.pearson("s_letters", "y"), 6).alias("pearson"), F.count_distinct("y").alias("k"))
    return both.where("k > 1").drop("k")


@query(f"WITH {SNAPSHOTS} SELECT trajectory_id, count(*) FILTER (mask_ratio = 0) AS terminal, count(*) FILTER (mask_ratio >= 0.5) AS early, max_by(score, step) AS last_score FROM s GROUP BY 1")
def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).groupBy("trajectory_id").agg(F.count_if(F.col("mask_ratio") == 0).alias("terminal"), F.count_if(F.col("mask_ratio") >= 0.5).alias("early"), F.max_by("score", "step").alias("last_score"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups that raise on a missing key, before the join is used."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return records.lookup_or_raise(records.lookup_or_raise(people, nation, "nation"), region, "region").select("c_custkey", "n_name", "r_name")
