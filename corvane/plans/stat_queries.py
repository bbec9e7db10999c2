"""Queries of statistics and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import resample, stats
from corvane.operators.select import accuracy, rerank
from corvane.plans.registry import query
from corvane.plans.views import CANDIDATES, SCORED, SNAPSHOTS, candidates, scored_documents, snapshots

#: Resamples of the registered bootstraps: N_BOOT of the reference, so the bounds are those at places 25 and 975.
TIMES = 1000
_DRAW = "CAST(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) % {n} AS BIGINT)"
_AUC = """p AS (SELECT {group} v, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM l GROUP BY ALL),
q AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {part} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p)
SELECT {group} CAST(sum(pos) + sum(neg) AS BIGINT) AS n, CASE WHEN sum(pos) + sum(neg) >= 10 AND sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)) END AS auc FROM q GROUP BY ALL"""
_LONG = "l AS (SELECT {extra} y, score, v FROM (UNPIVOT (SELECT {extra} y, s_fwd, s_const, s_letters, (s_fwd + s_letters) / 2 AS s_mean FROM d) ON s_fwd, s_const, s_letters, s_mean INTO NAME score VALUE v))"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scored_documents(spark, sf_dir).withColumn("s_mean", (F.col("s_fwd") + F.col("s_letters")) / 2).withColumn("bucket", stats.range_bucket("ratio"))
    return docs.unpivot(["bucket", "y"], ["s_fwd", "s_const", "s_letters", "s_mean"], "score", "v")


@query(f"WITH {SCORED}, {_LONG.format(extra='')}, {_AUC.format(group='score,', part='score')}")
def auc_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.auc(_long(spark, sf_dir), ["score"], "v", "y")


_BUCKET = "CASE WHEN {r} >= 0 AND {r} < 0.1 THEN '0.0-0.10' WHEN {r} >= 0.1 AND {r} < 0.3 THEN '0.1-0.30' WHEN {r} >= 0.3 AND {r} < 0.5 THEN '0.3-0.50' WHEN {r} >= 0.5 AND {r} < 0.7 THEN '0.5-0.70' WHEN {r} >= 0.7 AND {r} < 0.9 THEN '0.7-0.90' WHEN {r} >= 0.9 AND {r} < 1.01 THEN '0.9-1.01' ELSE 'other' END"


@query(f"WITH {SCORED.replace('SELECT doc_id', 'SELECT ' + _BUCKET.format(r='(CAST(n_chars % 10 AS DOUBLE) / 10)') + ' AS bucket, doc_id')}, {_LONG.format(extra='bucket,')}, {_AUC.format(group='bucket, score,', part='bucket, score')}")
def auc_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.auc(_long(spark, sf_dir), ["bucket", "score"], "v", "y")


@query(f"WITH {SCORED} SELECT round(corr(s_fwd, s_letters), 6) AS fwd_letters, round(corr(s_fwd, y), 6) AS fwd_y, round(corr(s_letters, y), 6) AS letters_y FROM d")
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored_documents(spark, sf_dir)
    r = lambda a, b, n: F.round(stats.pearson(a, b), 6).alias(n)
    return d.agg(r("s_fwd", "s_letters", "fwd_letters"), r("s_fwd", "y", "fwd_y"), r("s_letters", "y", "letters_y"))


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT problem_id, corr(prm_score, CAST(correct AS INT)) AS r FROM c GROUP BY problem_id HAVING count(*) >= 2 AND min(prm_score) < max(prm_score) AND bool_or(correct) AND NOT bool_and(correct))
SELECT count(*) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median FROM p"""
)
def point_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.bool_or("correct") & ~F.bool_and("correct") & (F.min("prm_score") < F.max("prm_score"))
    per = candidates(spark, sf_dir).groupBy("problem_id").agg(both.alias("ok"), stats.pearson("prm_score", F.col("correct").cast("int")).alias("r")).where("ok")
    out = stats.mean_and_median(per, "r", "problem_id")
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query(
    f"""WITH {CANDIDATES}, x AS (SELECT a.problem_id, sign(a.prm_score - b.prm_score) * (CAST(a.correct AS INT) - CAST(b.correct AS INT)) AS s FROM c a JOIN c b ON a.problem_id = b.problem_id AND a.sample_id < b.sample_id),
g AS (SELECT problem_id, (count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / count(*) FILTER (s <> 0) AS gamma FROM x GROUP BY problem_id HAVING count(*) FILTER (s <> 0) > 0)
SELECT count(*) AS n, round(avg(gamma), 6) AS mean, round(median(gamma), 6) AS median FROM g"""
)
def kendall_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank agreement by counts per score; the oracle compares all pairs."""
    out = stats.mean_and_median(stats.gamma(candidates(spark, sf_dir), "problem_id", "prm_score", "correct"), "gamma", "problem_id")
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


_BUCKETS = "b AS (SELECT least(CAST(floor(mask_ratio * 10) AS BIGINT), 9) AS bucket, count(*) AS n, avg(CAST(final_correct = (score > 50) AS INT)) AS acc FROM s GROUP BY 1)"


def _bucket_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).groupBy(stats.decile("mask_ratio").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("final_correct") == (F.col("score") > 50)).cast("int")).alias("acc"))


@query(
    f"""WITH {SNAPSHOTS}, {_BUCKETS}, r AS (SELECT rank() OVER (ORDER BY bucket) AS ra, rank() OVER (ORDER BY acc) + (count(*) OVER (PARTITION BY acc) - 1) / 2 AS rb FROM b)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r"""
)
def spearman_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(_bucket_accuracy(spark, sf_dir), "bucket", "acc").withColumn("rho", F.round("rho", 6))


@query(f"WITH {SNAPSHOTS}, {_BUCKETS}, r AS (SELECT bucket, lead(bucket) OVER (ORDER BY bucket) AS next_bucket, round(lead(acc) OVER (ORDER BY bucket) - acc, 9) AS rise FROM b) SELECT * FROM r WHERE rise > 0.001")
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.monotonic_violations(_bucket_accuracy(spark, sf_dir), "bucket", "acc", 0.001).withColumn("rise", F.round("rise", 9))


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT problem_id, avg(orm_score) FILTER (correct) - avg(orm_score) FILTER (NOT correct) AS delta FROM c GROUP BY problem_id HAVING bool_or(correct) AND NOT bool_and(correct)),
o AS (SELECT delta, row_number() OVER (ORDER BY delta, problem_id) - 1 AS i, count(*) OVER () AS n FROM p)
SELECT count(*) AS n, round(avg(delta), 6) AS mean, round(median(delta), 6) AS median, count(*) FILTER (delta > 0) / count(*) AS positive_share,
round(max(delta) FILTER (i = floor(0.1 * n + 1e-9)), 6) AS p10, round(max(delta) FILTER (i = floor(0.9 * n + 1e-9)), 6) AS p90 FROM o"""
)
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.score_delta(candidates(spark, sf_dir), "problem_id", "orm_score", "correct")
    return out.select("n", "positive_share", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p10", "p90")])


_CONF = """SELECT {bucket} AS bucket, count(*) AS n, count(*) FILTER (logit > 0 AND y = 1) AS tp, count(*) FILTER (logit > 0 AND y = 0) AS fp, count(*) FILTER (logit <= 0 AND y = 1) AS fn, count(*) FILTER (logit <= 0 AND y = 0) AS tn,
round(avg(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))), 6) AS mean_bce FROM d GROUP BY 1"""


@query(
    f"""WITH {SCORED}, k AS ({_CONF.format(bucket='least(CAST(floor(ratio * 10) AS BIGINT), 9)')})
SELECT *, tp + tn AS n_correct, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM k"""
)
def confusion_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(scored_documents(spark, sf_dir), stats.decile("ratio"), "logit", "y").withColumn("mean_bce", F.round("mean_bce", 6))


@query(f"WITH {SCORED}, k AS ({_CONF.format(bucket='least(CAST(floor(ratio / 0.1) AS BIGINT), 9)')}) SELECT bucket, n, (tp + tn) / n AS accuracy, mean_bce FROM k")
def bce_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets by division, where 0.3 falls into bucket 2."""
    out = stats.confusion(scored_documents(spark, sf_dir), stats.decile_by_division("ratio"), "logit", "y")
    return out.select("bucket", "n", "accuracy", F.round("mean_bce", 6).alias("mean_bce"))


@query("SELECT l_suppkey % 8 AS grp, count(*) AS n, round(avg(l_quantity / l_linenumber), 6) AS mean, round(coalesce(stddev_samp(l_quantity / l_linenumber) / sqrt(count(*)), 0), 6) AS standard_error FROM lineitem GROUP BY 1")
def throughput_stderr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.session import table

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("grp"), (F.col("l_quantity") / F.col("l_linenumber")).alias("rate"))
    out = stats.mean_and_error(rows, "grp", "rate")
    return out.select("grp", "n", F.round("mean", 6).alias("mean"), F.round("standard_error", 6).alias("standard_error"))


@query(f"WITH {SNAPSHOTS} SELECT least(CAST(floor(mask_ratio * 10) AS BIGINT), 9) AS bucket, count(*) AS n, round(avg(score - 50 * mask_ratio), 6) AS mean_delta, round(avg(abs(score - 50 * mask_ratio)), 6) AS mean_abs_delta, round(stddev_pop(score - 50 * mask_ratio), 6) AS std_delta FROM s GROUP BY 1")
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.col("score") - 50 * F.col("mask_ratio")
    return snapshots(spark, sf_dir).groupBy(stats.decile("mask_ratio").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.avg(F.abs(delta)), 6).alias("mean_abs_delta"), F.round(F.stddev_pop(delta), 6).alias("std_delta"))


@query(f"WITH {CANDIDATES}, p AS (SELECT base_seed, problem_id, max_by(correct, (orm_score, -sample_id)) AS ok FROM c GROUP BY 1, 2), a AS (SELECT base_seed, count(*) FILTER (ok) / count(*) AS acc FROM p GROUP BY 1) SELECT count(*) AS n_seeds, round(avg(acc), 9) AS mean, round(stddev_samp(acc), 9) AS sample_std, round(stddev_pop(acc), 9) AS population_std FROM a")
def seed_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both deviations over seeds: of the sample, as in seed sweeps, and of the population, as in budget sweeps."""
    acc = accuracy(rerank(candidates(spark, sf_dir), "orm_score", "problem_id", "base_seed"), "base_seed")
    return acc.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("accuracy"), 9).alias("mean"), F.round(F.stddev_samp("accuracy"), 9).alias("sample_std"), F.round(F.stddev_pop("accuracy"), 9).alias("population_std"))


@query(f"WITH {CANDIDATES} SELECT round(avg(orm_score) FILTER (correct), 6) AS mean_correct, round(avg(orm_score) FILTER (NOT correct), 6) AS mean_incorrect, round(avg(orm_score) FILTER (correct) - avg(orm_score) FILTER (NOT correct), 6) AS difference FROM c")
def sign_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.avg(F.when(c, F.col("orm_score"))) for c in (F.col("correct"), ~F.col("correct")))
    return candidates(spark, sf_dir).agg(F.round(a, 6).alias("mean_correct"), F.round(b, 6).alias("mean_incorrect"), F.round(a - b, 6).alias("difference"))


@query("SELECT o_orderpriority AS method, count(*) AS n, round(avg(o_totalprice), 6) AS mean_seconds FROM orders GROUP BY 1")
def mean_time_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.session import table

    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_seconds"))




def _mixed(x: str) -> str:
    """The mixing function of the draws, its products cut to 64 bits."""
    cut = lambda z: f"CAST(({z}) % 18446744073709551616 AS UBIGINT)"
    z = cut(f"CAST({x} AS UHUGEINT) + {resample.STEP}")
    for factor, shift in zip(resample.FACTORS, resample.SHIFTS, strict=False):
        z = cut(f"CAST(list_transform([{z}], lambda z: xor(z, z >> {shift}))[1] AS UHUGEINT) * {factor}")
    return f"list_transform([{z}], lambda z: xor(z, z >> {resample.SHIFTS[2]}))[1]"


_OUT = f"""{CANDIDATES}, o AS (SELECT problem_id, bool_or(correct) AS oracle, max_by(correct, (orm_score, -sample_id)) AS orm, max_by(correct, (prm_score, -sample_id)) AS prm, count(*) OVER () AS n FROM c GROUP BY problem_id), pl AS (SELECT *, row_number() OVER (ORDER BY oracle NULLS FIRST, orm NULLS FIRST, prm NULLS FIRST) - 1 AS place FROM o),
dr AS (SELECT b, CAST({_mixed("CAST(b AS UBIGINT) * 1099511627776 + CAST(i AS UBIGINT)")} % n AS BIGINT) AS place FROM (SELECT place AS i, n FROM pl), range(0, {TIMES}) r(b)),
m AS (SELECT b, sum(CAST(oracle AS BIGINT)) / count(*) AS oracle, sum(CAST(orm AS BIGINT)) / count(*) AS orm, sum(CAST(prm AS BIGINT)) / count(*) AS prm FROM dr JOIN pl USING (place) GROUP BY b)"""
_LO, _HI = int(0.025 * TIMES), int(0.975 * TIMES)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda s: F.max_by("correct", F.struct(F.col(s), -F.col("sample_id")))
    return candidates(spark, sf_dir).groupBy("problem_id").agg(F.bool_or("correct").alias("oracle"), top("orm_score").alias("orm"), top("prm_score").alias("prm"))


@query(
    f"""WITH {_OUT}, u AS (UNPIVOT m ON oracle, orm, prm INTO NAME method VALUE v), k AS (SELECT method, v, row_number() OVER (PARTITION BY method ORDER BY v, b) - 1 AS i FROM u),
p AS (UNPIVOT (SELECT sum(CAST(oracle AS BIGINT)) / count(*) AS oracle, sum(CAST(orm AS BIGINT)) / count(*) AS orm, sum(CAST(prm AS BIGINT)) / count(*) AS prm FROM o) ON oracle, orm, prm INTO NAME method VALUE point)
SELECT method, point, max(v) FILTER (i = {_LO}) AS lo, max(v) FILTER (i = {_HI}) AS hi FROM k JOIN p USING (method) GROUP BY method, point"""
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap(_outcomes(spark, sf_dir), ["oracle", "orm", "prm"], TIMES)


@query(
    f"""WITH {_OUT}, u AS (SELECT 'oracle' AS "left", 'orm' AS "right", b, oracle - orm AS v FROM m UNION ALL SELECT 'orm', 'prm', b, orm - prm FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY v, b) - 1 AS i FROM u),
p AS (SELECT 'oracle' AS "left", 'orm' AS "right", sum(CAST(oracle AS BIGINT)) / count(*) - sum(CAST(orm AS BIGINT)) / count(*) AS delta FROM o UNION ALL SELECT 'orm', 'prm', sum(CAST(orm AS BIGINT)) / count(*) - sum(CAST(prm AS BIGINT)) / count(*) FROM o)
SELECT "left", "right", round(delta, 9) AS delta, round(max(v) FILTER (i = {_LO}), 9) AS lo, round(max(v) FILTER (i = {_HI}), 9) AS hi FROM k JOIN p USING ("left", "right") GROUP BY ALL"""
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.paired_bootstrap(_outcomes(spark, sf_dir), [("oracle", "orm"), ("orm", "prm")], TIMES)
    return out.select("left", "right", *[F.round(c, 9).alias(c) for c in ("delta", "lo", "hi")])


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT problem_id, count(*) AS n FROM c GROUP BY 1), d AS (SELECT trial, problem_id, {_DRAW.format(key="trial || '-' || problem_id", n='n')} AS sample_id FROM p, range(0, 10) r(trial)),
a AS (SELECT trial, count(*) FILTER (correct) / count(*) AS acc FROM d JOIN c USING (problem_id, sample_id) GROUP BY trial) SELECT count(*) AS trials, round(avg(acc), 9) AS mean, round(stddev_samp(acc), 9) AS std FROM a"""
)
def random_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.random_rerank(candidates(spark, sf_dir), 10).agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg("accuracy"), 9).alias("mean"), F.round(F.stddev_samp("accuracy"), 9).alias("std"))


@query(
    f"""WITH {CANDIDATES} SELECT problem_id, sample_id, CAST(CAST(('0x' || substr(sha256('[' || base_seed || ',' || problem_id || ',' || sample_id || ',"gen"]'), 1, 16)) AS UBIGINT) & 9223372036854775807::UBIGINT AS BIGINT) AS seed FROM c"""
)
def seed_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumn("stage", F.lit("gen")).select("problem_id", "sample_id", resample.derive_seed("base_seed", "problem_id", "sample_id", "stage").alias("seed"))
