"""Queries of selection and of pool summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import equivalence
from corvane.operators import select as sel
from corvane.operators import summary
from corvane.plans.registry import query
from corvane.plans.views import CANDIDATES, candidates
from corvane.session import ship

NS = (1, 2, 4, 8)
_N = "ns(n) AS (VALUES (1), (2), (4), (8)), b AS (SELECT * FROM c, ns WHERE sample_id < n)"
#: Winners by (count desc, first asc) over answers; %s is a filter.
_WIN = """v AS (SELECT problem_id, answer, count(*) AS votes, min(sample_id) AS first, bool_or(correct) AS any_correct, min_by(correct, sample_id) AS first_correct, min(gold) AS gold FROM c {where} GROUP BY problem_id, answer),
w AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, first) AS rn FROM v)"""


@query(
    f"""WITH {CANDIDATES}, {_N},
o AS (SELECT n, problem_id, bool_or(correct) AS ok FROM b GROUP BY n, problem_id),
v AS (SELECT n, problem_id, answer, count(*) AS k, min(sample_id) AS f, bool_or(correct) AS ok FROM b GROUP BY n, problem_id, answer),
m AS (SELECT n, problem_id, ok FROM v QUALIFY row_number() OVER (PARTITION BY n, problem_id ORDER BY k DESC, f) = 1),
r AS (SELECT n, problem_id, correct AS ok FROM b QUALIFY row_number() OVER (PARTITION BY n, problem_id ORDER BY orm_score DESC, sample_id) = 1),
p AS (SELECT n, problem_id, correct AS ok FROM b QUALIFY row_number() OVER (PARTITION BY n, problem_id ORDER BY prm_score DESC, sample_id) = 1),
u AS (SELECT 'oracle' AS method, * FROM o UNION ALL SELECT 'majority', * FROM m UNION ALL SELECT 'orm', * FROM r UNION ALL SELECT 'prm', * FROM p)
SELECT method, n, count(*) AS num_problems, count(*) FILTER (ok) AS num_correct, count(*) FILTER (ok) / count(*) AS accuracy FROM u GROUP BY method, n"""
)
def pool_accuracy_by_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle, majority and both rerankers for every budget: one shuffle by problem, one small one by budget."""
    per = sel.outcomes(sel.budgets(candidates(spark, sf_dir), NS), ("orm_score", "prm_score"), "problem_id", "n")
    names = {"oracle": "oracle", "majority": "majority", "orm": "orm_score", "prm": "prm_score"}
    counted = per.groupBy("n").agg(F.count(F.lit(1)).alias("num_problems"), *[F.count_if(c).alias(m) for m, c in names.items()])
    rows = counted.unpivot(["n", "num_problems"], list(names), "method", "num_correct")
    return rows.select("method", "n", "num_problems", "num_correct", (F.col("num_correct") / F.greatest("num_problems", F.lit(1))).alias("accuracy"))


@query(f"WITH {CANDIDATES}, {_WIN.format(where='WHERE answer IS NOT NULL')} SELECT problem_id, answer, votes, answer = gold AS is_correct FROM w WHERE rn = 1")
def majority_bon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.majority_bon(candidates(spark, sf_dir))


@query(f"WITH {CANDIDATES}, {_WIN.format(where='')} SELECT problem_id, answer, votes, any_correct AS is_correct FROM w WHERE rn = 1")
def majority_with_null_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.majority_with_null_class(candidates(spark, sf_dir))


@query(f"WITH {CANDIDATES} SELECT problem_id, count(*) FILTER (correct) * 2 > count(*) AS is_correct FROM c GROUP BY problem_id")
def majority_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.majority_strict(candidates(spark, sf_dir))


@query(
    f"""WITH {CANDIDATES}, {_WIN.format(where='WHERE answer IS NOT NULL')},
t AS (SELECT problem_id, count(*) AS num_all, count(answer) AS num_valid, min(sample_id) AS lowest FROM c GROUP BY problem_id),
e AS (SELECT problem_id, count(*) AS unique_answers, sum(votes) AS total FROM v GROUP BY problem_id),
h AS (SELECT problem_id, -sum(votes / total * log2(votes / total)) AS entropy FROM v JOIN e USING (problem_id) GROUP BY problem_id)
SELECT t.problem_id, w.answer AS selected_answer, coalesce(w.first, lowest) AS selected_sample_id, coalesce(w.answer = w.gold, false) AS is_correct, num_valid = 0 AS fallback_used,
       num_valid, num_all - num_valid AS num_invalid, (num_all - num_valid) / num_all AS invalid_rate, coalesce(unique_answers, 0) AS unique_answers, round(coalesce(entropy, 0.0), 6) + 0.0 AS entropy_bits
FROM t LEFT JOIN (SELECT * FROM w WHERE rn = 1) w USING (problem_id) LEFT JOIN e USING (problem_id) LEFT JOIN h USING (problem_id)"""
)
def majority_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sel.majority_readout(candidates(spark, sf_dir))
    return out.withColumn("entropy_bits", F.round("entropy_bits", 6) + 0.0)


@query(f"WITH {CANDIDATES}, {_N} SELECT problem_id, n, bool_or(correct) AS is_correct FROM b GROUP BY problem_id, n")
def oracle_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.oracle(sel.budgets(candidates(spark, sf_dir), NS), "problem_id", "n")


def _rerank_sql(score: str, source: str = "b", keys: str = "problem_id, n", where: str = "") -> str:
    return f"WITH {CANDIDATES}, {_N} SELECT {keys}, sample_id, answer, {score} AS score, correct AS is_correct FROM {source} {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, sample_id) = 1"


@query(_rerank_sql("orm_score"))
def rerank_orm_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.rerank(sel.budgets(candidates(spark, sf_dir), NS), "orm_score", "problem_id", "n")


@query(_rerank_sql("prm_score"))
def rerank_prm_tie_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores tie often: the lowest position wins."""
    return sel.rerank(sel.budgets(candidates(spark, sf_dir), NS), "prm_score", "problem_id", "n")


@query(_rerank_sql("orm_score", "c", "problem_id, base_seed"))
def rerank_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.rerank(candidates(spark, sf_dir), "orm_score", "problem_id", "base_seed")


@query(
    f"""WITH {CANDIDATES}, v AS (SELECT problem_id, answer, sum(quantity) AS weight, min(sample_id) AS first, min(gold) AS gold FROM c GROUP BY problem_id, answer),
t AS (SELECT problem_id, sum(weight) AS total, sum(weight) FILTER (answer IS NOT NULL) AS valid FROM v GROUP BY problem_id),
h AS (SELECT problem_id, max_by(sample_id, (quantity, -sample_id)) AS heaviest, max(quantity) AS most FROM c GROUP BY problem_id),
w AS (SELECT * FROM v WHERE answer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY weight DESC, first) = 1)
SELECT problem_id, answer, round(coalesce(weight, most) / total, 6) AS share, round(weight / valid, 6) AS valid_share, round(1 - coalesce(valid, 0) / total, 6) AS invalid_mass, coalesce(answer = gold, false) AS is_correct,
answer IS NULL AS fallback_used, CASE WHEN answer IS NULL THEN heaviest END AS fallback_sample_id FROM t JOIN h USING (problem_id) LEFT JOIN w USING (problem_id)"""
)
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.weighted_vote(candidates(spark, sf_dir), "quantity")


@query(
    f"""WITH {CANDIDATES} SELECT problem_id, answer, count(*) AS votes, min(sample_id) AS first, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id) AS members,
row_number() OVER (PARTITION BY problem_id ORDER BY min(sample_id)) - 1 AS cluster_id FROM c WHERE answer IS NOT NULL GROUP BY problem_id, answer"""
)
def answer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.clusters(candidates(spark, sf_dir))


@query(
    f"""WITH {CANDIDATES}, f AS (SELECT problem_id, sample_id, correct, CASE WHEN answer IN ('A', 'N') THEN 'an' WHEN answer IS NOT NULL THEN lower(answer) END AS form FROM c),
v AS (SELECT problem_id, form, count(*) AS votes, min(sample_id) AS first, min_by(correct, sample_id) AS ok FROM f WHERE form IS NOT NULL GROUP BY problem_id, form),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, first) = 1)
SELECT p.problem_id, form AS answer, coalesce(ok, false) AS is_correct FROM (SELECT DISTINCT problem_id FROM c) p LEFT JOIN w USING (problem_id)"""
)
def majority_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("answer").isin("A", "N"), "an").when(F.col("answer").isNotNull(), F.lower("answer"))
    return sel.majority_canonical(candidates(spark, sf_dir), form)


#: Classes of values within 2 of each other: {own} says which stay alone.
_CLASSES = """x AS (SELECT *, CASE WHEN answer IS NOT NULL THEN quantity END AS value FROM c),
g AS (SELECT *, coalesce(CAST(value - lag(value) OVER w > 2 AS INT), 0) AS broken FROM x WHERE value IS NOT NULL AND NOT ({own}) WINDOW w AS (PARTITION BY problem_id ORDER BY value, sample_id)),
r AS (SELECT problem_id, sample_id, value, correct, sum(broken) OVER (PARTITION BY problem_id ORDER BY value, sample_id ROWS UNBOUNDED PRECEDING) AS run FROM g
      UNION ALL SELECT problem_id, sample_id, value, correct, -1 - sample_id FROM x WHERE {own}),
k AS (SELECT problem_id, run, count(*) AS votes, min(sample_id) AS class_id, min_by(correct, sample_id) AS ok, min_by(value, sample_id) AS value FROM r GROUP BY 1, 2),
w AS (SELECT *, count(*) OVER (PARTITION BY problem_id) AS n_classes FROM k QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, class_id) = 1),
p AS (SELECT problem_id, count(answer) AS n, count(*) FILTER (answer IS NULL) AS num_invalid, min(sample_id) AS lowest, count(*) FILTER (answer IS NOT NULL AND quantity = 50) AS n50 FROM c GROUP BY 1)"""


@query(
    f"""WITH {CANDIDATES}, {_CLASSES.format(own='false')}
SELECT problem_id, class_id, coalesce(votes, 0) AS votes, coalesce(n_classes, 0) AS n_classes, num_invalid, coalesce(ok, false) AS is_correct FROM p LEFT JOIN w USING (problem_id)"""
)
def equivalence_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of answers within 2 of each other, closed transitively; the largest one, ties to the lowest id, graded by its first member."""
    value = F.when(F.col("answer").isNotNull(), F.col("quantity"))
    classes = sel.equivalence_classes(candidates(spark, sf_dir).withColumn("value", value), 2.0)
    each = classes.groupBy("problem_id", "class_id").agg(F.count(F.lit(1)).alias("votes"), F.min_by("correct", "sample_id").alias("ok"))
    valid = F.col("class_id").isNotNull()
    best = F.max_by(F.struct("class_id", "votes", "ok"), F.when(valid, F.struct("votes", -F.col("class_id"))))
    per = each.groupBy("problem_id").agg(best.alias("b"), F.count("class_id").alias("n_classes"), F.coalesce(F.sum(F.when(~valid, F.col("votes"))), F.lit(0)).alias("num_invalid"))
    return per.select("problem_id", "b.class_id", F.coalesce("b.votes", F.lit(0)).alias("votes"), "n_classes", "num_invalid", F.coalesce("b.ok", F.lit(False)).alias("is_correct"))


def _near(a: str, b: str) -> bool:
    """Numbers within 2 of each other; 50 can't be compared with anything, and 40 equals nothing, not even itself."""
    if "50" in (a, b):
        raise ValueError("no number: 50")
    if "40" in (a, b):
        return False
    return abs(int(a) - int(b)) <= 2


@query(
    f"""WITH {CANDIDATES}, {_CLASSES.format(own='answer IS NOT NULL AND quantity IN (40, 50)').replace("FROM x WHERE answer", "FROM x WHERE answer")},
e AS (SELECT problem_id, -sum(votes / n * log2(votes / n)) AS entropy FROM k JOIN p USING (problem_id) GROUP BY 1)
SELECT problem_id, CAST(CAST(value AS BIGINT) AS VARCHAR) AS selected_answer, coalesce(votes, 0) AS selected_count, coalesce(class_id, lowest) AS selected_sample_id, coalesce(ok, false) AS correct, class_id IS NULL AS fallback_used,
n AS num_valid, num_invalid, coalesce(n_classes, 0) AS unique_classes, round(coalesce(entropy, 0), 6) + 0.0 AS entropy_bits, CAST(n * (n - 1) / 2 AS BIGINT) AS comparison_count, CAST(n50 * (n - n50) + n50 * (n50 - 1) / 2 AS BIGINT) AS error_count
FROM p LEFT JOIN w USING (problem_id) LEFT JOIN e USING (problem_id)"""
)
def equivalence_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a comparison that the caller supplies and that fails for some answers."""
    ship(spark)
    pool = candidates(spark, sf_dir).withColumn("text", F.when(F.col("answer").isNotNull(), F.col("quantity").cast("bigint").cast("string")))
    out = equivalence.equivalence_readout(pool, _near, answer="text")
    columns = ["problem_id", "selected_answer", "selected_count", "selected_sample_id", "correct", "fallback_used", "num_valid", "num_invalid", "unique_classes", "comparison_count", "error_count"]
    return out.select(*columns, (F.round("entropy_bits", 6) + 0.0).alias("entropy_bits"))


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT problem_id, count(*) AS n, count(*) FILTER (correct) AS k, count(*) FILTER (answer IS NULL) AS inv, count(DISTINCT answer) AS u, bool_or(correct) AS ok, sum(quantity) AS tokens FROM c GROUP BY problem_id)
SELECT count(*) AS num_problems, CAST(sum(n) AS BIGINT) AS num_candidates, CAST(sum(k) AS BIGINT) AS num_correct, sum(k) / sum(n) AS mean_candidate_accuracy, count(*) FILTER (ok) AS oracle_correct, count(*) FILTER (k * 2 > n) AS strict_correct,
CAST(sum(inv) AS BIGINT) AS num_invalid, round(avg(inv / n), 6) AS mean_invalid_rate, round(avg(u), 6) AS mean_unique, count(*) FILTER (u > 1) AS num_diverse, min(n) AS min_candidates, max(n) AS max_candidates, CAST(sum(tokens) AS BIGINT) AS total_calls FROM p"""
)
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.pool_summary(candidates(spark, sf_dir), calls="quantity")


@query(
    f"""WITH {CANDIDATES}, {_WIN.format(where='WHERE answer IS NOT NULL')},
p AS (SELECT problem_id, count(*) AS n, count(*) FILTER (answer IS NULL) AS inv, sum(quantity) AS s, bool_or(correct) AS oracle, max_by(correct, (orm_score, -sample_id)) AS orm, max_by(correct, (prm_score, -sample_id)) AS prm FROM c GROUP BY problem_id),
m AS (SELECT p.*, coalesce(w.answer = w.gold, false) AS majority FROM p LEFT JOIN (SELECT * FROM w WHERE rn = 1) w USING (problem_id)),
u AS (SELECT * FROM (UNPIVOT m ON majority, oracle, orm, prm INTO NAME method VALUE ok))
SELECT method, count(*) AS num_problems, count(*) FILTER (ok) AS num_correct, count(*) FILTER (ok) / count(*) AS accuracy, CAST(sum(n) * 128 AS BIGINT) AS logical_denoising, CAST(CASE WHEN method IN ('orm', 'prm') THEN sum(n) ELSE 0 END AS BIGINT) AS logical_scorer,
CAST(sum(n) * 128 + CASE WHEN method IN ('orm', 'prm') THEN sum(n) ELSE 0 END AS BIGINT) AS logical_total, CAST(CASE WHEN method IN ('orm', 'prm') THEN sum(ceil(n / 4)) ELSE 0 END AS BIGINT) AS physical_scorer_forwards,
CASE WHEN method IN ('orm', 'prm') THEN sum(s) ELSE 0.0 END AS scorer_seconds, CAST(sum(inv) AS BIGINT) AS total_invalid, round(avg(inv / n), 6) AS mean_invalid_rate FROM u GROUP BY method"""
)
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods in one grouping by problem."""
    rows = summary.method_rows(candidates(spark, sf_dir), {"orm": "orm_score", "prm": "prm_score"}, 128, 4, "quantity")
    return summary.method_summary(rows).withColumn("mean_invalid_rate", F.round("mean_invalid_rate", 6))


_PARTICLES = f"""{CANDIDATES}, v AS (SELECT problem_id, answer, count(*) AS k, sum(quantity) AS w, min(sample_id) AS first, min(gold) AS gold FROM c GROUP BY 1, 2),
t AS (SELECT problem_id, sum(k) FILTER (answer IS NOT NULL) AS n, sum(w) FILTER (answer IS NOT NULL) AS ws, sum(k) AS rn, sum(w) AS rw, count(answer) AS unique_answers, coalesce(max_by(answer = gold, (round(w, 9), -first)) FILTER (answer IS NOT NULL), false) AS weighted FROM v GROUP BY 1),
e AS (SELECT problem_id, coalesce(-sum(k / n * log2(k / n)) FILTER (answer IS NOT NULL), 0) AS e1, coalesce(-sum(w / ws * log2(w / ws)) FILTER (answer IS NOT NULL), 0) AS e2, -sum(k / rn * log2(k / rn)) AS e3, -sum(w / rw * log2(w / rw)) AS e4 FROM v JOIN t USING (problem_id) GROUP BY 1)"""


@query(f"WITH {_PARTICLES} SELECT problem_id, round(e1, 6) + 0.0 AS entropy_bits, round(e2, 6) + 0.0 AS weighted_entropy_bits, round(e3, 6) + 0.0 AS raw_entropy_bits, round(e4, 6) + 0.0 AS raw_weighted_entropy_bits FROM e")
def entropy_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.entropy(candidates(spark, sf_dir), "quantity")
    return out.select("problem_id", *[(F.round(c, 6) + 0.0).alias(c) for c in out.columns[1:]])


_RECORDS = f"""{_PARTICLES}, q AS (SELECT problem_id, max_by(correct, (orm_score, -sample_id)) AS top, bool_or(correct) AS oracle, count(*) AS m, count(*) FILTER (answer IS NULL) AS inv, coalesce(sum(quantity) FILTER (answer IS NULL), 0) / sum(quantity) AS mass,
sum(quantity) * sum(quantity) / sum(quantity * quantity) AS ess, count(DISTINCT base_seed) AS anc, count(DISTINCT base_seed) FILTER (answer IS NOT NULL) AS lin, sum(quantity) AS s FROM c GROUP BY 1),
z AS (SELECT * FROM q JOIN t USING (problem_id) JOIN e USING (problem_id))"""
_TOTALS = "CAST(sum(m) * 128 AS BIGINT) AS total_logical_denoising, CAST(sum(m) * 2 AS BIGINT) AS total_logical_scoring, CAST(sum(m) * 130 AS BIGINT) AS total_logical_total, 128 * count(*) AS total_physical_denoising, 2 * count(*) AS total_physical_scoring"


@query(
    f"""WITH {_RECORDS} SELECT count(*) AS num_problems, round(avg(CAST(weighted AS INT)), 6) AS weighted_accuracy, round(avg(CAST(top AS INT)), 6) AS top_accuracy, round(avg(CAST(oracle AS INT)), 6) AS oracle_accuracy, round(avg(CAST(inv = m AS INT)), 6) AS fallback_rate,
round(avg(CAST(ess < 0.5 * m AS INT)), 6) AS trigger_rate, round(avg(unique_answers), 6) AS mean_unique_answers, round(avg(e1), 6) AS mean_entropy_bits, round(avg(e2), 6) AS mean_weighted_entropy_bits, round(avg(e3), 6) AS mean_raw_entropy_bits, round(avg(e4), 6) AS mean_raw_weighted_entropy_bits,
round(avg(inv), 6) AS mean_num_invalid, round(avg(mass), 6) AS mean_invalid_mass, round(avg(ess), 6) AS mean_ess, round(avg(anc), 6) AS mean_unique_ancestors, round(avg(lin), 6) AS mean_final_lineages, round(avg(s), 6) AS mean_seconds, {_TOTALS} FROM z"""
)
def smc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of weighted particles; a candidate's seed stands for its ancestor."""
    return summary.particle_summary(summary.particle_records(candidates(spark, sf_dir), "quantity", "orm_score", "base_seed", "quantity", 128))


@query(f"WITH {_RECORDS} SELECT count(*) AS num_problems, round(avg(CAST(top AS INT)), 6) AS accuracy, round(avg(CAST(oracle AS INT)), 6) AS oracle_accuracy, round(avg(unique_answers), 6) AS mean_unique_answers, round(avg(inv), 6) AS mean_num_invalid, round(avg(s), 6) AS mean_seconds, {_TOTALS} FROM z")
def topm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_m_summary(summary.particle_records(candidates(spark, sf_dir), "quantity", "orm_score", "base_seed", "quantity", 128))


@query(f"WITH {CANDIDATES} SELECT problem_id FROM c GROUP BY problem_id HAVING count(*) >= 3")
def at_least_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.at_least(candidates(spark, sf_dir), 3)


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT problem_id, count(DISTINCT answer) AS u FROM c GROUP BY problem_id)
SELECT count(*) AS num_problems, count(*) FILTER (u > 1) / count(*) AS diverse_share, round(avg(u), 6) AS mean_unique, round(stddev_pop(u), 6) AS std_unique FROM p"""
)
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.diversity(candidates(spark, sf_dir))


@query(
    f"""WITH {CANDIDATES} SELECT problem_id, count(*) FILTER (answer IS NULL) AS num_invalid, count(*) FILTER (answer IS NULL) / count(*) AS invalid_rate,
coalesce(string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id) FILTER (answer IS NULL), '') AS invalid_ids, coalesce(sum(quantity) FILTER (answer IS NULL), 0) AS invalid_mass FROM c GROUP BY problem_id"""
)
def invalid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.invalid_stats(candidates(spark, sf_dir), "quantity")


@query(f"WITH {CANDIDATES} SELECT key, CAST(sum(v) AS BIGINT) AS total FROM (SELECT 'denoising' AS key, quantity AS v FROM c UNION ALL SELECT 'scoring', sample_id FROM c) GROUP BY key")
def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = candidates(spark, sf_dir).withColumn("calls", F.create_map(F.lit("denoising"), F.col("quantity").cast("bigint"), F.lit("scoring"), F.col("sample_id").cast("bigint")))
    return summary.counter_totals(counted, "calls")


@query("SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1, 2")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.session import table

    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANDIDATES} SELECT base_seed, avg(CAST(correct AS INT)) AS accuracy, count(*) AS n FROM c GROUP BY base_seed")
def mean_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("base_seed").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANDIDATES} SELECT count(*) AS num_trajectories, count(*) FILTER (correct) AS num_correct, count(DISTINCT problem_id) AS num_problems, count(*) FILTER (correct) / count(*) AS accuracy FROM c")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.merge_stats(candidates(spark, sf_dir))


@query(f"WITH {CANDIDATES} SELECT problem_id FROM c GROUP BY problem_id HAVING list_sort(list(DISTINCT sample_id)) = range(0, 4)")
def exact_sample_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems whose sample ids are 0 to 3, no more and no less."""
    return summary.exact_sets(candidates(spark, sf_dir), 4)


@query(
    f"""WITH {CANDIDATES}, g AS (SELECT problem_id, base_seed, correct FROM c)
SELECT base_seed, gold, count(*) AS n, count(*) FILTER (correct) AS k FROM c GROUP BY CUBE (base_seed, gold)"""
)
def cube_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts over all combinations of seed and gold answer."""
    return candidates(spark, sf_dir).cube("base_seed", "gold").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"))


@query()
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: mergeable HyperLogLog sketches by seed, and their union's estimate."""
    part = candidates(spark, sf_dir).groupBy("base_seed").agg(F.hll_sketch_agg("problem_id").alias("sketch"), F.count_distinct("problem_id").alias("exact"))
    return part.select("base_seed", "exact", F.hll_sketch_estimate("sketch").alias("estimate"))
