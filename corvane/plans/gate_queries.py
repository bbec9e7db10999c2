"""Queries of gates, identities and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import gates, lineage, resample, select, summary
from corvane.plans.registry import query
from corvane.plans.views import CANDIDATES, SNAPSHOTS, candidates, snapshots
from corvane.session import table


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT problem_id, count(*) AS n, count(DISTINCT sample_id) AS d, min(sample_id) AS lo, max(sample_id) AS hi FROM c GROUP BY 1)
SELECT 'count' AS "check", CAST(problem_id AS VARCHAR) AS key, '4' AS expected, CAST(n AS VARCHAR) AS actual FROM p WHERE n <> 4
UNION ALL SELECT 'ids', CAST(problem_id AS VARCHAR), '0..3', lo || '..' || hi FROM p WHERE d <> n OR lo <> 0 OR hi <> n - 1
UNION ALL SELECT 'correct', problem_id || '/' || sample_id, CAST(coalesce(answer = gold, false) AS VARCHAR), CAST(correct AS VARCHAR) FROM (SELECT problem_id, sample_id, answer, gold, correct OR orm_score < 1000 AS correct FROM c) WHERE correct <> coalesce(answer = gold, false)"""
)
def dq_candidate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades are forged for low scores, so that the gate has something to find."""
    pool = candidates(spark, sf_dir)
    return gates.candidate_set(pool.withColumn("correct", F.col("correct") | (F.col("orm_score") < 1000)), 4)


@query(
    f"""WITH {CANDIDATES}, k AS (SELECT problem_id, sample_id + CASE WHEN quantity = 50 THEN 100 ELSE 0 END AS sample_id, CASE WHEN quantity = 1 THEN NULL ELSE prm_score END AS score FROM c)
SELECT 'missing' AS "check", problem_id || '/' || sample_id AS key, '1' AS expected, '0' AS actual FROM c WHERE quantity = 50 UNION ALL SELECT 'unknown', problem_id || '/' || sample_id, '0', '1' FROM k WHERE sample_id >= 100
UNION ALL SELECT 'finite', problem_id || '/' || sample_id, 'finite', NULL FROM k WHERE score IS NULL"""
)
def dq_score_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = candidates(spark, sf_dir)
    moved = F.col("sample_id") + F.when(F.col("quantity") == 50, 100).otherwise(0)
    scores = pool.select("problem_id", moved.alias("sample_id"), F.when(F.col("quantity") != 1, F.col("prm_score")).alias("score"))
    return gates.score_vector(pool, scores)


@query(
    f"""WITH {SNAPSHOTS}, t AS (SELECT event_id % 9000 AS state_id, trajectory_id AS problem_id, mask_ratio, CAST(floor(mask_ratio * 10) AS BIGINT) AS mask_bucket FROM s),
p AS (SELECT problem_id, count(DISTINCT mask_bucket) AS b, max(c) AS m FROM (SELECT problem_id, mask_bucket, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT 'unique' AS "check", CAST(state_id AS VARCHAR) AS key, '1' AS expected, CAST(count(*) AS VARCHAR) AS actual FROM t GROUP BY state_id HAVING count(*) > 1
UNION ALL SELECT 'ratio', CAST(state_id AS VARCHAR), '0 < r < 1', CAST(mask_ratio AS VARCHAR) FROM t WHERE mask_ratio <= 0 OR mask_ratio >= 1
UNION ALL SELECT 'fraction', CAST(state_id AS VARCHAR), 'mean', '0.5' FROM t WHERE state_id % 100 = 0
UNION ALL SELECT 'outcomes', CAST(state_id AS VARCHAR), '8', '4' FROM t WHERE state_id % 100 = 1 UNION ALL SELECT 'label', CAST(state_id AS VARCHAR), '0 or 1', '2' FROM t WHERE state_id % 100 = 2
UNION ALL SELECT 'constant label', CAST(problem_id AS VARCHAR), 'one', 'several' FROM t GROUP BY problem_id HAVING bool_or(state_id % 100 = 2) AND NOT bool_and(state_id % 100 = 2)
UNION ALL SELECT 'buckets', CAST(problem_id AS VARCHAR), '10', CAST(b AS VARCHAR) FROM p WHERE b <> 10 OR m > 1"""
)
def dq_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).select((F.col("event_id") % 9000).alias("state_id"), F.col("trajectory_id").alias("problem_id"), "mask_ratio", F.floor(F.col("mask_ratio") * 10).alias("mask_bucket"))
    many, few = (F.array(*[F.lit(float(x)) for x in xs]) for xs in ((1, 1, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0)))
    forged = lambda k: F.col("state_id") % 100 == k
    rows = rows.withColumns({"outcomes": F.when(forged(1), few).otherwise(many), "fraction": F.when(forged(0), 0.5).otherwise(0.25), "y": F.when(forged(2), 2).otherwise(F.col("problem_id") % 2)})
    return gates.states(rows, outcomes=8, label="y")


@query(
    f"""WITH {CANDIDATES}, r AS (SELECT problem_id || '/' || sample_id AS key, coalesce(answer, 'none') AS answer, CASE WHEN quantity = 7 THEN 'late' ELSE 'ok' END AS g, CASE WHEN answer IS NULL THEN 'invalid' WHEN quantity = 8 THEN 'odd' ELSE 'ok' END AS e, correct, correct <> (quantity = 9) AS graded, CASE WHEN quantity = 10 THEN 'Z' ELSE coalesce(answer, 'none') END AS ea FROM c)
SELECT 'grade status' AS "check", key, 'ok/timeout/error' AS expected, g AS actual FROM r WHERE g = 'late' UNION ALL SELECT 'extraction status', key, 'ok/invalid/timeout/error', e FROM r WHERE e = 'odd'
UNION ALL SELECT 'correct', key, CAST(graded AS VARCHAR), CAST(correct AS VARCHAR) FROM r WHERE graded <> correct UNION ALL SELECT 'answer', key, ea, answer FROM r WHERE ea <> answer"""
)
def dq_candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, grades and answers are forged by quantity."""
    pool = candidates(spark, sf_dir)
    answer = F.coalesce("answer", F.lit("none"))
    extraction = F.when(F.col("answer").isNull(), "invalid").when(F.col("quantity") == 8, "odd").otherwise("ok")
    rows = pool.select("problem_id", "sample_id", answer.alias("answer"), "correct", F.when(F.col("quantity") == 7, "late").otherwise("ok").alias("grade_status"), extraction.alias("extraction_status"), (F.col("correct") != (F.col("quantity") == 9)).alias("grade_correct"), F.when(F.col("quantity") == 10, "Z").otherwise(answer).alias("extraction_answer"))
    return gates.candidate_records(rows)


@query(
    f"""WITH {CANDIDATES}, v AS (SELECT problem_id, answer, count(*) AS k, min(sample_id) AS f FROM c WHERE answer IS NOT NULL GROUP BY 1, 2),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY k DESC, f) = 1),
p AS (SELECT problem_id, count(*) AS n, min(sample_id) AS lowest, bool_or(correct) AS oracle FROM c GROUP BY 1),
m AS (SELECT p.*, answer, coalesce(f, lowest) AS sample FROM p LEFT JOIN b USING (problem_id))
SELECT 'count' AS "check", CAST(problem_id AS VARCHAR) AS key, '4' AS expected, CAST(n AS VARCHAR) AS actual FROM m WHERE n <> 4 UNION ALL SELECT 'base seed', CAST(problem_id AS VARCHAR), '42', '43' FROM m WHERE problem_id % 50 = 1
UNION ALL SELECT 'prompt', CAST(problem_id AS VARCHAR), '3', '4' FROM m WHERE problem_id % 50 = 2 UNION ALL SELECT 'majority', CAST(problem_id AS VARCHAR), concat_ws('/', answer, sample), concat_ws('/', answer, sample + 1) FROM m WHERE problem_id % 50 = 3
UNION ALL SELECT 'oracle', CAST(problem_id AS VARCHAR), CAST(oracle AS VARCHAR), CAST(NOT oracle AS VARCHAR) FROM m WHERE problem_id % 50 = 4
UNION ALL SELECT 'range', CAST(problem_id AS VARCHAR), '0..999', CAST(problem_id AS VARCHAR) FROM m WHERE problem_id >= 1000 UNION ALL SELECT 'problems', 'all', '1000', CAST(count(*) AS VARCHAR) FROM m HAVING count(*) <> 1000"""
)
def dq_whole_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of some problems is forged."""
    pool = candidates(spark, sf_dir)
    said = select.majority_readout(pool).join(pool.groupBy("problem_id").agg(F.count(F.lit(1)).alias("num_candidates"), F.bool_or("correct").alias("oracle")), "problem_id")
    forged = lambda k: F.col("problem_id") % 50 == k
    problems = said.select(
        "problem_id",
        F.when(forged(1), 43).otherwise(42).alias("base_seed"),
        "num_candidates",
        F.array(F.lit(1), F.lit(2), F.lit(3)).alias("prompt_ids"),
        F.when(forged(2), 4).otherwise(3).alias("prompt_length"),
        "selected_answer",
        (F.col("selected_sample_id") + forged(3).cast("int")).alias("selected_sample_id"),
        (F.col("oracle") != forged(4)).alias("oracle"),
    )
    return gates.whole_pool(problems, pool, 42, 4, 1000)


@query(
    """WITH d AS (SELECT o_orderkey + CASE WHEN o_orderkey % 100 = 3 THEN 100000000 ELSE 0 END AS k, CASE WHEN o_orderkey % 100 = 4 THEN 43 ELSE 42 END AS seed, CASE WHEN o_orderkey % 100 = 5 THEN 2 ELSE 1 END AS times FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 100 IN (3, 5))
SELECT 'assigned' AS "check", CAST(k AS VARCHAR) AS key, 'assigned' AS expected, 'other' AS actual FROM d WHERE k >= 100000000 UNION ALL SELECT 'repeated', CAST(k AS VARCHAR), '1', '2' FROM d WHERE times = 2 UNION ALL SELECT 'identity seed', CAST(k AS VARCHAR), '42', 'other' FROM d WHERE seed = 43"""
)
def dq_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard that is half done, with ids of another shard, repeated rows and rows of another seed."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("problem_id"))
    hundred = F.col("problem_id") % 100
    done = ids.where((F.col("problem_id") % 2 == 0) | hundred.isin(3, 5)).withColumn("times", F.when(hundred == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    done = done.select((F.col("problem_id") + F.when(hundred == 3, 100000000).otherwise(0)).alias("problem_id"), F.when(hundred == 4, 43).otherwise(42).alias("seed"), F.lit("t").alias("task"), F.explode("times").alias("time"))
    return gates.resumable(ids, done, ["seed", "task"], {"seed": 42, "task": "t"})


@query(
    f"""WITH {CANDIDATES}, r AS (SELECT problem_id, CASE WHEN problem_id % 100 = 1 AND sample_id = 0 THEN -1 WHEN problem_id % 100 = 2 THEN problem_id + 1 ELSE problem_id END AS ordinal, sample_id FROM c),
p AS (SELECT problem_id, ordinal, count(*) AS c, count(DISTINCT sample_id) AS d, min(sample_id) AS lo, max(sample_id) AS hi FROM r GROUP BY 1, 2),
m AS (SELECT *, count(*) OVER (PARTITION BY problem_id) AS p, count(*) OVER (PARTITION BY ordinal) AS o FROM p)
SELECT 'ordinal' AS "check", CAST(problem_id AS VARCHAR) AS key, '0..999' AS expected, CAST(ordinal AS VARCHAR) AS actual FROM m WHERE ordinal < 0 OR ordinal >= 1000 UNION ALL SELECT 'one ordinal', CAST(problem_id AS VARCHAR), '1', CAST(p AS VARCHAR) FROM m WHERE p > 1
UNION ALL SELECT 'one problem', CAST(problem_id AS VARCHAR), '1', CAST(o AS VARCHAR) FROM m WHERE o > 1 UNION ALL SELECT 'samples', CAST(problem_id AS VARCHAR), '4', CAST(c AS VARCHAR) FROM m WHERE c <> 4 OR d <> 4 OR lo <> 0 OR hi <> 3
UNION ALL SELECT 'problems', 'all', '1000', CAST(count(DISTINCT problem_id) AS VARCHAR) FROM m HAVING count(DISTINCT problem_id) <> 1000"""
)
def dq_formal_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals that are negative, out of range, shared or several of a problem."""
    id_, hundred = F.col("problem_id"), F.col("problem_id") % 100
    ordinal = F.when((hundred == 1) & (F.col("sample_id") == 0), -1).when(hundred == 2, id_ + 1).otherwise(id_)
    return gates.formal_set(candidates(spark, sf_dir).select("problem_id", ordinal.alias("ordinal"), "sample_id"), 1000, 4)


@query(f"WITH {CANDIDATES} SELECT 'summary' AS \"check\", 'num_correct' AS key, CAST(count(*) FILTER (correct) AS VARCHAR) AS expected, CAST(count(*) FILTER (correct) + 1 AS VARCHAR) AS actual FROM c")
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared summary with one number forged."""
    again = summary.merge_stats(candidates(spark, sf_dir))
    return gates.reproduced(again.withColumn("num_correct", F.col("num_correct") + 1), again)


@query(
    f"""WITH {CANDIDATES}, d AS (SELECT problem_id || '/' || sample_id AS key, CASE WHEN quantity = 3 THEN 2 ELSE 1 END AS calls FROM c) SELECT 'calls' AS "check", key, '1' AS expected, '2' AS actual FROM d WHERE calls = 2"""
)
def dq_score_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = candidates(spark, sf_dir)
    return gates.score_vector(pool, pool.select("problem_id", "sample_id", F.col("prm_score").alias("score"), F.when(F.col("quantity") == 3, 2).otherwise(1).alias("calls")), "calls")


@query(
    """WITH i AS (SELECT DISTINCT l_suppkey % 16 AS shard, '{"seed":' || CASE WHEN l_suppkey % 16 = 5 THEN 43 ELSE 42 END || ',"task":"t"}' AS identity FROM lineitem)
SELECT 'identity' AS "check", CAST(shard AS VARCHAR) AS key, '{"seed":42,"task":"t"}' AS expected, identity AS actual FROM i WHERE identity <> '{"seed":42,"task":"t"}'"""
)
def dq_pool_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("shard"), F.when(F.col("l_suppkey") % 16 == 5, 43).otherwise(42).alias("seed"), F.lit("t").alias("task"))
    return gates.same_identity(rows, ["seed", "task"], "shard")


@query(
    f"""WITH {SNAPSHOTS}, t AS (SELECT trajectory_id, list(step ORDER BY step) AS steps, list(mask_ratio ORDER BY step) AS ratios, count(*) AS n FROM s GROUP BY trajectory_id),
d AS (SELECT *, CAST(CAST(('0x' || substr(sha256('[42,' || trajectory_id || ',0,"trajectory"]'), 1, 16)) AS UBIGINT) & 9223372036854775807::UBIGINT AS BIGINT) AS seed, sha256('[' || trajectory_id || ',7]') AS sha FROM t)
SELECT 'steps' AS "check", trajectory_id || '/0' AS key, '64' AS expected, CAST(n AS VARCHAR) AS actual FROM t WHERE steps <> range(0, 64) UNION ALL SELECT 'ratios', trajectory_id || '/0', '64', CAST(n AS VARCHAR) FROM t WHERE n <> 64
UNION ALL SELECT 'label', trajectory_id || '/0', 'true', 'false' FROM t WHERE trajectory_id % 10 = 3
UNION ALL SELECT 'seed', trajectory_id || '/0', CAST(seed AS VARCHAR), CAST(seed - 1 AS VARCHAR) FROM d WHERE trajectory_id % 10 = 4
UNION ALL SELECT 'calls', trajectory_id || '/0', '64', '63' FROM t WHERE trajectory_id % 10 = 5
UNION ALL SELECT 'prompt', trajectory_id || '/0', sha, sha256('[7]') FROM d WHERE trajectory_id % 10 = 6
UNION ALL SELECT 'trajectory', trajectory_id || '/0', '0..0', '0' FROM t WHERE false"""
)
def dq_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole trajectories against a schedule of 64 steps, which few of them have; labels, seeds, calls and prompt hashes of some are forged."""
    rows = snapshots(spark, sf_dir).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step", "mask_ratio"))).alias("s"))
    rows = rows.select(F.col("trajectory_id").alias("problem_id"), F.lit(0).alias("trajectory_id"), F.transform("s", lambda x: x["step"]).alias("snapshot_steps"), F.transform("s", lambda x: x["mask_ratio"]).alias("mask_ratios"), F.array_repeat(F.lit(1), 4).alias("generated_token_ids"), F.lit(True).alias("graded"))
    forged = lambda k: F.col("problem_id") % 10 == k
    rows = rows.withColumns({"_b": F.lit(42), "_s": F.lit("trajectory"), "prompt_ids": F.array(F.col("problem_id").cast("bigint"), F.lit(7).cast("bigint")), "is_correct": ~forged(3)})
    seed = resample.derive_seed("_b", "problem_id", "trajectory_id", "_s")
    told = F.when(forged(6), F.sha2(F.lit("[7]"), 256)).otherwise(gates.token_hash("prompt_ids"))
    rows = rows.withColumns({"seed": seed - forged(4).cast("int"), "calls": F.lit(64) - forged(5).cast("int"), "prompt_sha256": told})
    return gates.trajectory(rows, list(range(64)), 4, base_seed=42, samples=1, steps=64, prompts=True)


@query(f"WITH {CANDIDATES} SELECT 'weight' AS \"check\", CAST(problem_id AS VARCHAR) AS key, 'finite, >= 0' AS expected, CAST(quantity - 2 AS VARCHAR) AS actual FROM c WHERE quantity < 2 UNION ALL SELECT 'sum', CAST(problem_id AS VARCHAR), '> 0', CAST(sum(quantity - 2) AS VARCHAR) FROM c GROUP BY problem_id HAVING sum(quantity - 2) <= 0")
def dq_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.weights(candidates(spark, sf_dir).withColumn("w", F.col("quantity") - 2), "w")


@query(f"WITH {CANDIDATES}, p AS (SELECT problem_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS calls FROM c GROUP BY 1) SELECT 'logical' AS \"check\", CAST(problem_id AS VARCHAR) AS key, CAST(n * 25 AS VARCHAR) AS expected, CAST(calls AS VARCHAR) AS actual FROM p WHERE calls <> n * 25")
def dq_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = candidates(spark, sf_dir).groupBy("problem_id").agg(F.count(F.lit(1)).alias("num_candidates"), F.sum("quantity").cast("bigint").alias("logical")).withColumn("physical", F.lit(25))
    return gates.conserved_calls(per, 25)


@query("WITH s AS (SELECT DISTINCT s_nationkey AS shard FROM supplier WHERE s_nationkey <> 7) SELECT 'shards' AS \"check\", 'all' AS key, '25' AS expected, CAST(count(*) AS VARCHAR) AS actual FROM s HAVING count(*) <> 25 UNION ALL SELECT 'complete', 'all', '0', CAST(count(*) FILTER (shard = 3) AS VARCHAR) FROM s HAVING count(*) FILTER (shard = 3) > 0")
def dq_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").where("s_nationkey <> 7").select(F.col("s_nationkey").alias("shard")).distinct()
    return gates.contiguous_shards(rows.withColumns({"n": F.lit(25), "complete": F.col("shard") != 3}), "shard", "n", "complete")


@query(
    f"""WITH {CANDIDATES}, k AS (SELECT *, problem_id % 16 AS shard FROM c), m AS (SELECT unnest([3, 11]) AS shard)
SELECT shard, count(*) AS n, count(*) FILTER (correct) AS n_correct, '3,11' AS lacking FROM k WHERE shard NOT IN (3, 11) GROUP BY 1"""
)
def merged_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of which one is absent and one not complete: the others pass their gates as one pool, and the two are named."""
    pool = candidates(spark, sf_dir).withColumn("shard", F.col("problem_id") % 16).where("shard <> 3")
    shards = pool.select("shard").distinct().withColumns({"num_shards": F.lit(16), "complete": F.col("shard") != 11, "seed": F.lit(42)})
    rows, lacking = gates.merged_pool(pool, shards, ["problem_id", "sample_id"], ["seed"], missing="skip")
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct")).withColumn("lacking", F.lit(",".join(map(str, lacking))))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 100 AS h, CASE WHEN o_orderkey % 10 = 0 THEN 'validation' ELSE 'fit' END AS side FROM orders)
SELECT 'missing' AS "check", CAST(o_orderkey AS VARCHAR) AS key, side AS expected, NULL AS actual FROM o WHERE h = 1 UNION ALL SELECT 'unknown', CAST(-o_orderkey AS VARCHAR), NULL, side FROM o WHERE h = 2
UNION ALL SELECT 'side', CAST(o_orderkey AS VARCHAR), side, 'validation' FROM o WHERE h = 3 UNION ALL SELECT 'repeated', CAST(o_orderkey AS VARCHAR), '1', '2' FROM o WHERE h = 4"""
)
def dq_frozen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split against the frozen one: some ids missing, unknown, on the other side, or twice there."""
    hundred = F.col("o_orderkey") % 100
    frozen = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "validation").otherwise("fit").alias("split"))
    mine = frozen.where(hundred != 1).withColumn("split", F.when(hundred == 3, "validation").otherwise(F.col("split")))
    mine = mine.union(mine.where(hundred == 4)).union(mine.where(hundred == 2).withColumn("o_orderkey", -F.col("o_orderkey")))
    return gates.frozen_split(mine, frozen, "o_orderkey")


@query(
    """WITH r AS (SELECT CASE WHEN c_custkey % 50 = 6 THEN -c_custkey - 1 ELSE c_custkey END AS id, c_nationkey AS place, sha256(c_name) AS sha, c_mktsegment AS gold, c_custkey % 50 AS f FROM customer)
SELECT 'source' AS "check", CAST(id AS VARCHAR) AS key, 'known' AS expected, 'unknown' AS actual FROM r WHERE f = 6 UNION ALL SELECT 'problem_ordinal', CAST(id AS VARCHAR), CAST(place AS VARCHAR), CAST(place + 1 AS VARCHAR) FROM r WHERE f = 3
UNION ALL SELECT 'problem_sha256', CAST(id AS VARCHAR), sha, sha256('') FROM r WHERE f = 4 UNION ALL SELECT 'answer_target', CAST(id AS VARCHAR), gold, NULL FROM r WHERE f IN (4, 5)"""
)
def dq_source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as examples, and rows of them with a fault of each kind."""
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("problem_id"), F.col("c_nationkey").alias("ordinal"), F.sha2("c_name", 256).alias("sha"), F.col("c_mktsegment").alias("gold_answer"))
    fault, sound = F.col("problem_id") % 50, lambda *f: ~(F.col("problem_id") % 50).isin(*f)
    rows = source.select(
        F.when(fault == 6, -F.col("problem_id") - 1).otherwise(F.col("problem_id")).alias("problem_id"),
        (F.col("ordinal") + (fault == 3).cast("int")).alias("problem_ordinal"),
        F.when(sound(4), F.col("sha")).otherwise(F.sha2(F.lit(""), 256)).alias("problem_sha256"),
        F.when(sound(4, 5), F.col("gold_answer")).alias("answer_target"),
    )
    return gates.source_identity(rows, source, "problem_id", {"problem_ordinal": "ordinal", "problem_sha256": "sha", "answer_target": "gold_answer"})


@query(
    """WITH r AS (SELECT l_suppkey % 16 AS shard, '{"kind":"' || l_returnflag || '","seed":' || 42 + l_suppkey % 4 || ',"shards":16}' AS text FROM lineitem)
SELECT shard, sha256(text) AS identity, count(*) AS n FROM r GROUP BY 1, 2"""
)
def manifest_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of every row's manifest without what may vary (shard and row), by shard."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("shard"), F.col("l_returnflag").alias("kind"), (42 + F.col("l_suppkey") % 4).alias("seed"), F.lit(16).alias("shards"), F.col("l_orderkey").alias("row"))
    return lineage.identity(rows, ["shard", "row"]).groupBy("shard", "identity").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":' || CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"c_name":"' || replace(c_name, '#', chr(92) || '"') || '","c_nationkey":' || c_nationkey || '}') AS sha FROM customer"""
)
def canonical_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON with sorted keys: numbers, texts with quotation marks in them, and nulls."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.regexp_replace("c_name", "#", '"').alias("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_custkey")
    return rows.select("c_custkey", F.sha2(lineage.canonical_struct(rows), 256).alias("sha"))


@query()
def problem_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Mersenne shuffle of all orders as problems, and how much of their candidates is on either side."""
    split = lineage.problem_split(table(spark, sf_dir, "orders"), "o_orderkey", 42)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    both = split.join(lines, F.col("o_orderkey").cast("bigint") == F.col("l_orderkey"), "left")
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("problems"), F.sum("n").alias("candidates"), F.sum(F.col("o_orderkey").cast("bigint")).alias("id_sum"))


@query("SELECT true AS same, count(*) AS n FROM lineitem")
def split_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a problem fall into one fold."""
    folds = lineage.split_by_hash(table(spark, sf_dir, "lineitem"), "l_orderkey", 5).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), (F.min("fold") == F.max("fold")).alias("same"))
    return folds.groupBy("same").agg(F.sum("c").alias("n"))
