"""Queries of token arrays and particle operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import arrays, denoise, particles
from corvane.plans.registry import query
from corvane.plans.views import CANDIDATES, SNAPSHOTS, candidates, snapshots
from corvane.session import ship, table

MASK, PAD, END = 49, 48, 47
_SORTED = "list({x} ORDER BY step)"
_TRAJ = f"""{SNAPSHOTS}, t AS (SELECT trajectory_id, {_SORTED.format(x='CAST(event_id % 50 AS INT)')} AS ids, {_SORTED.format(x='mask_ratio')} AS ratios, {_SORTED.format(x='step')} AS steps, {_SORTED.format(x='score')} AS scores FROM s GROUP BY trajectory_id)"""
_STR = "array_to_string({x}, ',')"


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per trajectory: token ids, ratios, steps and scores in order. A user's events are one trajectory."""
    rows = snapshots(spark, sf_dir).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step", (F.col("event_id") % 50).cast("int").alias("id"), "mask_ratio", "score"))).alias("s"))
    part = lambda f: F.transform("s", lambda x: x[f])
    return rows.select("trajectory_id", part("id").alias("ids"), part("mask_ratio").alias("ratios"), part("step").alias("steps"), part("score").alias("scores"))


@query(
    f"""WITH {_TRAJ}, z AS (SELECT trajectory_id, unnest(range(1, least(len(steps) - 1, len(scores)) + 1)) AS i, steps, ratios, scores FROM t)
SELECT trajectory_id, steps[i] AS step, scores[i] AS state, ratios[i] AS mask_ratio FROM z WHERE ratios[i] >= 0.2 AND ratios[i] <= 0.8"""
)
def snapshot_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratios' list is one shorter here: zipping ends with it."""
    rows = trajectories(spark, sf_dir).select("trajectory_id", "steps", "scores", F.slice("ratios", F.lit(1), F.size("ratios") - 1).alias("ratios"))
    return arrays.flatten_snapshots(rows, "steps", "scores", "ratios", 0.2, 0.8)


@query(f"WITH {_TRAJ} SELECT trajectory_id, '1,2,' || ids[-1] AS ids, len(ids) AS n FROM t")
def final_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = arrays.final_sequence(F.array(F.lit(1), F.lit(2)), F.transform("ids", lambda x: F.array(x)))
    return trajectories(spark, sf_dir).select("trajectory_id", arrays.joined(last).alias("ids"), F.size("ids").cast("bigint").alias("n"))


@query(f"WITH {_TRAJ} SELECT trajectory_id, len(list_filter(ids, lambda x: x = {MASK})) / len(ids) AS mask_share FROM t")
def mask_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(spark, sf_dir).select("trajectory_id", arrays.share_of(F.col("ids"), MASK).alias("mask_share"))


@query(f"WITH {_TRAJ} SELECT trajectory_id, {_STR.format(x='list_concat([1, 2], list_reverse(ids))')} AS ids FROM t")
def reverse_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(spark, sf_dir).select("trajectory_id", arrays.joined(arrays.reverse_generated(F.array(F.lit(1), F.lit(2)), F.col("ids"))).alias("ids"))


@query(f"WITH {_TRAJ} SELECT trajectory_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i - 1 >= len(ids) // 2 THEN {MASK} ELSE x END), ',') AS ids FROM t")
def mask_right_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(spark, sf_dir).select("trajectory_id", arrays.joined(arrays.mask_right_half(F.col("ids"), MASK)).alias("ids"))


@query(f"WITH {_TRAJ}, p AS (SELECT trajectory_id, list_transform(ids, lambda x: CASE WHEN x >= 30 THEN {PAD} ELSE x END) AS ids FROM t) SELECT trajectory_id, array_to_string(ids[1:greatest(coalesce(list_max(list_filter(list_transform(ids, lambda x, i: CASE WHEN x <> {PAD} THEN i END), lambda x: x IS NOT NULL)), 1), 1)], ',') AS ids FROM p")
def strip_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir).withColumn("ids", F.transform("ids", lambda x: F.when(x >= 30, PAD).otherwise(x)))
    return rows.select("trajectory_id", arrays.joined(arrays.strip_padding(F.col("ids"), PAD)).alias("ids"))


@query(f"WITH {_TRAJ} SELECT trajectory_id, array_to_string(list_filter(CASE WHEN list_position(ids, {END}) > 0 THEN ids[1:list_position(ids, {END}) - 1] ELSE ids END, lambda x: x <> {MASK}), ',') AS ids FROM t")
def truncate_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(spark, sf_dir).select("trajectory_id", arrays.joined(arrays.until_end(F.col("ids"), END, MASK)).alias("ids"))


@query(
    f"""WITH {_TRAJ}, b AS (SELECT trajectory_id, ids, max(len(ids)) OVER (PARTITION BY trajectory_id % 8) - len(ids) AS more FROM t)
SELECT trajectory_id, array_to_string(list_concat(ids, list_transform(range(0, more), lambda x: {PAD})), ',') AS padded, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(0, more), lambda x: 0)), ',') AS attention FROM b"""
)
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir).withColumn("batch", F.col("trajectory_id") % 8)
    return arrays.padded(rows, "ids", "batch", PAD).select("trajectory_id", arrays.joined(F.col("padded")).alias("padded"), arrays.joined(F.col("attention")).alias("attention"))


@query(
    f"""WITH {_TRAJ}, e AS (SELECT *, list_position(ids[6:], {END}) AS pos FROM t), k AS (SELECT trajectory_id, unnest(range(1, len(ids) + 1)) AS i, ids, scores, CASE WHEN pos > 0 THEN 5 + pos - 1 ELSE len(ids) END AS fin FROM e)
SELECT trajectory_id, round(coalesce(sum(scores[i]) FILTER (i > 5 AND i <= fin AND ids[i] <> {MASK}) / nullif(count(*) FILTER (i > 5 AND i <= fin AND ids[i] <> {MASK}), 0), 0), 6) AS pooled FROM k GROUP BY trajectory_id"""
)
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = arrays.masked_mean(F.col("scores"), F.col("ids"), F.lit(5), END, MASK)
    return trajectories(spark, sf_dir).select("trajectory_id", F.round(pooled, 6).alias("pooled"))


@query(f"WITH {SNAPSHOTS} SELECT trajectory_id, -1 AS step FROM s GROUP BY 1 UNION ALL SELECT trajectory_id, step FROM s WHERE step % 6 = 0 OR step = n - 1")
def capture_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir)
    start = rows.select("trajectory_id").distinct().withColumn("step", F.lit(-1).cast("bigint"))
    return start.unionByName(rows.where((F.col("step") % 6 == 0) | (F.col("step") == F.col("n") - 1)).select("trajectory_id", "step"))


@query(
    "WITH x AS (SELECT event_id, value / 100 * 128.0 AS x FROM events) SELECT event_id, round(sin(x), 6) AS e0, round(sin(x * pow(10000.0, -1.0 / 2)), 6) AS e1, round(sin(x * pow(10000.0, -1.0)), 6) AS e2, round(cos(x), 6) AS e3, round(cos(x * pow(10000.0, -1.0 / 2)), 6) AS e4, round(cos(x * pow(10000.0, -1.0)), 6) AS e5, 0.0::DOUBLE AS e6 FROM x"
)
def sinusoidal_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = arrays.sinusoidal(F.col("value") / 100, 7)
    return table(spark, sf_dir, "events").select("event_id", e.alias("e")).select("event_id", *[F.round(F.col("e")[k], 6).alias(f"e{k}") for k in range(7)])


@query("SELECT a.label, count(*) AS n, round(avg(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(a.embedding[i] AS DOUBLE)))), 6) AS mean_square FROM embeddings a GROUP BY a.label")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(arrays.dot(e, e)), 6).alias("mean_square"))


@query(f"WITH {CANDIDATES} SELECT problem_id, count(*) AS k, round(sum(quantity) * sum(quantity) / sum(quantity * quantity), 6) AS ess FROM c GROUP BY problem_id")
def ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.ess(candidates(spark, sf_dir), "quantity").withColumn("ess", F.round("ess", 6))


_H = "greatest(least(1 / (1 + exp(-(quantity - 25) / 5)), 1 - 1e-6), 1e-6)"


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumn("h", particles.probability((F.col("quantity") - 25) / 5))


@query(
    f"""WITH {CANDIDATES}, g AS (SELECT problem_id, i / 20 AS beta, pow({_H}, i / 20) AS w FROM c, range(0, 21) r(i)), e AS (SELECT problem_id, beta, sum(w) * sum(w) / sum(w * w) AS ess FROM g GROUP BY ALL)
SELECT problem_id, round(max(beta), 2) AS beta, round(max_by(ess, beta), 6) AS ess FROM e WHERE ess + 1e-9 >= 3 GROUP BY problem_id"""
)
def temper_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of fewer than three candidates can't reach the target and are left out."""
    out = particles.tempering(_probabilities(spark, sf_dir), "h", 3.0 - 1e-9)
    return out.select("problem_id", F.round("beta", 2).alias("beta"), F.round("ess", 6).alias("ess"))


@query(
    f"""WITH {CANDIDATES}, w AS (SELECT problem_id, sample_id, count(*) OVER p AS k, sum(quantity) OVER (PARTITION BY problem_id ORDER BY sample_id ROWS UNBOUNDED PRECEDING) / sum(quantity) OVER p AS hi, row_number() OVER (PARTITION BY problem_id ORDER BY sample_id) AS rn FROM c WINDOW p AS (PARTITION BY problem_id)),
x AS (SELECT problem_id, sample_id, k, CASE WHEN rn = k THEN 1.0 ELSE hi END AS hi, problem_id % 1000 / 1000 AS u FROM w), s AS (SELECT DISTINCT problem_id, k, u, unnest(range(0, k)) AS slot FROM x)
SELECT s.problem_id, CAST(slot AS INT) AS slot, min(sample_id) AS ancestor FROM s JOIN x ON s.problem_id = x.problem_id AND (s.u + slot) / s.k <= x.hi GROUP BY 1, 2"""
)
def systematic_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.systematic_resample(candidates(spark, sf_dir), "quantity", F.col("problem_id") % 1000 / 1000)


@query(
    f"""WITH {CANDIDATES}, l AS (SELECT problem_id, sample_id, ln(1.0 / 8) + ln((prm_score + 0.01) / 2) - 0.5 * ln({_H}) AS l FROM c), m AS (SELECT *, max(l) OVER (PARTITION BY problem_id) AS m FROM l)
SELECT problem_id, sample_id, round(exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY problem_id), 6) AS weight FROM m"""
)
def smc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probabilities(spark, sf_dir).withColumns({"v": F.lit(1.0 / 8), "h2": (F.col("prm_score") + 0.01) / 2})
    return particles.final_weights(rows, "v", "h", "h2", 0.5).select("problem_id", "sample_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {CANDIDATES}, t AS (SELECT problem_id, sample_id, row_number() OVER (PARTITION BY problem_id ORDER BY prm_score DESC, sample_id) - 1 AS place FROM c QUALIFY place < 2) SELECT problem_id, CAST(place * 4 + i AS INT) AS child, sample_id AS parent FROM t, range(0, 4) r(i)")
def topm_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.expanded(particles.top_m(candidates(spark, sf_dir), "prm_score", 2), 8, 2)


@query(
    f"""WITH {CANDIDATES}, r AS (SELECT problem_id, sample_id, orm_score AS score, row_number() OVER (PARTITION BY problem_id ORDER BY prm_score DESC, sample_id) - 1 AS first, row_number() OVER (PARTITION BY problem_id ORDER BY orm_score DESC, sample_id) - 1 AS last, count(*) OVER (PARTITION BY problem_id) AS k FROM c)
SELECT a.problem_id, a.sample_id, b.sample_id AS parent, a.score, a.last < 2 AS retained, a.last = 0 AS selected FROM r a JOIN r b ON a.problem_id = b.problem_id AND b.first = a.sample_id * least(2, a.k) // a.k"""
)
def topm_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.guided_top_m(candidates(spark, sf_dir), "prm_score", "orm_score", 2)


@query(f"WITH {SNAPSHOTS}, g AS (SELECT trajectory_id, step // 16 AS segment, step, score FROM s WHERE step // 16 < n // 16) SELECT trajectory_id, segment, step, score FROM g QUALIFY row_number() OVER (PARTITION BY trajectory_id, segment ORDER BY score DESC, step) = 1")
def branch_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.branch_best(snapshots(spark, sf_dir), "trajectory_id", "step", 16, "score", "step")


@query(f"WITH {SNAPSHOTS} SELECT trajectory_id, step, CASE WHEN step = 127 THEN n ELSE CAST(floor(n * (1 - (1 - (step + 1) * 0.999 / 128) / (1 - step * 0.999 / 128))) AS BIGINT) END AS transferred FROM s WHERE step < 128")
def transfer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule has 128 steps, and the last transfers all that is left: a trajectory's events beyond them lie outside of it."""
    return snapshots(spark, sf_dir).where("step < 128").select("trajectory_id", "step", particles.transfer_count(F.col("n"), F.col("step"), 128).alias("transferred"))


@query(
    f"""WITH {CANDIDATES}, r AS (SELECT problem_id, sample_id, {_H} AS h1, (prm_score + 0.01) / 2 AS h2, count(*) OVER (PARTITION BY problem_id) AS k FROM c QUALIFY k >= 3),
g AS (SELECT problem_id, i / 20 AS beta, pow(h1, i / 20) AS w FROM r, range(0, 21) x(i)), e AS (SELECT problem_id, beta, sum(w) * sum(w) / sum(w * w) AS ess FROM g GROUP BY ALL),
b AS (SELECT problem_id, max(beta) AS beta FROM e WHERE ess + 1e-9 >= 3 GROUP BY problem_id), f AS (SELECT r.*, beta, pow(h1, beta) AS w1 FROM r JOIN b USING (problem_id)),
z AS (SELECT problem_id, sum(w1) * sum(w1) / sum(w1 * w1) < 3.5 AS resampled, sum(w1) AS total FROM f GROUP BY 1),
q AS (SELECT problem_id, sample_id, k, CASE WHEN sample_id = k - 1 THEN 1.0 ELSE sum(w1) OVER (PARTITION BY problem_id ORDER BY sample_id ROWS UNBOUNDED PRECEDING) / sum(w1) OVER (PARTITION BY problem_id) END AS hi FROM f),
s AS (SELECT f.problem_id, f.sample_id, min(q.sample_id) AS a FROM f JOIN q ON f.problem_id = q.problem_id AND (0.37 + f.sample_id) / f.k <= q.hi GROUP BY 1, 2),
j AS (SELECT f.*, resampled, CASE WHEN resampled THEN a ELSE f.sample_id END AS ancestor, CASE WHEN resampled THEN 1 / k ELSE w1 / total END AS v FROM f JOIN z USING (problem_id) JOIN s ON f.problem_id = s.problem_id AND f.sample_id = s.sample_id),
l AS (SELECT j.problem_id, j.sample_id, ancestor, resampled, ln(v) + ln(j.h2) - beta * ln(p.h1) AS l FROM j JOIN r p ON j.problem_id = p.problem_id AND ancestor = p.sample_id)
SELECT problem_id, sample_id, ancestor, resampled, round(exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY problem_id), 6) AS weight FROM (SELECT *, max(l) OVER (PARTITION BY problem_id) AS m FROM l)"""
)
def smc_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempering, conditional resampling and final weights of problems with three candidates or more."""
    rows = _probabilities(spark, sf_dir).withColumn("h2", (F.col("prm_score") + 0.01) / 2)
    enough = rows.groupBy("problem_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 3").select("problem_id")
    rows = rows.join(enough, "problem_id").select("problem_id", "sample_id", "h", "h2")
    out = particles.two_stage(rows, "h", "h2", 3.0 - 1e-9, 3.5, F.lit(0.37))
    return out.select("problem_id", "sample_id", "ancestor", "resampled", F.round("weight", 6).alias("weight"))


@query()
def denoise_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine with a toy kernel, over every trajectory: no SQL, tested by resuming and by reordering."""
    ship(spark)
    ids = F.transform("ids", lambda x: F.when(x % 3 == 0, MASK).otherwise(x))
    states = trajectories(spark, sf_dir).select("trajectory_id", ids.alias("x"), F.lit(0).alias("next_step"), F.crc32(F.col("trajectory_id").cast("string")).alias("seed"))
    return denoise.run(states, 16, MASK, denoise.toy_kernel(MASK)).select("trajectory_id", arrays.joined(F.col("x")).alias("ids"))


@query(f"WITH {CANDIDATES} SELECT problem_id, string_agg('7,8,' || sample_id || ',' || CAST(quantity AS INT), ';' ORDER BY sample_id) AS sequences FROM c GROUP BY problem_id")
def candidate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem's candidates in order, each the prompt and its own ids."""
    pool = candidates(spark, sf_dir).withColumns({"prompt": F.array(F.lit(7), F.lit(8)), "ids": F.array(F.col("sample_id").cast("int"), F.col("quantity").cast("int"))})
    made = arrays.candidate_sequences(pool, "prompt", "ids")
    return made.select("problem_id", F.array_join(F.transform("sequences", arrays.joined), ";").alias("sequences"))
