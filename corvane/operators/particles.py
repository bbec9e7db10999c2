"""Particle operators over score tables: effective size, tempering, resampling, weights, top-M, branching.

Particles have problem_id and sample_id. Sums over a problem are grouped aggregates; running sums are
windows of one problem's particles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = "problem_id"
GRID = [round(0.05 * k, 2) for k in range(21)]


def ess(rows: DataFrame, weight: str) -> DataFrame:
    """1 / sum w^2 of normalised weights, as (sum w)^2 / sum w^2; null without positive weight."""
    return rows.groupBy(P).agg(F.count(F.lit(1)).alias("k"), F.try_divide(F.sum(weight) * F.sum(weight), F.sum(F.col(weight) * F.col(weight))).alias("ess"))


def probability(logit: Column) -> Column:
    """The logistic function, within [1e-6, 1 - 1e-6]."""
    return F.greatest(F.least(1 / (1 + F.exp(-logit)), F.lit(1 - 1e-6)), F.lit(1e-6))


def tempering(rows: DataFrame, h: str, target: float) -> DataFrame:
    """problem_id, beta, ess: the largest beta of the grid whose weights h^beta keep an effective size of the target.

    The whole grid is one aggregate by problem: no row per particle and beta.
    """

    def size(beta: float) -> Column:
        w = F.pow(F.col(h), F.lit(beta))
        return F.struct(F.lit(beta).alias("beta"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))

    sizes = rows.groupBy(P).agg(F.array(*map(size, GRID)).alias("sizes"))
    best = F.try_element_at(F.filter("sizes", lambda s: s["ess"] + 1e-12 >= target), F.lit(-1))
    return sizes.select(P, best.alias("b")).where("b IS NOT NULL").select(P, "b.beta", "b.ess")


def systematic_resample(rows: DataFrame, weight: str, offset: Column) -> DataFrame:
    """problem_id, slot, ancestor: for each of K evenly spaced positions the first particle whose running share reaches it.

    A particle serves the positions between its own bounds, so slots come from its bounds directly:
    a sequence per particle in place of a range join. The last running share counts as 1.
    """
    order = Window.partitionBy(P).orderBy("sample_id")
    everything = Window.partitionBy(P)
    run = rows.select(
        P,
        "sample_id",
        F.count(F.lit(1)).over(everything).alias("k"),
        (F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(everything)).alias("hi"),
        F.row_number().over(order).alias("rn"),
    )
    run = run.withColumn("hi", F.when(F.col("rn") == F.col("k"), 1.0).otherwise(F.col("hi")))
    run = run.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(-1.0))).withColumn("u", offset)
    # Slots s with lo < (u + s) / K <= hi, tested as they are computed, so rounding can't lose or repeat one.
    slots = F.filter(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")), lambda s: ((F.col("u") + s) / F.col("k") > F.col("lo")) & ((F.col("u") + s) / F.col("k") <= F.col("hi")))
    return run.select(P, F.explode(slots).alias("slot"), F.col("sample_id").alias("ancestor"))


def final_weights(rows: DataFrame, v: str, h1: str, h2: str, beta: float) -> DataFrame:
    """rows with `weight`: softmax over the problem of ln v + ln h2 - beta ln h1."""
    log = F.log(v) + F.log(h2) - beta * F.log(h1)
    everything = Window.partitionBy(P)
    top = rows.withColumn("_l", log).withColumn("_m", F.max("_l").over(everything)).withColumn("_e", F.exp(F.col("_l") - F.col("_m")))
    return top.withColumn("weight", F.col("_e") / F.sum("_e").over(everything)).drop("_l", "_m", "_e")


def non_finite(rows: DataFrame, score: str) -> DataFrame:
    """The rows that forbid a selection: scores that are null, NaN or infinite."""
    return rows.where(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")))


def top_m(rows: DataFrame, score: str, m: int) -> DataFrame:
    """rows of the m best, with `place`; ties to the lowest id. Run `non_finite` first."""
    best = Window.partitionBy(P).orderBy(F.col(score).desc(), "sample_id")
    return rows.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < m)


def expanded(kept: DataFrame, k: int, m: int) -> DataFrame:
    """problem_id, child, parent: child c comes from kept[floor(c / (k / m))]."""
    if k % m:
        raise ValueError("m must divide k")
    first = F.col("place") * (k // m)
    return kept.select(P, F.explode(F.sequence(first, first + (k // m - 1))).alias("child"), F.col("sample_id").alias("parent"))


def guided_top_m(rows: DataFrame, h1: str, h2: str, m: int) -> DataFrame:
    """Both stages of top-M guidance over score tables: problem_id, sample_id, parent, score, retained, selected.

    Particles are numbered 0 to k - 1. The m best by h1 (all of fewer) share the k places of the second stage,
    in order and evenly where m divides k. There h2 scores the particle in each place: the m best are
    retained, the best is selected; ties always go to the lowest id. One shuffle by problem; what a problem
    gathers are its m best. Run `non_finite` on both scores first.
    """
    own = Window.partitionBy(P)
    place = lambda by: F.row_number().over(own.orderBy(F.col(by).desc(), "sample_id")) - 1
    staged = rows.select(P, "sample_id", F.col(h2).alias("score"), place(h1).alias("first"), place(h2).alias("last"), F.count(F.lit(1)).over(own).alias("k"))
    kept = F.sort_array(F.collect_list(F.when(F.col("first") < m, F.struct("first", "sample_id"))).over(own))
    at = F.floor(F.col("sample_id") * F.size("kept") / F.col("k")).cast("int")
    return staged.withColumn("kept", kept).select(P, "sample_id", F.get("kept", at)["sample_id"].alias("parent"), "score", (F.col("last") < m).alias("retained"), (F.col("last") == 0).alias("selected"))


def branch_best(rows: DataFrame, group: str, step: str, every: int, score: str, tie: str) -> DataFrame:
    """group, segment, best step and score: of each full segment of `every` steps; what is left over stays unbranched."""
    full = F.floor(F.count(F.lit(1)).over(Window.partitionBy(group)) / every)
    segment = F.floor(F.col(step) / every)
    inside = rows.withColumns({"segment": segment, "_full": full}).where("segment < _full")
    return inside.groupBy(group, "segment").agg(F.max_by(F.struct(step, score), F.struct(F.col(score), -F.col(tie))).alias("b")).select(group, "segment", f"b.{step}", f"b.{score}")


def transfer_count(masked: Column, step: Column, steps: int, eps: float = 1e-3) -> Column:
    """How many masked places a denoising step fills: int(m (1 - s / t)) on an even grid of times from 1 to eps, all in the last step."""
    time = lambda i: 1 - i * (1 - eps) / steps
    return F.when(step == steps - 1, masked).otherwise(F.floor(masked * (1 - time(step + 1) / time(step))).cast("bigint"))


def weights_of(score: Column, kind: str) -> Column:
    """A vote's weight from a score: raw, sigmoid, or exp (a softmax once votes are normalised)."""
    return {"raw": score, "sigmoid": probability(score), "exp": F.exp(score)}[kind]


def two_stage(rows: DataFrame, h1: str, h2: str, target: float, least: float, offset: Column) -> DataFrame:
    """Both stages of particle guidance over score tables: problem_id, sample_id, ancestor, weight, resampled.

    Stage one tempers h1 to the target and, where the effective size falls under `least`, resamples; slot s
    then continues from its ancestor. The last weight is v h2 / h1(ancestor)^beta, normalised, with v even
    after resampling and the first weight else. One shuffle by problem serves every step.
    """
    beta = tempering(rows, h1, target)
    first = rows.join(beta, P).withColumn("w1", F.pow(F.col(h1), F.col("beta")))
    size = first.groupBy(P).agg((F.sum("w1") * F.sum("w1") / F.sum(F.col("w1") * F.col("w1"))).alias("ess1"), F.sum("w1").alias("total"), F.count(F.lit(1)).alias("k"))
    slots = systematic_resample(first, "w1", offset).select(P, F.col("slot").alias("sample_id"), "ancestor")
    joined = first.join(size, P).join(slots, [P, "sample_id"])
    joined = joined.withColumn("resampled", F.col("ess1") < least).withColumn("ancestor", F.when(F.col("resampled"), F.col("ancestor")).otherwise(F.col("sample_id")))
    joined = joined.withColumn("v", F.when(F.col("resampled"), 1 / F.col("k")).otherwise(F.col("w1") / F.col("total")))
    parent = rows.select(P, F.col("sample_id").alias("ancestor"), F.col(h1).alias("h1_parent"))
    joined = joined.join(parent, [P, "ancestor"])
    log = F.log("v") + F.log(h2) - F.col("beta") * F.log("h1_parent")
    everything = Window.partitionBy(P)
    out = joined.withColumn("_l", log).withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(everything)))
    return out.select(P, "sample_id", "ancestor", (F.col("_e") / F.sum("_e").over(everything)).alias("weight"), "resampled", "beta")
