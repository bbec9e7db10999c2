"""Summaries of candidate pools: one grouping by problem, one over the problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = "problem_id"


def pool_summary(pool: DataFrame, calls: str) -> DataFrame:
    """Thirteen measures of a pool; the invalid rate is the mean of the problems' rates, not a pooled ratio."""
    per = pool.groupBy(P).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"), F.count_if(F.col("answer").isNull()).alias("inv"), F.count_distinct("answer").alias("u"), F.bool_or("correct").alias("ok"), F.sum(calls).alias("calls"))
    return per.agg(
        F.count(F.lit(1)).alias("num_problems"),
        F.sum("n").alias("num_candidates"),
        F.sum("k").alias("num_correct"),
        (F.sum("k") / F.sum("n")).alias("mean_candidate_accuracy"),
        F.count_if("ok").alias("oracle_correct"),
        F.count_if(F.col("k") * 2 > F.col("n")).alias("strict_correct"),
        F.sum("inv").alias("num_invalid"),
        F.round(F.avg(F.col("inv") / F.col("n")), 6).alias("mean_invalid_rate"),
        F.round(F.avg("u"), 6).alias("mean_unique"),
        F.count_if(F.col("u") > 1).alias("num_diverse"),
        F.min("n").alias("min_candidates"),
        F.max("n").alias("max_candidates"),
        F.sum("calls").cast("bigint").alias("total_calls"),
    )


def bits(value: str, counted: Column) -> Column:
    """Aggregate: -sum p log2 p of the shares of `value` in rows that count, as log2 N - sum v log2 v / N; 0 without any."""
    v = F.when(counted, F.col(value))
    return F.greatest(F.coalesce(F.log2(F.sum(v)) - F.sum(v * F.log2(v)) / F.sum(v), F.lit(0.0)), F.lit(0.0)) + 0.0


def _entropies() -> list[Column]:
    """Of rows by answer with k and w: bits of the valid answers' shares and of all, where invalid is a class; by count and by weight."""
    valid, every = F.col("answer").isNotNull(), F.lit(True)
    named = {"entropy_bits": ("k", valid), "weighted_entropy_bits": ("w", valid), "raw_entropy_bits": ("k", every), "raw_weighted_entropy_bits": ("w", every)}
    return [bits(v, c).alias(n) for n, (v, c) in named.items()]


def entropy(pool: DataFrame, weight: str) -> DataFrame:
    """problem_id and four entropies of its answers, see `_entropies`."""
    each = pool.groupBy(P, "answer").agg(F.count(F.lit(1)).alias("k"), F.sum(weight).alias("w"))
    return each.groupBy(P).agg(*_entropies())


def method_rows(pool: DataFrame, scorers: dict[str, str], steps: int, batch: int, seconds: str) -> DataFrame:
    """A row per problem and method: majority, oracle and the scorers; correct, calls, forwards, seconds, invalid answers.

    Every method needs the candidates' denoising calls; a scorer adds a call per candidate, in batches. One
    grouping by answer and one by problem.
    """
    top = [F.max(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.struct(F.col(c), -F.col("sample_id"), "correct"))).alias(m) for m, c in scorers.items()]
    each = pool.groupBy(P, "answer").agg(F.count(F.lit(1)).alias("k"), F.min("sample_id").alias("first"), F.bool_or("correct").alias("any"), F.first("gold").alias("gold"), F.sum(seconds).alias("seconds"), *top)
    valid = F.col("answer").isNotNull()
    best = F.max_by(F.col("answer") == F.col("gold"), F.when(valid, F.struct("k", -F.col("first"))))
    per = each.groupBy(P).agg(best.alias("majority"), F.bool_or("any").alias("oracle"), F.sum("k").alias("n"), F.coalesce(F.sum(F.when(~valid, F.col("k"))), F.lit(0)).alias("num_invalid"), F.sum("seconds").alias("seconds"), *[F.max(m)["correct"].alias(m) for m in scorers])

    def row(method: str) -> Column:
        scored = method in scorers
        return F.struct(
            F.lit(method).alias("method"),
            F.coalesce(method, F.lit(False)).alias("correct"),
            (F.col("n") * steps).alias("logical_denoising"),
            (F.col("n") if scored else F.lit(0).cast("bigint")).alias("logical_scorer"),
            (F.ceil(F.col("n") / batch) if scored else F.lit(0).cast("bigint")).alias("forwards"),
            (F.col("seconds") if scored else F.lit(0.0)).cast("double").alias("seconds"),
        )

    methods = F.array(*[row(m) for m in ("majority", "oracle", *scorers)])
    return per.select(P, "num_invalid", (F.col("num_invalid") / F.col("n")).alias("invalid_rate"), F.inline(methods))


def method_summary(rows: DataFrame) -> DataFrame:
    """Per method of `method_rows`: accuracy, totals of calls, forwards and seconds, invalid answers."""
    return rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("num_problems"),
        F.count_if("correct").alias("num_correct"),
        (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"),
        F.sum("logical_denoising").alias("logical_denoising"),
        F.sum("logical_scorer").alias("logical_scorer"),
        F.sum(F.col("logical_denoising") + F.col("logical_scorer")).alias("logical_total"),
        F.sum("forwards").alias("physical_scorer_forwards"),
        F.sum("seconds").alias("scorer_seconds"),
        F.sum("num_invalid").alias("total_invalid"),
        F.avg("invalid_rate").alias("mean_invalid_rate"),
    )


def particle_records(pool: DataFrame, weight: str, score: str, ancestor: str, seconds: str, steps: int, least: float = 0.5) -> DataFrame:
    """A row per problem of weighted particles: readouts, diversity, effective size, lineages, calls.

    The weighted readout is the heaviest valid answer, the top particle that of the highest score; without a valid answer the
    weighted readout falls back and is wrong. Resampling is triggered where the effective size is under `least` of the
    particles. One grouping by answer and one by problem; a problem's ancestors are a bounded list.
    """
    each = pool.groupBy(P, "answer").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(weight).alias("w"),
        F.sum(F.col(weight) * F.col(weight)).alias("w2"),
        F.min("sample_id").alias("first"),
        F.bool_or("correct").alias("any"),
        F.first("gold").alias("gold"),
        F.max(F.struct(F.col(score), (-F.col("sample_id")).alias("s"), "correct")).alias("top"),
        F.collect_set(ancestor).alias("ancestors"),
        F.collect_set(F.when(F.col("answer").isNotNull(), F.col(ancestor))).alias("final"),
        F.sum(seconds).alias("seconds"),
    )
    valid = F.col("answer").isNotNull()
    best = F.max_by(F.col("answer") == F.col("gold"), F.when(valid, F.struct(F.round("w", 9), -F.col("first"))))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("bigint")
    out = each.groupBy(P).agg(
        F.coalesce(best, F.lit(False)).alias("weighted_correct"),
        F.max("top")["correct"].alias("top_correct"),
        F.bool_or("any").alias("oracle"),
        F.count(F.when(valid, 1)).alias("unique_answers"),
        *_entropies(),
        F.sum("k").alias("n"),
        F.coalesce(F.sum(F.when(~valid, F.col("k"))), F.lit(0)).alias("num_invalid"),
        (F.coalesce(F.sum(F.when(~valid, F.col("w"))), F.lit(0.0)) / F.sum("w")).alias("invalid_mass"),
        (F.sum("w") * F.sum("w") / F.sum("w2")).alias("ess"),
        distinct("ancestors").alias("unique_ancestors"),
        distinct("final").alias("final_lineages"),
        F.sum("seconds").alias("seconds"),
    )
    calls = {"logical_denoising": F.col("n") * steps, "logical_scoring": 2 * F.col("n"), "logical_total": F.col("n") * (steps + 2), "physical_denoising": F.lit(steps).cast("bigint"), "physical_scoring": F.lit(2).cast("bigint")}
    return out.withColumns({"fallback_used": F.col("num_invalid") == F.col("n"), "triggered": F.col("ess") < least * F.col("n"), **calls})


_CALLS = ("logical_denoising", "logical_scoring", "logical_total", "physical_denoising", "physical_scoring")


def _means(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: num_problems, means of the columns, totals of the calls."""
    return records.agg(F.count(F.lit(1)).alias("num_problems"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(n) for n, c in columns.items()], *[F.sum(c).alias(f"total_{c}") for c in _CALLS])


def particle_summary(records: DataFrame) -> DataFrame:
    """The seventeen measures of weighted particles over the problems of `particle_records`."""
    names = {"weighted_accuracy": "weighted_correct", "top_accuracy": "top_correct", "oracle_accuracy": "oracle", "fallback_rate": "fallback_used", "trigger_rate": "triggered"}
    same = ("unique_answers", "entropy_bits", "weighted_entropy_bits", "raw_entropy_bits", "raw_weighted_entropy_bits", "num_invalid", "invalid_mass", "ess", "unique_ancestors", "final_lineages", "seconds")
    return _means(records, names | {f"mean_{c}": c for c in same})


def top_m_summary(records: DataFrame) -> DataFrame:
    """The seven measures of top-M guidance over the problems of `particle_records`."""
    return _means(records, {"accuracy": "top_correct", "oracle_accuracy": "oracle", "mean_unique_answers": "unique_answers", "mean_num_invalid": "num_invalid", "mean_seconds": "seconds"})


def diversity(pool: DataFrame) -> DataFrame:
    """Share of problems with several valid answers, mean and population deviation of their number."""
    per = pool.groupBy(P).agg(F.count_distinct("answer").alias("u"))
    return per.agg(F.count(F.lit(1)).alias("num_problems"), (F.count_if(F.col("u") > 1) / F.count(F.lit(1))).alias("diverse_share"), F.round(F.avg("u"), 6).alias("mean_unique"), F.round(F.stddev_pop("u"), 6).alias("std_unique"))


def invalid_stats(pool: DataFrame, weight: str) -> DataFrame:
    bad = F.col("answer").isNull()
    return pool.groupBy(P).agg(
        F.count_if(bad).alias("num_invalid"),
        (F.count_if(bad) / F.count(F.lit(1))).alias("invalid_rate"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad, F.col("sample_id")))), lambda x: x.cast("string")), ",").alias("invalid_ids"),
        F.coalesce(F.sum(F.when(bad, F.col(weight))), F.lit(0.0)).alias("invalid_mass"),
    )


def counter_totals(rows: DataFrame, counters: str) -> DataFrame:
    """Sums of nested counters by key."""
    return rows.select(F.explode(counters).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("total"))


def merge_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("num_trajectories"), F.count_if("correct").alias("num_correct"), F.count_distinct(P).alias("num_problems"), (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"))


def at_least(pool: DataFrame, n: int) -> DataFrame:
    """Problems with n candidates or more."""
    return pool.groupBy(P).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n).select(P)


def exact_sets(pool: DataFrame, n: int) -> DataFrame:
    """Problems whose distinct sample ids are exactly 0 to n - 1."""
    return pool.groupBy(P).agg(F.count_distinct("sample_id").alias("d"), F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi")).where(f"d = {n} AND lo = 0 AND hi = {n - 1}").select(P)
