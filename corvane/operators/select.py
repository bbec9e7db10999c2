"""Selection over candidate pools: first N, oracle, seven majorities, rerank, votes and clusters.

A pool has problem_id, sample_id (0, 1, ...), answer (null: invalid), gold and correct. Ties always go
to the lowest position. All functions are one grouped aggregation after at most one window per problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = "problem_id"


def first_n(pool: DataFrame, n: int) -> DataFrame:
    """The first n candidates of each problem, before any filter on scores."""
    return pool.where(F.col("sample_id") < n)


def budgets(pool: DataFrame, ns: tuple[int, ...]) -> DataFrame:
    """The pool once for each budget n, with its first n candidates: one pass, no join."""
    return pool.withColumn("n", F.explode(F.array(*[F.lit(n) for n in ns]))).where(F.col("sample_id") < F.col("n"))


def oracle(pool: DataFrame, *keys: str) -> DataFrame:
    """Is any candidate correct?"""
    return pool.groupBy(*(keys or (P,))).agg(F.bool_or("correct").alias("is_correct"))


def votes(pool: DataFrame, *keys: str, weight: Column | None = None) -> DataFrame:
    """Per answer (null is one too): count or weight, first position, any correct, and its first member's grade."""
    return pool.groupBy(*(keys or (P,)), "answer").agg(
        F.count(F.lit(1)).alias("votes"),
        F.sum(F.lit(1.0) if weight is None else weight).alias("weight"),
        F.min("sample_id").alias("first"),
        F.bool_or("correct").alias("any_correct"),
        F.min_by("correct", "sample_id").alias("first_correct"),
        F.first("gold").alias("gold"),
    )


def _winner(counted: DataFrame, keys: tuple[str, ...], by: str, *values: Column) -> DataFrame:
    """Of each group of answers the one with the most, then the lowest first position: an aggregate, not a sort."""
    best = F.max_by(F.struct("answer", "votes", "weight", "first", "any_correct", "first_correct", "gold"), F.struct(F.col(by), -F.col("first")))
    return counted.groupBy(*keys).agg(best.alias("w")).select(*keys, "w.*")


def majority_bon(pool: DataFrame, *keys: str) -> DataFrame:
    """Most frequent valid answer; correct if it equals the gold answer."""
    keys = keys or (P,)
    won = _winner(votes(pool, *keys).where("answer IS NOT NULL"), keys, "votes")
    return won.select(*keys, "answer", "votes", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).alias("is_correct"))


def majority_with_null_class(pool: DataFrame, *keys: str) -> DataFrame:
    """Invalid answers vote as one class; correct if any member of the class is."""
    keys = keys or (P,)
    return _winner(votes(pool, *keys), keys, "votes").select(*keys, "answer", "votes", F.col("any_correct").alias("is_correct"))


def majority_strict(pool: DataFrame, *keys: str) -> DataFrame:
    """More than half of the candidates are correct."""
    return pool.groupBy(*(keys or (P,))).agg((F.count_if("correct") * 2 > F.count(F.lit(1))).alias("is_correct"))


def majority_readout(pool: DataFrame, *keys: str) -> DataFrame:
    """The canonical readout: valid answers vote; without any, the lowest candidate is taken and counts as wrong.

    Returns selected_answer, selected_sample_id, is_correct, fallback_used, num_valid, num_invalid,
    invalid_rate, unique_answers and entropy_bits.
    """
    keys = keys or (P,)
    valid = F.col("answer").isNotNull()
    each = votes(pool, *keys)
    best = F.max_by(F.struct("answer", "first"), F.when(valid, F.struct("votes", -F.col("first"))))
    n_valid = F.coalesce(F.sum(F.when(valid, F.col("votes"))), F.lit(0))
    # -sum p log2 p = log2 N - sum v log2 v / N
    entropy = F.coalesce(F.log2(n_valid) - F.sum(F.when(valid, F.col("votes") * F.log2("votes"))) / n_valid, F.lit(0.0))
    out = each.groupBy(*keys).agg(
        best.alias("b"),
        F.min("first").alias("lowest"),
        n_valid.alias("num_valid"),
        F.sum("votes").alias("num_all"),
        F.count(F.when(valid, 1)).alias("unique_answers"),
        F.when(n_valid > 0, F.greatest(entropy, F.lit(0.0))).otherwise(0.0).alias("entropy_bits"),
        F.first("gold").alias("gold"),
    )
    return out.select(
        *keys,
        F.col("b.answer").alias("selected_answer"),
        F.coalesce("b.first", "lowest").alias("selected_sample_id"),
        F.coalesce(F.col("b.answer") == F.col("gold"), F.lit(False)).alias("is_correct"),
        (F.col("num_valid") == 0).alias("fallback_used"),
        "num_valid",
        (F.col("num_all") - F.col("num_valid")).alias("num_invalid"),
        ((F.col("num_all") - F.col("num_valid")) / F.col("num_all")).alias("invalid_rate"),
        "unique_answers",
        "entropy_bits",
    )


def majority_canonical(pool: DataFrame, form: Column, *keys: str) -> DataFrame:
    """Votes by a canonical form; correct if the class's first member is. A problem without any form stays, as wrong."""
    keys = keys or (P,)
    each = votes(pool.withColumn("answer", form), *keys)
    best = F.max_by(F.struct("answer", "first_correct"), F.when(F.col("answer").isNotNull(), F.struct("votes", -F.col("first"))))
    return each.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.answer").alias("answer"), F.coalesce("b.first_correct", F.lit(False)).alias("is_correct"))


def equivalence_classes(pool: DataFrame, tolerance: float) -> DataFrame:
    """Candidates with the lowest sample_id of their class: the closure of |a - b| <= tolerance over numeric answers.

    On a line the closure needs no pairs: sorted values break where a gap is wider than the tolerance.
    Null values are in no class. For any other comparison see `equivalence`.
    """
    valid = pool.withColumn("valid", F.col("value").isNotNull())
    order = Window.partitionBy(P, "valid").orderBy("value", "sample_id")
    broken = F.coalesce((F.col("value") - F.lag("value").over(order) > tolerance).cast("int"), F.lit(0))
    run = valid.withColumn("broken", broken).withColumn("run", F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("class_id", F.when(F.col("valid"), F.min("sample_id").over(Window.partitionBy(P, "valid", "run")))).drop("broken", "run", "valid")


def rerank(pool: DataFrame, score: str, *keys: str) -> DataFrame:
    """The candidate of the highest score; null scores are left out after the first-N cut, NaN never wins."""
    keys = keys or (P,)
    ok = pool.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.max_by(F.struct("sample_id", "answer", "correct", F.col(score).alias("score")), F.struct(F.col(score), -F.col("sample_id")))
    return ok.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.sample_id", "b.answer", "b.score", F.col("b.correct").alias("is_correct"))


def weighted_vote(pool: DataFrame, weight: str, *keys: str) -> DataFrame:
    """The answer of the greatest weight, its share of all and of the valid weight, and the invalid answers' share.

    Without a valid answer the heaviest candidate, ties to the lowest, is the fallback: it has no answer and counts as wrong.
    """
    keys = keys or (P,)
    heaviest = F.max(F.struct(F.col(weight).alias("w"), (-F.col("sample_id")).alias("s")))
    each = pool.groupBy(*keys, "answer").agg(F.sum(weight).alias("weight"), F.min("sample_id").alias("first"), F.first("gold").alias("gold"), heaviest.alias("top"))
    valid = F.col("answer").isNotNull()
    best = F.max_by(F.struct("answer", "weight"), F.when(valid, F.struct(F.round("weight", 9), -F.col("first"))))
    out = each.groupBy(*keys).agg(best.alias("b"), F.sum("weight").alias("total"), F.sum(F.when(valid, F.col("weight"))).alias("valid"), F.first("gold").alias("gold"), F.max("top").alias("top"))
    none = F.col("b").isNull()
    return out.select(
        *keys,
        F.col("b.answer").alias("answer"),
        F.round(F.coalesce("b.weight", "top.w") / F.col("total"), 6).alias("share"),
        F.round(F.col("b.weight") / F.col("valid"), 6).alias("valid_share"),
        F.round(1 - F.coalesce("valid", F.lit(0.0)) / F.col("total"), 6).alias("invalid_mass"),
        F.coalesce(F.col("b.answer") == F.col("gold"), F.lit(False)).alias("is_correct"),
        none.alias("fallback_used"),
        F.when(none, -F.col("top.s")).alias("fallback_sample_id"),
    )


def weighted_outcomes(pool: DataFrame, weights: dict[str, Column], *keys: str) -> DataFrame:
    """keys and one column per weight: is the answer of the greatest weight correct? All from one grouping by answer."""
    keys = keys or (P,)
    sums = [F.round(F.sum(w), 9).alias(name) for name, w in weights.items()]
    each = pool.groupBy(*keys, "answer").agg(F.min("sample_id").alias("first"), F.first("gold").alias("gold"), *sums)
    top = lambda name: F.max_by(F.col("answer") == F.col("gold"), F.when(F.col("answer").isNotNull(), F.struct(F.col(name), -F.col("first"))))
    return each.groupBy(*keys).agg(*[F.coalesce(top(name), F.lit(False)).alias(name) for name in weights])


def outcomes(pool: DataFrame, scores: tuple[str, ...], *keys: str) -> DataFrame:
    """keys, oracle, majority (invalid answers are a class) and one column per score: is the selected candidate correct?

    All methods from one grouping by answer and one above it, so the pool is shuffled and read once.
    """
    keys = keys or (P,)
    top = [F.max(F.when(F.col(s).isNotNull() & ~F.isnan(s), F.struct(F.col(s), -F.col("sample_id"), "correct"))).alias(s) for s in scores]
    each = pool.groupBy(*keys, "answer").agg(F.count(F.lit(1)).alias("votes"), F.min("sample_id").alias("first"), F.bool_or("correct").alias("any_correct"), *top)
    best = F.max_by("any_correct", F.struct("votes", -F.col("first")))
    return each.groupBy(*keys).agg(F.bool_or("any_correct").alias("oracle"), best.alias("majority"), *[F.max(s)["correct"].alias(s) for s in scores])


def clusters(pool: DataFrame) -> DataFrame:
    """Valid answers with their votes, members and rank by first appearance."""
    each = pool.where("answer IS NOT NULL").groupBy(P, "answer").agg(F.count(F.lit(1)).alias("votes"), F.min("sample_id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("sample_id")), lambda x: x.cast("string")), ",").alias("members"))
    return each.withColumn("cluster_id", (F.row_number().over(Window.partitionBy(P).orderBy("first")) - 1).cast("bigint"))


def accuracy(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Problems, correct ones and their share, 0 without problems."""
    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_problems"), F.count_if("is_correct").alias("num_correct")).withColumn("accuracy", F.col("num_correct") / F.greatest("num_problems", F.lit(1)))
