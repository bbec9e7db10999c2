"""Joins and set operations over pools, scores and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by `order`. An aggregate with map-side combine, where a window would sort."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def with_scores(pool: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every candidate with its score, or null; `scores` must hold a key once (see `last_wins`)."""
    return pool.join(scores, list(keys), "left")


def aligned(left: DataFrame, right: DataFrame, order: Column | str) -> DataFrame:
    """Rows of two lists by their position inside a problem: (problem_id, pos, a, b), null where one list ends."""
    place = Window.partitionBy("problem_id").orderBy(order)
    number = lambda df, name: df.select("problem_id", (F.row_number().over(place) - 1).cast("bigint").alias("pos"), F.col("value").alias(name))
    return number(left, "a").join(number(right, "b"), ["problem_id", "pos"], "full")


def unpaired(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, left, right): how often a key stands on each side, where that differs: paired outcomes need none."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "left").join(count(right, "right"), list(keys), "full")
    return both.select(*keys, F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right")).where(F.col("left") != F.col("right"))


def prefix_violations(prefix: DataFrame, run: dict) -> DataFrame:
    """(problem_id, field): fields of a reused pool that aren't those of the run that extends it; null equals null."""
    one = [F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in run.items()]
    return prefix.select("problem_id", F.explode(F.array_compact(F.array(*one))).alias("field")).distinct()


def remaining(assigned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an interrupted run has still to do: ids, never counts, decide."""
    return assigned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def cover_violations(all_ids: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(violation, id): ids in no part, in several parts, or in a part but not among all."""
    marked = all_ids.select(F.col(key).alias("id")).distinct().withColumn("part", F.lit(""))
    for name, df in parts.items():
        marked = marked.unionByName(df.select(F.col(key).alias("id")).distinct().withColumn("part", F.lit(name)))
    per = marked.groupBy("id").agg(F.bool_or(F.col("part") == "").alias("known"), F.count_if(F.col("part") != "").alias("n"))
    kind = F.when(~F.col("known"), "unknown").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "overlap")
    return per.select(kind.alias("violation"), "id").where("violation IS NOT NULL")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_ids, right_ids) of texts that both sides hold; the ids of a hash are gathered per side first."""
    ids = lambda df, name: df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias(name))
    return ids(left, "left_ids").join(ids(right, "right_ids"), key)


def prefix_extended(pool: DataFrame, n: int) -> DataFrame:
    """(problem_id, sample_id, reused): candidates 0 to n - 1, those that the pool has already marked."""
    wanted = pool.select("problem_id").distinct().select("problem_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("sample_id"))
    have = pool.select("problem_id", "sample_id", F.lit(True).alias("reused"))
    return wanted.join(have, ["problem_id", "sample_id"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def merged_shards(shards: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, copies): rows that the union of the shards holds more than once."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def shard_of(rows: DataFrame, n: int) -> DataFrame:
    """Numbered rows (see `order.numbered`) with their shard: strided, and contiguous by ceiling division."""
    return rows.withColumns({"strided": F.pmod("ordinal", F.lit(n)), "contiguous": F.floor(F.col("ordinal") / F.ceil(F.col("total") / n))})
