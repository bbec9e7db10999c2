"""Records of problems, selections by id, lookups that must succeed, and comparisons of nested manifests."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.gates import GateError


def analysis_records(pool: DataFrame, scorers: Iterable[str]) -> DataFrame:
    """problem_id, gold, one readout struct (sample_id, answer, correct) per scorer, oracle, and the scores by candidate.

    One grouping by problem: readouts are aggregates, the score map has a problem's candidates.
    """
    names = list(scorers)
    best = [F.max_by(F.struct("sample_id", "answer", "correct"), F.struct(F.col(s), -F.col("sample_id"))).alias(s) for s in names]
    scores = F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample_id", F.struct(*names).alias("scores")))))
    return pool.groupBy("problem_id").agg(F.first("gold").alias("gold"), F.bool_or("correct").alias("oracle"), *best, scores.alias("scores"))


def select_ids(rows: DataFrame, key: str, ids: Iterable | None = None, most: int | None = None) -> DataFrame:
    """rows of the given ids, then the first `most` of them in the order given; unknown, repeated and no ids are errors."""
    wanted = None if ids is None else list(ids)
    if wanted is not None:
        if not wanted or len(set(wanted)) != len(wanted):
            raise ValueError("ids must be given once each")
        wanted = wanted if most is None else wanted[:most]
        found = {r[0] for r in rows.where(F.col(key).isin(wanted)).select(key).distinct().collect()}
        if missing := [x for x in wanted if x not in found]:
            raise GateError("unknown ids", [(x,) for x in missing[:5]])
        return rows.where(F.col(key).isin(wanted))
    return rows if most is None else rows.orderBy(key).limit(most)


def lookup_or_raise(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """rows with the dimension's columns; a key without a row in it is an error, found before the join is used."""
    missing = rows.select(key).distinct().join(dimension, key, "left_anti").take(5)
    if missing:
        raise GateError(f"no {key}", missing)
    return rows.join(dimension, key)


def state_sequences(rows: DataFrame, label: str) -> DataFrame:
    """ids (given, or the prompt and the generated ids), prompt_len and the chosen label, within 0 and 1."""
    ids = F.coalesce("input_ids", F.concat("prompt_ids", "gen_ids"))
    return rows.select("problem_id", "state_id", ids.alias("ids"), F.coalesce("prompt_len", F.size("prompt_ids")).alias("prompt_len"), F.col(label).cast("double").alias("label")).where("label BETWEEN 0 AND 1")


def last_token_place(ids: Column, prompt_len: Column, end: int, mask: int) -> Column:
    """The place of the last id, from prompt_len on and before the first end token there, that is no mask; prompt_len - 1 without one."""
    own = F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))
    at = F.array_position(own, end).cast("int")
    cut = F.when(at > 0, F.slice(own, F.lit(1), at - 1)).otherwise(own)
    places = F.filter(F.transform(cut, lambda x, i: F.when(x != mask, i)), lambda i: i.isNotNull())
    return prompt_len + F.coalesce(F.array_max(places), F.lit(-1))


def subsample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the smallest hashes of (seed, key): a sampling operator, the same at any partitioning."""
    return rows.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def label_balance(rows: DataFrame, label: str, group: str) -> DataFrame:
    """group, n, positives (at least a half) and the mean target."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) >= 0.5).alias("positives"), F.avg(label).alias("mean_target"))


def differences(expected: Mapping, actual: Mapping, at: str = "") -> list[tuple[str, object, object]]:
    """(path, expected, actual) of every leaf in which two nested mappings differ; missing keys count as None."""
    out = []
    for k in sorted({*expected, *actual}, key=str):
        a, b = expected.get(k), actual.get(k)
        if isinstance(a, Mapping) and isinstance(b, Mapping):
            out += differences(a, b, f"{at}{k}.")
        elif a != b or type(a) is not type(b):
            out.append((f"{at}{k}", a, b))
    return out


def artifact_violations(declared: DataFrame, files: DataFrame) -> DataFrame:
    """(path, declared, found): artifacts whose content (binary files with path and content) has another hash, or is missing."""
    found = files.select(F.col("path"), F.sha2("content", 256).alias("found"))
    both = declared.join(found, "path", "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("found"))).select("path", F.col("sha256").alias("declared"), "found")


def version_violations(pins: Mapping[str, str], found: Mapping[str, str | None]) -> list[tuple[str, str, str | None]]:
    return [(k, v, found.get(k)) for k, v in sorted(pins.items()) if found.get(k) != v]
