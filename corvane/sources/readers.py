"""Readers of shards, score files, state records and problem sets. Only Spark's readers touch a path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.gates import GateError, require
from corvane.operators.order import numbered

#: Rows of score shards: {"items": [{"meta": {...}, "score": x}]} and {"results": [{...}]}.
ITEM = "items array<struct<meta: struct<problem_id: bigint, trajectory_id: bigint, seed: bigint, is_correct: boolean, answer: string>, score: double>>"
RESULT = "results array<struct<pid: bigint, tid: bigint, step: int, mr: double, score: double, final_correct: boolean>>"
#: State records of one JSON line each.
STATE = "state_id string, problem_id string, `group` string, input_ids array<int>, prompt_len int, mask_ratio double, mask_bucket int, binary_label double, fractional_label double, continuation_outcomes array<double>"


def _strict_json(spark: SparkSession, path: str | Sequence[str], schema: str, lines: bool) -> DataFrame:
    """JSON with a given schema, where a bad file or line is an error, never a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(not lines).lower()).json(path if isinstance(path, str) else list(path))


def item_scores(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """pid, tid, seed, is_correct, answer, score and the file of every item of the shards under a path or glob."""
    rows = _strict_json(spark, path, ITEM, False).select(F.col("_metadata.file_name").alias("file"), F.posexplode("items").alias("pos", "i"))
    return rows.select(F.col("i.meta.problem_id").alias("pid"), F.col("i.meta.trajectory_id").alias("tid"), "i.meta.seed", "i.meta.is_correct", F.nullif(F.col("i.meta.answer"), F.lit("None")).alias("answer"), "i.score", "file", "pos")


def result_scores(spark: SparkSession, path: str | Sequence[str], ratio: float | None = None) -> DataFrame:
    """Snapshot scores; with `ratio`, only those at exactly that mask ratio (0.0: the terminal state)."""
    rows = _strict_json(spark, path, RESULT, False).select(F.col("_metadata.file_name").alias("file"), F.posexplode("results").alias("pos", "r")).select("r.*", "file", "pos")
    return rows if ratio is None else rows.where(F.col("mr") == ratio)


def state_records(spark: SparkSession, path: str) -> DataFrame:
    """State records by line; blank lines are skipped."""
    return _strict_json(spark, path, STATE, True)


def shard_files(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Parquet shards of a folder without partial and merged ones, and with `tag` only files that carry it."""
    name = F.col("_metadata.file_name")
    keep = ~name.contains("partial") & ~name.contains("merged")
    rows = spark.read.parquet(path)
    return rows.where(keep & (name.contains(tag) if tag else F.lit(True)))


def with_file_config(rows: DataFrame, config: Sequence[Column]) -> DataFrame:
    """rows with the columns that their file's name tells (see functions.text.file_config on _metadata.file_name)."""
    return rows.select("*", *config)


def gold_of(solution: Column) -> Column:
    """What stands behind the last ####, without commas and white space."""
    return F.regexp_replace(F.trim(F.element_at(F.split(solution, "####"), -1)), ",", "")


def _ordinals(rows: DataFrame, order: str) -> DataFrame:
    """rows with `ordinal`, their place in the order of a number or a text, without a task that sees them all."""
    if isinstance(rows.schema[order].dataType, T.StringType):
        return numbered(rows.withColumn("_one", F.lit(0)), "_one", order).drop("_one", "total")
    return numbered(rows, order).drop("total")


def problems(rows: DataFrame, order: str, question: str = "question", solution: str = "answer") -> DataFrame:
    """global_problem_id (the place in scan order), question, gold_answer and the full solution."""
    return _ordinals(rows, order).select(F.col("ordinal").cast("bigint").alias("global_problem_id"), F.col(question).alias("question"), gold_of(F.col(solution)).alias("gold_answer"), F.col(solution).alias("full_gold_solution"))


def question_list_sha256() -> Column:
    """Aggregate over global_problem_id, problem_sha256 and problem_ordinal: the hash of both as a JSON list, in order; a small record per problem."""
    each = F.collect_list(F.struct("problem_ordinal", F.struct("global_problem_id", "problem_sha256").alias("record")))
    return F.sha2(F.to_json(F.transform(F.array_sort(each), lambda p: p["record"])), 256)


def pinned(rows: DataFrame, order: str, pins: Mapping[str, object], key: str = "unique_id", question: str = "problem", revision: str | None = None) -> DataFrame:
    """A pinned problem set: its rows with global_problem_id, problem_ordinal and problem_sha256, once it is what its pins say.

    pins may hold revision, count, and question_list_sha256 (see `question_list_sha256`). With pins a row without an id is an
    error, without any it gets "test:" and its place; an id that repeats always is one.
    """
    known = _ordinals(rows, order).withColumn("global_problem_id", F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("test:"), F.col("ordinal").cast("string"))))
    known = known.withColumns({"problem_ordinal": F.col("ordinal").cast("bigint"), "problem_sha256": F.sha2(question, 256)}).drop("ordinal")
    if "revision" in pins and revision != pins["revision"]:
        raise GateError("revision", [(pins["revision"], revision)])
    require("repeated ids", duplicates(known, "global_problem_id"))
    seen = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(key), F.lit("")) == "").alias("unnamed")).first()
    if pins and seen["unnamed"]:
        raise GateError("rows without an id", [(seen["unnamed"],)])
    if "count" in pins and seen["n"] != pins["count"]:
        raise GateError("count", [(pins["count"], seen["n"])])
    if "question_list_sha256" in pins:
        found = known.agg(question_list_sha256().alias("h")).first()["h"]
        if found != pins["question_list_sha256"]:
            raise GateError("question list", [(pins["question_list_sha256"], found)])
    return known


def union_of_configs(parts: dict[str, DataFrame], order: str, overrides: dict[str, str], gold: Column, counts: dict[str, int] | None = None) -> DataFrame:
    """All configurations with ids config:train:row and a global ordinal; overrides replace the gold answer.

    With `counts`, a configuration of another size is an error. All sizes come from one pass over the union; a row's
    global ordinal is its place behind the rows of the configurations before.
    """
    names = sorted(parts)
    ranked = {n: _ordinals(parts[n], order).withColumn("source_config", F.lit(n)) for n in names}
    every = reduce(DataFrame.unionByName, ranked.values())
    sizes = {r["source_config"]: r["n"] for r in every.groupBy("source_config").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and (wrong := [(n, sizes.get(n, 0), counts.get(n)) for n in names if sizes.get(n, 0) != counts.get(n)]):
        raise ValueError(f"{wrong[0][0]}: {wrong[0][1]} rows, not {wrong[0][2]}")
    starts = dict(zip(names, accumulate([0, *[sizes.get(n, 0) for n in names]]), strict=False))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("source_config"))
    key = F.concat_ws(":", "source_config", F.lit("train"), F.col("ordinal").cast("string"))
    out = every.withColumns({"source_row_index": F.col("ordinal").cast("bigint"), "global_problem_id": key, "gold_answer": gold, "problem_ordinal": (start + F.col("ordinal")).cast("bigint")})
    if overrides:
        known = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        out = out.withColumn("gold_answer", F.coalesce(F.try_element_at(known, F.col("global_problem_id")), F.col("gold_answer")))
    return out.drop("ordinal")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def lm_samples(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Samples of evaluation results of any shape, as VARIANT with position, filter and grade."""
    text = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_name").alias("file"), F.parse_json("value").alias("v"))
    samples = F.try_variant_get("v", f"$.samples.{task}", "array<variant>")
    rows = text.select("file", F.posexplode(samples).alias("pos", "s"))
    get = lambda p, t: F.try_variant_get("s", p, t)
    return rows.select("file", "pos", get("$.filter", "string").alias("filter"), F.coalesce(get("$.exact_match", "double") > 0.5, F.lit(False)).alias("is_correct"), F.coalesce(get("$.filtered_resps[0][0]", "string"), get("$.filtered_resps[0]", "string")).alias("filtered"), F.coalesce(get("$.resps[0][0]", "string"), get("$.resps[0]", "string")).alias("response"), get("$.target", "string").alias("target"))


def prefer_flexible(samples: DataFrame) -> DataFrame:
    """Of samples with several filters only the flexible one; one filter alone stays."""
    kinds = samples.agg(F.count_distinct("filter").alias("kinds"))
    return samples.crossJoin(F.broadcast(kinds)).where((F.col("kinds") <= 1) | (F.col("filter") == "flexible-extract")).drop("kinds")  # one row, not a product


def checkpoint_source(names: Sequence[str]) -> str | None:
    """Which of a checkpoint's files is read: the adapter, else the model, else the best state."""
    for wanted in ("adapter", "model", "best.pt"):
        for n in sorted(names):
            if wanted in n:
                return n
    return None


