"""Fail-closed gates: a DataFrame of violations (check, key, expected, actual), and a raise if there are any.

Gates are actions of their own, run before the work that they guard: an assertion inside a plan may be pruned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.resample import derive_seed
from corvane.operators.select import majority_readout


class GateError(ValueError):
    """A gate found violations; `examples` has the first five."""

    def __init__(self, gate: str, examples: list) -> None:
        super().__init__(f"{gate}: {[tuple(e) for e in examples]}")
        self.examples = examples


def require(gate: str, violations: DataFrame) -> None:
    """Raise if there is any violation; only five are fetched."""
    found = violations.take(5)
    if found:
        raise GateError(gate, found)


def _rows(df: DataFrame, check: str, key: Column, expected: Column, actual: Column, bad: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(check).alias("check"), key.cast("string").alias("key"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _found(*checks: tuple[str, Column, Column, Column, Column]) -> Column:
    """Generator of the violations of one row: each check is (name, key, expected, actual, bad); an unknown bad is bad."""
    one = [F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("check"), key.cast("string").alias("key"), want.cast("string").alias("expected"), got.cast("string").alias("actual"))) for name, key, want, got, bad in checks]
    return F.inline(F.array_compact(F.array(*one)))


_ONE = ("problem_id", "sample_id")


def _key(*columns: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in columns])


def candidate_set(pool: DataFrame, n: int, base_seed: int | None = None, tokens: tuple[str, int] | None = None) -> DataFrame:
    """Of each problem: n candidates, ids 0 to n - 1, grades that equal a comparison with gold, derived seeds, and token lists of the given length.

    One pass: counts of a problem are windows over its candidates, and stand at its first row.
    """
    own = Window.partitionBy("problem_id")
    first = F.row_number().over(own.orderBy("sample_id")) == 1
    rows = pool.withColumns({"_c": F.count(F.lit(1)).over(own), "_d": F.size(F.collect_set("sample_id").over(own)), "_lo": F.min("sample_id").over(own), "_hi": F.max("sample_id").over(own), "_first": first})
    key, one = F.col("problem_id"), _key(*_ONE)
    at = lambda bad: F.col("_first") & F.coalesce(bad, F.lit(True))
    should = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    checks = [
        ("count", key, F.lit(n), F.col("_c"), at(F.col("_c") != n)),
        ("ids", key, F.lit(f"0..{n - 1}"), F.concat_ws("..", F.col("_lo").cast("string"), F.col("_hi").cast("string")), at((F.col("_d") != F.col("_c")) | (F.col("_lo") != 0) | (F.col("_hi") != F.col("_c") - 1))),
        ("correct", one, should, F.col("correct"), ~F.col("correct").eqNullSafe(should)),
    ]
    if base_seed is not None:
        rows = rows.withColumns({"_b": F.lit(base_seed), "_s": F.lit("gen")}).withColumn("_want", derive_seed("_b", "problem_id", "sample_id", "_s"))
        checks.append(("seed", one, F.col("_want"), F.col("seed"), F.col("seed") != F.col("_want")))
    if tokens is not None:
        checks.append(("tokens", one, F.lit(tokens[1]), F.size(tokens[0]), F.size(tokens[0]) != tokens[1]))
    return rows.select(_found(*checks))


#: How grading and extraction may end.
GRADES, EXTRACTIONS = ("ok", "timeout", "error"), ("ok", "invalid", "timeout", "error")


def candidate_records(pool: DataFrame) -> DataFrame:
    """Each candidate's grade_status and extraction_status are known ones, correct is grade_correct, answer is extraction_answer."""
    one = _key(*_ONE)
    graded = F.coalesce("grade_correct", F.lit(False))
    return pool.select(_found(
        ("grade status", one, F.lit("/".join(GRADES)), F.col("grade_status"), ~F.col("grade_status").isin(*GRADES)),
        ("extraction status", one, F.lit("/".join(EXTRACTIONS)), F.col("extraction_status"), ~F.col("extraction_status").isin(*EXTRACTIONS)),
        ("correct", one, graded, F.col("correct"), ~F.coalesce("correct", F.lit(False)).eqNullSafe(graded)),
        ("answer", one, F.col("extraction_answer"), F.col("answer"), ~F.col("answer").eqNullSafe(F.col("extraction_answer"))),
    ))


def whole_pool(problems: DataFrame, pool: DataFrame, base_seed: int, n: int, formal: int | None = None) -> DataFrame:
    """What a pool says of its problems against its candidates.

    problems: problem_id, base_seed, num_candidates, prompt_ids, prompt_length, selected_answer, selected_sample_id and
    oracle. Ids are unique, seed and count are the pool's, the prompt is there and of its length, majority and oracle are
    those that the candidates give again. formal: the ids are 0 to formal - 1. For the candidates themselves see
    `candidate_set`, for the envelope `config`.
    """
    again = majority_readout(pool).select("problem_id", F.col("selected_answer").alias("_answer"), F.col("selected_sample_id").alias("_sample"))
    again = again.join(pool.groupBy("problem_id").agg(F.bool_or("correct").alias("_oracle")), "problem_id")
    own = Window.partitionBy("problem_id")
    rows = problems.withColumns({"_n": F.count(F.lit(1)).over(own), "_first": F.row_number().over(own.orderBy("num_candidates")) == 1}).join(again, "problem_id", "left")
    key = F.col("problem_id")
    checks = [
        ("unique", key, F.lit(1), F.col("_n"), F.col("_first") & (F.col("_n") > 1)),
        ("base seed", key, F.lit(base_seed), F.col("base_seed"), F.col("base_seed") != base_seed),
        ("count", key, F.lit(n), F.col("num_candidates"), F.col("num_candidates") != n),
        ("prompt", key, F.size("prompt_ids"), F.col("prompt_length"), (F.size("prompt_ids") <= 0) | (F.size("prompt_ids") != F.col("prompt_length"))),
        ("majority", key, _key("_answer", "_sample"), _key("selected_answer", "selected_sample_id"), ~(F.col("_answer").eqNullSafe(F.col("selected_answer")) & F.col("_sample").eqNullSafe(F.col("selected_sample_id")))),
        ("oracle", key, F.col("_oracle"), F.col("oracle"), F.col("_oracle") != F.col("oracle")),
    ]
    if formal is not None:
        checks.append(("range", key, F.lit(f"0..{formal - 1}"), key, (key < 0) | (key >= formal)))
    out = rows.select(_found(*checks))
    if formal is None:
        return out
    count = problems.agg(F.count_distinct("problem_id").alias("d"))
    return out.unionByName(count.select(_found(("problems", F.lit("all"), F.lit(formal), F.col("d"), F.col("d") != formal))))


def source_identity(rows: DataFrame, source: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Each row is of a source example, and says of it what the example says: `fields` maps rows' columns to the source's.

    The source has a row per key; a null on one side only differs. Violations are keyed by the row's key.
    """
    theirs = source.select(F.col(key).alias("_key"), *[F.col(b).alias(f"_{k}") for k, b in enumerate(fields.values())], F.lit(True).alias("_there"))
    both = rows.select(F.col(key).alias("_own"), *[F.col(a).alias(f"_has_{k}") for k, a in enumerate(fields)]).join(theirs, F.col("_own") == F.col("_key"), "left")
    there = F.coalesce("_there", F.lit(False))
    checks = [("source", F.col("_own"), F.lit("known"), F.lit("unknown"), ~there)]
    for k, name in enumerate(fields):
        checks.append((name, F.col("_own"), F.col(f"_{k}"), F.col(f"_has_{k}"), there & ~F.col(f"_{k}").eqNullSafe(F.col(f"_has_{k}"))))
    return both.select(_found(*checks))


def score_vector(pool: DataFrame, scores: DataFrame, calls: str | None = None) -> DataFrame:
    """Every candidate has one finite score, and every score a candidate; `calls`: a column that must be 1 in each score."""
    keys = list(_ONE)
    one = _key(*keys)
    more = [] if calls is None else [F.min(calls).alias("_calls")]
    per = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.first("score").alias("score"), *more)
    both = pool.select(*keys, F.lit(1).alias("c")).join(per, keys, "full")
    there = F.col("m").isNotNull()
    checks = [
        ("missing", one, F.lit(1), F.coalesce("m", F.lit(0)), F.col("m").isNull()),
        ("unknown", one, F.lit(0), F.col("m"), F.col("c").isNull()),
        ("repeated", one, F.lit(1), F.col("m"), there & (F.col("m") > 1)),
        ("finite", one, F.lit("finite"), F.col("score"), there & F.coalesce(F.isnan("score") | (F.abs("score") == float("inf")), F.lit(True))),
    ]
    if calls is not None:
        checks.append(("calls", one, F.lit(1), F.col("_calls"), there & F.coalesce(F.col("_calls") != 1, F.lit(True))))
    return both.select(_found(*[(n, k, e, a, F.coalesce(bad, F.lit(False))) for n, k, e, a, bad in checks]))


def states(rows: DataFrame, per_problem: int = 10, outcomes: int | None = None, label: str | None = None) -> DataFrame:
    """State ids unique, 0 < ratio < 1, bucket = floor(ratio * 10), fraction = mean of binary outcomes, one state per bucket and problem.

    outcomes: how many a state has; label: a column that is 0 or 1 and the same in all states of a problem. Checks of a row in
    one pass, of a problem in another.
    """
    key = F.col("state_id")
    own = Window.partitionBy("state_id")
    seen = rows.withColumns({"_c": F.count(F.lit(1)).over(own), "_first": F.row_number().over(own.orderBy("mask_ratio")) == 1})
    mean = F.aggregate("outcomes", F.lit(0.0), lambda a, x: a + x) / F.size("outcomes")
    bucket = F.floor(F.col("mask_ratio") * 10)
    checks = [
        ("unique", key, F.lit(1), F.col("_c"), F.col("_first") & (F.col("_c") > 1)),
        ("ratio", key, F.lit("0 < r < 1"), F.col("mask_ratio"), (F.col("mask_ratio") <= 0) | (F.col("mask_ratio") >= 1)),
        ("bucket", key, bucket, F.col("mask_bucket"), bucket != F.col("mask_bucket")),
        ("binary", key, F.lit("0 or 1"), F.lit("other"), F.exists("outcomes", lambda x: ~x.isin(0.0, 1.0))),
        ("fraction", key, F.lit("mean"), F.col("fraction"), F.abs(F.col("fraction") - mean) > 1e-12),
    ]
    if outcomes is not None:
        checks.append(("outcomes", key, F.lit(outcomes), F.size("outcomes"), F.size("outcomes") != outcomes))
    if label is not None:
        checks.append(("label", key, F.lit("0 or 1"), F.col(label), ~F.col(label).isin(0, 1)))
    ends = [] if label is None else [F.min(label).alias("lo"), F.max(label).alias("hi")]
    each = rows.groupBy("problem_id", "mask_bucket").agg(F.count(F.lit(1)).alias("c"), *ends)
    per = each.groupBy("problem_id").agg(F.count(F.lit(1)).alias("b"), F.max("c").alias("m"), *([(F.min("lo") != F.max("hi")).alias("_label")] if ends else []))
    problem = F.col("problem_id")
    of_problem = [("buckets", problem, F.lit(per_problem), F.col("b"), (F.col("b") != per_problem) | (F.col("m") > 1))]
    if label is not None:
        of_problem.append(("constant label", problem, F.lit("one"), F.lit("several"), F.col("_label")))
    return seen.select(_found(*checks)).unionByName(per.select(_found(*of_problem)))


def resumable(assigned: DataFrame, done: DataFrame, fields: Sequence[str], current: dict, key: str = "problem_id") -> DataFrame:
    """May an interrupted shard go on? Done ids are among the assigned ones, each once, and every row's identity fields are the current run's."""
    per = done.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.col(f).eqNullSafe(F.lit(current[f]))).alias(f"_same_{k}") for k, f in enumerate(fields)])
    known = assigned.select(F.col(key), F.lit(True).alias("_known")).distinct()
    rows = per.join(known, key, "left")
    checks = [("assigned", F.col(key), F.lit("assigned"), F.lit("other"), F.col("_known").isNull()), ("repeated", F.col(key), F.lit(1), F.col("_n"), F.col("_n") > 1)]
    checks += [(f"identity {f}", F.col(key), F.lit(str(current[f])), F.lit("other"), ~F.col(f"_same_{k}")) for k, f in enumerate(fields)]
    return rows.select(_found(*checks))


def formal_set(rows: DataFrame, problems: int, samples: int) -> DataFrame:
    """Trajectories of a formal set: ordinals 0 to problems - 1, one per problem and one problem per ordinal, and samples 0 to samples - 1 of each, once."""
    pairs = rows.groupBy("problem_id", "ordinal").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("sample_id").alias("d"), F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"))
    marked = pairs.withColumns({"_p": F.count(F.lit(1)).over(Window.partitionBy("problem_id")), "_o": F.count(F.lit(1)).over(Window.partitionBy("ordinal"))})
    key = F.col("problem_id")
    out = marked.select(_found(
        ("ordinal", key, F.lit(f"0..{problems - 1}"), F.col("ordinal"), (F.col("ordinal") < 0) | (F.col("ordinal") >= problems)),
        ("one ordinal", key, F.lit(1), F.col("_p"), F.col("_p") > 1),
        ("one problem", key, F.lit(1), F.col("_o"), F.col("_o") > 1),
        ("samples", key, F.lit(samples), F.col("c"), (F.col("c") != samples) | (F.col("d") != samples) | (F.col("lo") != 0) | (F.col("hi") != samples - 1)),
    ))
    total = pairs.agg(F.count_distinct("problem_id").alias("n"))
    return out.unionByName(total.select(_found(("problems", F.lit("all"), F.lit(problems), F.col("n"), F.col("n") != problems))))


def reproduced(declared: DataFrame, again: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """A declared summary, one row, against the one computed again from its records: a violation per column that differs, or is in only one of them."""
    names = sorted({*declared.columns, *again.columns})
    left = declared.select(*[F.col(c).alias(f"_d{k}") if c in declared.columns else F.lit(None).alias(f"_d{k}") for k, c in enumerate(names)])
    right = again.select(*[F.col(c).alias(f"_a{k}") if c in again.columns else F.lit(None).alias(f"_a{k}") for k, c in enumerate(names)])
    kinds = dict(again.dtypes)

    def differs(k: int, c: str) -> Column:
        d, a = F.col(f"_d{k}"), F.col(f"_a{k}")
        if c not in declared.columns or c not in again.columns:
            return F.lit(True)
        near = F.abs(d - a) <= tolerance if tolerance and kinds[c] in ("double", "float") else d == a
        return ~(F.coalesce(near, F.lit(False)) | (d.isNull() & a.isNull()))

    both = left.join(F.broadcast(right))  # a row each
    return both.select(_found(*[("summary", F.lit(c), F.col(f"_a{k}"), F.col(f"_d{k}"), differs(k, c)) for k, c in enumerate(names)]))


def output_contract(spark: SparkSession, folder: str, expected: Sequence[str], resume: bool) -> list[tuple[str, str]]:
    """(violation, name): a new run's folder holds none of its files and nothing else; one that goes on holds all that it resumes from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
    if resume:
        return [("missing", n) for n in sorted(set(expected) - there)]
    return [("stale", n) for n in sorted(there)]


def same_identity(rows: DataFrame, fields: Sequence[str], shard: str) -> DataFrame:
    """Shards whose fields differ from those of the lowest shard; compared as JSON, so null equals null."""
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    per = rows.select(shard, text.alias("identity")).distinct()
    want = per.agg(F.min_by("identity", F.struct(shard, "identity")).alias("want"))
    return _rows(per.join(F.broadcast(want)), "identity", F.col(shard), F.col("want"), F.col("identity"), F.col("identity") != F.col("want"))


def token_hash(ids: str | Column) -> Column:
    """The SHA-256 of token ids as a JSON array without spaces."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("]")), 256)


def trajectory(rows: DataFrame, schedule: list[int], length: int, base_seed: int | None = None, samples: int | None = None, steps: int | None = None, prompts: bool = False) -> DataFrame:
    """Steps equal the schedule, as many ratios, ratios within [0, 1] and never rising, tokens of a length, label = grade; all in one pass.

    base_seed: `seed` is the derived one of problem and trajectory; samples: trajectory ids are 0 to samples - 1; steps: `calls`
    are that many; prompts: prompt_ids are there and have the hash prompt_sha256.
    """
    key = _key("problem_id", "trajectory_id")
    want = F.array(*map(F.lit, schedule))
    rising = F.exists(F.sequence(F.lit(1), F.greatest(F.size("mask_ratios") - 1, F.lit(1))), lambda i: F.get(F.col("mask_ratios"), i) > F.get(F.col("mask_ratios"), i - 1))
    checks = [
        ("steps", key, F.lit(len(schedule)), F.size("snapshot_steps"), F.col("snapshot_steps") != want),
        ("ratios", key, F.lit(len(schedule)), F.size("mask_ratios"), F.size("mask_ratios") != len(schedule)),
        ("range", key, F.lit("0 to 1"), F.lit("outside"), F.exists("mask_ratios", lambda r: (r < 0) | (r > 1))),
        ("falling", key, F.lit("never rising"), F.lit("rising"), (F.size("mask_ratios") > 1) & rising),
        ("tokens", key, F.lit(length), F.size("generated_token_ids"), F.size("generated_token_ids") != length),
        ("label", key, F.col("graded"), F.col("is_correct"), ~F.col("graded").eqNullSafe(F.col("is_correct"))),
    ]
    if base_seed is not None:
        rows = rows.withColumns({"_b": F.lit(base_seed), "_s": F.lit("trajectory")}).withColumn("_seed", derive_seed("_b", "problem_id", "trajectory_id", "_s"))
        checks.append(("seed", key, F.col("_seed"), F.col("seed"), F.col("seed") != F.col("_seed")))
    if samples is not None:
        checks.append(("trajectory", key, F.lit(f"0..{samples - 1}"), F.col("trajectory_id"), (F.col("trajectory_id") < 0) | (F.col("trajectory_id") >= samples)))
    if steps is not None:
        checks.append(("calls", key, F.lit(steps), F.col("calls"), F.col("calls") != steps))
    if prompts:
        checks.append(("prompt", key, token_hash("prompt_ids"), F.col("prompt_sha256"), (F.size("prompt_ids") < 1) | (token_hash("prompt_ids") != F.col("prompt_sha256"))))
    return rows.select(_found(*checks))


def weights(rows: DataFrame, weight: str) -> DataFrame:
    """Finite, not negative, and of a positive sum per problem, whose sum stands at its first row: one pass."""
    own = Window.partitionBy("problem_id")
    seen = rows.select("problem_id", F.col(weight).alias("_w")).withColumns({"_t": F.sum("_w").over(own), "_first": F.row_number().over(own.orderBy("_w")) == 1})
    bad = F.col("_w").isNull() | F.isnan("_w") | (F.abs("_w") == float("inf")) | (F.col("_w") < 0)
    key = F.col("problem_id")
    return seen.select(_found(("weight", key, F.lit("finite, >= 0"), F.col("_w"), bad), ("sum", key, F.lit("> 0"), F.col("_t"), F.col("_first") & ~F.coalesce(F.col("_t") > 0, F.lit(False)))))


def conserved_calls(rows: DataFrame, steps: int) -> DataFrame:
    """Logical calls are candidates times steps; physical ones are steps."""
    key, logical = F.col("problem_id"), F.col("num_candidates") * steps
    return rows.select(_found(("logical", key, logical, F.col("logical"), F.col("logical") != logical), ("physical", key, F.lit(steps), F.col("physical"), F.col("physical") != steps)))


def contiguous_shards(rows: DataFrame, shard: str, num_shards: str, complete: str) -> DataFrame:
    """Shard ids 0 to n - 1, each once and complete, all with the same n. No shards at all are a violation."""
    per = rows.agg(F.count(F.lit(1)).alias("c"), F.count_distinct(shard).alias("d"), F.min(shard).alias("lo"), F.max(shard).alias("hi"), F.min(num_shards).alias("n"), F.max(num_shards).alias("m"), F.count_if(~F.col(complete)).alias("open"))
    bad = (F.col("c") != F.col("n")) | (F.col("d") != F.col("c")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("n") != F.col("m"))
    return per.select(_found(("shards", F.lit("all"), F.col("m"), F.col("c"), bad), ("complete", F.lit("all"), F.lit(0), F.col("open"), F.col("open") > 0)))


def merged_pool(rows: DataFrame, shards: DataFrame, keys: Sequence[str], identity: Sequence[str] = (), missing: str = "error", problems: int | None = None) -> tuple[DataFrame, list[int]]:
    """The rows of all shards as one pool, once it passes its gates, and the shards that it lacks.

    rows: with `shard`; shards: shard, num_shards, complete and the identity's columns, a row each. Shards have one num_shards and
    one identity, each number under it occurs once at most, keys are unique over all of them and, with `problems`, that many
    problems are there. missing="error": every shard is there and complete; "skip": shards that are absent or not complete are
    left out with their rows and returned. Whatever else is wrong raises GateError.
    """
    if missing not in ("error", "skip"):
        raise ValueError("missing is error or skip")
    said = shards.select("shard", "num_shards", "complete", *identity).collect()  # a row per shard
    sizes = {r["num_shards"] for r in said}
    if len(sizes) != 1:
        raise GateError("num_shards", [(s,) for s in sorted(sizes)])
    n, seen = sizes.pop(), Counter(r["shard"] for r in said)
    if odd := sorted(s for s, c in seen.items() if c > 1 or not 0 <= s < n):
        raise GateError("shards", [(s,) for s in odd])
    kinds = {tuple(r[c] for c in identity) for r in said}
    if len(kinds) > 1:
        raise GateError("identity", sorted(kinds, key=str))
    there = {r["shard"] for r in said if r["complete"]}
    lacking = sorted(set(range(n)) - there)
    if lacking and missing == "error":
        raise GateError("missing or incomplete shards", [(s,) for s in lacking])
    pool = rows.where(F.col("shard").isin(sorted(there)))
    copies = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    require("repeated", copies.where("copies > 1"))
    if problems is not None:
        require("problems", pool.agg(F.count_distinct("problem_id").alias("n")).where(F.col("n") != problems))
    return pool, lacking


def frozen_split(split: DataFrame, frozen: DataFrame, key: str, side: str = "split") -> DataFrame:
    """A split against the frozen one: ids that it lacks, that it has besides, that are on the other side, or that repeat."""
    mine = split.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(side).alias("_mine"))
    theirs = frozen.select(F.col(key).alias("_key"), F.col(side).alias("_side"))
    both = mine.join(theirs, F.col(key).eqNullSafe(F.col("_key")), "full")
    at = F.when(F.col("_n").isNull(), F.col("_key")).otherwise(F.col(key))
    have, want = F.col("_n").isNotNull(), F.col("_side").isNotNull()
    return both.select(_found(
        ("missing", at, F.col("_side"), F.lit(None), ~have),
        ("unknown", at, F.lit(None), F.col("_mine"), ~want),
        ("side", at, F.col("_side"), F.col("_mine"), have & want & ~F.col("_side").eqNullSafe(F.col("_mine"))),
        ("repeated", at, F.lit(1), F.col("_n"), F.coalesce(F.col("_n") > 1, F.lit(False))),
    ))


def config(values: dict, rules: dict) -> list[str]:
    """The names of values that break their rule; a rule is a predicate."""
    return [k for k, ok in rules.items() if k not in values or not ok(values[k])]


def pool_spec(seed: int, n: int, allowed: set[tuple[int, int]]) -> bool:
    return (seed, n) in allowed
