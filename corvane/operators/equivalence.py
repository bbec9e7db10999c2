"""Majority over classes of equivalent answers, by a comparison that the caller supplies.

The comparison is symmetric, says whether two answers are the same, and may raise: then the pair is
recorded and not merged. Classes are the closure of what it says, so it need not be transitive.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship

_CLUSTER = "struct<representative_sample_id:bigint,representative_answer:string,sample_ids:array<bigint>,count:bigint>"
_ERROR = "struct<left_sample_id:bigint,right_sample_id:bigint,error_type:string,error_message:string>"


def classes(answers: list[str], equivalent: Callable[[str, str], bool]) -> tuple[dict[str, str], dict[tuple[str, str], Exception], set[str]]:
    """Each different answer's class, named by the first of its answers in the list, the pairs whose comparison raised, and
    the answers whose own candidates stay apart.

    Every pair of different answers is compared once, and an answer that stands twice with itself: where the
    comparison fails or says no there, only another answer of the class holds its candidates together.
    """
    count = Counter(answers)
    order = list(count)
    up = {a: a for a in order}
    place = {a: k for k, a in enumerate(order)}
    failed: dict[tuple[str, str], Exception] = {}
    unlike: set[str] = set()

    def top(a: str) -> str:
        while up[a] != a:
            a = up[a]
        return a

    for k, a in enumerate(order):
        for b in order[k if count[a] > 1 else k + 1 :]:
            try:
                same = equivalent(a, b)
            except Exception as e:  # noqa: BLE001  a failing comparison is a result
                failed[a, b] = e
                same = False
            if a == b and not same:
                unlike.add(a)
            if same and top(a) != top(b):
                low, high = sorted((top(a), top(b)), key=place.get)
                up[high] = low
    named = {a: top(a) for a in order}
    size = Counter(named.values())
    return named, failed, {a for a in unlike if size[named[a]] == 1}


def _readout(members: list[dict], equivalent: Callable[[str, str], bool]) -> dict:
    """clusters, errors and the number of comparisons of one problem's candidates, in the order of their ids."""
    valid = [m for m in members if m["answer"] is not None]
    named, failed, apart = classes([m["answer"] for m in valid], equivalent)
    groups: dict[tuple, list[dict]] = {}
    for m in valid:
        a = m["answer"]
        groups.setdefault((named[a], m["sample_id"] if a in apart else None), []).append(m)
    errors = []
    for k, m in enumerate(valid) if failed else ():
        for other in valid[k + 1 :]:
            e = failed.get((m["answer"], other["answer"])) or failed.get((other["answer"], m["answer"]))
            if e is not None:
                errors.append({"left_sample_id": m["sample_id"], "right_sample_id": other["sample_id"], "error_type": type(e).__name__, "error_message": str(e).replace("\n", " ")[:300]})
    clusters = [{"representative_sample_id": g[0]["sample_id"], "representative_answer": g[0]["answer"], "sample_ids": [m["sample_id"] for m in g], "count": len(g)} for g in groups.values()]
    return {"clusters": clusters, "errors": errors, "comparisons": len(valid) * (len(valid) - 1) // 2}


def equivalence_readout(pool: DataFrame, equivalent: Callable[[str, str], bool], key: str = "problem_id", answer: str = "answer") -> DataFrame:
    """One row per problem: the largest class of equivalent valid answers, ties to the lowest representative.

    pool: key, sample_id, answer (null: invalid) and correct. Invalid candidates vote for nothing. A class's
    representative is its lowest candidate, whose own grade (null: wrong) is the readout's. Without a valid answer the lowest
    candidate is the fallback, and wrong. Returns key, selected_answer, selected_count, selected_sample_id,
    correct, fallback_used, fallback_sample_id, clusters, num_valid, num_invalid, invalid_sample_ids,
    invalid_rate, unique_classes, entropy_bits, comparison_count, error_count and errors.

    One shuffle by problem, whose candidates are one list; the comparison runs in Arrow batches of problems.
    """
    ship(pool.sparkSession)
    member = F.struct(F.col("sample_id").cast("bigint").alias("sample_id"), F.col(answer).cast("string").alias("answer"), F.coalesce("correct", F.lit(False)).alias("correct"))
    lists = pool.groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("members"))
    result = pa.struct([
        ("clusters", pa.list_(pa.struct([("representative_sample_id", pa.int64()), ("representative_answer", pa.string()), ("sample_ids", pa.list_(pa.int64())), ("count", pa.int64())]))),
        ("errors", pa.list_(pa.struct([("left_sample_id", pa.int64()), ("right_sample_id", pa.int64()), ("error_type", pa.string()), ("error_message", pa.string())]))),
        ("comparisons", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_readout(m, equivalent) for m in batch.column("members").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, result)], [*batch.schema.names, "made"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema)
    rows = lists.mapInArrow(run, f"{kinds}, made struct<clusters:array<{_CLUSTER}>,errors:array<{_ERROR}>,comparisons:bigint>")
    rows = rows.select(key, "members", "made.clusters", "made.errors", "made.comparisons", F.filter("members", lambda m: m["answer"].isNull()).alias("bad"))
    # The most members, then the lowest representative.
    best = F.array_max(F.transform("clusters", lambda c: F.struct(c["count"].alias("n"), (-c["representative_sample_id"]).alias("lowest"), c["representative_answer"].alias("answer"))))
    rows = rows.withColumn("best", best).withColumn("valid", F.size("members") - F.size("bad"))
    chosen = F.coalesce(-F.col("best.lowest"), F.get("members", F.lit(0))["sample_id"])
    graded = F.exists("members", lambda m: (m["sample_id"] == -F.col("best.lowest")) & m["correct"])
    share = lambda c: c["count"] / F.col("valid")
    entropy = F.aggregate("clusters", F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    none = F.col("best").isNull()
    return rows.select(
        key,
        F.col("best.answer").alias("selected_answer"),
        F.coalesce("best.n", F.lit(0)).alias("selected_count"),
        chosen.alias("selected_sample_id"),
        F.coalesce(graded, F.lit(False)).alias("correct"),
        none.alias("fallback_used"),
        F.when(none, chosen).alias("fallback_sample_id"),
        "clusters",
        F.col("valid").cast("bigint").alias("num_valid"),
        F.size("bad").cast("bigint").alias("num_invalid"),
        F.transform("bad", lambda m: m["sample_id"]).alias("invalid_sample_ids"),
        (F.size("bad") / F.size("members")).alias("invalid_rate"),
        F.size("clusters").cast("bigint").alias("unique_classes"),
        entropy.alias("entropy_bits"),
        F.col("comparisons").alias("comparison_count"),
        F.size("errors").cast("bigint").alias("error_count"),
        "errors",
    )
