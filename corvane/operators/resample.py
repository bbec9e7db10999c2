"""Resampling with draws by hash: the same rows at any partitioning, and in any engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import ship


def draw(key: Column, n: Column | int) -> Column:
    """A whole number from 0 to n - 1 by the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n


def derive_seed(base: str, problem: str, particle: str, stage: str) -> Column:
    """63 bits of the SHA-256 of the JSON array of the parts; numbers stay numbers, the stage is a string."""
    text = F.concat(F.lit("["), F.col(base).cast("string"), F.lit(","), F.col(problem).cast("string"), F.lit(","), F.col(particle).cast("string"), F.lit(',"'), F.col(stage), F.lit('"]'))
    top = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (top % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")


#: Fixed values of the 64-bit mixing function: its increment, its two factors and its three shifts.
STEP, FACTORS, SHIFTS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each 64-bit counter."""
    z = x + np.uint64(STEP)
    for factor, shift in zip(FACTORS, SHIFTS, strict=False):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(SHIFTS[2]))


def resampled_means(outcomes: DataFrame, values: list[str], times: int, most: int = 1024) -> DataFrame:
    """`resample` and the mean of each value over it: n draws with replacement, the same for all values.

    values are 0/1 columns (null counts as a problem without it), so problems fall into few classes of equal
    outcomes. Places 0 to n - 1 are dealt to the classes in their order, and a drawn place tells its class by
    the classes' bounds: draws meet no table, are never rows and never shuffled. A draw is the mixed counter
    (resample * 2^40 + i) modulo n. A task makes the draws of its share of 0 to n - 1 for all resamples, block by block, and sends
    a count per resample and class.
    """
    spark = outcomes.sparkSession
    found = outcomes.groupBy(*values).agg(F.count(F.lit(1)).alias("n")).orderBy(*[F.col(v).asc_nulls_first() for v in values]).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different outcomes: values must be 0 or 1")
    ends = np.cumsum([r["n"] for r in found], dtype=np.uint64)
    total, kinds = int(ends[-1]) if len(ends) else 0, len(found)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((times, kinds), np.int64)
        for batch in batches:
            own = batch.column("id").to_numpy().astype(np.uint64)
            for b in range(times):
                drawn = mixed(own + np.uint64(b << 40)) % np.uint64(total)
                counts[b] += np.bincount(np.searchsorted(ends, drawn, "right"), minlength=kinds)
        b, kind = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int64)), pa.array(kind.astype(np.int32)), pa.array(counts[b, kind])], ["resample", "kind", "n"])

    draws = spark.range(total).mapInArrow(run, "resample bigint, kind int, n bigint")
    share = lambda v: F.coalesce(F.sum(F.when(F.col("kind").isin([k for k, r in enumerate(found) if r[v]]), F.col("n"))), F.lit(0)) / F.sum("n")
    return draws.groupBy("resample").agg(*[share(v).alias(v) for v in values])


def interval(means: DataFrame, value: str | Column, times: int, alpha: float = 0.05) -> list[Column]:
    """Aggregates lo and hi over rows with `at`, the place of the mean in order: the percentile bounds."""
    lo, hi = int(alpha / 2 * times), int((1 - alpha / 2) * times)
    return [F.max(F.when(F.col("at") == lo, value)).alias("lo"), F.max(F.when(F.col("at") == hi, value)).alias("hi")]


def bootstrap(outcomes: DataFrame, methods: list[str], times: int) -> DataFrame:
    """method, point, lo, hi for 0/1 columns."""
    means = resampled_means(outcomes, methods, times).unpivot("resample", methods, "method", "m")
    placed = means.withColumn("at", F.row_number().over(Window.partitionBy("method").orderBy("m", "resample")) - 1)
    bounds = placed.groupBy("method").agg(*interval(placed, F.col("m"), times))
    n = F.count(F.lit(1))
    points = outcomes.agg(*[(F.sum(F.col(m).cast("bigint")) / n).alias(m) for m in methods]).withColumn("one", F.lit(1)).unpivot("one", methods, "method", "point").drop("one")
    return points.join(bounds, "method")


def paired_bootstrap(outcomes: DataFrame, pairs: list[tuple[str, str]], times: int) -> DataFrame:
    """a, b, delta, lo, hi: the difference of two methods over the same draws."""
    methods = sorted({m for p in pairs for m in p})
    means = resampled_means(outcomes, methods, times)
    rows = means.select("resample", F.inline(F.array(*[F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), (F.col(x) - F.col(y)).alias("m")) for x, y in pairs])))
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("left", "right").orderBy("m", "resample")) - 1)
    bounds = placed.groupBy("left", "right").agg(*interval(placed, F.col("m"), times))
    n = F.count(F.lit(1))
    flat = outcomes.agg(F.array(*[F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), (F.sum(F.col(x).cast("bigint")) / n - F.sum(F.col(y).cast("bigint")) / n).alias("delta")) for x, y in pairs]).alias("p")).select(F.inline("p"))
    return flat.join(bounds, ["left", "right"])


def random_rerank(pool: DataFrame, trials: int) -> DataFrame:
    """trial, accuracy of a candidate drawn per problem, by its place in the order of the ids, which may have gaps."""
    per = pool.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("sample_id", "correct"))).alias("graded"))
    rows = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    picked = draw(F.concat_ws("-", F.col("trial").cast("string"), F.col("problem_id").cast("string")), F.col("n")).cast("bigint")
    return rows.select("trial", F.get("graded", picked.cast("int"))["correct"].alias("ok")).groupBy("trial").agg((F.count_if("ok") / F.count(F.lit(1))).alias("accuracy"))


def sequential(outcomes: list[int], times: int, seed: int, alpha: float = 0.05) -> tuple[float, float, float]:
    """(point, lo, hi) with the draws of one Mersenne Twister stream, on the driver: exact parity for a bounded list of outcomes."""
    import random

    stream, n = random.Random(seed), len(outcomes)
    if not n:
        return 0.0, 0.0, 0.0
    means = sorted(sum(outcomes[stream.randrange(n)] for _ in range(n)) / n for _ in range(times))
    return sum(outcomes) / n, means[int(alpha / 2 * times)], means[int((1 - alpha / 2) * times)]
