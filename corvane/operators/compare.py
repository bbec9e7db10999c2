"""Nested records compared path by path: VARIANT values as rows of nodes, joined in full, numbers within a tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def nodes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, path, kind and text of every node of a VARIANT column: objects, arrays, and their leaves.

    Paths are $, $.a, $.a[0], and $['odd key'] for keys that aren't plain words. kind is OBJECT, ARRAY, NUMBER, STRING, BOOLEAN, VOID
    and so on; text is the JSON of a leaf and null for an object or array. A null record has no nodes. One
    pass opens one level, until none has a level below.
    """
    level = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.col(value).alias("v"))
    out = []
    while True:
        head = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z_]+", 0)
        level = level.withColumn("kind", F.when(head.isin(*NUMBERS), "NUMBER").otherwise(head))
        holds = F.col("kind").isin("OBJECT", "ARRAY")
        out.append(level.select("_key", "path", "kind", F.when(~holds, F.to_json("v")).alias("text")))
        inner = level.where(holds)
        if inner.isEmpty():
            return reduce(DataFrame.unionAll, out).withColumnRenamed("_key", key)
        parts = inner.alias("l").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("l.v").outer()).alias("e"))
        plain = F.concat(F.lit("."), F.col("e.key"))
        quoted = F.concat(F.lit("['"), F.replace(F.replace(F.col("e.key"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"))
        step = F.when(F.col("e.key").isNull(), F.concat(F.lit("["), F.col("e.pos").cast("string"), F.lit("]"))).when(F.col("e.key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), plain).otherwise(quoted)
        level = parts.select("l._key", F.concat("l.path", step).alias("path"), F.col("e.value").alias("v"))


def _close(a: Column, b: Column, absolute: float, relative: float) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    return (a == b) | (F.abs(x - y) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(x), F.abs(y))))


def differences(expected: DataFrame, actual: DataFrame, key: str, value: str, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """key, path, difference, expected and actual of every place at which two sets of records differ.

    difference is missing (not in actual), extra (not in expected), type (another kind) or value. Numbers are
    equal within the absolute or the relative tolerance, whichever is wider; whatever their JSON form, they are one kind. A null
    value is a value: it differs from a key that isn't there. Keys must be unique on each side; a record of one side is missing or
    extra with all its nodes. One shuffle by key and path.
    """
    a = nodes(expected, key, value).select(F.col(key).alias("_a"), F.col("path").alias("_pa"), F.col("kind").alias("_ka"), F.col("text").alias("_ta"))
    b = nodes(actual, key, value).select(F.col(key).alias("_b"), F.col("path").alias("_pb"), F.col("kind").alias("_kb"), F.col("text").alias("_tb"))
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")) & (F.col("_pa") == F.col("_pb")), "full")
    numbers = F.col("_ka") == "NUMBER"
    same = F.when(numbers, _close(F.col("_ta"), F.col("_tb"), absolute, relative)).otherwise(F.col("_ta").eqNullSafe(F.col("_tb")))
    kind = F.when(F.col("_pb").isNull(), "missing").when(F.col("_pa").isNull(), "extra").when(F.col("_ka") != F.col("_kb"), "type").when(~F.coalesce(same, F.lit(False)), "value")
    return both.select(F.when(F.col("_pa").isNotNull(), F.col("_a")).otherwise(F.col("_b")).alias(key), F.coalesce("_pa", "_pb").alias("path"), kind.alias("difference"), F.col("_ta").alias("expected"), F.col("_tb").alias("actual")).where(F.col("difference").isNotNull())
