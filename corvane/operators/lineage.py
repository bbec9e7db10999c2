"""Identities, canonical hashes and problem-level splits."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.order import numbered


def canonical_json(value) -> str:
    """JSON with sorted keys and without spaces: equal values, equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical_struct(df: DataFrame, without: Iterable[str] = ()) -> Column:
    """All columns but some as JSON, keys in order, nulls kept."""
    names = sorted(c for c in df.columns if c not in set(without))
    return F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"})


def identity(df: DataFrame, varying: Iterable[str]) -> DataFrame:
    """df with `identity`, the hash of all that may not vary between shards."""
    return df.withColumn("identity", F.sha2(canonical_struct(df, varying), 256))


def problem_split(problems: DataFrame, key: str, seed: int, share: float = 0.1, least: int = 1, most: int | None = None) -> DataFrame:
    """key (as text) and `split`, "fit" or "validation": ids in order of text, of which a Mersenne shuffle takes the first.

    A shuffle moves places alike whatever stands in them. So the driver shuffles as many numbers as there
    are problems, and ids are ranked where they are: they join the places that the shuffle put first.
    An id that repeats is an error, as is a share that isn't between 0 and 1.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    ids = problems.select(F.col(key).cast("string").alias(key))
    seen = ids.groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("n")).first()
    if seen["most"] > 1:
        raise ValueError("problem ids repeat")
    places = list(range(seen["n"]))
    random.Random(seed).shuffle(places)
    size = max(least, int(seen["n"] * share))
    held = problems.sparkSession.createDataFrame([(p,) for p in places[: size if most is None else min(size, most)]], "ordinal bigint")
    # One value for all: ids are ranked as its ties, by the bytes behind what they have in common.
    ranked = numbered(ids.withColumn("_one", F.lit(0)), "_one", key)
    return ranked.join(held.withColumn("_held", F.lit("validation")), "ordinal", "left").select(key, F.coalesce("_held", F.lit("fit")).alias("split"))


def split_by_hash(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows with `fold` by a hash of the problem id: all rows of a problem together, at any size, without a shuffle."""
    return rows.withColumn("fold", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)))
