"""Token arrays: snapshots, padding, masks and pooling, by higher-order functions inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_snapshots(rows: DataFrame, steps: str, states: str, ratios: str, lo: float, hi: float) -> DataFrame:
    """One row (step, state, mask_ratio) per snapshot with lo <= ratio <= hi; lists of unequal length end with the shortest."""
    n = F.least(F.size(steps), F.size(states), F.size(ratios))
    zipped = F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(a) for c, a in ((steps, "step"), (states, "state"), (ratios, "mask_ratio"))])
    inside = F.filter(zipped, lambda s: (s["mask_ratio"] >= lo) & (s["mask_ratio"] <= hi))
    return rows.select(*[c for c in rows.columns if c not in (steps, states, ratios)], F.inline(inside))


def final_sequence(prompt: Column, snapshots: Column) -> Column:
    """The prompt and the last snapshot; null without one."""
    return F.concat(prompt, F.try_element_at(snapshots, F.lit(-1)))


def share_of(ids: Column, token: int) -> Column:
    """How much of a list is the token; null for an empty list."""
    return F.try_divide(F.size(F.filter(ids, lambda x: x == token)), F.size(ids))


def reverse_generated(prompt: Column, generated: Column) -> Column:
    return F.concat(prompt, F.reverse(generated))


def candidate_sequences(pool: DataFrame, prompt: str, tokens: str) -> DataFrame:
    """problem_id and sequences: prompt and generated ids of each candidate, in the order of sample_id."""
    one = F.struct("sample_id", F.concat(prompt, tokens).alias("ids"))
    return pool.groupBy("problem_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["ids"]).alias("sequences"))


def mask_right_half(ids: Column, mask: int) -> Column:
    """From place size // 2 on the mask."""
    return F.transform(ids, lambda x, i: F.when(i >= F.floor(F.size(ids) / 2), F.lit(mask)).otherwise(x))


def strip_padding(ids: Column, pad: int) -> Column:
    """Without the pads at the end; of nothing but pads the first stays."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(x != pad, i + 1)), lambda x: x.isNotNull())
    return F.slice(ids, F.lit(1), F.greatest(F.coalesce(F.array_max(places), F.lit(1)), F.lit(1)))


def until_end(ids: Column, end: int, mask: int) -> Column:
    """Up to the first end token, exclusive, and then without masks."""
    at = F.array_position(ids, end).cast("int")
    cut = F.when(at > 0, F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(ids)
    return F.filter(cut, lambda x: x != mask)


def padded(rows: DataFrame, ids: str, batch: str, pad: int) -> DataFrame:
    """rows with `padded` and `attention`: lists filled up to their batch's longest."""
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("longest"))
    more = F.col("longest") - F.size(ids)
    return rows.join(longest, batch).withColumns({"padded": F.concat(ids, F.array_repeat(F.lit(pad), more)), "attention": F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), more))}).drop("longest")


def masked_mean(values: Column, ids: Column, prompt_len: Column, end: int, mask: int) -> Column:
    """Mean of the values at places from prompt_len on, before the first end token there, where the id is no mask; 0 without one."""
    own = F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))
    at = F.array_position(own, end).cast("int")
    last = F.when(at > 0, prompt_len + at - 1).otherwise(F.size(ids))
    picked = F.filter(F.arrays_zip(values.alias("v"), ids.alias("t"), F.sequence(F.lit(0), F.size(ids) - 1).alias("i")), lambda s: (s["i"] >= prompt_len) & (s["i"] < last) & (s["t"] != mask))
    return F.aggregate(picked, F.lit(0.0), lambda a, s: a + s["v"]) / F.greatest(F.size(picked), F.lit(1))


def capture_schedule(steps: int, every: int, initial: bool = True) -> list[int]:
    """Steps whose snapshot is kept: the initial state as -1, each `every`-th, and the last."""
    if every <= 0:
        raise ValueError("every must be positive")
    out = sorted({*range(0, steps, every), steps - 1})
    return [-1, *out] if initial else out


def sinusoidal(x: Column, dim: int, scale: float = 128.0) -> Column:
    """Sines, then cosines, of x * scale at geometric frequencies; an odd dimension ends with 0."""
    half = dim // 2
    args = [x * scale * (10000.0 ** (-i / max(half - 1, 1))) for i in range(half)]
    return F.array(*[F.sin(a) for a in args], *[F.cos(a) for a in args], *[F.lit(0.0)] * (dim - 2 * half))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def joined(ids: Column) -> Column:
    return F.concat_ws(",", F.transform(ids, lambda x: x.cast("string")))
