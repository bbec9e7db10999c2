"""Ranks, running sums and order statistics over a whole table without a task that holds all rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Levels by which one value's rows are told apart, and the place of a value's own parts within a part of the table.
_WIDE = 1 << 20


def _rank(rows: DataFrame, name: str) -> Column:
    """A number that never orders two values of the column otherwise than the values themselves; equal ones may be told apart no further.

    Text: six bytes behind the beginning that all values share, so a common prefix hides nothing.
    """
    if not isinstance(rows.schema[name].dataType, T.StringType):
        return F.col(name).cast("double")
    ends = rows.agg(F.min(name).alias("a"), F.max(name).alias("b")).first()
    a, b = ((ends["a"] or "").encode(), (ends["b"] or "").encode())
    shared = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    head = F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), shared + 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _bounds(rows: DataFrame, by: Column, n: int) -> list:
    shares = [i / n for i in range(1, n)] or [0.5]
    return rows.agg(F.percentile_approx(by, shares, 10 * max(n, 1000)).alias("b")).first()["b"] or []


def _place(by: Column, bounds: list) -> Column:
    literals = [F.lit(b) for b in sorted(set(bounds))]
    return F.size(F.filter(F.array(*literals), lambda b: by > b)) if literals else F.lit(0)


def with_part(rows: DataFrame, by: str, parts: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with `_part`: the place of `by` among quantiles of the column, so that parts follow each other.

    The bounds are literals of the plan: every execution deals rows alike, which range partitioning with
    its sampling does not promise. Null is in a part before all others, NaN in the last.

    A value that several quantiles fall on has that many quantiles' share of the rows. With `ties` its rows are
    dealt to as many parts of their own, by bounds of the first of these columns that has different values there;
    null is such a value as well. So parts stay even where one value is a third of the table, or all of it.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows, F.col(by), n)
    plain = F.when(F.col(by).isNull(), -1).otherwise(_place(F.col(by), bounds))
    if not ties:
        return rows.withColumn("_part", plain)
    heavy = {v: c for v, c in Counter(bounds).items() if c > 1}
    sizes = rows.agg(F.count_if(F.col(by).isNull()).alias("null"), F.count(F.lit(1)).alias("all")).first()
    if sizes["null"] * n > 2 * sizes["all"]:
        heavy[None] = int(sizes["null"] * n / sizes["all"])
    own = F.lit(0)
    for value, count in heavy.items():
        here = F.col(by).eqNullSafe(F.lit(value).cast(rows.schema[by].dataType))
        for name in ties:
            rank = _rank(rows.where(here), name)
            if found := _bounds(rows.where(here), rank, count):
                own = F.when(here, 1 + F.when(rank.isNull(), 0).otherwise(1 + _place(rank, found))).otherwise(own)
                if len(set(found)) > 1:
                    break
    return rows.withColumn("_part", plain.cast("bigint") * _WIDE + own)


def running(rows: DataFrame, group: list[str], by: str, sums: dict[str, str]) -> DataFrame:
    """rows with, per name, the sum of its column over the rows of the group that come before; (group, by) must be unique.

    Each part adds up its own rows; what precedes a part is a sum over the parts before it.
    """
    dealt = with_part(rows, by)
    own = Window.partitionBy(*group, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    totals = dealt.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    joined = local.join(base, [*group, "_part"])
    return joined.select(*rows.columns, *[(F.col(f"_in_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def numbered(rows: DataFrame, by: str, *ties: str) -> DataFrame:
    """rows with `ordinal`, 0, 1, ... by `by`, then `ties`, and `total`, their number. Rows of one value are dealt out by their ties."""
    dealt = with_part(rows, by, ties=ties)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by, *ties)) - 1
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(everything).alias("total"))
    return dealt.withColumn("_at", place).join(base, "_part").select(*rows.columns, (F.col("_base") + F.col("_at")).alias("ordinal"), "total")


def order_statistics(rows: DataFrame, by: str, places: dict[str, float]) -> list[Column]:
    """Aggregates over `numbered` rows: sorted[int(q * n)] for each name, without interpolation."""
    return [F.max(F.when(F.col("ordinal") == F.floor(F.lit(q) * F.col("total") + 1e-9), F.col(by))).alias(name) for name, q in places.items()]


def median(by: str) -> Column:
    """Aggregate over `numbered` rows: the middle one, or the mean of both middle ones."""
    middle = (F.col("ordinal") == F.floor((F.col("total") - 1) / 2)) | (F.col("ordinal") == F.floor(F.col("total") / 2))
    return F.avg(F.when(middle, F.col(by)))
