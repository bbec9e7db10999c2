"""Statistics of scores against outcomes: AUC, rank agreement, correlations, calibration, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.order import median, numbered, order_statistics, running


def decile(ratio: str) -> Column:
    """Bucket 0 to 9 of a ratio by int(ratio * 10); 1.0 is in the last."""
    return F.least(F.floor(F.col(ratio) * 10), F.lit(9)).cast("bigint")


def decile_by_division(ratio: str) -> Column:
    """The other rule, int(ratio / 0.1): 0.3 is in bucket 2."""
    return F.least(F.floor(F.col(ratio) / 0.1), F.lit(9)).cast("bigint")


def range_bucket(ratio: str) -> Column:
    """Half-open ranges of a mask ratio by name. The bounds."""
    out = F.lit("other")
    for lo, hi, name in ((0.0, 0.10, "0.0-0.10"), (0.1, 0.30, "0.1-0.30"), (0.3, 0.50, "0.3-0.50"), (0.5, 0.70, "0.5-0.70"), (0.7, 0.90, "0.7-0.90"), (0.9, 1.01, "0.9-1.01")):
        out = F.when((F.col(ratio) >= lo) & (F.col(ratio) < hi), name).otherwise(out)
    return out


def auc(rows: DataFrame, group: list[str], value: str, y: str, least: int = 10) -> DataFrame:
    """group, n, auc: the share of (positive, negative) pairs in order, ties a half; null below `least` rows or with one class.

    Rows are counted per value first, then negatives below each value come from `running`: no pairs and
    no task with all rows.
    """
    counts = rows.groupBy(*group, value).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    below = running(counts, group, value, {"neg_below": "neg"})
    per = below.groupBy(*group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum((F.col("pos") * (2 * F.col("neg_below") + F.col("neg"))).cast("double")).alias("twice"))
    n = F.col("p") + F.col("q")
    return per.select(*group, n.alias("n"), F.when((n >= least) & (F.col("p") > 0) & (F.col("q") > 0), F.col("twice") / (2.0 * F.col("p") * F.col("q"))).alias("auc"))


def pearson(a: str, b: str | Column) -> Column:
    """Pearson's r; null where either column doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def gamma(rows: DataFrame, group: str, score: str, correct: str) -> DataFrame:
    """group, gamma: (concordant - discordant) / both, over pairs of different score and outcome; groups without such pairs are left out."""
    counts = rows.groupBy(group, score).agg(F.count_if(correct).alias("pos"), F.count_if(~F.col(correct)).alias("neg"))
    before = Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    seen = counts.withColumns({"pos_below": F.coalesce(F.sum("pos").over(before), F.lit(0)), "neg_below": F.coalesce(F.sum("neg").over(before), F.lit(0))})
    per = seen.groupBy(group).agg(F.sum(F.col("pos") * F.col("neg_below")).alias("c"), F.sum(F.col("neg") * F.col("pos_below")).alias("d"))
    return per.where("c + d > 0").select(group, ((F.col("c") - F.col("d")) / (F.col("c") + F.col("d"))).alias("gamma"))


def mean_and_median(rows: DataFrame, value: str, *ties: str) -> DataFrame:
    return numbered(rows, value, *ties).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), median(value).alias("median"))


def score_delta(rows: DataFrame, group: str, score: str, correct: str) -> DataFrame:
    """n, mean, median, positive_share, p10, p90 of mean(score, correct) - mean(score, incorrect) over groups with both."""
    per = rows.groupBy(group).agg((F.avg(F.when(F.col(correct), F.col(score))) - F.avg(F.when(~F.col(correct), F.col(score)))).alias("delta")).where("delta IS NOT NULL")
    return numbered(per, "delta", group).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), median("delta").alias("median"), (F.count_if(F.col("delta") > 0) / F.count(F.lit(1))).alias("positive_share"), *order_statistics(per, "delta", {"p10": 0.1, "p90": 0.9}))


def bce_with_logits(x: str, y: str) -> Column:
    """max(x, 0) - x y + ln(1 + e^-|x|)."""
    return F.greatest(F.col(x), F.lit(0.0)) - F.col(x) * F.col(y) + F.log1p(F.exp(-F.abs(x)))


def confusion(rows: DataFrame, bucket: Column, logit: str, y: str) -> DataFrame:
    """bucket, n, n_correct, tp, fp, fn, tn, accuracy, precision, recall, mean_bce; predicted positive iff logit > 0; 0 without denominator."""
    said, true = F.col(logit) > 0, F.col(y) == 1
    per = rows.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(c).alias(name) for name, c in (("tp", said & true), ("fp", said & ~true), ("fn", ~said & true), ("tn", ~said & ~true))],
        F.avg(bce_with_logits(logit, y)).alias("mean_bce"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0))
    return per.select("*", (F.col("tp") + F.col("tn")).alias("n_correct"), ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), share("tp", F.col("tp") + F.col("fp")).alias("precision"), share("tp", F.col("tp") + F.col("fn")).alias("recall"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, rho of a small table (one row per bucket): Pearson of mid-ranks; null below three rows."""
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    ranked = rows.select(rank(a).alias("ra"), rank(b).alias("rb"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, pearson("ra", "rb")).alias("rho"))


def monotonic_violations(rows: DataFrame, bucket: str, accuracy: str, slack: float = 0.01) -> DataFrame:
    """bucket, next_bucket, drop: neighbouring buckets whose accuracy rises by more than the slack."""
    order = Window.orderBy(bucket)
    return rows.select(F.col(bucket).alias("bucket"), F.lead(bucket).over(order).alias("next_bucket"), (F.lead(accuracy).over(order) - F.col(accuracy)).alias("rise")).where(F.col("rise") > slack)


def mean_and_error(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, standard_error (sample deviation over root n; 0 for one row)."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(F.lit(1))), F.lit(0.0)).alias("standard_error"))


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t, by the continued fraction of the incomplete beta function."""
    import math

    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > 1e-300 else 1e300
        out = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d)
                c = 1 + k / c
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a rank correlation over n buckets; None below three or without rho."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    return t_tail(rho * ((n - 2) / (1 - rho * rho)) ** 0.5, n - 2)
