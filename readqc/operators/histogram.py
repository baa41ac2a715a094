"""Histogram statistics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expressions import ratio


def median_mad(hist: DataFrame, by: list[str], key: str, n: str) -> DataFrame:
    """by, median, mad: interpolated medians of key weighted by n, and of its distance from the median."""
    med = hist.groupBy(*by).agg(F.percentile(key, 0.5, F.col(n)).alias("median"))
    joined = hist.join(F.broadcast(med), by) if by else hist.crossJoin(med)  # one row a group
    mad = joined.groupBy(*by, "median").agg(F.percentile(F.abs(F.col(key) - F.col("median")), 0.5, F.col(n)).alias("mad"))
    return mad


def mode(key: str, n: str) -> Column:
    """The most frequent key; the largest of several."""
    return F.max_by(key, F.struct(n, key))


def mean_sd(key: str, n: str, sample: bool = False) -> tuple[Column, Column]:
    """Mean and standard deviation (population, or sample with 0 up to one value) as aggregates."""
    k, c = F.col(key).cast("double"), F.col(n)
    total, s, ss = F.sum(c), F.sum(k * c), F.sum(k * k * c)
    mean = ratio(s, total)
    if sample:
        return mean, F.when(total > 1, F.sqrt(F.greatest((ss - s * s / total) / (total - 1), F.lit(0.0)))).otherwise(0.0)
    return mean, F.when(total > 0, F.sqrt(F.greatest(ss / total - mean * mean, F.lit(0.0)))).otherwise(0.0)


def cumulative(hist: DataFrame, key: str, n: str, by: list[str] | None = None) -> DataFrame:
    """hist plus up_to, at_or_above and total; a histogram has one row a key, so it fits a task."""
    w = W.partitionBy(*by) if by else W.partitionBy()
    up = F.sum(n).over(w.orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(n).over(w)
    return hist.withColumns({"up_to": up, "total": total}).withColumn("at_or_above", F.col("total") - F.col("up_to") + F.col(n))


def percentile_up(p: float, key: str = "depth") -> Column:
    """First key whose cumulative count reaches ceil(total * p), else the last; over cumulative()."""
    return F.coalesce(F.min(F.when(F.col("up_to") >= F.ceil(F.col("total") * F.lit(p)), F.col(key))), F.max(key)).cast("double")


def percentile_down(p: float, key: str = "depth") -> Column:
    """First key whose cumulative count reaches trunc(total * p); 0 if that is 0."""
    goal = F.floor(F.col("total") * F.lit(p))
    return F.coalesce(F.when(F.max(goal) == 0, F.lit(0)), F.min(F.when(F.col("up_to") >= goal, F.col(key))), F.lit(0)).cast("double")


def upper_median(key: str = "depth") -> Column:
    """First key whose cumulative count exceeds half of the total."""
    return F.coalesce(F.min(F.when(F.col("up_to") > F.floor(F.col("total") / 2), F.col(key))), F.lit(0)).cast("double")
