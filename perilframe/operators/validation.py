"""Measures of agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row", "col", F.col("toa").alias("ta")).join(b.select("row", "col", F.col("toa").alias("tb")), ["row", "col"], "full")


def sorensen(a: DataFrame, b: DataFrame) -> DataFrame:
    """2 |A and B| / (|A| + |B|) of reached cells."""
    x, y = F.col("ta").isNotNull(), F.col("tb").isNotNull()
    return _both(a, b).agg((2.0 * F.count_if(x & y) / (F.count_if(x) + F.count_if(y))).alias("sorensen"))


def arrival_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson's r over cells that both reach: null without any, not a number if either arrives everywhere at once (a single cell too)."""
    both = F.covar_pop("ta", "tb"), F.stddev_pop("ta") * F.stddev_pop("tb")
    sums = _both(a, b).where("ta is not null and tb is not null").agg(*(c.alias(n) for c, n in zip(both, ("covariance", "spread"))))
    return sums.select(F.when(F.col("spread") == 0, float("nan")).otherwise(F.col("covariance") / F.col("spread")).alias("r"))


def area_difference(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    x, y = F.col("ta").isNotNull(), F.col("tb").isNotNull()
    return _both(predicted, actual).agg((1.0 * F.count_if(x != y) / F.count_if(y)).alias("area_difference"))


def calibration_curve(df: DataFrame, score: str, observed: str, width: float = 10.0) -> DataFrame:
    return df.groupBy(F.floor(F.col(score) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(observed).alias("observed"))


def within_stratum_variance(df: DataFrame, score: str, stratum: str) -> DataFrame:
    """The share of the score's variance inside strata."""
    each = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.var_pop(score).alias("v"))
    inside = each.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("inside"))
    return inside.crossJoin(df.agg(F.var_pop(score).alias("total"))).select((F.col("inside") / F.col("total")).alias("within_share"))  # one row each
