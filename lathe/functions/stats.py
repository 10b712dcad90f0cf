"""Statistics as Columns and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bayesian_add(a: Column, b: Column) -> Column:
    """The probability that two independent indications give together."""
    return F.try_divide(a * b, a * b + (1 - a) * (1 - b))


def bayesian_subtract(a: Column, b: Column) -> Column:
    return bayesian_add(a, 1 - b)


def moments(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """count, mean, variance, skew and excess kurtosis, and the sums s0 to s4 that merge by adding."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
        F.count(v).alias("s0"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.sum(v * v * v).alias("s3"), F.sum(v * v * v * v).alias("s4"),
    )


def from_sums(s0: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and population variance of merged sums."""
    mean = F.try_divide(s1, s0)
    return mean, F.try_divide(s2, s0) - mean * mean


def trimmed(df: DataFrame, value: str, middle: float, keys: list[str] = ()) -> DataFrame:
    """Mean and variance of the middle share of each group. The cuts are exact percentiles, so groups need no sort."""
    low = (1 - middle) / 2
    cuts = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(1 - low))).alias("__cut"))
    joined = df.join(cuts, list(keys)) if keys else df.crossJoin(F.broadcast(cuts))
    return joined.where(F.col(value).between(F.col("__cut")[0], F.col("__cut")[1])).groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def chi_square(observed: list[Column], expected: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.try_divide((o - e) * (o - e), e) for o, e in zip(observed, expected, strict=True)])


def floor_mod(v: Column, step: float) -> tuple[Column, Column]:
    return F.floor(v / step) * step, F.pmod(v, F.lit(step))


def weighted_choice(df: DataFrame, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, likelier the heavier (exponential keys; a top-k, not a sort)."""
    return df.where(F.col(weight) > 0).withColumn("__k", -F.log(1 - F.rand(seed)) / F.col(weight)).orderBy("__k").limit(n).drop("__k")
