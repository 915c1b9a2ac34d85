"""Robust statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import group_quantiles
from .store import stored

MAD_TO_SIGMA = 0.6744897501960817

#: Coefficients of a rational Chebyshev fit of the complementary error function (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def rounded(c: str | Column, places: int) -> Column:
    """Half to even at a number of decimal places, on the binary value (Spark's bround rounds its shortest decimal form)."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.rint(x * 10.0**places) / 10.0**places + 0.0  # no negative zero


def upper_tail_p(z: Column) -> Column:
    """Normal upper tail of z >= 0; null and NaN give 1. Spark has no erf, so it is a polynomial inside the codegen."""
    x = z / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return F.when(z.isNull() | F.isnan(z), 1.0).otherwise(0.5 * t * F.exp(-x * x + poly))


def upper_tail_sql(z: str) -> str:
    """The same expression in SQL."""
    t = f"(1.0 / (1.0 + 0.5 * (({z}) / sqrt(2.0))))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"(0.5 * {t} * exp(-(({z}) / sqrt(2.0)) * (({z}) / sqrt(2.0)) + {poly}))"


def with_robust_z(df: DataFrame, keys: list[str], value: str, least_mad: float = 0.0, name: str = "robust_z", median: str = "_median") -> DataFrame:
    """Distance from the group's median in robust standard deviations.

    Null where the group's median absolute deviation is 0 (before least_mad is applied). Medians come from slices,
    so no group sits in one task.
    """
    med = group_quantiles(df, keys, value, {median: 0.5})
    one = df.join(med, keys) if keys else df.join(F.broadcast(med))  # without keys: one row
    one = stored(one.withColumn("_dev", F.abs(F.col(value) - F.col(median))), "deviations")
    mad = group_quantiles(one, keys, "_dev", {"_mad": 0.5})
    both = one.join(mad, keys) if keys else one.join(F.broadcast(mad))
    z = F.when(F.col("_mad") > 0, MAD_TO_SIGMA * (F.col(value) - F.col(median)) / F.greatest("_mad", F.lit(least_mad)))
    return both.withColumn(name, z).drop("_dev", "_mad")
