"""Numeric expressions over vectors and groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, at most 1 in amount; 0 where a vector is zero.

    The root is that of the product, so a vector's cosine to itself is 1, and ties with what is 1 otherwise stay ties.
    """

    def over(s: Column) -> Column:
        both = s["aa"] * s["bb"]
        norm = F.when((both > 0) & (both < float("inf")), F.sqrt(both)).otherwise(F.sqrt(s["aa"]) * F.sqrt(s["bb"]))
        of = s["ab"] / norm
        return F.when(norm > 0, F.when((of > 1) & ~F.isnan(of), 1.0).when(of < -1, -1.0).otherwise(of)).otherwise(0.0)

    return F.get(F.transform(F.array(F.struct(dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb"))), over), F.lit(0))


def usable_vector(v: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def sample_skewness(x: Column) -> Column:
    """Third central moment over the cube of the sample deviation; 0 for fewer than 3 values or no spread."""
    n = F.count(x)
    return F.when((n >= 3) & (F.stddev_samp(x) > 0), F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5))).otherwise(0.0)


def sample_kurtosis(x: Column) -> Column:
    """Fourth central moment over the sample variance squared, less 3; 0 for fewer than 4 values or no spread."""
    n = F.count(x)
    return F.when((n >= 4) & (F.stddev_samp(x) > 0), (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3).otherwise(0.0)
