"""Decline curves and fit quality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exponential(t: Column, qi: Column, di: Column) -> Column:
    return qi * F.exp(-di * t)


def hyperbolic(t: Column, qi: Column, di: Column, b: Column) -> Column:
    """The base is kept positive so that a negative ``t`` cannot yield NaN."""
    return qi / F.pow(F.greatest(1 + b * di * t, F.lit(1e-9)), 1 / b)


def harmonic(t: Column, qi: Column, di: Column) -> Column:
    return qi / (1 + di * t)


def curve(model: Column, t: Column, qi: Column, di: Column, b: Column) -> Column:
    """The rate at ``t`` under the named model.  A flat model has ``di = b = 0``."""
    return (
        F.when(model == "harmonic", harmonic(t, qi, di))
        .when((model == "exponential") | (b == 0), exponential(t, qi, di))
        .otherwise(hyperbolic(t, qi, di, b))
    )


def r2_score(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """R-squared per key; 0 for a series that does not vary.

    ``var_pop`` keeps a running mean, so the spread is exact for series that vary little
    against their level, and both sums combine map-side in a single pass.
    """
    residual = F.sum(F.pow(F.col(actual) - F.col(predicted), F.lit(2.0)))
    spread = F.var_pop(actual) * F.count(actual)
    return df.groupBy(*keys).agg(
        F.when(spread > 0, 1 - residual / spread).otherwise(0.0).alias("r2")
    )
