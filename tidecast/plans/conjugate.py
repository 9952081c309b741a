"""Closed-form posteriors from aggregated moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_posterior(df: DataFrame, x: Column, y: Column, by: Sequence[str] = (), prior_precision: float = 1e-6, noise_var: float = 1.0) -> DataFrame:
    """(by, intercept, slope, intercept_sd, slope_sd): y = intercept + slope * x + noise, independent normal priors at 0.

    The normal equations are one aggregation, combined before its exchange; nothing else of the data is kept.
    """
    x, y = x.cast("double"), y.cast("double")
    m = df.groupBy(*by).agg((F.count(y) + F.lit(prior_precision)).alias("n"), F.sum(x).alias("sx"), (F.sum(x * x) + F.lit(prior_precision)).alias("sxx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return m.select(
        *by,
        ((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det).alias("intercept"),
        ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).alias("slope"),
        F.sqrt(F.lit(noise_var) * F.col("sxx") / det).alias("intercept_sd"),
        F.sqrt(F.lit(noise_var) * F.col("n") / det).alias("slope_sd"),
    )
