"""Posterior draws: thinning, replay over a horizon, in-sample means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.rng import key_of, normal
from tidecast.names import POS, SAMPLE_DIMS


def thin_draws(posterior: DataFrame, num: int, seed: int = 0) -> DataFrame:
    """num draws, renumbered as chain 0, draw 0..num-1: without repeats, or with, where there are fewer than num.

    The order is that of the MD5 of seed, chain and draw, so it doesn't depend on partitions.
    """
    if num < 1:
        raise ValueError("ask for one draw or more")
    names = posterior.select(*SAMPLE_DIMS).distinct()
    ranked = names.withColumn("_r", F.row_number().over(Window.orderBy(F.md5(key_of(seed, "thin", F.col("chain"), F.col("draw"))), "chain", "draw")) - 1)
    total = names.count()
    taken = ranked.filter(F.col("_r") < num).withColumn("_n", F.col("_r").cast("long"))
    if num > total:
        picks = posterior.sparkSession.range(num).select(F.col("id").alias("_n"), F.pmod(F.conv(F.substring(F.md5(key_of(seed, "pick", F.col("id"))), 1, 8), 16, 10).cast("long"), F.lit(total)).cast("int").alias("_r"))
        taken = picks.join(ranked, "_r")
    return posterior.join(F.broadcast(taken.drop("_r")), list(SAMPLE_DIMS)).withColumn("chain", F.lit(0)).withColumn("draw", F.col("_n")).drop("_n")


def noise(seed: int, var: str, keys: Sequence[str]) -> Column:
    return normal(key_of(seed, var, F.col("chain"), F.col("draw"), *(F.col(k) for k in keys), F.col(POS)))


def random_walk_replay(posterior: DataFrame, steps: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """forecast paths: each draw's last level, then fresh increments drift + sigma * noise summed over the horizon.

    posterior has chain, draw, keys, level, drift, sigma, obs_sigma; steps is the horizon's pos (broadcast: a horizon).
    """
    grid = posterior.crossJoin(F.broadcast(steps))
    over = Window.partitionBy(*SAMPLE_DIMS, *keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = grid.withColumn("mu_future", F.col("level") + F.sum(F.col("drift") + F.col("sigma") * noise(seed, "level", keys)).over(over))
    return walked.withColumn("forecast", F.col("mu_future") + F.col("obs_sigma") * noise(seed, "obs", keys)).select(*SAMPLE_DIMS, *keys, POS, "mu_future", "forecast")


def linear_predictor(posterior: DataFrame, covariates: DataFrame, coefficients: dict[str, str], intercept: str = "intercept") -> DataFrame:
    """mu = intercept + sum of coefficient * covariate, for every draw and step; draws stay apart."""
    mu = F.col(intercept)
    for parameter, covariate in coefficients.items():
        mu = mu + F.col(parameter) * F.col(covariate)
    return posterior.crossJoin(covariates).withColumn("mu", mu)
