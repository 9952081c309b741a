"""Regressions of many columns from aggregated moments: conjugate, Poisson, and pooled over series.

Rows are read for sums alone, combined before their exchange; what follows is arrays of one row a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions import linalg
from tidecast.functions.rng import key_of, normal
from tidecast.functions.special import log_gamma
from tidecast.scratch import stored


#: Rounds of a pooled fit that one job runs.
TOGETHER = 5


def moments(rows: DataFrame, by: Sequence[str], columns: Sequence[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """(by, n, xx, xy, yy, sw): sums of weighted products of the design columns and y over rows where none is null."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    named = {f"_x{i}": c.cast("double") for i, c in enumerate(columns)}
    p = len(columns)
    made = rows.select(*by, *(c.alias(n) for n, c in named.items()), y.cast("double").alias("_y"), w.alias("_w")).dropna(subset=[*named, "_y", "_w"])
    wx = [F.col("_w") * F.col(n) for n in named]
    sums = {f"_{i}_{j}": F.sum(wx[i] * F.col(f"_x{j}")) for i in range(p) for j in range(i + 1)} | {f"_{i}": F.sum(wx[i] * F.col("_y")) for i in range(p)}
    sums |= {"n": F.count("_y"), "yy": F.sum(F.col("_w") * F.col("_y") * F.col("_y")), "sw": F.sum("_w")}
    held = made.groupBy(*by).agg(*(s.alias(n) for n, s in sums.items()))
    xx = F.array(*(F.array(*(F.col(f"_{max(i, j)}_{min(i, j)}") for j in range(p))) for i in range(p)))
    return held.select(*by, "n", xx.alias("xx"), F.array(*(F.col(f"_{i}") for i in range(p))).alias("xy"), "yy", "sw")


def conjugate(rows: DataFrame, by: Sequence[str], columns: Sequence[Column], y: Column, precision: Sequence[float], mean: Sequence[float] | None = None, shape: float = 1e-3, rate: float = 1e-3) -> DataFrame:
    """(by, coef, cov, shape, rate, log_evidence): the normal-inverse-gamma posterior of y's regression on columns.

    Coefficients given the noise variance are normal about `mean` (0) with precision `precision` over that variance; the
    variance is inverse gamma.  cov is to be multiplied by the variance.  A series of few rows leans on the prior.
    """
    p = len(columns)
    prior, start = linalg.diagonal(precision), linalg.vector(mean or [0.0] * p)
    held = moments(rows, by, columns, y).select(*by, "n", "yy", linalg.plus(F.col("xx"), prior).alias("a"), linalg.added(F.col("xy"), linalg.times(prior, start)).alias("b"))
    held = held.withColumn("inv", linalg.inverse(F.col("a"), p)).withColumn("coef", linalg.times(F.col("inv.x"), F.col("b")))
    rest = F.col("yy") + linalg.quadratic(prior, start) - linalg.dot(F.col("b"), F.col("coef"))
    held = held.withColumn("_shape", F.lit(shape) + F.col("n") / 2).withColumn("_rate", F.lit(rate) + F.lit(0.5) * rest)
    gammas = F.lit(shape * math.log(rate) - math.lgamma(shape) + 0.5 * sum(map(math.log, precision))) + log_gamma(F.col("_shape")) - F.col("_shape") * F.ln("_rate")
    evidence = gammas - F.lit(0.5) * F.col("inv.logdet") - F.col("n") / 2 * F.lit(math.log(2 * math.pi))
    return held.select(*by, "n", "coef", F.col("inv.x").alias("cov"), F.col("_shape").alias("shape"), F.col("_rate").alias("rate"), evidence.alias("log_evidence"))


def predictive(posterior: DataFrame, steps: DataFrame, by: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """steps with mean, scale and df: Student's t of what is seen at each, a conjugate posterior at hand.

    steps has the keys `by`, or none of them, then each series sees all steps."""
    keys = [k for k in by if k in steps.columns]
    at = posterior.join(steps, keys) if keys else posterior.crossJoin(F.broadcast(steps))
    at = at.withColumn("_at", linalg.vector(columns))
    spread = F.sqrt(F.col("rate") / F.col("shape") * (1 + linalg.quadratic(F.col("cov"), F.col("_at"))))
    return at.select(*dict.fromkeys([*by, *steps.columns]), linalg.dot(F.col("coef"), F.col("_at")).alias("mean"), spread.alias("scale"), (2 * F.col("shape")).alias("df"))


def coefficient_draws(posterior: DataFrame, by: Sequence[str], size: int, draws: int, seed: int, variance: Column) -> DataFrame:
    """(by, draw, coef): draws of the coefficients given the noise variance, by the Cholesky factor of their covariance."""
    held = posterior.withColumn("_l", linalg.cholesky(F.col("cov"), size)).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    z = F.array(*(normal(key_of(seed, "coef", *(F.col(k) for k in by), F.col("draw"), F.lit(i))) for i in range(size)))
    return held.select(*by, "draw", linalg.added(F.col("coef"), linalg.times(F.col("_l"), z), F.sqrt(variance)).alias("coef"))


def poisson(rows: DataFrame, by: Sequence[str], columns: Sequence[Column], y: Column, rounds: int = 12, ridge: float = 1e-9) -> DataFrame:
    """(by, n, coef, se, step): Poisson regression with a log link, by reweighted least squares.

    Each round is one aggregation of weighted moments by series, and a solve a series; its coefficients are written to
    the shared folder, so a round reads the rows once and recomputes none before.  The first round starts at
    ln(y + 1/2).  step is the largest change of a coefficient in the last round.  Means are held below e**30, where a
    round that oversteps would overflow: the next rounds bring it back, or `step` tells that they didn't.
    """
    p = len(columns)
    design = rows.select(*by, *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)), y.cast("double").alias("_y")).dropna()
    xs = [F.col(f"_x{i}") for i in range(p)]
    small = linalg.diagonal([ridge] * p)
    coef: DataFrame | None = None
    for r in range(rounds):
        at = design
        if coef is None:
            at = at.withColumn("_mu", F.col("_y") + 0.5)
        else:
            at = at.join(coef.select(*by, "coef"), list(by)) if by else at.crossJoin(F.broadcast(coef.select("coef")))
            eta = sum((F.get("coef", F.lit(i)) * x for i, x in enumerate(xs)), F.lit(0.0))
            at = at.withColumn("_mu", F.exp(F.least(eta, F.lit(30.0))))
        z = F.ln("_mu") + (F.col("_y") - F.col("_mu")) / F.col("_mu")
        held = moments(at, by, xs, z, F.col("_mu")).withColumn("_inv", linalg.inverse(linalg.plus(F.col("xx"), small), p)["x"])
        now = held.select(*by, "n", linalg.times(F.col("_inv"), F.col("xy")).alias("coef"), F.array(*(F.sqrt(linalg.at(F.col("_inv"), i, i)) for i in range(p))).alias("se"))
        if coef is None:
            now = now.withColumn("step", F.lit(None).cast("double"))
        else:
            before = coef.select(*by, F.col("coef").alias("_before"))
            now = now.join(before, list(by)) if by else now.crossJoin(F.broadcast(before))
            now = now.withColumn("step", F.array_max(F.zip_with("coef", "_before", lambda a, b: F.abs(a - b)))).drop("_before")
        coef = stored(now, f"poisson-{r}")
    return coef


def pooled(rows: DataFrame, by: Sequence[str], columns: Sequence[Column], y: Column, pools: Sequence[str] = (), rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Partially pooled regression: (series table, pool table).

    A series' coefficients are normal about its pool's mean with the pool's covariance, and its noise has the pool's
    variance; `pools` are some of the keys `by` (none: one pool).  Rows are read once, for moments by series.  Each
    round of EM is then one aggregation of the series' posteriors by pool: an exchange of a few numbers a task, however
    many series there are; every TOGETHER rounds the parameters are written to the shared folder.

    Series: by, n, coef, cov (posterior mean and covariance).  Pools: pools, centre, spread, noise, series.  It starts
    from least squares over all rows of a pool, with a covariance of the coefficients' squares plus 1 on the diagonal.
    A series without whole rows isn't there.  rounds has to be 1 or more.
    """
    p = len(columns)
    held = stored(moments(rows, by, columns, y), "pooled-moments")
    one = [*pools] or ["_pool"]
    held = held if pools else held.withColumn("_pool", F.lit(0))
    add = lambda name: F.array(*(F.array(*(F.sum(linalg.at(F.col(name), i, j)) for j in range(p))) for i in range(p)))
    each = lambda name: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(p)))
    whole = held.groupBy(*one).agg(add("xx").alias("xx"), each("xy").alias("xy"), F.sum("yy").alias("yy"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("series"))
    whole = whole.withColumn("centre", linalg.times(linalg.inverse(linalg.plus(F.col("xx"), linalg.diagonal([1e-9] * p)), p)["x"], F.col("xy")))
    wide = F.transform("centre", lambda c, i: F.transform("centre", lambda e, j: F.when(i == j, 1 + c * e).otherwise(F.lit(0.0))))
    noise = (F.col("yy") - linalg.dot(F.col("centre"), F.col("xy"))) / F.col("n")
    pool = stored(whole.select(*one, "centre", wide.alias("spread"), noise.alias("noise"), "series"), "pooled-0")
    # expressions are made once and used in every round
    second = linalg.plus(F.col("cov"), linalg.outer(F.col("coef"), F.col("coef")))
    left = F.col("yy") - 2 * linalg.dot(F.col("coef"), F.col("xy")) + linalg.inner(F.col("xx"), F.col("second"))
    sums = (each("coef").alias("c"), add("second").alias("s"), F.sum("left").alias("left"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("series"))
    centre = F.transform("c", lambda x: x / F.col("series"))
    spread = F.zip_with("s", "centre", lambda row, a: F.zip_with(row, "centre", lambda x, b: x / F.col("series") - a * b))
    told = (*one, "centre", spread.alias("spread"), (F.col("left") / F.col("n")).alias("noise"), "series")
    posterior = _posterior(p)
    for r in range(rounds):
        m = _series(held, pool, one, posterior)
        pool = m.withColumn("second", second).withColumn("left", left).groupBy(*one).agg(*sums).withColumn("centre", centre).select(*told)
        # a round uses the one before once, so a few make one plan
        if (r + 1) % TOGETHER == 0 or r + 1 == rounds:
            pool = stored(pool, f"pooled-{r + 1}")
    out = _series(held, pool, one, posterior)
    return out.select(*by, "n", "coef", "cov"), pool.drop("_pool")


def _posterior(p: int) -> tuple[Column, Column, Column]:
    """The prior precision of a pool, and a series' covariance and coefficients given it."""
    cov = linalg.inverse(linalg.plus(linalg.scaled(F.col("xx"), 1 / F.col("noise")), F.col("_prior")), p)["x"]
    right = linalg.added(linalg.times(F.col("_prior"), F.col("centre")), F.col("xy"), 1 / F.col("noise"))
    return linalg.inverse(F.col("spread"), p)["x"], cov, linalg.times(F.col("cov"), right)


def _series(held: DataFrame, pool: DataFrame, one: Sequence[str], posterior: tuple[Column, Column, Column]) -> DataFrame:
    """Each series' posterior given its pool."""
    prior, cov, coef = posterior
    return held.join(pool.withColumn("_prior", prior).drop("series"), list(one)).withColumn("cov", cov).withColumn("coef", coef)
