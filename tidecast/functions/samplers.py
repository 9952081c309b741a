"""Gamma, beta, Poisson and multivariate normal numbers as Columns: functions of their key, like those of rng.

Rejection takes candidates from a counter stream: the key with a number after it.  The first FEW are looked at; only
where none will do, MORE are, and where none of those does, the row raises.  A candidate fails with probability below
0.15, so the first bound is passed once in millions of rows, and the second never.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.functions import linalg
from tidecast.functions.rng import normal, uniforms
from tidecast.functions.special import log_gamma

FEW, MORE = 8, 128
#: Up to this rate Poisson counts come by inversion.
SMALL_RATE = 10.0


def _numbered(key: Column, i: Column) -> Column:
    return F.concat_ws("|", key, i.cast("string"))


def _first(key: Column, candidate: Callable[[Column], Column]) -> Column:
    """The first candidate that isn't null, by number from 0."""
    tried = lambda lo, hi: F.aggregate(F.sequence(F.lit(lo), F.lit(hi - 1)), F.lit(None).cast("double"), lambda got, i: F.coalesce(got, candidate(_numbered(key, i))))
    return F.coalesce(tried(0, FEW), tried(FEW, MORE), F.raise_error(F.lit("no candidate was accepted")).cast("double"))


def gamma(key: Column, shape: Column) -> Column:
    """A gamma number of rate 1, by Marsaglia's and Tsang's cubes; a shape below 1 takes one of shape + 1 down by a power.

    Null for a shape that isn't above 0."""
    shape = shape.cast("double")

    def from_one_up(a: Column) -> Column:
        d = a - F.lit(1 / 3)

        def candidate(k: Column) -> Column:
            def tested(c: Column) -> Column:
                v = F.pow(1 + c["z"] / F.sqrt(9 * d), F.lit(3.0))
                return F.when((v > 0) & (F.ln(c["u"]) < 0.5 * c["z"] * c["z"] + d - d * v + d * F.ln(v)), d * v)

            return linalg.let(F.struct(normal(k).alias("z"), uniforms(F.concat_ws("|", k, F.lit("u")))[0].alias("u")), tested)

        return _first(key, candidate)

    boost = F.when(shape < 1, F.pow(uniforms(F.concat_ws("|", key, F.lit("boost")))[0], 1 / shape)).otherwise(F.lit(1.0))
    return F.when(shape > 0, linalg.let(F.when(shape < 1, shape + 1).otherwise(shape), from_one_up) * boost)


def beta(key: Column, a: Column, b: Column) -> Column:
    """A beta number: one gamma number's part of two."""
    return linalg.let(gamma(F.concat_ws("|", key, F.lit("a")), a), lambda x: x / (x + gamma(F.concat_ws("|", key, F.lit("b")), b)))


def inverse_gamma(key: Column, shape: Column, rate: Column) -> Column:
    return rate / gamma(key, shape)


def poisson(key: Column, rate: Column) -> Column:
    """A Poisson count, as a double: by inversion up to SMALL_RATE, else by Hoermann's transformed rejection, which is
    exact at any rate.  Null for a rate below 0 or of no number."""
    rate = rate.cast("double")

    def inverted(lam: Column) -> Column:
        u = uniforms(key)[0]
        start = F.struct(F.lit(0.0).alias("k"), F.exp(-lam).alias("p"), F.exp(-lam).alias("s"))
        # u has 32 bits: no count above 64 is reached at these rates
        step = lambda s, i: F.when(u <= s["s"], s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["p"] * lam / (s["k"] + 1)).alias("p"), (s["s"] + s["p"] * lam / (s["k"] + 1)).alias("s")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["k"])

    def rejected(lam: Column) -> Column:
        b = 0.931 + 2.53 * F.sqrt(lam)
        a = -0.059 + 0.02483 * b
        inverse = 1.1239 + 1.1328 / (b - 3.4)
        top = 0.9277 - 3.6224 / (b - 2)

        def candidate(k: Column) -> Column:
            u, v = uniforms(k)

            def tested(c: Column) -> Column:
                us = 0.5 - F.abs(c["u"])
                n = F.floor((2 * a / us + b) * c["u"] + lam + 0.43).cast("double")
                inside = (us >= 0.07) & (c["v"] <= top)
                out = (n < 0) | ((us < 0.013) & (c["v"] > us))
                exact = F.ln(c["v"] * inverse / (a / (us * us) + b)) <= n * F.ln(lam) - lam - log_gamma(n + 1)
                return F.when(inside, n).when(~out & exact, n)

            return linalg.let(F.struct((u - 0.5).alias("u"), v.alias("v")), tested)

        return _first(key, candidate)

    return F.when(rate == 0, F.lit(0.0)).when((rate > 0) & (rate <= SMALL_RATE), inverted(rate)).when(rate > SMALL_RATE, rejected(rate))


def multivariate_normal(key: Column, mean: Column, covariance: Column, size: int) -> Column:
    """An array of `size` numbers with this mean and covariance, by its Cholesky factor."""
    z = F.array(*(normal(_numbered(key, F.lit(i))) for i in range(size)))
    return linalg.added(mean, linalg.times(linalg.cholesky(covariance, size), z))


def student(key: Column, degrees: Column) -> Column:
    """A Student number of any degrees of freedom, which may differ by row."""
    return normal(key) * F.sqrt(degrees / (2 * gamma(F.concat_ws("|", key, F.lit("chi")), degrees / 2)))



def zero_sum_normal(key: Column, sigma: Column, size: int) -> Column:
    """An array of `size` numbers that sum to 0: normal ones of this deviation less their mean."""
    z = F.array(*(normal(_numbered(key, F.lit(i))) for i in range(size)))
    return linalg.let(z, lambda v: linalg.let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / size, lambda m: F.transform(v, lambda x: sigma * (x - m))))
