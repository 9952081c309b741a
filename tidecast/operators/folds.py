"""State recursions as array folds: one row a series, no window and no Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.names import POS


def paths(series: DataFrame, keys: Sequence[str], value: str = "y") -> DataFrame:
    """(keys, path): each key's values in order of pos."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(POS), F.col(value).alias("v"))))
    return series.groupBy(*keys).agg(F.transform(rows, lambda r: r["v"]).alias("path"))


#: States that a fold appends to one array at a time.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(path: Column, init: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column], Column]) -> Column:
    """The emitted states of a left fold over an array.

    States gather by blocks, so that a path of n costs n * BLOCK appends at most and not n * n.
    """
    empty = F.transform(F.slice(path, 1, 0), lambda v: emit(step(init, v)))

    def one(acc: Column, v: Column) -> Column:
        return let(step(acc["s"], v), lambda now: F.struct(now.alias("s"), F.concat(acc["out"], F.array(emit(now))).alias("out")))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["s"].alias("s"), F.slice(acc["none"], 1, 0).alias("out")), one)
        return let(inner, lambda got: F.struct(got["s"].alias("s"), F.concat(acc["out"], F.array(got["out"])).alias("out"), acc["none"].alias("none")))

    def over(p: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(p), F.lit(BLOCK)), lambda at: at < F.size(p))
        parts = F.transform(starts, lambda at: F.slice(p, at + 1, BLOCK))
        start = F.struct(init.alias("s"), F.slice(F.array(empty), 1, 0).alias("out"), empty.alias("none"))
        return F.flatten(F.aggregate(parts, start, block, lambda acc: acc["out"]))

    return let(path, over)


def ar1(noise: Column, start: Column, phi: float, sigma: float) -> Column:
    """x[t] = phi * x[t - 1] + sigma * noise[t], from start."""
    return scan(noise, start.cast("double"), lambda s, e: F.lit(phi) * s + F.lit(sigma) * e, lambda s: s)


def kalman_local_level(path: Column, obs_var: float, level_var: float, mean0: float = 0.0, var0: float = 1e6) -> Column:
    """Filtered (m, p) of a local level, and log likelihood terms ll, at each step."""
    init = F.struct(F.lit(mean0).alias("m"), F.lit(var0).alias("p"), F.lit(0.0).alias("ll"))

    def step(s: Column, y: Column) -> Column:
        prior = s["p"] + F.lit(level_var)
        f = prior + F.lit(obs_var)
        gain = prior / f
        err = y - s["m"]
        return F.struct((s["m"] + gain * err).alias("m"), (prior * (1 - gain)).alias("p"), (F.lit(-0.5) * (F.ln(F.lit(6.283185307179586) * f) + err * err / f)).alias("ll"))

    return scan(path, init, step, lambda s: s)


def holt_winters_damped(path: Column, alpha: float, beta: float, gamma: float, phi: float, season: int) -> Column:
    """One-step-ahead means of damped additive Holt-Winters with one source of error.

    The season is an array whose first entry is the next step's; each step puts the new one at its end.
    """
    init = F.struct(F.get(path, F.lit(0)).alias("level"), F.lit(0.0).alias("trend"), F.array_repeat(F.lit(0.0), season).alias("season"), F.lit(0.0).alias("mu"))

    def step(s: Column, y: Column) -> Column:
        drift = s["level"] + F.lit(phi) * s["trend"]
        now = F.get(s["season"], F.lit(0))
        mu = drift + now
        err = y - mu
        later = F.concat(F.slice(s["season"], 2, season - 1), F.array(now + F.lit(gamma) * err))
        return F.struct((drift + F.lit(alpha) * err).alias("level"), (F.lit(phi) * s["trend"] + F.lit(beta) * err).alias("trend"), later.alias("season"), mu.alias("mu"))

    return scan(path, init, step, lambda s: s["mu"])
