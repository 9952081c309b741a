"""Diagnostics of fits: whether a variational loss still falls, effective sample size, R-hat."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.linalg import dot, let


def elbo_convergence(losses: DataFrame, steps: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, fall, mad, still_falling, assessed) of each history (by, step from 0, loss): fall is the median of the window
    that begins at the midpoint less that of the last one.

    The windows hold a tenth of the steps, 10 at least; a loss falls still when it fell by more than the last window's
    median absolute deviation and twice the standard error of a difference of medians.  Overlapping windows, or a loss
    anywhere that isn't finite, can't be assessed.  steps: their number, where it isn't each history's own.
    """
    by = list(by)
    bad = F.col("loss").isNull() | F.isnan("loss") | (F.abs("loss") == float("inf"))
    whole = losses.groupBy(*by).agg((F.count(F.lit(1)) if steps is None else F.lit(steps)).cast("long").alias("_steps"), F.count_if(bad).alias("_bad"))
    whole = whole.withColumn("_n", F.greatest(F.floor(F.col("_steps") / 10), F.lit(10)).cast("long")).withColumn("_mid", F.floor(F.col("_steps") / 2).cast("long"))
    beside = lambda rows, one: rows.join(one, by) if by else rows.crossJoin(F.broadcast(one))
    late = F.col("step") >= F.col("_steps") - F.col("_n")
    window = beside(losses, whole).withColumn("_late", late).withColumn("_middle", (F.col("step") >= F.col("_mid")) & (F.col("step") < F.col("_mid") + F.col("_n"))).filter("_late or _middle")
    medians = window.groupBy(*by).agg(F.median(F.when(F.col("_late"), F.col("loss"))).alias("_l"), F.median(F.when(F.col("_middle"), F.col("loss"))).alias("_m"))
    out = beside(window.filter("_late"), medians).groupBy(*by).agg(F.median(F.abs(F.col("loss") - F.col("_l"))).alias("mad"), *(F.first(c).alias(c) for c in ("_l", "_m", "_n", "_mid", "_steps", "_bad")))
    ok = (F.col("_bad") == 0) & (F.col("_mid") + F.col("_n") <= F.col("_steps") - F.col("_n"))
    threshold = F.greatest(F.col("mad"), F.lit(2 * 1.858) * F.col("mad") * F.sqrt(F.lit(2.0) / F.col("_n")))
    fall = F.col("_m") - F.col("_l")
    return out.select(*by, fall.alias("fall"), "mad", F.coalesce(ok & (fall > threshold), F.lit(False)).alias("still_falling"), ok.alias("assessed"))


def still_falling(losses: np.ndarray) -> bool | None:
    """elbo_convergence()'s rule on one fit's losses; None where windows overlap or a loss isn't finite."""
    steps = len(losses)
    n = max(steps // 10, 10)
    mid = steps // 2
    if mid + n > steps - n or not np.isfinite(losses).all():
        return None
    late, middle = losses[-n:], losses[mid : mid + n]
    mad = np.median(np.abs(late - np.median(late)))
    return bool(np.median(middle) - np.median(late) > max(mad, 2 * 1.858 * mad * np.sqrt(2 / n)))


def split_rhat(chains: np.ndarray) -> float:
    """Split R-hat of draws (chain, draw)."""
    half = chains.shape[1] // 2
    x = np.concatenate([chains[:, :half], chains[:, half : 2 * half]])
    within, between = x.var(1, ddof=1).mean(), half * x.mean(1).var(ddof=1)
    return float(np.sqrt(((half - 1) / half * within + between / half) / within)) if within > 0 else float("nan")


def effective_size(chains: np.ndarray) -> float:
    """Effective sample size by Geyer's initial positive pairs of the mean autocorrelation."""
    m, n = chains.shape
    x = chains - chains.mean(1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x, size)
    acov = np.fft.irfft(f * np.conj(f), size)[:, :n].mean(0) / n
    if acov[0] <= 0:
        return float(m * n)
    rho, tau = acov / acov[0], -1.0
    for k in range(0, n - 1, 2):
        pair = rho[k] + rho[k + 1]
        if pair < 0:
            break
        tau += 2 * pair
    return float(m * n / max(tau, 1e-12))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _variance(values: Column) -> Column:
    return let(_mean(values), lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(values) - 1))


def split_rhat_of(chains: Column) -> Column:
    """split_rhat() of an array of chains of equal length; NaN below 4 draws or where halves don't vary."""

    def over(halves: Column) -> Column:
        n = F.size(F.get(halves, F.lit(0)))
        within = _mean(F.transform(halves, _variance))
        between = n * _variance(F.transform(halves, _mean))
        return let(F.struct(within.alias("w"), between.alias("b"), n.alias("n")), lambda v: F.when(v["w"] > 0, F.sqrt(((v["n"] - 1) / v["n"] * v["w"] + v["b"] / v["n"]) / v["w"])).otherwise(F.lit(float("nan"))))

    half = F.floor(F.size(F.get(chains, F.lit(0))) / 2).cast("int")
    halves = F.concat(F.transform(chains, lambda c: F.slice(c, F.lit(1), half)), F.transform(chains, lambda c: F.slice(c, half + 1, half)))
    return F.when(F.size(F.get(chains, F.lit(0))) > 3, let(halves, over)).otherwise(F.lit(float("nan")))


def effective_size_of(chains: Column) -> Column:
    """effective_size() of an array of chains of equal length: lag products until Geyer's first negative pair, and no
    further, as a fold over pairs of lags."""
    n, m = F.size(F.get(chains, F.lit(0))), F.size(chains)
    centred = F.transform(chains, lambda c: let(_mean(c), lambda mean: F.transform(c, lambda x: x - mean)))

    def over(x: Column) -> Column:
        lag = lambda k: F.aggregate(x, F.lit(0.0), lambda s, c: s + F.coalesce(dot(F.slice(c, F.lit(1), n - k), F.slice(c, k + 1, n - k)), F.lit(0.0))) / (n * m)
        start = F.struct(F.lit(-1.0).alias("tau"), F.lit(True).alias("live"))

        def pairs(zero: Column) -> Column:
            step = lambda acc, k: F.when(acc["live"], let((lag(k) + lag(k + 1)) / zero, lambda pair: F.when(pair < 0, F.struct(acc["tau"].alias("tau"), F.lit(False).alias("live"))).otherwise(F.struct((acc["tau"] + 2 * pair).alias("tau"), F.lit(True).alias("live"))))).otherwise(acc)
            lags = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(2)), lambda k: k < n - 1)
            tau = F.aggregate(lags, start, step, lambda acc: acc["tau"])
            return F.when(zero > 0, n * m / F.greatest(tau, F.lit(1e-12))).otherwise((n * m).cast("double"))

        return let(lag(F.lit(0)), pairs)

    return let(centred, over)


def hdi_of(ordered: Column, prob: float = 0.94) -> Column:
    """The shortest interval [low, high] that holds floor(prob * n) steps between an array's n values in rising order."""
    if not 0 < prob < 1:
        raise ValueError("prob must lie between 0 and 1")
    n = F.size(ordered)
    gap = F.floor(F.lit(prob) * n).cast("int")
    spans = F.transform(F.sequence(F.lit(0), n - 1 - gap), lambda i: F.struct((F.get(ordered, i + gap) - F.get(ordered, i)).alias("width"), F.get(ordered, i).alias("low"), F.get(ordered, i + gap).alias("high")))
    return F.array_min(spans)


def summary(posterior: DataFrame, parameters: Sequence[str], keys: Sequence[str] = (), prob: float = 0.94) -> DataFrame:
    """(keys, parameter, mean, sd, hdi_low, hdi_high, ess, rhat) of scalar parameters over (chain, draw).

    One row holds the draws of one parameter of one series; chains are cut to the shortest.
    """
    long = posterior.select(*keys, "chain", "draw", *(F.col(p).cast("double") for p in parameters)).unpivot([*keys, "chain", "draw"], list(parameters), "parameter", "value")
    by = [*keys, "parameter"]
    held = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.array_sort(F.collect_list("value")).alias("_v"))
    moments = held.withColumn("_h", hdi_of(F.col("_v"), prob)).select(*by, "mean", "sd", F.col("_h.low").alias("hdi_low"), F.col("_h.high").alias("hdi_high"))

    chains = long.groupBy(*by, "chain").agg(F.array_sort(F.collect_list(F.struct("draw", "value"))).alias("c")).groupBy(*by).agg(F.collect_list(F.transform("c", lambda r: r["value"])).alias("c"))
    cut = F.transform("c", lambda c: F.slice(c, 1, F.array_min(F.transform("c", F.size))))
    mixing = chains.withColumn("c", cut).select(*by, effective_size_of(F.col("c")).alias("ess"), split_rhat_of(F.col("c")).alias("rhat"))
    return moments.join(mixing, by)
