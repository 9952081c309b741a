"""Numpy inference kernels, run in Arrow-fed tasks: one task holds one group of series, never a whole table."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.names import POS

Target = Callable[[np.ndarray], tuple[float, np.ndarray]]


def numeric(logp: Callable[[np.ndarray], float], step: float = 1e-5) -> Target:
    """A target from a log density alone, by central differences; for few parameters."""

    def both(x: np.ndarray) -> tuple[float, np.ndarray]:
        g = np.array([(logp(x + e) - logp(x - e)) / (2 * step) for e in np.eye(len(x)) * step])
        return logp(x), g

    return both


def conditional_mvn(loc: np.ndarray, cov: np.ndarray, observed: np.ndarray, jitter: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of what follows `observed` in a normal vector."""
    n = len(observed)
    cov = (cov + cov.T) / 2 + jitter * np.eye(len(cov))
    root = np.linalg.cholesky(cov[:n, :n])
    half = np.linalg.solve(root, cov[:n, n:])
    mean = loc[n:] + half.T @ np.linalg.solve(root, observed - loc[:n])
    rest = cov[n:, n:] - half.T @ half
    return mean, (rest + rest.T) / 2 + jitter * np.eye(len(rest))


def _gp(series: DataFrame, keys: Sequence[str], horizon: int, kernel: Callable[[int], float], jitter: float, value: str, columns: Callable[..., dict], fields: str) -> DataFrame:
    """columns(future positions, mean, covariance, key) of each series' exact conditional, beside its keys."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(POS)
        y, at = frame[value].to_numpy(float), frame[POS].to_numpy()
        where = np.concatenate([at, at[-1] + 1 + np.arange(horizon)])
        # a stationary kernel is asked once for each gap
        gaps, place = np.unique(np.subtract.outer(where, where), return_inverse=True)
        cov = np.array([kernel(int(g)) for g in gaps])[place.reshape(len(where), len(where))]
        mean, var = conditional_mvn(np.full(len(where), y.mean()), cov, y, jitter)
        key = [frame[k].iloc[0] for k in keys]
        out = columns(where[len(at) :], mean, var, key)
        return pd.DataFrame({**{k: [v] * len(out[POS]) for k, v in zip(keys, key)}, **out})

    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    rows = series.select(*keys, POS, value)
    return rows.groupBy(*(keys or [F.lit("all")])).applyInPandas(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + fields)


def gp_forecast(series: DataFrame, keys: Sequence[str], horizon: int, kernel: Callable[[int], float], jitter: float = 1e-6, value: str = "y") -> DataFrame:
    """(keys, pos, mean, variance): the exact conditional of each series under a stationary kernel around its mean."""
    return _gp(series, keys, horizon, kernel, jitter, value, lambda at, mean, var, key: {POS: at, "mean": mean, "variance": np.diag(var)}, f"{POS} long, mean double, variance double")


def gp_samples(series: DataFrame, keys: Sequence[str], horizon: int, kernel: Callable[[int], float], num_samples: int = 100, seed: int = 0, jitter: float = 1e-6, value: str = "y") -> DataFrame:
    """(keys, chain, draw, pos, forecast): joint draws of gp_forecast's conditional, seeded by the series' keys."""

    def paths(at: np.ndarray, mean: np.ndarray, var: np.ndarray, key: list) -> dict:
        word = int.from_bytes(hashlib.md5(repr((seed, [str(k) for k in key])).encode()).digest()[:8], "little")
        drawn = mean + np.random.default_rng(word).standard_normal((num_samples, horizon)) @ np.linalg.cholesky(var).T
        return {"chain": 0, "draw": np.repeat(np.arange(num_samples), horizon), POS: np.tile(at, num_samples), "forecast": drawn.ravel()}

    return _gp(series, keys, horizon, kernel, jitter, value, paths, f"chain int, draw long, {POS} long, forecast double")


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def advi(target: Target, dim: int, rng: np.random.Generator, steps: int = 2000, rate: float = 0.01, full_rank: bool = False, start: np.ndarray | None = None) -> tuple[Callable[[int], np.ndarray], np.ndarray]:
    """Variational normal by Adam on one reparametrised draw a step: (sampler, losses).

    Mean field has scales softplus(rho); full rank a lower triangle.  A step that isn't finite has no gradient, and its
    loss repeats the last finite one.
    """
    mean = np.zeros(dim) if start is None else start.copy()
    low = np.tril_indices(dim, -1)
    rho, off = np.full(dim, -2.0), np.zeros(len(low[0]) if full_rank else 0)
    params = np.concatenate([mean, rho, off])
    m, v = np.zeros_like(params), np.zeros_like(params)
    losses, last = np.empty(steps), np.nan

    def root(p: np.ndarray) -> np.ndarray:
        out = np.diag(softplus(p[dim : 2 * dim]))
        if full_rank:
            out[low] = p[2 * dim :]
        return out

    for t in range(1, steps + 1):
        e = rng.standard_normal(dim)
        scale = softplus(params[dim : 2 * dim])
        x = params[:dim] + (root(params) @ e if full_rank else scale * e)
        with np.errstate(all="ignore"):
            logp, g = target(x)
        loss = -logp - np.log(scale).sum() - 0.5 * (e @ e) - 0.5 * dim * np.log(2 * np.pi)
        slope = 1 / (1 + np.exp(-params[dim : 2 * dim]))
        grad = np.concatenate([-g, (-g * e - 1 / scale) * slope, -np.outer(g, e)[low] if full_rank else off])
        if not (np.isfinite(loss) and np.isfinite(grad).all()):
            grad, loss = np.zeros_like(params), last
        last, losses[t - 1] = loss, loss
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    final, lower = params[:dim], root(params)
    return (lambda n: final + rng.standard_normal((n, dim)) @ lower.T), losses


def nuts(target: Target, start: np.ndarray, rng: np.random.Generator, draws: int, tune: int, depth: int = 8, accept: float = 0.8) -> np.ndarray:
    """Draws by the no-U-turn sampler with multinomial choice, dual-averaged step size and a diagonal metric."""
    x, dim = start.astype(float), len(start)
    inverse = np.ones(dim)
    logp, g = target(x)
    eps, mu, bar, hbar = 0.1, np.log(1.0), 0.0, 0.0
    seen: list[np.ndarray] = []
    out = np.empty((draws, dim))
    count = 0
    for it in range(tune + draws):
        p = rng.standard_normal(dim) / np.sqrt(inverse)
        h0 = logp - 0.5 * (p * p * inverse).sum()
        tree = [0.0, 0]

        def leap(x, p, g, way):
            p = p + 0.5 * way * eps * g
            x = x + way * eps * inverse * p
            with np.errstate(all="ignore"):
                logp, g = target(x)
            return x, p + 0.5 * way * eps * g, logp, g

        def build(x, p, g, way, d):
            # ends left and right, a proposal, log weight, whether to go on
            if d == 0:
                x, p, lp, g = leap(x, p, g, way)
                w = lp - 0.5 * (p * p * inverse).sum() - h0
                w = w if np.isfinite(w) else -np.inf
                tree[0] += min(1.0, np.exp(min(w, 0)))
                tree[1] += 1
                end = (x, p, g)
                return end, end, (x, lp, g), w, w > -1000
            l1, r1, c1, w1, ok = build(x, p, g, way, d - 1)
            if not ok:
                return l1, r1, c1, w1, False
            l2, r2, c2, w2, ok = build(*(r1 if way > 0 else l1), way, d - 1)
            w = np.logaddexp(w1, w2)
            if np.log(rng.random()) < w2 - w:
                c1 = c2
            l, r = (l1, r2) if way > 0 else (l2, r1)
            gap = r[0] - l[0]
            return l, r, c1, w, ok and gap @ l[1] >= 0 and gap @ r[1] >= 0

        left = right = (x, p, g)
        weight = 0.0
        for d in range(depth):
            way = 1 if rng.random() < 0.5 else -1
            l, r, c, w, ok = build(*(right if way > 0 else left), way, d)
            if ok and np.log(rng.random()) < w - weight:
                x, logp, g = c
            weight = np.logaddexp(weight, w)
            left, right = (left, r) if way > 0 else (l, right)
            gap = right[0] - left[0]
            if not ok or gap @ left[1] < 0 or gap @ right[1] < 0:
                break
        if it < tune:
            count += 1
            hbar += (accept - tree[0] / max(tree[1], 1) - hbar) / (count + 10)
            step = mu - np.sqrt(count) / 0.05 * hbar
            bar = count**-0.75 * step + (1 - count**-0.75) * bar
            eps = float(np.exp(np.clip(step, -12, 3)))
            seen.append(x)
            if it == tune // 2 and len(seen) > 10:
                inverse = np.var(np.array(seen[len(seen) // 2 :]), axis=0) + 1e-6
                count, hbar, bar, mu = 0, 0.0, 0.0, np.log(10 * eps)
            if it == tune - 1:
                eps = float(np.exp(np.clip(bar, -12, 3)))
        else:
            out[it - tune] = x
    return out


def pathfinder(target: Target, start: np.ndarray, rng: np.random.Generator, iterations: int = 100, tries: int = 20) -> Callable[[int], np.ndarray]:
    """Quasi-Newton path to the mode; the normal along it with the best evidence bound is the approximation."""
    x, dim = start.astype(float), len(start)
    logp, g = target(x)
    h = np.eye(dim) / max(1.0, np.linalg.norm(g))
    best = (-np.inf, x, np.eye(dim) * 0.1)
    for _ in range(iterations):
        way, t = h @ g, 1.0
        while t > 1e-8:
            new, grad = target(x + t * way)
            if np.isfinite(new) and new >= logp + 1e-4 * t * (g @ way):
                break
            t /= 2
        else:
            break
        s, y = t * way, g - grad
        x, logp, g = x + s, new, grad
        if s @ y > 1e-10:
            r = 1 / (s @ y)
            a = np.eye(dim) - r * np.outer(s, y)
            h = a @ h @ a.T + r * np.outer(s, s)
        try:
            root = np.linalg.cholesky((h + h.T) / 2 + 1e-10 * np.eye(dim))
        except np.linalg.LinAlgError:
            continue
        e = rng.standard_normal((tries, dim))
        at = x + h @ g + e @ root.T
        bound = np.mean([target(a)[0] for a in at]) + np.log(np.diag(root)).sum()
        if np.isfinite(bound) and bound > best[0]:
            best = (bound, x + h @ g, root)
        if np.linalg.norm(g) < 1e-5:
            break
    _, centre, root = best
    return lambda n: centre + rng.standard_normal((n, dim)) @ root.T


def kalman_loglik(y: np.ndarray, obs_var: float, level_var: float, mean0: float, var0: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, filtered means and variances of a local level."""
    m, p, total = mean0, var0, 0.0
    ms, ps = np.empty(len(y)), np.empty(len(y))
    for t, v in enumerate(y):
        p = p + level_var
        f = p + obs_var
        err = v - m
        total -= 0.5 * (np.log(2 * np.pi * f) + err * err / f)
        m, p = m + p / f * err, p * (1 - p / f)
        ms[t], ps[t] = m, p
    return total, ms, ps


def kalman_score(y: np.ndarray, obs_var: float, level_var: float, mean0: float, var0: float) -> tuple[float, np.ndarray, float, float]:
    """The log likelihood of a local level and its derivatives by y, by obs_var and by level_var, in two passes."""
    m, p, total = mean0, var0, 0.0
    seen = []
    for v in y.tolist():
        prior = p + level_var
        f = prior + obs_var
        err, gain = v - m, prior / f
        total -= 0.5 * (math.log(2 * math.pi * f) + err * err / f)
        m, p = m + gain * err, prior * obs_var / f
        seen.append((prior, f, err, gain))
    d_m = d_p = d_obs = d_level = 0.0
    by_y = np.empty(len(y))
    for t in range(len(seen) - 1, -1, -1):
        prior, f, err, gain = seen[t]
        d_gain, d_err = d_m * err, d_m * gain - err / f
        d_f = -0.5 / f + 0.5 * err * err / (f * f) - (d_p * prior * obs_var + d_gain * prior) / (f * f)
        d_prior = (d_p * obs_var + d_gain) / f + d_f
        d_obs += d_p * prior / f + d_f
        by_y[t] = d_err
        d_level += d_prior
        d_m, d_p = d_m - d_err, d_prior
    return total, by_y, d_obs, d_level


def smooth_level(ms: np.ndarray, ps: np.ndarray, level_var: float, rng: np.random.Generator) -> np.ndarray:
    """One draw of the level's path given all observations, backwards from the filter."""
    out = np.empty(len(ms))
    out[-1] = ms[-1] + np.sqrt(ps[-1]) * rng.standard_normal()
    for t in range(len(ms) - 2, -1, -1):
        gain = ps[t] / (ps[t] + level_var)
        out[t] = ms[t] + gain * (out[t + 1] - ms[t]) + np.sqrt(ps[t] * (1 - gain)) * rng.standard_normal()
    return out
