"""Filter, smoother, gaps and horizons against the joint normal distribution of all states."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError
from tidecast.operators import state_space as ss

P = {"level_0": 0.3, "level_1": 0.02, "season": 0.05, "obs": 1.1}
MODEL = ss.StateSpace([ss.LevelTrend(2), ss.Seasonal(3), ss.Regression(1)], var0=50.0)


def joint(t, q, z, y, var0, h):
    """(states, their covariance, log likelihood) by one normal distribution over all steps; t, q, z by step."""
    n, m = len(y), len(z[0])
    covs, p = [], var0 * np.eye(m)
    for k in range(n):
        p = t[k] @ p @ t[k].T + q[k]
        covs.append(p)
    c = np.zeros((n * m, n * m))
    for i in range(n):
        b = covs[i]
        for j in range(i, n):
            b = b if j == i else t[j] @ b
            c[j * m : (j + 1) * m, i * m : (i + 1) * m], c[i * m : (i + 1) * m, j * m : (j + 1) * m] = b, b.T
    big = np.zeros((n, n * m))
    for k in range(n):
        big[k, k * m : (k + 1) * m] = z[k]
    seen = [k for k in range(n) if y[k] is not None]
    zo, yo = big[seen], np.array([y[k] for k in seen], float)
    v = zo @ c @ zo.T + h * np.eye(len(seen))
    gain = c @ zo.T @ np.linalg.inv(v)
    ll = -0.5 * (len(seen) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + yo @ np.linalg.solve(v, yo)) if seen else 0.0
    return gain @ yo, c - gain @ zo @ c, ll, big


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for s, n in ((0, 30), (1, 7), (2, 1), (3, 4)):
        for t in range(n):
            gone = s == 3 or (s == 0 and (t in (0, 5, 6) or t >= 26))
            out.append((s, t, None if gone else float(4 + 0.3 * t + 2 * math.sin(t) + rng.normal()), math.sin(t)))
    return out


@pytest.fixture(scope="module")
def paths(spark, rows):
    return ss.steps(spark.createDataFrame(rows, "s int, pos long, y double, x double").repartition(3), ["s"], covariates=["x"]).cache()


def matrices(xs):
    t = np.zeros((5, 5))
    t[0, :2], t[1, 1], t[2, 2:4], t[3, 2], t[4, 4] = 1, 1, -1, 1, 1
    return [t] * len(xs), [np.diag([0.3, 0.02, 0.05, 0, 0])] * len(xs), [[1, 0, 1, 0, x] for x in xs]


def test_filter_and_smoother_are_the_joint_normals(paths, rows):
    filtered = ss.filtered(paths, ["s"], MODEL, P).orderBy("s", "pos").toPandas()
    smooth = ss.smoothed(paths, ["s"], MODEL, P).orderBy("s", "pos").toPandas()
    for s in range(4):
        its = [r for r in rows if r[0] == s]
        y, xs = [r[2] for r in its], [r[3] for r in its]
        a, c, ll, z = joint(*matrices(xs), y, 50.0, 1.1)
        f, g = filtered[filtered.s == s], smooth[smooth.s == s]
        assert np.isclose(f.ll.sum(), ll) and np.allclose(np.array(g.a.to_list()).ravel(), a, atol=1e-6)
        assert np.allclose(g["mean"], z @ a, atol=1e-6) and np.allclose(g["variance"], np.diag(z @ c @ z.T), atol=1e-5)
        for k in range(len(y)):
            before, cov, _, z1 = joint(*(m[: k + 1] for m in matrices(xs)), [*y[:k], None], 50.0, 1.1)
            assert np.isclose(f["mean"].iloc[k], (z1 @ before)[k], atol=1e-6) and np.isclose(f.f.iloc[k], (z1 @ cov @ z1.T)[k, k] + 1.1, rtol=1e-6)
    assert filtered.v.isna().sum() == sum(r[2] is None for r in rows)


def test_an_exponential_kernel_with_uneven_gaps_is_learned_in_linear_time(spark):
    rng = np.random.default_rng(8)
    at = np.cumsum(rng.choice([0.5, 1.0, 3.0], 25))
    cov = 2.0 * np.exp(-np.abs(at[:, None] - at[None]) / 4.0)
    y = np.linalg.cholesky(cov + 0.1 * np.eye(25)) @ rng.normal(size=25)
    rows = [(1, k, float(v), float(g)) for k, (v, g) in enumerate(zip(y, np.diff(at, prepend=at[0])))]
    paths = ss.steps(spark.createDataFrame(rows, "s int, pos long, y double, gap double"), ["s"], covariates=["gap"])
    grid = [(v, c, 0.1) for v in (0.5, 2.0, 8.0) for c in (1.0, 4.0, 16.0)]
    for var, scale, obs in grid:
        model = ss.StateSpace([ss.Decay(gap=0)], var0=var)
        got = ss.filtered(paths, ["s"], model, {"decay_var": var, "decay_scale": scale, "obs": obs}).agg(F.sum("ll")).first()[0]
        k = var * np.exp(-np.abs(at[:, None] - at[None]) / scale) + obs * np.eye(25)
        assert np.isclose(got, -0.5 * (25 * math.log(2 * math.pi) + np.linalg.slogdet(k)[1] + y @ np.linalg.solve(k, y)))


def test_grids_of_parameters_and_their_posterior(spark, paths):
    grid = spark.createDataFrame([(a, b) for a in (0.1, 1.0) for b in (0.5, 2.0)], "level_0 double, obs double")
    model = ss.StateSpace([ss.LevelTrend(1)], var0=50.0)
    found = ss.likelihoods(paths, ["s"], model, grid).cache()
    table = found.toPandas()
    best = ss.most_likely(found, ["s"], ["level_0", "obs"]).toPandas().set_index("s")
    weights = ss.posterior(found, ["s"], ["level_0", "obs"]).toPandas()
    assert np.allclose(weights.groupby("s").weight.sum(), 1) and len(best) == 4
    for s, g in table.groupby("s"):
        top = g.sort_values(["loglik", "level_0", "obs"], ascending=[False, True, True]).iloc[0]
        assert (best.loc[s].level_0, best.loc[s].obs) == (top.level_0, top.obs)
    ahead = ss.forecast(paths, ["s"], model, ss.posterior(found, ["s"], ["level_0", "obs"])).toPandas()
    one = {tuple(r): ss.filtered(paths, ["s"], model, dict(zip(("level_0", "obs"), r))).filter("y is null").toPandas() for r in [(a, b) for a in (0.1, 1.0) for b in (0.5, 2.0)]}
    for _, r in ahead.iterrows():
        w = weights[weights.s == r.s].set_index(["level_0", "obs"]).weight
        cells = {k: v[(v.s == r.s) & (v.pos == r.pos)].iloc[0] for k, v in one.items()}
        mean = sum(w[k] * c["mean"] for k, c in cells.items())
        assert np.isclose(r["mean"], mean) and np.isclose(r["variance"], sum(w[k] * (c.f + c["mean"] ** 2) for k, c in cells.items()) - mean**2)


def test_unknown_covariates_and_missing_variances(spark, paths):
    rows = [(1, 0, 1.0, None), (1, 1, 2.0, 1.0)]
    odd = ss.steps(spark.createDataFrame(rows, "s int, pos long, y double, x double"), ["s"], covariates=["x"])
    model = ss.StateSpace([ss.LevelTrend(1), ss.Regression(1)])
    a, b = ss.filtered(odd, ["s"], model, {"level_0": 1.0, "obs": 1.0}).orderBy("pos").collect()
    assert a["mean"] is None and a.ll == 0.0 and b.v is not None
    with pytest.raises(AlignmentError):
        ss.filtered(paths, ["s"], model, {"obs": 1.0})
    still = ss.StateSpace([ss.LevelTrend(2, innovations=(True, False))])
    assert ss.filtered(paths, ["s"], still, {"level_0": 1.0, "obs": 1.0}).count() == 42
    assert ss.filtered(paths.filter("false"), ["s"], still, {"level_0": 1.0, "obs": 1.0}).count() == 0
