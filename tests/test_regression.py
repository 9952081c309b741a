"""Regressions from moments against numpy, with nulls, short series and hot keys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import linalg
from tidecast.plans import regression


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for s in range(24):
        coef = np.array([2.0, 0.4, -0.3]) + rng.normal(size=3) * [0.6, 0.1, 0.2]
        for t in range(2 if s == 5 else int(rng.integers(8, 40)) * (9 if s == 0 else 1)):
            x = np.array([1.0, t / 10 % 4, math.sin(t)])
            mu = float(coef @ x)
            out.append((s % 2, s, float(x[1]), float(x[2]), float(mu + 0.5 * rng.normal()), int(rng.poisson(math.exp(mu / 2)))))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    odd = [(0, 1, None, 1.0, 5.0, 1), (0, 1, 1.0, None, 5.0, 1), (1, 1, 1.0, 1.0, None, None)]
    return spark.createDataFrame(rows + odd, "g int, s int, a double, b double, y double, n int").repartition(5).cache()


def columns():
    return [F.lit(1.0), F.col("a"), F.col("b")]


def design(rows, s):
    its = [r for r in rows if r[1] == s]
    return np.array([[1.0, r[2], r[3]] for r in its]), np.array([r[4] for r in its]), np.array([r[5] for r in its], float)


def test_inverse_and_factor(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 6):
        a = rng.normal(size=(n, n + 2))
        a = a @ a.T
        df = spark.createDataFrame([(a.tolist(),)], "a array<array<double>>")
        r = df.select(linalg.inverse(F.col("a"), n).alias("i"), linalg.cholesky(F.col("a"), n).alias("l")).first()
        assert np.allclose(r.i.x, np.linalg.inv(a)) and np.isclose(r.i.logdet, np.linalg.slogdet(a)[1]) and np.allclose(r.l, np.linalg.cholesky(a))
    singular = spark.createDataFrame([([[1.0, 1.0], [1.0, 1.0]],)], "a array<array<double>>")
    assert singular.select(linalg.inverse(F.col("a"), 2)["x"].alias("x")).first().x[0][0] is None


def test_conjugate_posterior_evidence_and_forecast(spark, table, rows):
    precision, mean, shape, rate = np.array([0.1, 0.2, 0.3]), np.array([1.0, 0.0, -1.0]), 2.0, 1.5
    fit = regression.conjugate(table, ["s"], columns(), F.col("y"), list(precision), list(mean), shape, rate)
    got = {r.s: r for r in fit.collect()}
    ahead = {r.s: r for r in regression.predictive(fit, spark.createDataFrame([(0.7, -0.2)], "a double, b double"), ["s"], columns()).collect()}
    assert len(got) == 24
    for s, r in got.items():
        x, y, _ = design(rows, s)
        lam = np.diag(precision)
        post = x.T @ x + lam
        m = np.linalg.solve(post, x.T @ y + lam @ mean)
        a, b = shape + len(y) / 2, rate + 0.5 * (y @ y + mean @ lam @ mean - m @ post @ m)
        le = math.lgamma(a) - math.lgamma(shape) + shape * math.log(rate) - a * math.log(b) + 0.5 * (np.log(precision).sum() - np.linalg.slogdet(post)[1]) - len(y) / 2 * math.log(2 * math.pi)
        assert r.n == len(y) and np.allclose(r.coef, m) and np.allclose(r.cov, np.linalg.inv(post)) and np.isclose(r.shape, a) and np.isclose(r.rate, b) and np.isclose(r.log_evidence, le)
        at = np.array([1.0, 0.7, -0.2])
        assert np.isclose(ahead[s].mean, m @ at) and np.isclose(ahead[s].scale, math.sqrt(b / a * (1 + at @ np.linalg.inv(post) @ at))) and ahead[s].df == 2 * a


def test_draws_of_coefficients_have_the_posteriors_moments(table):
    fit = regression.conjugate(table.filter("s < 2"), ["s"], columns(), F.col("y"), [0.1] * 3)
    known = {r.s: r for r in fit.collect()}
    drawn = regression.coefficient_draws(fit, ["s"], 3, 4000, 7, F.lit(0.25)).collect()
    for s, r in known.items():
        c = np.array([d.coef for d in drawn if d.s == s])
        assert len(c) == 4000 and np.abs((c.mean(0) - r.coef) / np.sqrt(0.25 * np.diag(r.cov))).max() < 0.08
        white = np.linalg.inv(np.linalg.cholesky(0.25 * np.array(r.cov)))
        assert np.abs(white @ np.cov(c.T) @ white.T - np.eye(3)).max() < 0.1


def test_poisson_by_reweighted_least_squares(table, rows):
    got = {r.s: r for r in regression.poisson(table, ["s"], columns(), F.col("n"), rounds=9).collect()}
    for s, r in got.items():
        x, _, n = design(rows, s)
        if len(n) < 3:
            continue
        b = np.linalg.lstsq(x, np.log(n + 0.5), rcond=None)[0]
        for _ in range(60):
            mu = np.exp(np.minimum(x @ b, 30))
            b = b + np.linalg.solve(x.T @ (x * mu[:, None]) + 1e-9 * np.eye(3), x.T @ (n - mu))
        assert np.allclose(r.coef, b, atol=1e-6) and np.allclose(r.se, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * np.exp(x @ b)[:, None])))), atol=1e-6) and r.step < 1e-5


@pytest.mark.parametrize("pools", [[], ["g"]])
def test_pooled_fit_is_that_of_plain_rounds(table, rows, pools):
    series, pool = regression.pooled(table, ["g", "s"], columns(), F.col("y"), pools, rounds=6)
    got, told = {r.s: r for r in series.collect()}, pool.collect()
    for group in {s % 2 for s in got} if pools else {None}:
        ids = sorted(s for s in got if group is None or s % 2 == group)
        data = [design(rows, s)[:2] for s in ids]
        xs, ys = np.concatenate([d[0] for d in data]), np.concatenate([d[1] for d in data])
        c = np.linalg.solve(xs.T @ xs + 1e-9 * np.eye(3), xs.T @ ys)
        v, noise = np.diag(1 + c * c), (ys @ ys - c @ xs.T @ ys) / len(ys)
        for k in range(7):
            post = []
            for x, y in data:
                cov = np.linalg.inv(x.T @ x / noise + np.linalg.inv(v))
                post.append((cov @ (np.linalg.inv(v) @ c + x.T @ y / noise), cov))
            if k == 6:
                break
            c = np.mean([m for m, _ in post], 0)
            v = np.mean([k_ + np.outer(m, m) for m, k_ in post], 0) - np.outer(c, c)
            noise = sum(y @ y - 2 * m @ x.T @ y + np.sum(x.T @ x * (k_ + np.outer(m, m))) for (x, y), (m, k_) in zip(data, post)) / len(ys)
        for s, (m, cov) in zip(ids, post):
            assert np.allclose(got[s].coef, m) and np.allclose(got[s].cov, cov)
        (p,) = [r for r in told if not pools or r.g == group]
        assert np.allclose(p.centre, c) and np.allclose(p.spread, v) and np.isclose(p.noise, noise) and p.series == len(ids)
    # a series of two steps leans on its pool
    x, y, _ = design(rows, 5)
    assert np.all(np.isfinite(got[5].coef)) and len(y) == 2


def test_regressions_of_nothing(table):
    none = table.filter("false")
    assert regression.conjugate(none, ["s"], columns(), F.col("y"), [1.0] * 3).collect() == [] and regression.poisson(none, ["s"], columns(), F.col("n"), 2).collect() == []
    series, pool = regression.pooled(none, ["s"], columns(), F.col("y"), rounds=2)
    assert series.collect() == [] and pool.collect() == []
