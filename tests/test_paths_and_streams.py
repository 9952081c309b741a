"""Markov paths, prefix moments, mixing as folds, samplers, and the filter along a stream."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError
from tidecast.functions import samplers, special
from tidecast.functions.rng import key_of, normal_of
from tidecast.operators import folds, markov, windows
from tidecast.plans import diagnostics, prefix
from tidecast.streaming.level import local_level


def test_markov_paths_go_on_from_where_they_ended(spark):
    draws = spark.createDataFrame([(0, d, 1.0 + d, 0.5) for d in range(3)], "chain int, draw long, level double, phi double")
    steps = spark.createDataFrame([(s, t, float(t % 2)) for s in ("a", "b") for t in range(7)], "series string, pos long, x double")

    def transition(s, step):
        return {"level": F.col("phi") * s["level"] + step["x"] + 0.1 * F.get(step["e"], F.lit(0))}

    whole = markov.paths(draws, steps, {"level": F.col("level")}, transition, 5, "w", ["series"], ["x"])
    first = markov.paths(draws, steps.filter("pos < 4"), {"level": F.col("level")}, transition, 5, "w", ["series"], ["x"])
    ends = markov.last(first, ["level"], ["series"]).join(draws.drop("level"), ["chain", "draw"])
    rest = markov.paths(ends, steps.filter("pos >= 4"), {"level": F.col("level")}, transition, 5, "w", ["series"], ["x"])
    got = {(r.series, r.draw, r.pos): r.level for r in whole.collect()}
    assert got == {(r.series, r.draw, r.pos): r.level for r in first.union(rest).collect()}
    for s in "ab":
        for d in range(3):
            x = 1.0 + d
            for t in range(7):
                x = 0.5 * x + t % 2 + 0.1 * normal_of(5, "w0", 0, d, s, t)
                assert math.isclose(got[s, d, t], x, rel_tol=1e-12)
    with pytest.raises(AlignmentError):
        markov.paths(draws, steps.withColumn("x", F.when(F.col("pos") < 6, F.col("x"))), {"level": F.col("level")}, transition, 5, "w", ["series"], ["x"])


def test_prefix_moments_are_each_windows_own(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, float(rng.normal()), float(3 + t + rng.normal())) for s, lo, hi in (("a", 0, 40), ("b", 9, 40), ("c", 30, 40)) for t in range(lo, hi) if t % 7]
    data = spark.createDataFrame(rows + [("a", 7, None, 1.0)], "s string, pos long, x double, y double")
    splits = windows.window_splits(spark, 40, train=12, test=4, min_test=2, stride=5)
    columns = [F.lit(1.0), F.col("x")]
    got = {(r.s, r.t0, r.t1): r for r in prefix.window_moments(data, ["s"], columns, F.col("y"), splits).collect()}
    for (s, t0, t1), r in got.items():
        its = [x for x in rows if x[0] == s and t0 <= x[1] < t1]
        x, y = np.array([[1.0, i[2]] for i in its]).reshape(-1, 2), np.array([i[3] for i in its])
        assert r.n == len(its) and np.allclose(r.xx, x.T @ x) and np.allclose(r.xy, x.T @ y) and np.isclose(r.yy, y @ y)
    assert len(got) == 3 * splits.count()
    scores, out = prefix.backtest_regression(data, ["s"], columns, F.col("y"), splits, [0.5, 0.5])
    for r in out.collect():
        its = [x for x in rows if x[0] == r.s and r.t0 <= x[1] < r.t1]
        x, y = np.array([[1.0, i[2]] for i in its]), np.array([i[3] for i in its])
        b = np.linalg.solve(x.T @ x + 0.5 * np.eye(2), x.T @ y)
        (at,) = [np.array([1.0, i[2]]) for i in rows if (i[0], i[1]) == (r.s, r.pos)]
        assert r.t1 <= r.pos < r.t2 and np.isclose(r["mean"], b @ at)
    plan = scores._jdf.queryExecution().toString()
    assert "Expand" not in plan and scores.count() == splits.count()


def test_mixing_as_folds_is_that_of_numpy(spark):
    rng = np.random.default_rng(6)
    for n, phi in ((3, 0.0), (40, 0.0), (301, 0.9), (200, -0.5)):
        x = np.zeros((3, n))
        for t in range(1, n):
            x[:, t] = phi * x[:, t - 1] + rng.normal(size=3)
        df = spark.createDataFrame([(x.tolist(),)], "c array<array<double>>")
        r = df.select(diagnostics.effective_size_of(F.col("c")).alias("ess"), diagnostics.split_rhat_of(F.col("c")).alias("rhat")).first()
        assert np.isclose(r.ess, diagnostics.effective_size(x)) and (np.isclose(r.rhat, diagnostics.split_rhat(x)) if n > 3 else math.isnan(r.rhat))
    still = spark.createDataFrame([([[1.0] * 10] * 2,)], "c array<array<double>>").select(diagnostics.effective_size_of(F.col("c")).alias("e"), diagnostics.split_rhat_of(F.col("c")).alias("r")).first()
    assert still.e == 20 and math.isnan(still.r)


def test_log_gamma(spark):
    xs = [1e-8, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 20.0, 1e3, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(special.log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-12)


def test_samplers_have_their_moments_and_need_no_luck(spark, monkeypatch):
    rows = spark.range(20000).select("id", *(F.lit(v).alias(n) for n, v in (("small", 0.3), ("large", 7.5))))
    key = lambda n: key_of(1, n, F.col("id"))
    columns = {"g_small": samplers.gamma(key("a"), F.col("small")), "g_large": samplers.gamma(key("b"), F.col("large")), "b": samplers.beta(key("c"), F.col("small"), F.col("large")), "t": samplers.student(key("t"), F.lit(9.0))}
    columns |= {f"p_{lam}": samplers.poisson(key(f"p{lam}"), F.lit(float(lam))) for lam in (0, 0.5, 9, 11, 400, 1e7)}
    x = rows.select(*(c.alias(n) for n, c in columns.items())).toPandas()
    beta = 0.3 / 7.8
    want = {"g_small": (0.3, 0.3), "g_large": (7.5, 7.5), "b": (beta, beta * (1 - beta) / 8.8), "t": (0.0, 9 / 7)} | {f"p_{lam}": (lam, lam) for lam in (0, 0.5, 9, 11, 400, 1e7)}
    for name, (mean, var) in want.items():
        assert abs(x[name].mean() - mean) <= 5 * math.sqrt(var / 20000) and (var == 0 or abs(x[name].var() / var - 1) < 0.12), name
    for lam in (9, 11):
        values, counts = np.unique(x[f"p_{lam}"], return_counts=True)
        expected = np.array([math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) for k in values])
        keep = expected > 0.002
        assert np.abs(counts[keep] / 20000 - expected[keep]).max() < 0.012
    odd = spark.createDataFrame([(-1.0,), (None,)], "v double").select(samplers.gamma(F.lit("k"), F.col("v")).alias("g"), samplers.poisson(F.lit("k"), F.col("v")).alias("p")).collect()
    assert all(r.g is None and r.p is None for r in odd)
    # the bound of what is looked at first changes nothing
    monkeypatch.setattr(samplers, "FEW", 1)
    again = rows.select(samplers.gamma(key("b"), F.col("large")).alias("g")).toPandas()
    assert (again.g == x.g_large).all()


def test_multivariate_normal(spark):
    cov = [[2.0, 0.6], [0.6, 0.5]]
    z = spark.range(8000).select(samplers.multivariate_normal(key_of(2, "m", F.col("id")), F.array(F.lit(1.0), F.lit(-1.0)), F.array(*(F.array(*map(F.lit, r)) for r in cov)), 2).alias("z")).toPandas()
    z = np.array(z.z.to_list())
    assert np.abs(z.mean(0) - [1, -1]).max() < 0.06 and np.abs(np.cov(z.T) - cov).max() < 0.1


DAY = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def test_a_stream_over_files_equals_the_batch_fold(spark, tmp_path):
    rng = np.random.default_rng(3)
    for k in range(6):
        rows = []
        for s in ("a", "b") if k < 4 else ("a",):
            days = range(max(0, 2 * k - 1), 2 * k + 2)
            rows += [(s, DAY + dt.timedelta(days=int(rng.choice(days)), seconds=int(rng.integers(0, 86400)))) for _ in range(int(rng.integers(5, 30)))]
        spark.createDataFrame(rows, "event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = local_level(spark, f"{tmp_path}/in", 5.0, 1.0, late="3 days", files_per_batch=1)
    events = spark.read.parquet(f"{tmp_path}/in")
    # a series' days from its first to the last that the watermark closed
    end = events.agg(F.max("ts")).first()[0].replace(tzinfo=dt.timezone.utc) - dt.timedelta(days=3)
    counts = events.groupBy(F.col("event_type").alias("series"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("d")).count()
    ends = counts.groupBy("series").agg(F.min("d").alias("lo"))
    last = int(end.timestamp() // 86400) - 1
    spine = ends.select("series", F.explode(F.sequence(F.col("lo"), F.lit(last).cast("long"))).alias("d"))
    dense = spine.join(counts, ["series", "d"], "left").select("series", F.col("d").alias("pos"), F.coalesce(F.col("count"), F.lit(0)).cast("double").alias("y"))
    held = folds.paths(dense, ["series"]).join(ends, "series")
    want = held.select("series", "lo", F.posexplode(folds.kalman_local_level(F.col("path"), 5.0, 1.0)).alias("k", "s")).collect()
    table = {(r.series, (r.day - dt.date(1970, 1, 1)).days): (r.level, r.variance, r.loglik) for r in got.collect()}
    assert got.count() == len(table) == len(want)
    for r in want:
        assert np.allclose(table[r.series, r.lo + r.k], (r.s.m, r.s.p, r.s.ll))


def test_events_of_closed_days_are_too_late(spark, tmp_path):
    for rows in ([("a", 0), ("a", 1)], [("a", 9)], [("a", 0), ("a", 10)], [("a", 11)]):
        spark.createDataFrame([(s, DAY + dt.timedelta(days=d, hours=5)) for s, d in rows], "event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {(r.day - DAY.date()).days: r.y for r in local_level(spark, f"{tmp_path}/in", 5.0, 1.0, late="1 day", files_per_batch=1).collect()}
    assert got == {d: float(d in (0, 1, 9)) for d in range(10)}


def test_zero_sum_normals(spark):
    z = spark.range(4000).select(samplers.zero_sum_normal(key_of(2, "z", F.col("id")), F.lit(2.0), 5).alias("z")).toPandas()
    z = np.array(z.z.to_list())
    assert np.abs(z.sum(1)).max() < 1e-12 and np.abs(np.cov(z.T) - 4 * (np.eye(5) - 0.2)).max() < 0.3
