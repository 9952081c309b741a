"""Exact cases, numpy parity and the error contract."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError, BacktestWindowError, HorizonError, MethodResolutionError, NotFittedError
from tidecast.functions import features, rng
from tidecast.operators import folds, index, metrics, panel
from tidecast.operators.windows import window_splits
from tidecast.plans import diagnostics, kernels
from tidecast.plans.backtest import backtest, results_to_dataframe
from tidecast.plans.forecaster import METHODS, Forecaster, PathfinderForecaster, PriorForecaster
from tidecast.plans.spec import Compiled, ModelSpec, Prior, PriorConfig
from tidecast.sources import loaders


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("n", "settings", "want"),
    [
        (10, {"min_train": 6, "test": 2, "stride": 2}, [(0, 6, 8), (0, 8, 10)]),
        (10, {"train": 5, "test": 2, "stride": 2}, [(0, 5, 7), (2, 7, 9), (4, 9, 10)]),
        (8, {"min_train": 6, "test": 5}, [(0, 6, 8), (0, 7, 8)]),
    ],
)
def test_windows(spark, n, settings, want):
    assert rows(window_splits(spark, n, **settings)) == want


def test_window_errors(spark):
    for bad in ({"min_train": 20}, {"kind": "rolling"}, {"kind": "expanding", "train": 3}, {"stride": 0}):
        with pytest.raises(BacktestWindowError):
            window_splits(spark, 10, **bad)


def test_numeric_index(spark):
    at = spark.createDataFrame([(2 * k, k) for k in range(4)], "time long, pos long")
    assert [t for t, _ in rows(index.extend_time_index(at, 2))] == [0, 2, 4, 6, 8, 10]
    with pytest.raises(AlignmentError):
        index.extend_time_index(at, -1)
    with pytest.raises(AlignmentError):
        index.extend_time_index(spark.createDataFrame([(0, 0), (1, 1), (4, 2)], "time long, pos long"), 1)


def test_weekly_index(spark):
    at = spark.sql("select date_add(date'2024-01-07', cast(7 * id as int)) as time, id as pos from range(5)")
    out = rows(index.extend_time_index(at, 3))
    assert len(out) == 8 and str(out[-1][0]) == "2024-02-25"


def test_concat_index(spark):
    at = spark.range(5).selectExpr("id as time", "id as pos")
    future = lambda *t: spark.createDataFrame(list(zip(t, range(len(t)))), "time long, pos long")
    assert [t for t, _ in rows(index.concat_time_index(at, future(10, 20, 30)))] == [0, 1, 2, 3, 4, 10, 20, 30]
    for bad in (future(), future(7, 6), future(7, 7), future(4, 5)):
        with pytest.raises(AlignmentError):
            index.concat_time_index(at, bad)


def test_alignment(spark):
    data = spark.range(5).selectExpr("id as time", "id as pos")
    panel.validate_alignment(data, spark.range(7).selectExpr("id as time", "id as pos"))
    for bad in (spark.range(3).selectExpr("id as time", "id as pos"), spark.range(5).selectExpr("id + 10 as time", "id as pos")):
        with pytest.raises(AlignmentError):
            panel.validate_alignment(data, bad)
    with pytest.raises(AlignmentError):
        panel.as_series(data, "day", "pos")


def samples(spark, values, truth):
    pred = spark.createDataFrame([(d, i, float(v)) for i, row in enumerate(values) for d, v in enumerate(row)], "draw long, loc long, pred double")
    return pred, spark.createDataFrame([(i, float(t)) for i, t in enumerate(truth)], "loc long, truth double")


def test_metrics(spark):
    one = lambda f, v, t, **k: f(*samples(spark, v, t), ["loc"], **k).first()[0]
    assert one(metrics.eval_mae, [[0, 0, 100]], [0]) == 0
    assert one(metrics.eval_rmse, [[0, 2]], [0]) == 1
    assert one(metrics.eval_coverage, [[0, 1, 2]], [100]) == 0
    x = np.random.default_rng(7).normal(size=(20, 300))
    crps = one(metrics.eval_crps, x, [0] * 20)
    brute = np.mean([np.abs(r).mean() - 0.5 * np.abs(r[:, None] - r[None]).mean() for r in x])
    assert abs(crps - brute) < 1e-10 and abs(crps - 0.2337) < 0.03
    assert abs(one(metrics.eval_pinball, x, [0.3] * 20) - one(metrics.eval_mae, x, [0.3] * 20) / 2) < 1e-12
    with pytest.raises(Exception, match="two draws"):
        one(metrics.eval_crps, [[1]], [0])
    with pytest.raises(ValueError):
        metrics.metric("coverage", alpha=1.0)


def test_mase(spark):
    train = spark.range(10).selectExpr("id as pos", "cast(id as double) as y")
    for truth, want in ((2, 2.0), (3, 3.0)):
        assert metrics.make_mase(train, [])(*samples(spark, [[0, 0]], [truth]), ["loc"]).first()[0] == want
    with pytest.raises(ValueError):
        metrics.make_mase(train.withColumn("y", F.lit(1.0)), [])


def test_rng_is_the_drivers_and_partition_free(spark):
    df = spark.range(500)
    z = lambda d: {r[0]: r[1] for r in d.select("id", rng.normal(rng.key_of(1, "e", F.col("id")))).collect()}
    got = z(df)
    assert got == z(df.repartition(7)) and all(abs(v - rng.normal_of(1, "e", k)) < 1e-12 for k, v in got.items())


def test_folds_equal_loops(spark):
    y = [float(v) for v in np.random.default_rng(1).normal(size=30).cumsum()]
    df = spark.createDataFrame([(y,)], "path array<double>")
    got = [s.m for s in df.select(folds.kalman_local_level(F.col("path"), 2.0, 0.5)).first()[0]]
    assert np.allclose(got, kalman(y))
    total, means, _ = kernels.kalman_loglik(np.array(y), 2.0, 0.5, 0.0, 1e6)
    assert np.allclose(got, means)


def kalman(y):
    m, p, out = 0.0, 1e6, []
    for v in y:
        p += 0.5
        k = p / (p + 2.0)
        m, p = m + k * (v - m), p * (1 - k)
        out.append(m)
    return out


def test_conditional_normal():
    at = np.arange(16)
    cov = np.exp(-0.5 * ((at[:, None] - at[None]) / 3.0) ** 2) + 1e-6 * np.eye(16)
    loc, y = np.linspace(0, 2, 16), np.random.default_rng(11).normal(size=12)
    mean, var = kernels.conditional_mvn(loc, cov, y)
    c = cov + 1e-6 * np.eye(16)
    assert np.allclose(mean, loc[12:] + c[12:, :12] @ np.linalg.solve(c[:12, :12], y - loc[:12]), atol=1e-8)


@pytest.mark.parametrize("spec", [ModelSpec(period=7.0, terms=2, level=True), ModelSpec("poisson", level=True), ModelSpec("studentt")])
def test_gradients(spec):
    r = np.random.default_rng(0)
    m = Compiled(spec, r.poisson(5, 15).astype(float), np.arange(15), np.zeros((15, 0)))
    v = r.normal(size=m.dim) * 0.3
    _, g = m.target(v)
    assert np.allclose(g, kernels.numeric(lambda x: m.target(x)[0])(v)[1], rtol=1e-4, atol=1e-4)


def test_nuts_finds_moments():
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    inv = np.linalg.inv(cov)
    x = kernels.nuts(lambda v: (-0.5 * v @ inv @ v, -inv @ v), np.zeros(2), np.random.default_rng(3), 3000, 600)
    assert np.abs(x.mean(0)).max() < 0.15 and np.abs(np.cov(x.T) - cov).max() < 0.3
    assert diagnostics.split_rhat(x[:, 0].reshape(2, -1)) < 1.05 and diagnostics.effective_size(x[:, 0].reshape(2, -1)) > 300


@pytest.fixture(scope="module")
def trend(spark):
    r = np.random.default_rng(20260709)
    return spark.createDataFrame([(k, float(1 + 2 * k / 10 + r.normal(0, 0.1))) for k in range(30)], "pos long, y double")


@pytest.mark.parametrize("method", sorted(METHODS))
def test_forecasts_recover_a_trend(trend, method):
    settings = {"advi": {"num_steps": 3000, "optimizer": 0.02}, "fullrank_advi": {"num_steps": 3000, "optimizer": 0.02}, "nuts": {"num_draws": 150, "tune": 200}, "statespace": {"num_draws": 60, "tune": 80}}
    made = METHODS[method](ModelSpec(), **settings.get(method, {})).fit(trend)
    got = made.forecast(horizon=5, num_samples=60).groupBy("pos").agg(F.avg("forecast").alias("m")).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(30, 35))
    assert all(abs(r.m - (1 + 0.2 * r.pos)) < 0.5 for r in got)


def test_forecaster_contract(trend):
    made = PathfinderForecaster(ModelSpec())
    with pytest.raises(NotFittedError):
        made.forecast(horizon=1)
    made.fit(trend)
    with pytest.raises(HorizonError):
        made.forecast()
    draws = made.draw_posterior(10)
    a, b = made.forecast(horizon=3, posterior=draws), made.forecast(horizon=3, posterior=draws.repartition(5))
    assert rows(a) == rows(b) and a.count() == 30
    assert made.predict_in_sample(posterior=draws).count() == 300
    with pytest.raises(MethodResolutionError):
        Forecaster(ModelSpec(), method="magic")
    with pytest.raises(MethodResolutionError):
        ModelSpec("gamma")


def test_backtest_fits_all_windows(trend):
    found = results_to_dataframe(backtest(trend, lambda keys: PathfinderForecaster(ModelSpec(), keys), min_train=20, test=3, min_test=3, stride=4)).collect()
    assert [(r.t0, r.t1, r.t2) for r in found] == [(0, 20, 23), (0, 24, 27)] and all(r.mae < 0.6 for r in found)


def test_backtest_with_covariates_scales_and_training_scores(spark, trend):
    cov = spark.range(30).select(F.col("id").alias("pos"), (F.col("id") / 10.0).alias("x"))
    make = lambda keys: PathfinderForecaster(ModelSpec(trend=False, covariates=("x",)), keys)
    split = {"train": 20, "test": 3, "min_test": 3, "stride": 4}
    found = backtest(trend, make, covariates=cov, seasonality=1, in_sample=True, **split)
    got = results_to_dataframe(found).collect()
    assert [(r.t0, r.t1, r.t2) for r in got] == [(0, 20, 23), (4, 24, 27)]
    assert all(r.mae < 0.6 and 0 < r.train_mae < 0.3 for r in got)
    y = [r.y for r in trend.orderBy("pos").collect()]
    for r in got:
        assert abs(r.mase - r.mae / np.abs(np.diff(y[r.t0 : r.t1])).mean()) < 1e-9
    assert sorted(r[0] for r in found.predictions.filter("t0 = 4").select("pos").distinct().collect()) == [24, 25, 26]
    off = backtest(trend, make, covariates=cov, metrics=("mae",), transform=lambda p, t: (p, t.withColumn("truth", F.col("truth") + 10)), **split)
    assert all(r.mae > 9 for r in off.table.collect())
    with pytest.raises(Exception, match="too short or constant"):
        backtest(trend.withColumn("y", F.lit(1.0)), lambda keys: PathfinderForecaster(ModelSpec(), keys), seasonality=1, **split).table.collect()


def test_student_noise_has_students_quantiles(spark):
    made = PathfinderForecaster(ModelSpec("studentt", trend=False, degrees=3.0))
    posterior = spark.range(20000).selectExpr("0 as chain", "id as draw", "array(0d) as beta", "1d as sigma", "0d as level_sd", "0d as level", "array(0d) as mu_path")
    got = made._noisy(posterior.withColumn("pos", F.lit(0)).withColumn("mu", F.lit(0.0)), "mu", "obs", 5)
    q = got.agg(F.percentile("obs", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.975)))).first()[0]
    assert np.allclose(q, [0.0, 1.638, 3.182], atol=0.15)


def test_prior_predictive_needs_no_fit(trend):
    made = PriorForecaster(ModelSpec(level=True).with_priors(trend=Prior("normal", {"sigma": 1e-9})), num_draws=400).fit(trend)
    got = made.predict_in_sample(num_samples=400).groupBy("pos").agg(F.stddev("mu").alias("sd")).orderBy("pos").collect()
    assert len(got) == 30 and got[-1].sd > got[0].sd
    assert made.forecast(horizon=2, num_samples=10).count() == 20


def test_summary(spark):
    x = np.random.default_rng(2).normal(size=(2, 400))
    df = spark.createDataFrame([(c, d, float(x[c, d])) for c in range(2) for d in range(400)], "chain int, draw long, a double")
    r = diagnostics.summary(df, ["a"]).first()
    s = np.sort(x.ravel())
    k = int(0.94 * 800)
    w = s[k:] - s[: 800 - k]
    assert r.parameter == "a" and (r.hdi_low, r.hdi_high) == (s[w.argmin()], s[w.argmin() + k])
    assert abs(r["mean"] - x.mean()) < 1e-12 and r.rhat < 1.05 and r.ess > 300


def test_conditional_draws_follow_the_conditional(spark, trend):
    kernel = lambda lag: math.exp(-abs(lag) / 3)
    exact = {r.pos: r for r in kernels.gp_forecast(trend, [], 3, kernel).collect()}
    got = kernels.gp_samples(trend, [], 3, kernel, 4000).groupBy("pos").agg(F.avg("forecast").alias("m"), F.var_samp("forecast").alias("v")).collect()
    assert {r.pos for r in got} == set(exact) == {30, 31, 32}
    assert all(abs(r.m - exact[r.pos]["mean"]) < 0.06 and abs(r.v - exact[r.pos].variance) < 0.06 for r in got)


def test_priors():
    class Mine(PriorConfig):
        defaults = {"a": Prior("normal", {"sigma": 2.0})}

    assert Mine({"b": Prior("normal")}).create_prior("a").scale() == 2.0
    with pytest.raises(KeyError):
        Mine().create_prior("z")
    with pytest.raises(TypeError):
        Mine({"a": 3})


def test_convergence(spark):
    noise = np.random.default_rng(0).normal(size=2000)
    frame = lambda x: spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "step long, loss double")
    assert diagnostics.elbo_convergence(frame(np.linspace(1000, 100, 2000) + noise), 2000).first().still_falling
    assert not diagnostics.elbo_convergence(frame(50 + 5 * noise), 2000).first().still_falling
    assert not diagnostics.elbo_convergence(frame(np.linspace(100, 0, 10)), 10).first().assessed
    assert not diagnostics.elbo_convergence(frame([float("nan")] * 2000), 2000).first().assessed


def test_weekly_loaders(spark):
    shard = lambda k: spark.sql(f"select timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(h.id + {168 * k} as int)) as time, o.o as origin, d.d as destination, {k + 1}L as rides from range(168) h, values ('A'), ('B') as o(o), values ('A'), ('B') as d(d)")
    counts = loaders.od_counts([shard(0), shard(1)])
    assert np.allclose([y for _, y in rows(loaders.weekly_total(counts))], [math.log(672), math.log(1344)])
    assert np.allclose([r[2] for r in rows(loaders.weekly_by_origin(counts, 1))], [math.log1p(336), math.log1p(672)])
    with pytest.raises(ValueError):
        loaders.weekly_by_origin(counts, 0)


def test_features(spark):
    df = spark.range(48).withColumnRenamed("id", "pos")
    one = df.select("pos", *features.fourier_features(F.col("pos"), 24, 2)).collect()
    assert abs(one[12].sin_1) < 1e-9 and abs(one[3].cos_2 - one[27].cos_2) < 1e-9
    with pytest.raises(ValueError):
        features.fourier_features(F.col("pos"), 24, 0)
