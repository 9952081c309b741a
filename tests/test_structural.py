"""The two-phase state-space model, its grid posterior, forecasts and in-sample draws; prior factories; loaders."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError, HorizonError, MethodResolutionError
from tidecast.operators import panel, state_space as ss
from tidecast.plans import structural
from tidecast.plans.forecaster import PathfinderForecaster
from tidecast.plans.models import prior_obs_factory, prior_rv_factory
from tidecast.plans.spec import Prior
from tidecast.sources import loaders


class Trend(structural.StatespaceModel):
    covariates = ("x",)

    def statespace(self):
        return ss.StateSpace([ss.LevelTrend(2), ss.Regression(1)], var0=100.0)

    def priors(self):
        return {"level_0": [0.1, 1.0], "level_1": [0.001, 0.1], "obs": Prior("halfnormal", {"sigma": 4.0})}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=t), t, float(10 + 0.5 * t + 3 * (t % 4 == 0) + rng.normal())) for s, n in (("a", 28), ("b", 20)) for t in range(n) if t != 9]
    return spark.createDataFrame(rows, "s string, time date, pos long, y double").cache()


@pytest.fixture(scope="module")
def covariates(spark):
    return spark.createDataFrame([(t, float(t % 4 == 0)) for t in range(40)], "pos long, x double").cache()


@pytest.fixture(scope="module")
def fitted(data, covariates):
    return structural.StructuralForecaster(Trend(), ["s"], quantiles=3).fit(data.drop("time"), covariates)


def test_weights_are_the_posterior_of_the_grid(fitted):
    held = fitted.weights_.toPandas()
    assert len(held) == 2 * 2 * 2 * 3 and np.allclose(held.groupby("s").weight.sum(), 1) and fitted.is_fitted
    drawn = fitted.draw_posterior(4000).toPandas()
    for s, g in held.groupby("s"):
        share = drawn[drawn.s == s].groupby(fitted.names).size() / 4000
        for _, r in g.iterrows():
            assert abs(share.get(tuple(r[n] for n in fitted.names), 0.0) - r.weight) < 0.04


def test_forecast_paths_have_the_filters_moments(fitted, covariates):
    ahead = fitted.forecast(covariates=covariates.filter("pos < 33"), num_samples=3000)
    assert ahead.columns == ["s", "chain", "draw", "pos", "mu_future", "forecast"]
    got = ahead.groupBy("s", "pos").agg(F.avg("forecast").alias("m"), F.variance("forecast").alias("v"), F.variance("mu_future").alias("w")).toPandas().set_index(["s", "pos"])
    assert set(got.index) == {("a", t) for t in range(28, 33)} | {("b", t) for t in range(20, 33)}
    weights = fitted.weights_.select("s", *fitted.names, "weight")
    more = covariates.sparkSession.createDataFrame([(s, t, None) for s, n in (("a", 28), ("b", 20)) for t in range(n, 33)], "s string, pos long, y double").join(covariates, "pos")
    seen = fitted.data_.join(covariates, "pos").select("s", "pos", "y", "x")
    paths = ss.steps(seen.unionByName(more.select("s", "pos", "y", "x")).unionByName(covariates.sparkSession.createDataFrame([("a", 9, None, 0.0), ("b", 9, None, 0.0)], "s string, pos long, y double, x double")), ["s"], covariates=["x"])
    for r in ss.forecast(paths, ["s"], fitted.space, weights).filter("pos > 9").collect():
        sd = np.sqrt(r["variance"])
        assert abs(got.loc[(r.s, r.pos)].m - r["mean"]) < 0.1 * sd and abs(got.loc[(r.s, r.pos)].v / r["variance"] - 1) < 0.15 and got.loc[(r.s, r.pos)].w < got.loc[(r.s, r.pos)].v


def test_noise_is_keyed_and_draws_are_replayed(fitted, covariates):
    draws = fitted.draw_posterior(20)
    key = ["s", "chain", "draw", "pos"]
    long = {tuple(r[k] for k in key): r.forecast for r in fitted.forecast(covariates=covariates, posterior=draws).collect()}
    short = {tuple(r[k] for k in key): r.forecast for r in fitted.forecast(covariates=covariates.filter("pos < 30"), posterior=draws.filter("draw < 7")).collect()}
    assert short and all(long[k] == v for k, v in short.items())
    with pytest.raises(HorizonError):
        fitted.forecast(horizon=3)


def test_in_sample_draws_are_the_smoothers(fitted, data):
    got = fitted.predict_in_sample(num_samples=300).groupBy("s", "pos").agg(F.avg("mu").alias("m"), F.stddev("mu").alias("d"), F.avg("obs").alias("o")).toPandas()
    assert len(got) == 48 and {9} <= set(got.pos)
    y = {(r.s, r.pos): r.y for r in data.collect()}
    errors = [abs(r.m - y[r.s, r.pos]) for r in got.itertuples() if (r.s, r.pos) in y]
    assert np.mean(errors) < 1.2 and (got.d > 0).all()


def test_labels_of_a_structural_horizon(data):
    model = structural.Stated(ss.StateSpace([ss.LevelTrend(1)], var0=100.0), {"level_0": [0.5], "obs": [1.0]})
    whole = data.filter("pos <> 9").filter("pos > 9")
    made = structural.StructuralForecaster(model, ["s"]).fit(whole)
    got = {(r.s, r.pos, r.time_future) for r in made.forecast(horizon=2, num_samples=2).collect()}
    assert got == {(s, n + k, dt.date(2024, 1, 1) + dt.timedelta(days=n + k)) for s, n in (("a", 28), ("b", 20)) for k in range(2)}
    alone = structural.StructuralForecaster(model).fit(whole.filter("s = 'a'").drop("s"))
    assert alone.forecast(horizon=2, num_samples=3).count() == 6 and alone.predict_in_sample(num_samples=2).count() == 36


def test_models_that_do_not_fit_together(data, covariates):
    space = ss.StateSpace([ss.LevelTrend(1), ss.Regression(1)])
    state = lambda priors, covariates=("x",), of=space: structural.StructuralForecaster(structural.Stated(of, priors, covariates), ["s"])
    good = {"level_0": [1.0], "obs": [1.0]}
    with pytest.raises(AlignmentError):
        state(good, ())
    with pytest.raises(KeyError):
        state({"level_0": [1.0]})
    with pytest.raises(MethodResolutionError):
        state({**good, "other": [1.0]})
    with pytest.raises(MethodResolutionError):
        state({**good, "obs": Prior("normal", {})})
    with pytest.raises(MethodResolutionError):
        state({"level_0": list(range(1, 400)), "obs": list(range(1, 400))})
    with pytest.raises(NotImplementedError):
        state(good, ("x", "z"), ss.StateSpace([ss.LevelTrend(1), ss.Regression(1), ss.Regression(1, first=1)]))
    with pytest.raises(AlignmentError):
        state(good).fit(data)


def test_prior_factories(spark, data):
    with pytest.raises(HorizonError):
        Prior("normal", {"sigma": Prior("halfnormal", {"sigma": 1.0}, dims=("time",))})
    wobble = prior_rv_factory(Prior("normal", {"mu": Prior("normal", {"mu": 10.0, "sigma": 20.0}), "sigma": Prior("halfnormal", {"sigma": 3.0})}), "z")
    assert wobble.names == ["z_mu", "z_sigma"]
    model = prior_obs_factory(Prior("studentt", {"nu": 6.0, "sigma": Prior("halfnormal", {"sigma": 2.0})}), wobble)
    assert (model.family, model.degrees, model.sigma.name) == ("studentt", 6.0, "halfnormal")
    with pytest.raises(ValueError):
        prior_obs_factory(Prior("normal", {"mu": 1.0}), wobble)
    with pytest.raises(MethodResolutionError):
        prior_obs_factory(Prior("gamma", {}), wobble)
    made = PathfinderForecaster(model, ["s"], num_draws=40).fit(data.drop("time").filter("pos > 9"))
    ahead = made.forecast(horizon=2, num_samples=40).groupBy("s").agg(F.avg("mu_future").alias("m"), F.countDistinct("mu_future").alias("n")).collect()
    assert all(10 < r.m < 30 and r.n == 80 for r in ahead)


def test_hourly_csv_and_the_spine_alone(spark, tmp_path):
    (tmp_path / "h.csv").write_text("demand,heat\n" + "\n".join(f"{k}.5,{k % 3}" for k in range(30)) + "\n")
    got = loaders.hourly_csv(spark, f"{tmp_path}/h.csv", "2014-01-01 00:00:00", ["demand", "heat"]).orderBy("pos").collect()
    assert [(r.pos, r.demand, r.heat) for r in got] == [(k, k + 0.5, float(k % 3)) for k in range(30)]
    assert [r.time for r in got] == [dt.datetime(2014, 1, 1) + dt.timedelta(hours=k) for k in range(30)]
    series = spark.createDataFrame([(s, dt.date(2024, 1, 1 + k), k, 1.0) for s in "ab" for k in range(3)], "s string, time date, pos long, y double")
    alone = panel.null_covariates(series)
    assert alone.columns == ["time", "pos"] and alone.count() == 3
