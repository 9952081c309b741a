"""Priors that are what they say, models of one's own, ragged panels, indices below a day, and what must raise."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError, ConvergenceWarning, MethodResolutionError
from tidecast.functions import features
from tidecast.operators import folds, index, metrics, panel, results
from tidecast.plans import diagnostics
from tidecast.plans.backtest import backtest
from tidecast.plans.distributions import KNOWN, zero_sum
from tidecast.plans.forecaster import Forecaster, PathfinderForecaster, PriorForecaster, SeasonalNaiveForecaster
from tidecast.plans.models import UserModel, time_series
from tidecast.plans.spec import ModelSpec, Prior


def labels(spark, sql, kind="timestamp_ntz"):
    return spark.sql(sql).selectExpr(f"cast(t as {kind}) as time", "cast(p as long) as pos")


def extended(df, horizon, freq=None):
    n = df.count()
    return [str(r.time) for r in index.extend_time_index(df, horizon, freq).orderBy("pos").collect()][n:]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_indices_below_a_day(spark, kind):
    hours = labels(spark, "select timestamp'2024-03-01 00:00:00' + make_interval(0,0,0,0,cast(id as int)) as t, id as p from range(5)", kind)
    assert extended(hours, 3) == ["2024-03-01 05:00:00", "2024-03-01 06:00:00", "2024-03-01 07:00:00"]
    many = labels(spark, "select timestamp'2024-03-01 00:00:00' + make_interval(0,0,0,0,0,cast(30 * id as int)) as t, id as p from range(100)", kind)
    assert extended(many, 1) == ["2024-03-03 02:00:00"] and extended(many, 1, "6 hours") == ["2024-03-03 07:30:00"]
    days = labels(spark, "select timestamp'2024-03-01 06:00:00' + make_interval(0,0,0,cast(id as int)) as t, id as p from range(4)", kind)
    assert extended(days, 2) == ["2024-03-05 06:00:00", "2024-03-06 06:00:00"]


def test_calendar_months_are_inferred(spark):
    month = "select add_months(date'2023-11-01', cast({k} * id as int)) as t, id as p from range(6)"
    assert extended(labels(spark, month.format(k=1), "date"), 2) == ["2024-05-01", "2024-06-01"]
    assert extended(labels(spark, month.format(k=3), "date"), 1) == ["2025-05-01"]
    ends = "select last_day(add_months(date'2023-11-30', cast(id as int))) as t, id as p from range(6)"
    assert extended(labels(spark, ends, "date"), 2) == ["2024-05-31", "2024-06-30"]
    assert extended(labels(spark, ends, "date"), 1, "month_end") == ["2024-05-31"]
    with pytest.raises(AlignmentError):
        extended(labels(spark, "select date_add(date'2024-01-01', cast(id * id as int)) as t, id as p from range(5)", "date"), 1)
    with pytest.raises(AlignmentError):
        extended(labels(spark, month.format(k=1), "date"), 1, "fortnight")


def test_keyed_panels_keep_their_keys(spark):
    past = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, 2.0), ("b", 5, 0, 3.0)], "series string, time long, pos long, x double")
    later = spark.createDataFrame([("a", 3, 0, 4.0), ("b", 6, 0, 5.0)], "series string, time long, pos long, x double")
    got = sorted(tuple(r) for r in index.concat_covariates(past, later, ["x"], keys=["series"]).collect())
    assert got == [("a", 0, 0, 1.0), ("a", 1, 1, 2.0), ("a", 3, 2, 4.0), ("b", 5, 0, 3.0), ("b", 6, 1, 5.0)]
    with pytest.raises(AlignmentError):
        index.concat_covariates(past, later.withColumn("time", F.lit(4).cast("long")), ["x"], keys=["series"])
    assert panel.alignment_violations(past, past, keys=["series"]).count() == 0
    moved = past.withColumn("time", F.when(F.col("series") == "b", 7).otherwise(F.col("time")).cast("long"))
    assert [r.series for r in panel.alignment_violations(past, moved, keys=["series"]).collect()] == ["b"]


def test_a_forecast_without_a_truth_raises(spark):
    pred = spark.createDataFrame([(d, i, float(d)) for i in range(4) for d in range(3)], "draw long, loc long, pred double")
    truth = spark.createDataFrame([(i, 1.0) for i in range(4)], "loc long, truth double")
    assert metrics.evaluate_forecast(pred, truth, ["loc"]).first()["mae"] == 0
    with pytest.raises(Exception, match="no truth"):
        metrics.evaluate_forecast(pred, truth.filter("loc < 2"), ["loc"]).collect()
    with pytest.raises(Exception, match="several truths"):
        metrics.evaluate_forecast(pred, truth.union(truth), ["loc"]).collect()
    assert tuple(metrics.truth_gaps(pred, truth.filter("loc < 2").union(truth.filter("loc = 0")), ["loc"]).first()) == (4, 2, 1)


def test_metrics_of_ones_own(spark):
    pred = spark.createDataFrame([(d, i, float(d + i)) for i in range(2) for d in range(3)], "draw long, loc long, pred double")
    truth = spark.createDataFrame([(0, 0.0), (1, 5.0)], "loc long, truth double")

    def spread(draws, y):
        return F.array_max(draws) - F.array_min(draws)

    got = metrics.evaluate_forecast(pred, truth, ["loc"], metrics={"mae": "mae", "above": lambda d, y: (F.array_max(d) < y).cast("double"), "spread": spread}).first()
    assert (got.mae, got.above, got.spread) == (2.0, 0.5, 2.0)
    assert metrics.evaluate_forecast(pred, truth, ["loc"], metrics=["rmse", spread]).columns == ["rmse", "spread"]


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_densities_have_their_slopes_and_fit_their_draws(name):
    prior = Prior(name, {k: v * 1.5 + 0.5 for k, v in KNOWN[name].defaults.items() if k != "mu"})
    x = np.linspace(0.05, 0.95, 7) if name == "beta" else np.linspace(0.1, 4, 9) if prior.positive else np.linspace(-3, 3, 9) + 0.01
    h = 1e-6
    assert np.allclose(prior.density(x)[1], (prior.density(x + h)[0] - prior.density(x - h)[0]) / (2 * h), atol=1e-4)
    # the density, normalised on a grid, against the share of draws below a point
    grid = np.linspace(1e-6, 1 - 1e-6, 200_001) if name == "beta" else np.linspace(1e-6 if prior.positive else -400, 400, 2_000_001)
    weight = np.exp(prior.density(grid)[0])
    draws = prior.draw(np.random.default_rng(1), 40_000)
    at = np.median(draws)
    assert abs(weight[grid <= at].sum() / weight.sum() - 0.5) < 0.02


def test_priors_must_be_known_and_fit_their_place():
    for bad in (lambda: Prior("Wishart"), lambda: Prior("Normal", {"scale": 1.0}), lambda: ModelSpec(priors={"sigma": Prior("Normal")}), lambda: ModelSpec(priors={"trend": Prior("Gamma")}), lambda: ModelSpec(priors={"other": Prior("Normal")})):
        with pytest.raises(MethodResolutionError):
            bad()
    assert Prior("Half_Normal", {"sigma": 2.0}).scale() == 2.0
    assert abs(Prior("Gamma", {"alpha": Prior("LogNormal", {"sigma": 1e-6}), "beta": 2.0}).numbers()["alpha"] - 1) < 1e-3
    assert np.abs(zero_sum(np.random.default_rng(0), 5, 4).sum(1)).max() < 1e-12


def line(spark, n=30, slope=2.0, keys=("a",), noise=0.1):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(k, t, float(1 + slope * t + noise * rng.standard_normal())) for k in keys for t in range(n)], "series string, pos long, y double")


def test_a_tight_prior_is_obeyed(spark):
    data = line(spark)
    fits = {}
    for name, priors in (("loose", {}), ("tight", {"trend": Prior("Laplace", {"mu": 0.0, "b": 1e-4})})):
        model = PathfinderForecaster(ModelSpec(priors=priors), ["series"]).fit(data)
        fits[name] = np.mean([r.beta[1] for r in model.posterior_.collect()])
    assert abs(fits["loose"] - 2) < 0.2 and fits["tight"] < 1.0
    drawn = PriorForecaster(ModelSpec(priors={"sigma": Prior("LogNormal", {"mu": 0.0, "sigma": 1e-3})}), ["series"], num_draws=50).fit(data)
    sd = np.std([r.y for r in data.collect()])
    assert all(abs(r.sigma / sd - 1) < 0.05 for r in drawn.posterior_.collect())


def test_ragged_series_go_on_from_their_own_end(spark):
    data = line(spark, keys=("a", "b")).filter("series = 'a' or pos between 4 and 19")
    model = PathfinderForecaster(ModelSpec(), ["series"]).fit(data)
    got = model.forecast(horizon=3, num_samples=40).groupBy("series", "pos").agg(F.avg("forecast").alias("m")).collect()
    assert sorted((r.series, r.pos) for r in got) == [("a", 30), ("a", 31), ("a", 32), ("b", 20), ("b", 21), ("b", 22)]
    assert all(abs(r.m - (1 + 2 * r.pos)) < 1.5 for r in got)
    inside = model.predict_in_sample(num_samples=5).groupBy("series").agg(F.min("pos"), F.max("pos")).collect()
    assert sorted(map(tuple, inside)) == [("a", 0, 29), ("b", 4, 19)]


def test_a_falling_loss_warns(spark):
    falling = 1000 - 0.45 * np.arange(2000) + np.sin(np.arange(2000))
    assert diagnostics.still_falling(falling) is True and diagnostics.still_falling(np.sin(np.arange(2000.0))) is False
    assert diagnostics.still_falling(np.full(2000, np.nan)) is None and diagnostics.still_falling(falling[:12]) is None
    with pytest.warns(ConvergenceWarning, match="still falls"):
        Forecaster(ModelSpec(), ["series"], num_steps=300, optimizer=0.01).fit(line(spark))
    with warnings.catch_warnings():
        warnings.simplefilter("error", ConvergenceWarning)
        done = Forecaster(ModelSpec(), ["series"], num_steps=6000, optimizer=0.01).fit(line(spark, noise=0.5))
    assert [r.still_falling for r in done.convergence().collect()] == [False]


def test_a_model_of_ones_own(spark):
    """A damped response to a covariate, which no specification has."""
    rng = np.random.default_rng(2)
    rows = [(k, t, float(3 * math.tanh(x) + 0.05 * rng.standard_normal()), x) for k in "ab" for t, x in enumerate(rng.normal(size=40).tolist())]
    data = spark.createDataFrame(rows, "series string, pos long, y double, x double")
    model = UserModel({"gain": Prior("HalfNormal", {"sigma": 5.0})}, emit=lambda s, p, t, x: p["gain"] * np.tanh(x["x"]), covariates=("x",))
    fit = Forecaster(model, ["series"], num_steps=3000, optimizer=0.02).fit(data.filter("pos < 35").select("series", "pos", "y"), data.select("series", "pos", "x"))
    assert all(abs(np.mean(g) - 3) < 0.15 for g in [[r.beta[0] for r in fit.posterior_.filter(f"series = '{k}'").collect()] for k in "ab"])
    got = fit.forecast(covariates=data.select("series", "pos", "x"), num_samples=30)
    mean = {(r.series, r.pos): r.m for r in got.groupBy("series", "pos").agg(F.avg("forecast").alias("m")).collect()}
    assert set(mean) == {(k, t) for k in "ab" for t in range(35, 40)}
    assert all(abs(mean[k, t] - y) < 0.4 for k, t, y, _ in rows if t >= 35)
    again = fit.forecast(covariates=data.select("series", "pos", "x").repartition(5), num_samples=30)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_a_state_steps_on_from_its_last_value(spark):
    rng = np.random.default_rng(3)
    level = 5 + np.cumsum(0.5 + 0.05 * rng.standard_normal(30))
    data = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(level)], "series string, pos long, y double")
    model = time_series(Prior("Normal", {"sigma": 1.0}), Prior("HalfNormal", {"sigma": 0.2}))
    fit = Forecaster(model, ["series"], num_steps=6000, optimizer=0.02).fit(data)
    got = fit.forecast(horizon=4, num_samples=100).groupBy("pos").agg(F.avg("mu_future").alias("m"), F.stddev("mu_future").alias("sd")).orderBy("pos").collect()
    assert abs(got[0].m - level[-1] - 0.5) < 0.4 and all(abs(b.m - a.m - 0.5) < 0.2 for a, b in zip(got, got[1:]))
    assert got[-1].sd > got[0].sd > 0
    inside = fit.predict_in_sample(num_samples=50).groupBy("pos").agg(F.avg("mu").alias("m")).collect()
    assert all(abs(r.m - level[r.pos]) < 0.5 for r in inside)


def test_models_name_what_they_lack():
    with pytest.raises(MethodResolutionError):
        UserModel({}, emit=lambda *a: 0.0, family="gamma")
    with pytest.raises(MethodResolutionError):
        UserModel({}, emit=lambda *a: 0.0, step=lambda *a: 0.0)


def test_seasonal_naive_backtest_with_scores_of_ones_own(spark):
    data = spark.createDataFrame([(k, t, float(t % 7 + (k == "b"))) for k in "ab" for t in range(30)], "series string, pos long, y double")

    def widest(train, predictions, truth):
        return predictions.groupBy("t0", "t1", "t2").agg(F.max("pred").alias("widest"))

    got = backtest(data, lambda keys: SeasonalNaiveForecaster(keys, 7, num_draws=2), ["series"], metrics=["mae"], test=4, train=14, stride=8, per_window={"widest": widest}).table.collect()
    assert len(got) == 2 and all(r.mae == 0 and r.widest <= 7 for r in got)


def test_long_paths_fold_in_blocks(spark):
    n = 5000
    df = spark.createDataFrame([([1.0] * n,), ([],), ([2.0],)], "path array<double>")
    got = [r[0] for r in df.select(folds.scan(F.col("path"), F.lit(0.0), lambda s, v: s + v, lambda s: s)).collect()]
    assert got == [[float(k + 1) for k in range(n)], [], [2.0]]


def test_seasonal_naive_draws(spark):
    data = spark.range(31).selectExpr("id as pos", "cast(id as double) as y")
    for t_obs, horizon, period in ((23, 7, 7), (10, 3, 4), (30, 10, 7), (5, 3, 4)):
        want = {(k, t_obs + j, float(t_obs - k * period + j)) for k in range(1, t_obs // period + 1) for j in range(horizon) if t_obs - k * period + horizon <= t_obs}
        assert {tuple(r) for r in features.seasonal_naive(data, [], t_obs, horizon, period).collect()} == want


def test_hyperpriors_are_parameters_drawn_once(spark):
    model = UserModel({"drift": Prior("Normal", {"mu": Prior("Normal", {"mu": 2.0, "sigma": 0.5}), "sigma": 0.01})}, emit=lambda s, p, t, x: p["drift"] * t)
    assert model.names == ["drift_mu", "drift"]
    drawn = PriorForecaster(model, ["series"], num_draws=400).fit(line(spark))
    beta = np.array([r.beta for r in drawn.posterior_.collect()])
    assert abs(beta[:, 0].mean() - 2) < 0.1 and np.abs(beta[:, 0] - beta[:, 1]).max() < 0.1 and beta[:, 0].std() > 0.3
    fit = Forecaster(model, ["series"], num_steps=4000, optimizer=0.02).fit(line(spark, slope=1.0))
    assert np.abs(np.array([r.beta for r in fit.posterior_.collect()]) - 1).max() < 0.3


def test_filters_have_their_slopes():
    from tidecast.plans import kernels
    from tidecast.plans.forecaster import LevelModel

    rng = np.random.default_rng(1)
    y = rng.normal(size=25).cumsum()
    total, by_y, d_obs, d_level = kernels.kalman_score(y, 0.7, 0.2, 0.0, 1e-6)
    ll = lambda y, h, q: kernels.kalman_loglik(y, h, q, 0.0, 1e-6)[0]
    assert abs(total - ll(y, 0.7, 0.2)) < 1e-9
    e = 1e-6
    assert np.allclose(by_y, [(ll(y + u, 0.7, 0.2) - ll(y - u, 0.7, 0.2)) / (2 * e) for u in np.eye(25) * e], atol=1e-5)
    assert abs(d_obs - (ll(y, 0.7 + e, 0.2) - ll(y, 0.7 - e, 0.2)) / (2 * e)) < 1e-4 and abs(d_level - (ll(y, 0.7, 0.2 + e) - ll(y, 0.7, 0.2 - e)) / (2 * e)) < 1e-4
    model = LevelModel(ModelSpec(period=7.0, terms=1, level=True), y, np.arange(25), np.zeros((25, 0)))
    v = model.start() + 0.1
    value, g = model.target(v)
    assert abs(value - model.logp(v)) < 1e-9 and np.allclose(g, kernels.numeric(model.logp)(v)[1], atol=1e-4)


def test_results_come_out_of_what_holds_them(spark):
    fit = PathfinderForecaster(ModelSpec(), ["series"]).fit(line(spark))
    drawn = fit.forecast(horizon=2, num_samples=5, var_names=["forecast"])
    assert drawn.columns == ["series", "chain", "draw", "pos", "forecast"]
    with pytest.raises(ValueError):
        fit.forecast(horizon=2, var_names=["other"])
    assert results.prediction_samples({"predictions": drawn}) is drawn and results.prediction_samples(drawn) is drawn
    assert results.posterior_table(fit).count() == 200
    for bad in (3, {"other": drawn}, spark.range(2)):
        with pytest.raises(TypeError):
            results.prediction_samples(bad)
    both = results.by_model({"a": drawn, "b": drawn})
    assert {(r.model, r["count"]) for r in both.groupBy("model").count().collect()} == {("a", 10), ("b", 10)}
    scale = spark.createDataFrame([("a", 2.0)], "series string, scale double")
    shifted = drawn.withColumn("forecast", F.col("draw") - F.lit(2.0))
    assert sorted({r.forecast for r in results.back_transform(shifted, scale, ["series"], ["forecast"]).collect()}) == [0.0, 2.0, 4.0]
    with pytest.raises(Exception, match="no scale"):
        results.back_transform(drawn, scale.limit(0), ["series"], ["forecast"]).collect()


def test_calendar_columns(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00", 1.0), ("2024-01-07 23:00:00", None)], "t string, x double").withColumn("t", F.col("t").cast("timestamp"))
    got = [tuple(r) for r in df.select(*features.calendar_parts(F.col("t")), features.step_flag(F.col("t"), "2024-01-03")).collect()]
    assert got == [(0, 5, 1, 1, 0.0), (6, 23, 7, 1, 1.0)]
    assert features.design_matrix(df, ["t"], {"hour": F.hour("t")}).columns == ["t", "hour"]
    with pytest.raises(Exception, match="x holds null"):
        features.design_matrix(df, ["t"], {"x": F.col("x")}).collect()


def test_backtests_tell_what_fitting_took(spark):
    got = backtest(line(spark), lambda keys: PathfinderForecaster(ModelSpec(), keys), ["series"], min_train=20, test=3, stride=8, num_samples=20).table.collect()
    assert len(got) == 2 and all(r.train_walltime > 0 and r.num_samples == 20 for r in got)
