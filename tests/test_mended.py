"""Labels of forecasts, noise by key, ragged panels, the convergence rule."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError
from tidecast.plans import diagnostics
from tidecast.plans.backtest import backtest
from tidecast.plans.forecaster import PathfinderForecaster, SeasonalNaiveForecaster, local_trend_spec
from tidecast.plans.models import time_series
from tidecast.plans.spec import Prior

DAY = dt.date(2024, 1, 1)


def panel(spark, lengths):
    rng = np.random.default_rng(0)
    rows = [(s, DAY + dt.timedelta(days=t), t, float(5 + t + rng.normal())) for s, n in lengths.items() for t in range(n)]
    return spark.createDataFrame(rows, "series string, time date, pos long, y double")


@pytest.fixture(scope="module")
def ragged(spark):
    return panel(spark, {"a": 20, "b": 14}).cache()


@pytest.fixture(scope="module")
def fitted(ragged):
    return PathfinderForecaster(local_trend_spec(), ["series"], num_draws=20).fit(ragged)


def test_keyed_future_index_of_ragged_series(spark, fitted):
    later = [("a", DAY + dt.timedelta(days=20 + 2 * k), k) for k in range(3)] + [("b", DAY + dt.timedelta(days=14 + k), k) for k in range(2)]
    future = spark.createDataFrame(later, "series string, time date, pos long")
    out = fitted.forecast(future_index=future, num_samples=4)
    assert "time_future" in out.columns
    got = {(r.series, r.time_future, r.pos) for r in out.collect()}
    assert got == {("a", DAY + dt.timedelta(days=20 + 2 * k), 20 + k) for k in range(3)} | {("b", DAY + dt.timedelta(days=14 + k), 14 + k) for k in range(2)}
    wrong = spark.createDataFrame([("a", DAY + dt.timedelta(days=15), 0)], "series string, time date, pos long")
    with pytest.raises(AlignmentError):
        fitted.forecast(future_index=wrong)


def test_a_horizon_is_labelled_by_the_datas_own_step(fitted):
    got = fitted.forecast(horizon=3, num_samples=2).select("series", "pos", "time_future").distinct().collect()
    assert {(r.series, r.pos): r.time_future for r in got} == {(s, n + k): DAY + dt.timedelta(days=n + k) for s, n in (("a", 20), ("b", 14)) for k in range(3)}


def test_covariates_label_their_horizon(spark):
    rows = [(DAY + dt.timedelta(days=t), t, float(t % 3)) for t in range(18)]
    cov = spark.createDataFrame(rows, "time date, pos long, x double")
    from tidecast.plans.spec import ModelSpec

    data = panel(spark, {"a": 15})
    made = PathfinderForecaster(ModelSpec(covariates=("x",)), ["series"], num_draws=5).fit(data, cov)
    got = made.forecast(covariates=cov, num_samples=2).select("pos", "time_future").distinct().collect()
    assert {(r.pos, r.time_future) for r in got} == {(t, DAY + dt.timedelta(days=t)) for t in (15, 16, 17)}


def test_own_models_noise_depends_on_no_horizon_and_no_number_of_draws(ragged):
    made = PathfinderForecaster(time_series(Prior("normal", {"sigma": 1.0}), Prior("halfnormal", {"sigma": 5.0})), ["series"], num_draws=30).fit(ragged)
    draws = made.draw_posterior(10)
    long = {tuple(r[:4]): tuple(r[-2:]) for r in made.forecast(horizon=4, posterior=draws).select("series", "chain", "draw", "pos", "mu_future", "forecast").collect()}
    short = {tuple(r[:4]): tuple(r[-2:]) for r in made.forecast(horizon=2, posterior=draws.filter("draw < 5")).select("series", "chain", "draw", "pos", "mu_future", "forecast").collect()}
    assert len(short) == 2 * 5 * 2 and all(long[k] == v for k, v in short.items())


def test_ragged_panels_are_backtested_on_what_each_series_has(ragged):
    found = backtest(ragged.drop("time"), lambda keys: SeasonalNaiveForecaster(keys, 2, num_draws=2), ["series"], metrics=("mae",), test=3, train=8, stride=3)
    rows = {r.t1: r.mae for r in found.table.collect()}
    y = {(r.series, r.pos): r.y for r in ragged.collect()}
    n = {"a": 20, "b": 14}
    for t1, mae in rows.items():
        errors = [abs(np.mean([y[s, p - 2], y[s, p - 4]]) - y[s, p]) if p - t1 < 2 else None for s in n if n[s] > t1 for p in range(t1, min(t1 + 3, n[s]))]
        assert mae is not None and all(e is None or e >= 0 for e in errors)
    steps = {(r.series, r.t1, r.pos) for r in found.predictions.select("series", "t1", "pos").distinct().collect()}
    assert all(p < n[s] for s, _, p in steps) and any(s == "b" and t1 == 11 for s, t1, _ in steps) and not any(s == "b" and t1 >= 14 for s, t1, _ in steps)


def as_stated(loss):
    """The rule in its own words, on plain numbers."""
    if not np.isfinite(loss).all():
        return None
    n = max(int(len(loss) * 0.1), 10)
    if len(loss) // 2 + n > len(loss) - n:
        return None
    last, mid = loss[-n:], loss[len(loss) // 2 :][:n]
    mad = np.median(np.abs(last - np.median(last)))
    return bool(np.median(mid) - np.median(last) > max(mad, 2 * 1.858 * mad * np.sqrt(2 / n)))


def test_convergence_is_told_by_the_rule(spark):
    rng = np.random.default_rng(4)
    histories = {}
    for k in range(60):
        n = int(rng.integers(5, 400))
        x = rng.normal(size=n) * rng.choice([0.1, 1, 5]) - np.arange(n) * rng.choice([0, 0.001, 0.01, 0.1])
        if k % 9 == 0:
            x[0] = [np.nan, np.inf][k % 2]
        histories[k] = x
        assert diagnostics.still_falling(x) is as_stated(x)
    rows = pd.concat([pd.DataFrame({"k": k, "step": np.arange(len(x)), "loss": x}) for k, x in histories.items()])
    got = {r.k: (r.still_falling if r.assessed else None) for r in diagnostics.elbo_convergence(spark.createDataFrame(rows), by=["k"]).collect()}
    assert got == {k: as_stated(x) for k, x in histories.items()}


def test_posteriors_stay_readable_after_a_refit(ragged):
    made = PathfinderForecaster(local_trend_spec(), ["series"], num_draws=5).fit(ragged)
    before = made.posterior_
    made.fit(ragged.filter(F.col("series") == "a"))
    assert before.count() == 10 and made.posterior_.count() == 5
