"""Backtests: every window and series is fitted at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.names import POS
from tidecast.operators.metrics import DEFAULT_METRICS, Score, evaluate_forecast, named_metrics
from tidecast.operators.windows import window_splits
from tidecast.plans.forecaster import BaseForecaster

SPLIT = ["t0", "t1", "t2"]
Transform = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
PerWindow = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class BacktestResult:
    """t0, t1, t2 and metrics by name of each window, as a DataFrame, and the forecasts that they score."""

    table: DataFrame
    predictions: DataFrame


def window_scales(cut: DataFrame, keys: Sequence[str], seasonality: int) -> DataFrame:
    """(t0, t1, t2, scale): the mean |y[t] - y[t - seasonality]| of each window's training rows, pooled over series."""
    if seasonality < 1:
        raise ValueError("seasonality must be 1 or more")
    gap = F.abs(F.col("y") - F.lag("y", seasonality).over(Window.partitionBy(*SPLIT, *keys).orderBy(POS)))
    scale = cut.withColumn("_gap", gap).groupBy(*SPLIT).agg(F.avg("_gap").alias("scale"))
    return scale.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.raise_error(F.lit("a training window is too short or constant at this seasonality")).cast("double")))


def backtest(data: DataFrame, make: Callable[[list[str]], BaseForecaster], keys: Sequence[str] = (), metrics: Sequence[str | Score] | Mapping[str, str | Score] = DEFAULT_METRICS, test: int = 1, num_samples: int = 100, covariates: DataFrame | None = None, transform: Transform | None = None, seasonality: int | None = None, in_sample: bool = False, per_window: Mapping[str, PerWindow] | None = None, **split: object) -> BacktestResult:
    """Fit make(keys) on each window's training rows, forecast its test, score it.

    Windows become one more key, so all fits run as one job; a window holds its position in the series, and a fit sees
    nothing from t1 on.  Series that end early take part in the windows that end before them, and are scored on the
    steps that they have.  covariates (keys or not, pos, columns) span the data.  transform takes predictions (column
    pred) and truth and returns what is scored.  seasonality adds mase, scaled by each window's own training rows;
    in_sample adds train_ columns, the scores of observations resampled over the training rows.  per_window adds scores
    of one's own, tables (t0, t1, t2, name) made of the windows' training rows, the predictions and the truth.  All
    windows are fitted by one job, so train_walltime is the sum of the seconds that a window's fits took in their tasks.
    """
    duration = data.agg(F.max(POS)).first()[0] + 1
    windows = window_splits(data.sparkSession, duration, test=test, **split)
    # a series takes part in the windows that end before it does, on the steps that it has
    ends = data.groupBy(*keys).agg((F.max(POS) + 1).alias("_end"))
    cut = data.crossJoin(F.broadcast(windows)).filter((F.col(POS) >= F.col("t0")) & (F.col(POS) < F.col("t1")))
    cut = cut.join(ends, list(keys)) if keys else cut.crossJoin(F.broadcast(ends))
    cut = cut.filter("_end > t1").drop("_end")
    whole = [*SPLIT, *keys]
    fitted = make(whole).fit(cut.select(*whole, POS, "y"), covariates)
    # each window's horizon starts where its training ends
    steps = ends.crossJoin(F.broadcast(windows)).filter("_end > t1").withColumn(POS, F.explode(F.sequence(F.col("t1"), F.least("t2", "_end") - 1))).drop("_end")
    if fitted.had_covariates_:
        steps = steps.join(covariates, [*(k for k in keys if k in covariates.columns), POS])
    draws = fitted.draw_posterior(num_samples)
    predictions = fitted.forecast(covariates=steps, posterior=draws)
    truth = data.select(*keys, POS, F.col("y").alias("truth"))

    def score(samples: DataFrame, names: Mapping[str, str | Score]) -> DataFrame:
        pair = (samples, truth)
        if transform is not None:
            pair = transform(*pair)
        return evaluate_forecast(*pair, [*keys, POS], by=SPLIT, metrics=names)

    metrics = named_metrics(metrics)
    wanted = {**metrics, **({"_mae": "mae"} if seasonality is not None else {})}
    scores = score(predictions.withColumnRenamed("forecast", "pred"), wanted)
    if seasonality is not None:
        scores = scores.join(window_scales(cut, keys, seasonality), SPLIT)
        scores = scores.select(*SPLIT, *metrics, (F.col("_mae") / F.col("scale")).alias("mase"))
    for name, own in (per_window or {}).items():
        scores = scores.join(own(cut, predictions.withColumnRenamed("forecast", "pred"), truth).select(*SPLIT, F.col(name)), SPLIT)
    if in_sample:
        replayed = fitted.predict_in_sample(posterior=draws).withColumnRenamed("obs", "pred")
        trained = score(replayed, metrics)
        scores = scores.join(trained.select(*SPLIT, *(F.col(m).alias(f"train_{m}") for m in metrics)), SPLIT)
    scores = scores.withColumn("num_samples", F.lit(num_samples))
    if "fit_seconds" in fitted.posterior_.columns:
        took = fitted.posterior_.filter("chain = 0 and draw = 0").groupBy(*SPLIT).agg(F.sum("fit_seconds").alias("train_walltime"))
        scores = scores.join(took, SPLIT, "left")
    return BacktestResult(scores, predictions)


def results_to_dataframe(result: BacktestResult) -> DataFrame:
    return result.table.orderBy("t0", "t1")
