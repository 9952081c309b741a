"""Scores of sample forecasts: draws are reduced at each place in one pass, then averaged over places."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError
from tidecast.names import POS

DEFAULT_METRICS = ("mae", "rmse", "crps", "coverage")


def _open_unit(x: float, name: str) -> float:
    if not 0 < x < 1:
        raise ValueError(f"{name} must lie between 0 and 1")
    return float(x)


def quantile_of(ordered: Column, q: float) -> Column:
    """The linearly interpolated quantile of an array in rising order."""
    place = F.lit(q) * (F.size(ordered) - 1)
    low = F.floor(place).cast("int")
    a = F.get(ordered, low)
    b = F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (place - low) * (b - a)


def crps_of(ordered: Column, truth: Column) -> Column:
    """mean |x - y| less half the mean absolute difference of the draws, which sorted draws give by their ranks."""
    n = F.size(ordered).cast("double")
    spread = F.aggregate(F.transform(ordered, lambda x, i: (2 * (i + 1) - n - 1) * x), F.lit(0.0), lambda a, v: a + v) / (n * n)
    return F.aggregate(ordered, F.lit(0.0), lambda a, x: a + F.abs(x - truth)) / n - spread


def reduce_draws(samples: DataFrame, truth: DataFrame, on: Sequence[str], by: Sequence[str] = (), pred: str = "pred", value: str = "truth") -> DataFrame:
    """(by, on, truth, draws): each place's draws in rising order, beside its truth.

    Draws gather on the exchange of one aggregation; a place has as many as were drawn, never more.  A place without a
    truth, with a null one or with several raises: a score of what is left would be another score.
    """
    keys = list(dict.fromkeys([*by, *on]))
    held = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(pred)).alias("draws"))
    if set(on) - set(truth.columns):
        raise AlignmentError("the truth lacks " + ", ".join(sorted(set(on) - set(truth.columns))))
    shared = [k for k in keys if k in truth.columns]
    known = truth.groupBy(*shared).agg(F.max(value).cast("double").alias("_truth"), F.count(F.lit(1)).alias("_truths"))
    told = (
        F.when(F.col("_truths") > 1, F.raise_error(F.lit("a forecast has several truths")).cast("double"))
        .when(F.col("_truth").isNull(), F.raise_error(F.lit("a forecast has no truth")).cast("double"))
        .otherwise(F.col("_truth"))
    )
    return held.join(known, shared, "left").withColumn("truth", told).drop("_truth", "_truths")


def truth_gaps(samples: DataFrame, truth: DataFrame, on: Sequence[str], value: str = "truth") -> DataFrame:
    """One row: places of the forecast, those of them without a truth, and those with several."""
    places = samples.select(*on).distinct()
    known = truth.filter(F.col(value).isNotNull()).groupBy(*on).agg(F.count(F.lit(1)).alias("_truths"))
    met = places.join(known, list(on), "left")
    return met.agg(F.count(F.lit(1)).alias("places"), F.count_if(F.col("_truths").isNull()).alias("missing"), F.count_if(F.col("_truths") > 1).alias("repeated"))


def metric(name: str, alpha: float = 0.9, quantile: float = 0.5) -> Column:
    """The aggregate, over places of reduce_draws, of a metric by name."""
    d, y = F.col("draws"), F.col("truth")
    tail = (1 - _open_unit(alpha, "alpha")) / 2
    lo, hi = quantile_of(d, tail), quantile_of(d, 1 - tail)
    q = _open_unit(quantile, "quantile")
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)
    off = y - quantile_of(d, q)
    table = {
        "mae": lambda: F.avg(F.abs(quantile_of(d, 0.5) - y)),
        "rmse": lambda: F.sqrt(F.avg(F.pow(mean - y, 2))),
        "crps": lambda: F.avg(F.when(F.size(d) < 2, F.raise_error(F.lit("CRPS needs two draws or more"))).otherwise(crps_of(d, y))),
        "coverage": lambda: F.avg(F.when((lo <= y) & (y <= hi), F.lit(1.0)).otherwise(F.lit(0.0))),
        "pinball": lambda: F.avg(F.greatest(F.lit(q) * off, F.lit(q - 1) * off)),
        "interval_score": lambda: F.avg(hi - lo + F.lit(2 / (1 - alpha)) * (F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0)))),
    }
    if name not in table:
        raise ValueError(f"unknown metric {name!r}")
    return table[name]()


#: A metric of one's own: (draws in rising order, truth) of a place -> its score, which is averaged over places.
Score = Callable[[Column, Column], Column]


def evaluate_forecast(samples: DataFrame, truth: DataFrame, on: Sequence[str], by: Sequence[str] = (), metrics: Sequence[str | Score] | Mapping[str, str | Score] = DEFAULT_METRICS, alpha: float = 0.9, quantile: float = 0.5) -> DataFrame:
    """One row (for each value of `by`) with a column a metric, all from one pass over the draws.

    metrics are names, functions of a place's draws and truth, or both by name of their column.
    """
    places = reduce_draws(samples, truth, on, by)
    return places.groupBy(*by).agg(*(_aggregate(m, alpha, quantile).alias(name) for name, m in named_metrics(metrics).items()))


def named_metrics(metrics: Sequence[str | Score] | Mapping[str, str | Score]) -> dict[str, str | Score]:
    if isinstance(metrics, Mapping):
        return dict(metrics)
    return {m if isinstance(m, str) else m.__name__: m for m in metrics}


def _aggregate(m: str | Score, alpha: float, quantile: float) -> Column:
    return metric(m, alpha, quantile) if isinstance(m, str) else F.avg(m(F.col("draws"), F.col("truth")))


def crps_empirical(samples: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """CRPS of each place."""
    return reduce_draws(samples, truth, on).select(*on, crps_of(F.col("draws"), F.col("truth")).alias("crps"))


def _named(name: str):
    def of(samples: DataFrame, truth: DataFrame, on: Sequence[str], **settings: float) -> DataFrame:
        return evaluate_forecast(samples, truth, on, metrics=(name,), **settings)

    of.__name__ = f"eval_{name}"
    return of


eval_mae, eval_rmse, eval_crps, eval_coverage, eval_pinball, eval_interval_score = (_named(m) for m in ("mae", "rmse", "crps", "coverage", "pinball", "interval_score"))


def mase_scale(train: DataFrame, keys: Sequence[str], seasonality: int = 1, value: str = "y") -> DataFrame:
    """One row, scale: the mean |y[t] - y[t - seasonality]| pooled over all series."""
    if seasonality < 1:
        raise ValueError("seasonality must be 1 or more")
    gap = F.abs(F.col(value) - F.lag(value, seasonality).over(Window.partitionBy(*keys).orderBy(POS)))
    return train.withColumn("_gap", gap).agg(F.avg("_gap").alias("scale"))


def make_mase(train: DataFrame, keys: Sequence[str], seasonality: int = 1, value: str = "y"):
    """A metric (samples, truth, on) -> one row, mase; a scale of nothing or zero raises."""
    scale = mase_scale(train, keys, seasonality, value).first()["scale"]
    if not scale:
        raise ValueError("the training series is too short or constant at this seasonality")

    def mase(samples: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
        return eval_mae(samples, truth, on).select((F.col("mae") / F.lit(scale)).alias("mase"))

    return mase
