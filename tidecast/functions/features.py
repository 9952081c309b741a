"""Feature columns: Fourier terms, periodic profiles, availability, the seasonal-naive ensemble."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.names import POS


def fourier_features(position: Column, period: float, num_terms: int) -> list[Column]:
    """sin_1..sin_k and cos_1..cos_k of 2 pi k position / period."""
    if num_terms < 1:
        raise ValueError("num_terms must be 1 or more")
    angle = lambda k: F.lit(2 * math.pi * k) * position / F.lit(float(period))
    return [F.sin(angle(k)).alias(f"sin_{k}") for k in range(1, num_terms + 1)] + [F.cos(angle(k)).alias(f"cos_{k}") for k in range(1, num_terms + 1)]


def periodic_repeat(pattern: DataFrame, spine: DataFrame, period: int, value: str = "value") -> DataFrame:
    """spine with the pattern's value at pos modulo period; pattern is (pos, value) of one period, so it is broadcast."""
    one = pattern.select(F.col(POS).alias("_phase"), value)
    return spine.join(F.broadcast(one), F.pmod(F.col(POS), F.lit(period)) == F.col("_phase")).drop("_phase")


def weighted_availability(stock: Column, weights: Sequence[float]) -> Column:
    """Sum of weight * (1 - stock-out flag) over an array of slots."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(stock, w, lambda s, x: (1 - s.cast("double")) * x), F.lit(0.0), lambda a, v: a + v)


def saturating_availability(share: Column, floor: float, rate: float) -> Column:
    """floor + (1 - floor) * expm1(-rate * share) / expm1(-rate)."""
    return F.lit(floor) + F.lit(1 - floor) * F.expm1(F.lit(-rate) * share) / F.lit(math.expm1(-rate))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def seasonal_naive(history: DataFrame, keys: Sequence[str], t_obs: int, horizon: int, period: int, value: str = "y") -> DataFrame:
    """(keys, draw, pos, pred): each window of the history that starts a multiple of period before t_obs and holds the
    horizon is one draw of the future.

    A history row finds the draws whose windows hold it by division and explodes into those alone; nothing is joined.
    """
    back = F.lit(t_obs) - F.col(POS)
    first = F.greatest(F.ceil(back / period), F.lit(-(-horizon // period)).cast("long"), F.lit(1).cast("long"))
    last = F.least(F.floor((back + (horizon - 1)) / period), F.lit(t_obs // period).cast("long"))
    rows = history.filter(F.col(POS) < t_obs).select(*keys, POS, value, F.explode(F.when(first <= last, F.sequence(first, last))).alias("draw"))
    return rows.select(*keys, "draw", (F.col(POS) + F.col("draw") * period).cast("long").alias(POS), F.col(value).cast("double").alias("pred"))


def calendar_parts(time: Column) -> list[Column]:
    """weekday (Monday is 0), hour, day_of_month and month of a date or timestamp."""
    return [F.weekday(time).alias("weekday"), F.hour(time).alias("hour"), F.dayofmonth(time).alias("day_of_month"), F.month(time).alias("month")]


def step_flag(time: Column, since: str) -> Column:
    """1.0 from a date or timestamp on, 0.0 before."""
    return (time >= F.lit(since).cast("timestamp")).cast("double")


def design_matrix(df: DataFrame, keep: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """keep and named covariate columns; null or NaN in one of these raises when the table is read."""
    checked = {name: F.when(c.isNull() | F.isnan(c.cast("double")), F.raise_error(F.lit(f"{name} holds null or NaN")).cast("double")).otherwise(c.cast("double")) for name, c in columns.items()}
    return df.select(*keep, *(c.alias(name) for name, c in checked.items()))
