"""Panels: long tables of (keys, time, pos, value), their spines, density and alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.errors import AlignmentError
from tidecast.names import POS, TIME_DIM


def as_series(df: DataFrame, time: str, value: str | Sequence[str], keys: Sequence[str] = (), role: str = "series") -> DataFrame:
    """(keys, time, pos, y): one row a step.  Several value columns become rows named by the column `role`.

    pos counts from 0 by time within each key.  Spark tables have no order of their own, so a time column is a must.
    """
    if time not in df.columns:
        raise AlignmentError(f"no time column {time!r}: rows have no order without one")
    values = [value] if isinstance(value, str) else list(value)
    if len(values) > 1:
        df, keys, value = df.unpivot([*keys, time], values, role, "y"), [*keys, role], "y"
    else:
        value = values[0]
    over = Window.partitionBy(*keys).orderBy(time)
    return df.select(*keys, F.col(time).alias(TIME_DIM), (F.row_number().over(over) - 1).cast("long").alias(POS), F.col(value).cast("double").alias("y"))


def null_covariates(series: DataFrame) -> DataFrame:
    """The time spine alone: covariates of no columns."""
    return series.select(TIME_DIM, POS).distinct()


def spine(series: DataFrame, keys: Sequence[str], time: str = TIME_DIM, step: str = "1") -> DataFrame:
    """Every key with every step from the first to the last time of all, `step` apart."""
    ends = F.broadcast(series.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")))
    # one row of ends meets the keys, whose steps explode where they are
    return series.select(*keys).distinct().crossJoin(ends).select(*keys, F.explode(F.expr(f"sequence(_lo, _hi, {step})")).alias(time))


def densify(series: DataFrame, keys: Sequence[str], time: str, value: str, step: str, fill: float | None = 0.0) -> DataFrame:
    """series on its full spine; missing steps hold `fill`, or raise where fill is None."""
    full = spine(series, keys, time, step).join(series.select(*keys, time, value), [*keys, time], "left")
    if fill is None:
        gaps = full.filter(F.col(value).isNull()).count()
        if gaps:
            raise AlignmentError(f"{gaps} steps are missing")
        return full
    return full.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(float(fill))))


def alignment_violations(data: DataFrame, covariates: DataFrame, time: str = TIME_DIM, keys: Sequence[str] = ()) -> DataFrame:
    """The positions (of each key) whose time the covariates lack or hold otherwise; covariates may be without keys."""
    on = [*(k for k in keys if k in covariates.columns), POS]
    other = covariates.select(*on, F.col(time).alias("_other"))
    return data.select(*keys, POS, time).join(other, on, "left").filter(~F.col(time).eqNullSafe(F.col("_other"))).select(*keys, POS, time, F.col("_other").alias("covariate_time"))


def validate_alignment(data: DataFrame, covariates: DataFrame, time: str = TIME_DIM, keys: Sequence[str] = ()) -> None:
    """Raise unless the covariates cover the data and start with exactly its times."""
    bad = alignment_violations(data, covariates, time, keys).count()
    if bad:
        raise AlignmentError(f"{bad} of the observed steps have no equal covariate time")


def validate_finite(df: DataFrame, *columns: str) -> None:
    """Raise where a column holds null or NaN: aggregates would skip the one and sort the other last."""
    wrong = None
    for c in columns:
        test = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        wrong = test if wrong is None else wrong | test
    if wrong is not None and not df.filter(wrong).isEmpty():
        raise AlignmentError(f"null or NaN in {', '.join(columns)}")


def pivot(panel: DataFrame, index: str, column: str, values: Sequence, value: str, agg=F.sum) -> DataFrame:
    """Long to wide over stated column values: one conditional aggregation, no pass to find them."""
    return panel.groupBy(index).agg(*(F.coalesce(agg(F.when(F.col(column) == v, F.col(value))), F.lit(0.0)).alias(str(v)) for v in values))


def unpivot(wide: DataFrame, index: Sequence[str], columns: Sequence[str], name: str = "input", value: str = "value") -> DataFrame:
    return wide.unpivot(list(index), list(columns), name, value)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group (of all rows where there is no group)."""
    if not group:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def scale_by_train_mean(series: DataFrame, keys: Sequence[str], t_obs: int, value: str = "y") -> DataFrame:
    """value over its key's mean before t_obs; the mean is `scale`.  Later steps don't count."""
    scale = series.filter(F.col(POS) < t_obs).groupBy(*keys).agg(F.avg(value).alias("scale"))
    return series.join(scale, list(keys)).withColumn("scaled", F.col(value) / F.col("scale"))


def standardize_train_only(series: DataFrame, t_obs: int, columns: Sequence[str]) -> DataFrame:
    """columns less their mean before t_obs, over their population deviation there."""
    stats = series.filter(F.col(POS) < t_obs).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    out = series.crossJoin(F.broadcast(stats))
    return out.withColumns({f"{c}_std": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns), *(f"_s_{c}" for c in columns))
