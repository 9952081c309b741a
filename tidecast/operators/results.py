"""Tables of predictions and posteriors: taking them out of results, joining runs of several models, scaling back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.names import FUTURE_DIM, PREDICTIVE_GROUPS, SAMPLE_DIMS, TIME_DIM


def _taken(result: object, groups: Sequence[str], needs: Sequence[str], what: str) -> DataFrame:
    if isinstance(result, Mapping):
        result = next((result[g] for g in groups if g in result), None)
    for g in groups:
        if not isinstance(result, DataFrame) and getattr(result, g, None) is not None:
            result = getattr(result, g)
    if not isinstance(result, DataFrame) or not set(needs) <= set(result.columns):
        raise TypeError(f"no {what} in this")
    return result


def prediction_samples(result: object) -> DataFrame:
    """The table of drawn predictions of a result: one itself, a mapping with one of names.PREDICTIVE_GROUPS, or an
    object with such an attribute.  TypeError where there is none."""
    return _taken(result, PREDICTIVE_GROUPS, SAMPLE_DIMS, "drawn predictions")


def posterior_table(result: object) -> DataFrame:
    """The table of posterior draws of a fit: one itself, a mapping with "posterior", or a fitted forecaster."""
    return _taken(result, ("posterior", "posterior_"), SAMPLE_DIMS, "posterior draws")


def by_model(results: Mapping[str, DataFrame], name: str = "model") -> DataFrame:
    """Tables of equal columns as one, with a column that names each's model."""
    if not results:
        raise ValueError("no results")
    parts = [df.withColumn(name, F.lit(key)) for key, df in results.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def back_transform(predictions: DataFrame, scale: DataFrame, keys: Sequence[str], columns: Sequence[str], floor: float | None = 0.0) -> DataFrame:
    """columns times their key's `scale`, not below floor; a key without a scale raises."""
    known = predictions.join(scale.select(*keys, F.col("scale").alias("_scale")), list(keys), "left")
    by = F.when(F.col("_scale").isNull(), F.raise_error(F.lit("a series has no scale")).cast("double")).otherwise(F.col("_scale"))
    lifted = lambda c: F.col(c) * by if floor is None else F.greatest(F.col(c) * by, F.lit(float(floor)))
    return known.withColumns({c: lifted(c) for c in columns}).drop("_scale")


def with_future_time(df: DataFrame) -> DataFrame:
    """df with its time column named as predictions name it."""
    return df.withColumnRenamed(TIME_DIM, FUTURE_DIM)
