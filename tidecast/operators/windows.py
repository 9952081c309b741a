"""Expanding and rolling backtest windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.errors import BacktestWindowError


def window_splits(spark: SparkSession, duration: int, min_train: int | None = None, train: int | None = None, test: int | None = None, min_test: int = 1, stride: int = 1, kind: str | None = None) -> DataFrame:
    """(t0, t1, t2): train on [t0, t1), test on [t1, t2).

    Rolling windows train on `train` steps, expanding ones on all before t1, from min_train on.  Without test, a window
    tests to the end; a test is cut at the end, but holds min_test steps at least.
    """
    kind = kind or ("rolling" if train is not None else "expanding")
    if kind not in ("rolling", "expanding"):
        raise BacktestWindowError(f"unknown window type {kind!r}")
    if (kind == "rolling") != (train is not None):
        raise BacktestWindowError("a rolling window, and no other, needs a train length")
    first = train if kind == "rolling" else (min_train if min_train is not None else 1)
    if first < 1 or stride < 1 or min_test < 1 or (test is not None and test < min_test):
        raise BacktestWindowError("lengths and strides must be positive, and a test no shorter than min_test")
    if first > duration - min_test:
        raise BacktestWindowError("the series is too short for one window")
    t1 = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("long"), F.lit(duration - min_test).cast("long"), F.lit(stride).cast("long"))).alias("t1"))
    t0 = F.lit(0).cast("long") if kind == "expanding" else F.col("t1") - train
    t2 = F.lit(duration).cast("long") if test is None else F.least(F.col("t1") + test, F.lit(duration).cast("long"))
    return t1.select(t0.alias("t0"), "t1", t2.alias("t2"))
