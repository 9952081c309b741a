"""Backtests of regressions from prefix moments: all windows cost one aggregation of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import linalg
from tidecast.names import POS

SPLIT = ["t0", "t1", "t2"]


def window_moments(data: DataFrame, keys: Sequence[str], columns: Sequence[Column], y: Column, windows: DataFrame) -> DataFrame:
    """(keys, t0, t1, t2, n, xx, xy, yy): the moments of each series' rows in [t0, t1), for all windows at once.

    Rows are summed by series and the stretch between neighbouring ends of windows, before their exchange; a window is
    the difference of two running sums over stretches, so no row is copied for a window.  Windows are a table of the
    driver's size (window_splits).
    """
    p, keys = len(columns), list(keys)
    bounds = windows.select(F.explode(F.array("t0", "t1")).alias("_b")).distinct()
    rank = F.row_number().over(Window.orderBy("_b"))
    bounds = bounds.select("_b", (rank - 1).alias("_stretch"))
    ends = bounds.select(F.col("_b").alias("_low"), F.lead("_b").over(Window.orderBy("_b")).alias("_high"), "_stretch").filter("_high is not null")
    place = ends.select("_stretch", F.explode(F.sequence("_low", F.col("_high") - 1)).alias(POS))
    named = {f"x{i}": c.cast("double") for i, c in enumerate(columns)}
    rows = data.select(*keys, F.col(POS), *(c.alias(f"_{n}") for n, c in named.items()), y.cast("double").alias("_y")).dropna().join(F.broadcast(place), POS)
    sums = {f"_{i}_{j}": F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(p) for j in range(i + 1)} | {f"_{i}": F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(p)}
    sums |= {"_n": F.count("_y").cast("double"), "_yy": F.sum(F.col("_y") * F.col("_y"))}
    held = rows.groupBy(*keys, "_stretch").agg(*(s.alias(n) for n, s in sums.items()))
    # a series without rows in a stretch has running sums there all the same
    spine = held.select(*keys).distinct().crossJoin(F.broadcast(bounds.select("_stretch")))
    upto = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    running = spine.join(held, [*keys, "_stretch"], "left").select(*keys, "_stretch", F.array(*(F.coalesce(F.sum(F.coalesce(F.col(n), F.lit(0.0))).over(upto), F.lit(0.0)) for n in sums)).alias("_sums"))
    of = windows.join(bounds.toDF("t0", "_low"), "t0").join(bounds.toDF("t1", "_high"), "t1").select(*SPLIT, "_low", "_high")
    low = running.withColumnsRenamed({"_stretch": "_low", "_sums": "_from"}).join(F.broadcast(of), "_low")
    met = low.join(running.withColumnsRenamed({"_stretch": "_high", "_sums": "_to"}), [*keys, "_high"]).withColumn("_sums", F.zip_with("_to", "_from", lambda a, b: a - b))
    at = {n: F.get("_sums", F.lit(i)) for i, n in enumerate(sums)}
    xx = F.array(*(F.array(*(at[f"_{max(i, j)}_{min(i, j)}"] for j in range(p))) for i in range(p)))
    return met.select(*keys, *SPLIT, F.round(at["_n"]).cast("long").alias("n"), xx.alias("xx"), F.array(*(at[f"_{i}"] for i in range(p))).alias("xy"), at["_yy"].alias("yy"))


def fits(moments: DataFrame, by: Sequence[str], precision: Sequence[float]) -> DataFrame:
    """(by, n, coef, cov, noise): ridge regressions of moments; noise is the residuals' mean square over n - p, or over 1."""
    p = len(precision)
    held = moments.filter("n > 0").withColumn("cov", linalg.inverse(linalg.plus(F.col("xx"), linalg.diagonal(precision)), p)["x"]).withColumn("coef", linalg.times(F.col("cov"), F.col("xy")))
    left = F.col("yy") - 2 * linalg.dot(F.col("coef"), F.col("xy")) + linalg.quadratic(F.col("xx"), F.col("coef"))
    return held.select(*by, "n", "coef", "cov", (F.greatest(left, F.lit(0.0)) / F.greatest(F.col("n") - p, F.lit(1))).alias("noise"))


def backtest_regression(data: DataFrame, keys: Sequence[str], columns: Sequence[Column], y: Column, windows: DataFrame, precision: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(scores by window, predictions) of regressions fitted on every window and series at once.

    predictions: keys, t0, t1, t2, pos, truth, mean, sd.  scores: mae, rmse, log_score (mean log density of the truth) and
    n over all series' test steps.  A row of the data is read once for the fits and meets the windows that test it, which
    is what there is to score.  Series without rows in a window's training aren't forecast there.
    """
    keys = list(keys)
    fit = fits(window_moments(data, keys, columns, y, windows), [*keys, *SPLIT], precision)
    tests = F.broadcast(windows.withColumn(POS, F.explode(F.sequence(F.col("t1"), F.col("t2") - 1))))
    named = [c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    steps = data.select(*keys, POS, *named, y.cast("double").alias("truth")).dropna().join(tests, POS).withColumn("_at", F.array(*(F.col(f"_x{i}") for i in range(len(columns)))))
    met = steps.join(fit, [*keys, *SPLIT])
    sd = F.sqrt(F.col("noise") * (1 + linalg.quadratic(F.col("cov"), F.col("_at"))))
    out = met.select(*keys, *SPLIT, POS, "truth", linalg.dot(F.col("coef"), F.col("_at")).alias("mean"), sd.alias("sd"))
    error = F.col("truth") - F.col("mean")
    density = -0.5 * F.lit(math.log(2 * math.pi)) - F.ln("sd") - 0.5 * error * error / (F.col("sd") * F.col("sd"))
    scores = out.groupBy(*SPLIT).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(density).alias("log_score"), F.count(F.lit(1)).alias("n"))
    return scores, out
