"""Loaders: origin-destination counts, hourly records, and weekly totals of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.names import POS

WEEK = 168


def od_counts(shards: Sequence[DataFrame], hours: int = 1) -> DataFrame:
    """(time, pos, origin, destination, rides) of shards that follow each other in time; a position is `hours` long."""
    whole = shards[0]
    for s in shards[1:]:
        whole = whole.unionByName(s)
    start = F.broadcast(whole.agg(F.min("time").alias("_t0")))
    since = (F.unix_timestamp(F.col("time").cast("timestamp")) - F.unix_timestamp(F.col("_t0").cast("timestamp"))) / (3600 * hours)
    return whole.crossJoin(start).withColumn(POS, F.floor(since).cast("long")).drop("_t0")


def _blocks(counts: DataFrame, keys: Sequence[str], week: int) -> DataFrame:
    """rides of each whole block of `week` positions; a partial one at the end is dropped."""
    n = F.broadcast(counts.agg((F.max(POS) + 1).alias("_n")))
    rows = counts.crossJoin(n).withColumn("block", F.floor(F.col(POS) / week).cast("long")).filter(F.col("block") < F.floor(F.col("_n") / week))
    return rows.groupBy(*keys, "block").agg(F.sum("rides").alias("rides"))


def weekly_total(counts: DataFrame, week: int = WEEK) -> DataFrame:
    """(block, y): the logarithm of all rides of each week."""
    return _blocks(counts, [], week).select("block", F.ln("rides").alias("y"))


def weekly_by_origin(counts: DataFrame, num_series: int | None = 8, week: int = WEEK) -> DataFrame:
    """(origin, block, y): log1p of each week's rides from the num_series largest origins; ties go to the first by name."""
    if num_series is not None and num_series < 1:
        raise ValueError("num_series must be 1 or more")
    weeks = _blocks(counts, ["origin"], week)
    if num_series is not None:
        top = weeks.groupBy("origin").agg(F.sum("rides").alias("n")).orderBy(F.desc("n"), "origin").limit(num_series)
        weeks = weeks.join(F.broadcast(top.select("origin")), "origin", "left_semi")
    return weeks.select("origin", "block", F.log1p(F.col("rides").cast("double")).alias("y"))


def hourly_csv(spark: SparkSession, path: str, start: str, columns: Sequence[str]) -> DataFrame:
    """(time, pos, columns) of one CSV file whose rows are hours from `start` on, in the order of the file."""
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} double" for c in columns)).coalesce(1).withColumn("_i", F.monotonically_increasing_id())
    placed = rows.withColumn(POS, (F.row_number().over(Window.orderBy("_i")) - 1).cast("long"))
    return placed.select(F.expr(f"timestamp_ntz'{start}' + make_interval(0, 0, 0, 0, cast({POS} as int), 0, 0)").alias("time"), POS, *columns)
