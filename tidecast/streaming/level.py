"""A local level followed along an event stream: counts a day, filtered as days close."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidecast.scratch import folder

OUT = "series string, day date, y double, level double, variance double, loglik double"
STATE = "next long, level double, variance double, days array<long>, counts array<long>"
DAY_MS = 86_400_000


class Level:
    """The filter of one series, and the counts of the days that aren't closed yet."""

    def __init__(self, held: tuple | None, obs_var: float, level_var: float, mean0: float, var0: float) -> None:
        self.obs, self.step = obs_var, level_var
        self.next, self.m, self.p, days, counts = held or (None, mean0, var0, [], [])
        self.open = dict(zip(days, counts))

    def add(self, days: pd.Series) -> None:
        """Count events; those of days that have been closed are too late."""
        for day, n in days.value_counts().items():
            if self.next is None or day >= self.next:
                self.open[int(day)] = self.open.get(int(day), 0) + int(n)

    def close(self, watermark_ms: int) -> list[tuple]:
        """(day, y, level, variance, loglik) of the days that end by the watermark, those without events too."""
        if self.next is None:
            if not self.open or (min(self.open) + 1) * DAY_MS > watermark_ms:
                return []
            self.next = min(self.open)
        out = []
        while (self.next + 1) * DAY_MS <= watermark_ms:
            y = float(self.open.pop(self.next, 0))
            prior = self.p + self.step
            f, err = prior + self.obs, y - self.m
            self.m, self.p = self.m + prior / f * err, prior * (1 - prior / f)
            out.append((self.next, y, self.m, self.p, -0.5 * (math.log(2 * math.pi * f) + err * err / f)))
            self.next += 1
        return out

    def held(self) -> tuple:
        return self.next, self.m, self.p, list(self.open), list(self.open.values())

    def waits_for(self) -> int:
        """When the first open day ends."""
        return ((self.next if self.next is not None else min(self.open)) + 1) * DAY_MS


def local_level(spark: SparkSession, path: str, obs_var: float, level_var: float, late: str = "1 day", mean0: float = 0.0, var0: float = 1e6, files_per_batch: int | None = None, key: str = "event_type", time: str = "ts") -> DataFrame:
    """(series, day, y, level, variance, loglik): each series' daily counts filtered as a stream, everything that is
    available now.

    A day closes when the watermark, the latest event less `late`, passes its end; a timer in event time closes the days
    of series that get no more events.  Events of closed days are dropped; a day without any counts 0, from a series'
    first day on.  State is one series' filter and its open days: it doesn't grow with the stream.  Rows go to files as
    days close, and a batch that runs again writes the same.
    """
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    stream = stream.option("pathGlobFilter", name).parquet(parent) if name.endswith(".parquet") and not _is_folder(spark, path) else stream.parquet(path)
    events = stream.select(F.col(key).cast("string").alias("series"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", late)
    events = events.select("series", "at", F.unix_date(F.col("at").cast("date")).cast("long").alias("day"))

    def follow(of: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = Level(state.get if state.exists else None, obs_var, level_var, mean0, var0)
        if not state.hasTimedOut:
            for frame in frames:
                level.add(frame["day"])
        watermark = state.getCurrentWatermarkMs()
        rows = level.close(watermark)
        state.update(level.held())
        if level.open or level.next is not None:
            state.setTimeoutTimestamp(max(level.waits_for(), watermark + 1))
        if rows:
            day, *rest = zip(*rows)
            yield pd.DataFrame({"series": of[0], "day": pd.to_datetime(pd.Series(day), unit="D").dt.date, **dict(zip(("y", "level", "variance", "loglik"), map(list, rest)))})

    where = folder(spark, "level")
    closed = events.groupBy("series").applyInPandasWithState(follow, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    closed.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{where}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
