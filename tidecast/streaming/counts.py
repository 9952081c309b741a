"""Daily counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.scratch import folder


def daily_counts(spark: SparkSession, path: str, late: str = "2 days") -> DataFrame:
    """Stream path's events into counts and sums by type and day, everything that is available now, and return them.

    Each batch writes the days it changed, so that the watermark drops the state of days that no event can reach any
    more; of a day that several batches wrote, the latest counts.  Events later than `late` are dropped.  The result is
    read back from files, and nothing gathers in the driver.
    """
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(parent)
    # with-watermark columns must be TIMESTAMP
    events = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    counts = events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    days = counts.select("event_type", F.col("w.start").cast("date").alias("day"), "n", "total")
    where = folder(spark, "counts")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that runs again writes the same folder
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    spark.createDataFrame([], days.schema).write.parquet(f"{where}/out/batch=-1")
    run = days.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    written = spark.read.schema(days.schema.add("batch", "long")).option("basePath", f"{where}/out").parquet(f"{where}/out")
    latest = written.groupBy("event_type", "day").agg(F.max(F.struct("batch", "n", "total")).alias("last"))
    return latest.select("event_type", "day", "last.n", "last.total")
