"""Event streams: windowed counts, deduplication and sessions, over any streaming frame with an event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the events in a folder of Parquet files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and their value in cents per day and type; rows later than `late` are left out."""
    w = F.window("ts", "1 day")
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "cents")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no longer gap (an extension)."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Works off all that is there, appends closed windows to a folder, and stops."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def keep_rollup(events: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Works off what is there into an additive rollup: each batch's counts and cents go to a folder of the batch's number,
    so that a batch that runs twice replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_rollup(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rollup so far, its batches added up."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
