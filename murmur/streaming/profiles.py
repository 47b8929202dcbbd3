"""Structured Streaming versions of the hour profile, type distribution and post-type roll-up. An extension: the batch pipeline has no streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.normalize import utc_hour


def read_events(spark: SparkSession, folder: str, schema: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream. Times without a zone are UTC."""
    kind = schema or "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    # local times of the session's zone for the same instants, which the cast reads as such
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp")
    return stream.withColumn("ts", local if dict(stream.dtypes)["ts"] == "timestamp_ntz" else F.col("ts").cast("timestamp"))


def hour_profiles(events: DataFrame) -> DataFrame:
    """Per user, 24 counts by UTC hour, kept up to date: the state has a row per user."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("dated"), F.array(*[F.count_if(utc_hour(events, "ts") == h) for h in range(24)]).alias("hours"))


def windowed_types(events: DataFrame, kinds: Sequence[str], width: str = "1 hour", late: str = "10 minutes", kind: str = "event_type") -> DataFrame:
    """Per user and window, a count of each type. Events later than the watermark are left out and closed windows leave the state."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("events"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "events", *[f"n_{k}" for k in kinds])


def first_seen(events: DataFrame, late: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """Events without those repeated within the watermark: the streaming form of resuming by processed ids."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def to_table(stream: DataFrame, name: str, mode: str = "complete"):
    """A query into an in-memory table, for tests and small results."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
