"""Streaming forms: event windows, deduplication, sessions, job states and invalidation. Each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events a day and type; on a stream, rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    each = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return each.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "total")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    each = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return each.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job and step. events: job_id, seq, step (null: the job itself), status.

    A completed job completes its open steps; a failed one fails those that run.
    """
    steps = events.filter(F.col("step").isNotNull()).groupBy("job_id", "step").agg(F.max_by("status", "seq").alias("status"))
    jobs = events.filter(F.col("step").isNull()).groupBy("job_id").agg(F.max_by("status", "seq").alias("job_status"))
    both = steps.join(jobs, "job_id", "full_outer")
    status = (F.when((F.col("job_status") == "completed") & F.col("status").isin("pending", "running"), "completed")
              .when((F.col("job_status") == "failed") & (F.col("status") == "running"), "failed").otherwise(F.col("status")))
    return both.select("job_id", "step", status.alias("status"), F.coalesce("job_status", F.lit("running")).alias("job_status"))


def on_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a handler (invalidation, upsert) for each micro-batch until the input is used up."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
