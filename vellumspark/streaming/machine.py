"""The state of ingestion jobs, kept by a stateful stream.

Each event names a job and, unless it is the job's own, a step; ``seq`` orders the
events of a job whatever order they come in. The latest event of a step gives its
state, the latest of a job's own its state; a completed job completes its open
steps and a failed one fails those that run. A step that the pipeline doesn't have
counts as a warning and has no state. A job that hasn't ended is stuck once events
have come that are later than its last one by ``STUCK`` and the stream's lateness.

State is one row a job with the latest event of each step, a streaming aggregate
whose partial results are taken before the shuffle, so it doesn't grow with events
and no job's events meet in Python. Each change of a job sends it on with the number
of events seen; the row of the highest number is the job's state, so shuffled
input, replays and restarts end alike. An event counts however late it comes.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of the ingestion pipeline (fixed values).
STEPS = ("Parsing", "Table/Image Extraction", "Chunking", "Embedding Prep", "Embedding")
OPEN, ENDED = ("pending", "running"), ("completed", "failed")
STUCK = datetime.timedelta(hours=6)
#: A job as the stream sends it on: ``held`` are the states of ``STEPS`` in order, ``due`` the event time that makes it stuck.
SENT = "job_id long, held array<string>, job_status string, warnings long, seen long, last timestamp, due timestamp"


def _seconds(span: datetime.timedelta) -> Column:
    return F.expr(f"interval {int(span.total_seconds())} seconds")


def _job_status(said: Column) -> Column:
    return F.when(said.isin(*ENDED), said).otherwise("running")


def _closed(held: Column, job: Column) -> Column:
    """A step's state under the state of its job."""
    held = F.coalesce(held, F.lit("pending"))
    return F.when((job == "completed") & held.isin(*OPEN), "completed").when((job == "failed") & (held == "running"), "failed").otherwise(held)


def job_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """SENT of a stream of events (job_id, seq, ts, step, status). The session's state store has to be RocksDB's."""
    own, last = F.col("step").isNull(), F.max(F.col("ts").cast("timestamp"))
    newest = [F.max_by("status", F.when(F.col("step") == s, F.col("seq"))).alias(f"step{k}") for k, s in enumerate(STEPS)]
    jobs = events.groupBy("job_id").agg(F.max_by("status", F.when(own, F.col("seq"))).alias("said"), F.count_if(~own & ~F.col("step").isin(*STEPS)).alias("warnings"),
                                        F.count("*").alias("seen"), last.alias("last"), *newest)
    status = _job_status(F.col("said"))
    held = F.array(*[_closed(F.col(f"step{k}"), status) for k in range(len(STEPS))])
    due = F.when(status == "running", F.col("last") + _seconds(STUCK) + F.expr(f"interval {late}"))
    return jobs.select("job_id", held.alias("held"), status.alias("job_status"), "warnings", "seen", "last", due.alias("due"))


def job_batch(events: DataFrame, late: str = "1 day") -> DataFrame:
    """job_id, step, status, job_status, warnings, seen, stuck as the stream leaves them, by aggregates over the same events."""
    own = F.col("step").isNull()
    end = events.agg((F.max("ts") - F.expr(f"interval {late}")).alias("watermark"))
    jobs = events.groupBy("job_id").agg(F.max_by("status", F.when(own, F.col("seq"))).alias("said"), F.count_if(~own & ~F.col("step").isin(*STEPS)).alias("warnings"),
                                        F.count("*").alias("seen"), F.max("ts").alias("last"))
    jobs = jobs.crossJoin(F.broadcast(end)).withColumn("job_status", _job_status(F.col("said")))
    jobs = jobs.withColumn("stuck", (F.col("job_status") == "running") & (F.col("last") + _seconds(STUCK) <= F.col("watermark")))
    steps = events.filter(F.col("step").isin(*STEPS)).groupBy("job_id", "step").agg(F.max_by("status", "seq").alias("status"))
    every = jobs.select("*", F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("step")).join(steps, ["job_id", "step"], "left")
    return every.select("job_id", "step", _closed(F.col("status"), F.col("job_status")).alias("status"), "job_status", "warnings", "seen", "stuck")


def latest_states(sent: DataFrame) -> DataFrame:
    """The last state of each job and step of all that a stream sent on; stuck by the latest event that it has seen."""
    newest = sent.groupBy("job_id").agg(F.max_by(F.struct("held", "job_status", "warnings", "due"), "seen").alias("s"), F.max("seen").alias("seen"))
    end = sent.agg(F.max("last").alias("end"))
    stuck = F.coalesce(F.col("s.due") <= F.col("end"), F.lit(False))
    jobs = newest.crossJoin(F.broadcast(end)).select("job_id", "s.*", "seen", stuck.alias("stuck"))
    steps = F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in STEPS]).alias("step"), F.col("held").alias("status")))
    return jobs.select("job_id", steps.alias("e"), "job_status", "warnings", "seen", "stuck").select("job_id", "e.step", "e.status", "job_status", "warnings", "seen", "stuck")


def sent(spark: SparkSession, out: str) -> DataFrame:
    """All rows that ``run_jobs`` has written."""
    return spark.read.schema(SENT + ", batch long").option("basePath", out).parquet(out).drop("batch")


def run_jobs(events: DataFrame, out: str, checkpoint: str, late: str = "1 day") -> None:
    """Take in what there is of a stream of events; jobs sent on are appended to ``out``, one folder a batch, written anew if the batch is."""
    spark = events.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        job_stream(events, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
