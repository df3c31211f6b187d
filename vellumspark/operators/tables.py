"""Written intermediate tables, for results that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(frame: DataFrame) -> str:
    """The shared folder that the session names; only a local session without one gets a folder of its own."""
    spark = frame.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def written(frame: DataFrame, **options) -> DataFrame:
    """The frame, written as Parquet with these options and read again: executors may be lost, and no later step computes it anew."""
    path = f"{shared_dir(frame)}/vellum-table-{uuid.uuid4().hex}"
    frame.write.options(compression="zstd", **options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
