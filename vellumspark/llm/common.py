"""Shared helpers: table access, written intermediate tables, row keys."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a local session without one gets a folder of its own, any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Intermediate results written as Parquet in the shared checkpoint folder.

    A written table survives lost executors, cuts lineage and gives the
    optimizer real sizes. ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/vellum-{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def save(self, frame: DataFrame, few_rows: bool = False) -> DataFrame:
        """Write and reread. ``few_rows``: one file, for a table of a row a source or the like."""
        path = f"{self.root}/t{self.count}"
        self.count += 1
        if few_rows:
            frame.coalesce(1).write.option("compression", "none").parquet(path)
        else:
            frame.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def crc_mod_py(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def pick(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names.

    Extra input columns, whatever their names, never meet an operator's own.
    """
    return frame.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


#: Rows of texts in one Arrow batch; Spark's default of 10,000 suits narrow rows.
TEXT_ROWS = 1000


def text_rows(frame: DataFrame) -> DataFrame:
    """The frame, with Arrow batches small enough for rows that hold whole texts."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return frame


def worker_cache() -> dict:
    """A dictionary that lasts as long as the worker process, for models that tasks share.

    Functions travel by value, so their modules' globals last for one task only.
    """
    return sys.modules.setdefault("_vellum_worker_cache", types.ModuleType("_vellum_worker_cache")).__dict__
