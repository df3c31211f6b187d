"""A kept table of points by id: upserts and deletes that rewrite touched buckets only.

Points lie in buckets by a hash of their id. A version is a small manifest that
says in which folder each bucket's rows are; a change writes new folders for the
buckets it touches and then one new manifest, by a rename that fails if another
writer was first, in which case the change is planned again on what that writer
left. Readers follow one manifest, so they see a change whole or not at all, and
a change that breaks off leaves the version before it.

A change can carry a stream's name and a batch number; they are kept in the
manifest, and a batch that is there already changes nothing.

Defined results: of equal ids in one change the one of the greatest ``order`` stays,
of equal ones that of the greater hash of the row; null is an id like any other; a
change without rows makes no version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.contract_text import words3
from . import folders, tables

#: Buckets of a new store; attempts of a change that other writers overtake.
BUCKETS, ATTEMPTS = 64, 5


class Overtaken(RuntimeError):
    """Other writers were first at every attempt."""


@dataclass
class PointStore:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS) -> PointStore:
        """An empty store for rows of a schema that has ``id``; one that is there already is an error."""
        folders.write_json(spark, f"{path}/shape.json", {"schema": schema.json(), "buckets": buckets})
        folders.write_json(spark, f"{path}/versions/{0:012d}.json", {"buckets": {}, "streams": {}})
        return cls(spark, path)

    @property
    def schema(self) -> StructType:
        import json

        return StructType.fromJson(json.loads(folders.read_json(self.spark, f"{self.path}/shape.json")["schema"]))

    def version(self) -> int:
        """The newest version."""
        return max(int(name[:12]) for name in folders.names(self.spark, f"{self.path}/versions") if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        return folders.read_json(self.spark, f"{self.path}/versions/{self.version() if version is None else version:012d}.json")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(folders.read_json(self.spark, f"{self.path}/shape.json")["buckets"])).cast("int")

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The points of the newest version, or of another."""
        return self._rows(self.manifest(version))

    def _change(self, plan: Callable[[dict], tuple[set[int], DataFrame] | None], stream: str | None, batch: int | None) -> int:
        """Write what ``plan`` makes of the touched buckets of the newest version; the version that then stands."""
        for _ in range(ATTEMPTS):
            version = self.version()
            manifest = self.manifest(version)
            if stream is not None and manifest["streams"].get(stream, -1) >= batch:
                return version
            planned = plan(manifest)
            if planned is None and stream is None:
                return version
            held = dict(manifest["buckets"])
            if planned is not None:
                touched, rows = planned
                folder = uuid.uuid4().hex
                place = f"{self.path}/data/{folder}"
                rows.withColumn("bucket", self._bucket(F.col("id"))).repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(place)
                held = {b: f for b, f in held.items() if int(b) not in touched}
                held |= {name.split("=")[1]: folder for name in folders.names(self.spark, place) if name.startswith("bucket=")}
            streams = manifest["streams"] | ({} if stream is None else {stream: batch})
            draft = f"{self.path}/drafts/{uuid.uuid4().hex}.json"
            folders.write_json(self.spark, draft, {"buckets": held, "streams": streams})
            if folders.rename(self.spark, draft, f"{self.path}/versions/{version + 1:012d}.json"):
                return version + 1
        raise Overtaken(f"{self.path}: {ATTEMPTS} attempts")

    def upsert(self, points: DataFrame, order: Column | None = None, stream: str | None = None, batch: int | None = None) -> int:
        """Points take the place of those of their ids, or are added."""
        names = self.schema.names
        row = F.struct(*names)
        place = F.struct((order if order is not None else F.lit(0)).alias("order"), F.xxhash64(F.to_json(row)).alias("hash"))
        fresh = tables.written(points.groupBy(F.col("id").alias("_id")).agg(F.max_by(row, place).alias("r")).select("r.*"))
        touched = {r["b"] for r in fresh.select(self._bucket(F.col("id")).alias("b")).distinct().collect()}

        def plan(manifest: dict) -> tuple[set[int], DataFrame] | None:
            if not touched:
                return None
            old, ids = self._rows(manifest, touched), fresh.select(F.col("id").alias("new_id"))
            return touched, old.join(ids, old["id"].eqNullSafe(ids["new_id"]), "left_anti").unionByName(fresh.select(names))

        return self._change(plan, stream, batch)

    def delete(self, condition: Column, stream: str | None = None, batch: int | None = None) -> int:
        """Points that meet the condition go; a null doesn't meet it."""
        return self._remove(lambda rows: rows.filter(condition), lambda rows: rows.filter(~F.coalesce(condition, F.lit(False))), stream, batch)

    def remove(self, keys: DataFrame, column: str, stream: str | None = None, batch: int | None = None) -> int:
        """Points whose column has one of the keys (a table with that column) go."""
        keys = tables.written(keys.select(column).distinct())
        return self._remove(lambda rows: rows.join(keys, column, "left_semi"), lambda rows: rows.join(keys, column, "left_anti"), stream, batch)

    def _remove(self, gone: Callable[[DataFrame], DataFrame], left: Callable[[DataFrame], DataFrame], stream: str | None, batch: int | None) -> int:
        def plan(manifest: dict) -> tuple[set[int], DataFrame] | None:
            touched = {r["b"] for r in gone(self._rows(manifest)).select(self._bucket(F.col("id")).alias("b")).distinct().collect()}
            return (touched, left(self._rows(manifest, touched))) if touched else None

        return self._change(plan, stream, batch)

    def vacuum(self, versions: int = 2) -> int:
        """Delete manifests but for the newest ``versions``, and folders that none of these names; how many folders went. No writer may be at work."""
        newest = self.version()
        kept = [v for v in range(newest - versions + 1, newest + 1) if v >= 0]
        named = {folder for v in kept for folder in self.manifest(v)["buckets"].values()}
        for name in folders.names(self.spark, f"{self.path}/versions"):
            if name.endswith(".json") and int(name[:12]) not in kept:
                folders.delete(self.spark, f"{self.path}/versions/{name}")
        lost = [f for f in folders.names(self.spark, f"{self.path}/data") if f not in named]
        for folder in lost:
            folders.delete(self.spark, f"{self.path}/data/{folder}")
        return len(lost)


def sparse_vectors(texts: DataFrame) -> DataFrame:
    """id, sparse: each text's words with their counts. texts: id, page_content. Words are counted by an aggregation, linear in the text."""
    words = texts.select("id", F.explode_outer(words3(F.coalesce("page_content", F.lit("")))).alias("word"))
    counts = words.groupBy("id", "word").agg(F.count("word").cast("int").alias("n"))
    listed = counts.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "n")))).alias("e"))
    return listed.select("id", F.map_from_entries("e").alias("sparse"))


def rebuild_sparse(store: PointStore, force: bool = False) -> int:
    """Sparse vectors made anew from the texts, for points that lack one or for all; dense vectors and ids stay, other points' buckets too."""
    rows = store.read()
    rows = rows if force else rows.filter(F.col("sparse").isNull())
    fresh = sparse_vectors(rows.select("id", "page_content"))
    return store.upsert(rows.drop("sparse").join(fresh, "id").select(store.schema.names))
