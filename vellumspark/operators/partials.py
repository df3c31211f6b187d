"""Dashboard figures from partial sums that merge, so that new analyses are added without reading the old ones.

A partial is a row a project, day and risk band with counts and exact sums. Those
of several batches add up to those of all their rows; removed analyses are added
with a sign of -1. Every figure of the dashboard follows from the partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contract_text as C
from .points import PointStore

KEYS = ("project_id", "day", "band")
SUMS = {"n": "bigint", "risk": "bigint", "rated": "bigint", "quality": "decimal(38,6)", "flagged": "bigint", "high": "bigint"}


def partials(analyses: DataFrame, sign: int = 1, high_risk: int = 60) -> DataFrame:
    """id, KEYS, SUMS of completed analyses; ``sign`` -1 takes them away."""
    done = analyses.filter(F.col("status") == "completed")
    rated = F.coalesce(F.col("quality_score") != 0, F.lit(False))
    sums = {"n": F.lit(1), "risk": F.coalesce("overall_risk_score", F.lit(0)), "rated": rated.cast("int"), "quality": F.when(rated, F.col("quality_score").cast("decimal(18,6)")).otherwise(0),
            "flagged": F.coalesce("flagged", F.lit(False)).cast("int"), "high": F.coalesce(F.col("overall_risk_score") > high_risk, F.lit(False)).cast("int")}
    keyed = done.select("project_id", F.to_date("created_at").alias("day"), C.dashboard_band(F.col("overall_risk_score")).alias("band"), *[(v * sign).alias(k) for k, v in sums.items()])
    return _summed(keyed)


def _summed(rows: DataFrame) -> DataFrame:
    each = rows.groupBy(*KEYS).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in SUMS.items()])
    return each.select(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in KEYS]).alias("id"), *KEYS, *SUMS)


def merged(*parts: DataFrame) -> DataFrame:
    """Partials of all the parts' rows together."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _summed(rows)


def create(spark: SparkSession, path: str, project: str = "bigint") -> PointStore:
    """An empty store of partials."""
    schema = f"id string, project_id {project}, day date, band string, " + ", ".join(f"{c} {kind}" for c, kind in SUMS.items())
    return PointStore.create(spark, path, spark.createDataFrame([], schema).schema)


def take_in(store: PointStore, analyses: DataFrame, stream: str, batch: int, sign: int = 1) -> int:
    """Add a batch of analyses to the store once, however often it is given. The store has one writer."""
    if store.manifest()["streams"].get(stream, -1) >= batch:
        return store.version()
    fresh = partials(analyses, sign)
    known = store.read().join(fresh.select("id"), "id", "left_semi")
    return store.upsert(merged(fresh, known), stream=stream, batch=batch)


def totals(parts: DataFrame) -> DataFrame:
    """The row of ``dashboard.totals``."""
    held = parts.filter("n > 0")
    each = held.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    mean = lambda a, b: a.cast("double") / F.nullif(b, F.lit(0))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("analyses"), F.count("*").alias("projects"), F.bround(mean(F.sum("risk"), F.sum("n")), 1).alias("avg_risk"),
        F.bround(mean(F.sum("quality"), F.sum("rated")) * 100, 1).alias("avg_quality"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged"), F.coalesce(F.sum("high"), F.lit(0)).alias("high_risk"))


def risk_distribution(parts: DataFrame) -> DataFrame:
    """band, n of the bands that have analyses."""
    return parts.groupBy("band").agg(F.sum("n").alias("n")).filter("n > 0")


def timeline(parts: DataFrame, last_day: Column, days: int) -> DataFrame:
    """day, n over the window that ends on last_day, days without any included."""
    window = parts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    return window.join(parts.groupBy("day").agg(F.sum("n").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def overview(parts: DataFrame, projects: DataFrame, documents: DataFrame, first_day: Column | None = None) -> DataFrame:
    """One row: all projects and documents of an owner, and the analyses of the range with their means. projects: project_id; documents: project_id, one row a file."""
    ranged = parts if first_day is None else parts.filter(F.col("day") >= first_day)
    ranged = ranged.join(projects.select("project_id"), "project_id", "left_semi")
    held = documents.join(projects.select("project_id"), "project_id", "left_semi").agg(F.count("*").alias("documents"))
    counts = projects.agg(F.count_distinct("project_id").alias("total_projects"))
    return totals(ranged).withColumnRenamed("projects", "analysed_projects").crossJoin(F.broadcast(held)).crossJoin(F.broadcast(counts))
