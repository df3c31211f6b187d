"""Dashboard rollups over analyses (id, project_id, status, created_at, overall_risk_score, quality_score, flagged).

``now`` is always a parameter, so results are repeatable. Each rollup is one
aggregation with partial sums; none sorts or gathers its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import contract_text as C


def in_range(analyses: DataFrame, now: Column, days: int | None) -> DataFrame:
    done = analyses.filter(F.col("status") == "completed")
    return done if days is None else done.filter(F.col("created_at") > now - F.make_dt_interval(F.lit(days)))


def totals(analyses: DataFrame, high_risk: int = 60) -> DataFrame:
    """Counts and means of completed analyses; quality is averaged over non-zero scores, in percent."""
    done = analyses.filter(F.col("status") == "completed")
    return done.agg(
        F.count("*").alias("analyses"), F.count_distinct("project_id").alias("projects"),
        F.bround(F.avg("overall_risk_score"), 1).alias("avg_risk"),
        F.bround(F.avg(F.when(F.col("quality_score") != 0, F.col("quality_score"))) * 100, 1).alias("avg_quality"),
        F.count_if("flagged").alias("flagged"), F.count_if(F.col("overall_risk_score") > high_risk).alias("high_risk"))


def risk_distribution(analyses: DataFrame) -> DataFrame:
    """Completed analyses by dashboard band, bands without any included."""
    spark = analyses.sparkSession
    bands = spark.createDataFrame([(i, b) for i, b in enumerate(("low", "medium", "high", "critical"))], "place int, band string")
    counted = analyses.filter(F.col("status") == "completed").groupBy(C.dashboard_band(F.col("overall_risk_score")).alias("band")).count()
    return bands.join(counted, "band", "left").select("place", "band", F.coalesce("count", F.lit(0)).alias("n"))


def timeline(analyses: DataFrame, last_day: Column, days: int) -> DataFrame:
    """Completed analyses a day over the window that ends on last_day, days without any included."""
    window = analyses.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    counted = analyses.filter(F.col("status") == "completed").groupBy(F.to_date("created_at").alias("day")).count()
    return window.join(counted, "day", "left").select("day", F.coalesce("count", F.lit(0)).alias("n"))


def trends(analyses: DataFrame, now: Column, days: int = P.TREND_DAYS) -> DataFrame:
    """Last period against the one before: counts, mean risk and their change in percent (null where the base is 0)."""
    done = analyses.filter(F.col("status") == "completed").withColumn("age", F.date_diff(now, F.to_date("created_at")))
    this, last = F.col("age").between(0, days - 1), F.col("age").between(days, 2 * days - 1)

    def change(a: Column, b: Column) -> Column:
        return F.bround((a - b) * 100.0 / F.nullif(b, F.lit(0)), 1)

    sums = done.agg(F.count_if(this).alias("this_n"), F.count_if(last).alias("last_n"),
                    F.avg(F.when(this, F.col("overall_risk_score"))).alias("this_risk"), F.avg(F.when(last, F.col("overall_risk_score"))).alias("last_risk"))
    return sums.select("this_n", "last_n", change(F.col("this_n"), F.col("last_n")).alias("n_change"),
                       change(F.col("this_risk"), F.col("last_risk")).alias("risk_change"))


def recent(analyses: DataFrame, n: int = 10) -> DataFrame:
    return analyses.filter(F.col("status") == "completed").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def latest_per_project(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each project, by an aggregate rather than a sort of each project's rows."""
    newest = F.max_by(F.struct(*analyses.columns), F.struct("created_at", "id"))
    return analyses.groupBy("project_id").agg(newest.alias("row")).select("row.*")


def json_counts(rows: DataFrame, column: str, schema: str, value: Column, label: str) -> DataFrame:
    """How often each value occurs in a JSON column; text that is not JSON counts for nothing."""
    parsed = rows.withColumn("parsed", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))
    return parsed.select(value.alias(label)).filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def top_n(counts: DataFrame, label: str, n: int) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), F.col(label)).limit(n)


def content_type_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by what they hold; one with a table and an image counts in both. chunks: content_types array."""
    has = lambda kind: F.array_contains("content_types", kind)
    return chunks.agg(F.count("*").alias("total"), F.count_if(has("text")).alias("text"), F.count_if(has("table")).alias("tables"),
                      F.count_if(has("image")).alias("images"))


def metric_trend(results: DataFrame, metrics: list[str], now: Column, days: int) -> DataFrame:
    """Daily mean of each metric over the last days. results: ts and one column a metric."""
    long = results.filter(F.col("ts") > now - F.make_dt_interval(F.lit(days))).unpivot(["ts"], metrics, "metric", "value")
    return long.groupBy("metric", F.to_date("ts").alias("day")).agg(F.bround(F.avg("value"), 3).alias("mean"), F.count("value").alias("n"))


def weekly_change(daily: DataFrame) -> DataFrame:
    """Weekly sums with their change against the week before. daily: day, n."""
    weeks = daily.groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(F.sum("n").alias("n"))
    return weeks.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("week")))
