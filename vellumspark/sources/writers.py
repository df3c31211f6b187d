"""Writers: collections, JSON lines, CSV, chunk exports, reports and append-only logs."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store


def replace_collection(points: DataFrame, root: str) -> None:
    """Replace the partitions of the collections that ``points`` holds, and no others."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_name").parquet(root)


def append_collection(points: DataFrame, root: str) -> None:
    points.write.mode("append").partitionBy("collection_name").parquet(root)


def with_ids(chunks: DataFrame, collection: str) -> DataFrame:
    """Chunks as points with repeatable ids."""
    return chunks.withColumn("id", store.point_id(F.col("doc_id"), F.col("chunk_index"))).withColumn("collection_name", F.lit(collection))


def rebuild_sparse(points: DataFrame, force: bool = False) -> DataFrame:
    """Points with sparse vectors computed anew from their text; dense vectors and ids stay. Points that have one are left alone unless forced."""
    from ..functions.contract_text import words3

    words = words3(F.col("page_content"))
    counts = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)))))
    return points.withColumn("sparse", counts if force else F.coalesce("sparse", counts))


def json_lines(rows: DataFrame, path: str, order: list[Column] | None = None, most: int | None = None) -> None:
    """JSON lines; with ``most``, the first rows of the order."""
    rows = rows.orderBy(*order) if order else rows
    (rows.limit(most) if most is not None else rows).write.mode("overwrite").json(path)


def csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes doubled, null empty."""
    rows.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("nullValue", "").csv(path)


def csv_line(*columns: Column) -> Column:
    """One CSV line as text: only values with a comma or a quote are quoted, null is empty."""
    def cell(c: Column) -> Column:
        t = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(F.rlike(t, F.lit('[,"]')), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)

    return F.concat_ws(",", *[cell(c) for c in columns])


def conversation_text(turns: DataFrame) -> DataFrame:
    """conv_id, transcript in order of turns. turns: conv_id, turn, role, text."""
    line = F.concat(F.upper(F.col("role")), F.lit(": "), F.coalesce("text", F.lit("")))
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("l"))
    return parts.select("conv_id", F.array_join("l.line", "\n\n").alias("transcript"))


def log_status(spark: SparkSession, rows: DataFrame, root: str) -> None:
    """Append status rows; ``store.progressive`` and ``store.visible_analyses`` read the latest."""
    rows.write.mode("append").parquet(root)


def markdown_table(rows: DataFrame, most: int = 100) -> str:
    """A small, ordered result as Markdown; at most so many rows reach the driver."""
    head = rows.columns
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect()])


def html_table(rows: DataFrame, title: str, most: int = 100) -> str:
    """A small, ordered result as an HTML page, values escaped; at most so many rows reach the driver."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "<tr>" + "".join(cell("th", c) for c in rows.columns) + "</tr>"
    body = ["<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows.limit(most).collect()]
    return "\n".join(["<!DOCTYPE html>", f"<html><head><meta charset=\"utf-8\">{cell('title', title)}</head><body>{cell('h1', title)}", "<table>", head, *body, "</table></body></html>"])


def json_report(aggregates: DataFrame, cases: DataFrame, path: str, at: Column | None = None) -> None:
    """One JSON line with a time, a one-row table of aggregates, its grade and recommendation; a case a line beside it, in ``path``/cases.

    aggregates has clause_f1 and whatever else is to be reported.
    """
    from ..functions.contract_text import grade

    summary = F.struct(grade(F.col("clause_f1")).alias("grade"))
    line = aggregates.select((at if at is not None else F.current_timestamp()).alias("timestamp"), F.struct(*aggregates.columns).alias("aggregates"), summary.alias("summary"))
    line.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    cases.write.mode("overwrite").json(f"{path}/cases")


def metric_rows(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row a metric, for appending to a metrics table."""
    return results.unpivot(keys, metrics, "metric", "value").filter(F.col("value").isNotNull())
