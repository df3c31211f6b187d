"""Projects, collections, analyses and caches as tables: names, latest rows, cascades, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contract_text as C
from . import ordered


def unique_names(projects: DataFrame) -> DataFrame:
    """collection_name: the slug, with -1, -2 ... where an earlier project has the same."""
    s = C.slug(F.col("name"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("created_at", "id")) - 1
    return projects.withColumn("slug", s).withColumn("place", place).withColumn(
        "collection_name", F.when(F.col("place") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("place").cast("string")))).drop("slug", "place")


def owned(projects: DataFrame, owner: str, name_like: str | None = None) -> DataFrame:
    """An owner's projects, newest first; ``name_like`` is a pattern in which % and _ are wildcards, case aside."""
    rows = projects.filter(F.col("user_id") == owner)
    rows = rows if name_like is None else rows.filter(F.ilike("name", F.lit(name_like)))
    return rows.orderBy(F.col("created_at").desc(), "id")


SORTS = {"name": lambda: (F.lower("name"), F.col("id")), "documents": lambda: (F.col("documents").desc(), F.col("id")), "date": lambda: (F.col("created_at").desc(), F.col("id"))}


def find_projects(projects: DataFrame, text: str, sort: str = "date") -> DataFrame:
    """Projects whose name or description contains a text, case aside, in one of the orders of SORTS."""
    held = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in ("name", "description")]
    return projects.filter(held[0] | held[1]).orderBy(*SORTS[sort]())


def dataset_stats(analyses: DataFrame, clauses: DataFrame, least: float) -> DataFrame:
    """clause_type, clauses, analyses (eligible ones in all): completed analyses of that quality. clauses: id, clause_type."""
    eligible = analyses.filter((F.col("status") == "completed") & (F.col("quality_score") >= least)).select("id")
    typed = clauses.filter(F.col("clause_type").isNotNull()).join(eligible, "id").groupBy("clause_type").agg(F.count("*").alias("clauses"))
    return typed.crossJoin(eligible.agg(F.count("*").alias("analyses")))


def training_stats(examples: DataFrame) -> DataFrame:
    """part, source, clause_type, examples, part_hash. examples: part, source, clause_type, line.

    A part's hash is that of its blocks' hashes in order, a block's that of its
    lines' hashes in order; lines are hashed where they are, and a block is the
    hashes of one beginning, read in order without being held.
    """
    hashed = examples.select("part", "source", "clause_type", F.sha2(F.coalesce("line", F.lit("")), 256).alias("h"))
    blocks = ordered.ordered_digest(hashed.withColumn("block", F.substring("h", 1, 3)), ["part", "block"], "h")
    parts = blocks.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("b"))  # 4,096 blocks a part at most
    parts = parts.select("part", F.sha2(F.array_join("b.digest", ""), 256).alias("part_hash"))
    counts = hashed.groupBy("part", "source", "clause_type").agg(F.count("*").alias("examples"))
    return counts.join(parts, "part")


def invalidated(analyses: DataFrame, project_ids: DataFrame) -> DataFrame:
    """Analyses without those of projects that were ingested anew or deleted."""
    return analyses.join(project_ids.select("project_id"), "project_id", "left_anti")


def chat_pair(answers: DataFrame) -> DataFrame:
    """Two chat rows an answered question, for appending. answers: project_id, at, question, answer."""
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(0).alias("turn")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"), F.lit(1).alias("turn")))
    return answers.select("project_id", "at", F.explode(said).alias("s")).select("project_id", "at", "s.turn", "s.role", "s.text")


def cache_rows(answers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """cache_key, answer, at of answers whose key the cache lacks, the latest of each key, for appending."""
    key = C.cache_key(F.col("project_id").cast("string"), F.col("question"), F.col("k"), F.col("documents"))
    fresh = answers.withColumn("cache_key", key).groupBy("cache_key").agg(F.max_by(F.struct("answer", "at"), F.struct("at", "answer")).alias("x")).select("cache_key", "x.answer", "x.at")
    return fresh if known is None else fresh.join(known.select("cache_key"), "cache_key", "left_anti")


def delete_project(project_ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table (with project_id) without the rows of the given projects."""
    return {name: t.join(project_ids.select("project_id"), "project_id", "left_anti") for name, t in tables.items()}


def delete_document(points: DataFrame, source_file: str) -> DataFrame:
    return points.filter(~F.col("source_file").eqNullSafe(source_file))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def visible_analyses(analyses: DataFrame, hashes: DataFrame) -> DataFrame:
    """Latest analysis of each project; a completed one of an older corpus is hidden. hashes: project_id, corpus_hash."""
    newest = F.max_by(F.struct(*analyses.columns), F.struct("created_at", "id"))
    latest = analyses.groupBy("project_id").agg(newest.alias("a")).select("a.*")
    fresh = (F.col("status") != "completed") | F.col("document_hash").eqNullSafe(F.col("corpus_hash"))
    return latest.join(hashes, "project_id", "left").filter(fresh).drop("corpus_hash")


def progressive(events: DataFrame, columns: list[str]) -> DataFrame:
    """The last non-null value of each column by project. events: project_id, seq, columns..."""
    return events.groupBy("project_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns])


def point_id(doc: Column, index: Column) -> Column:
    """A repeatable id of a chunk."""
    return F.sha2(F.concat_ws("#", doc, index.cast("string")), 256)


def cached_answers(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions with the cached answer of their key, null where there is none. Both have cache_key."""
    return questions.join(cache.select("cache_key", "answer"), "cache_key", "left")


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, by an aggregate over rows."""
    return rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def hash_split(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Deal rows over named parts by a hash of their key; the same row always gets the same part."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    bounds, total = [], 0.0
    for name, share in shares.items():
        total += share
        bounds.append((name, total))
    part = F.when(u < bounds[0][1], bounds[0][0])
    for name, upto in bounds[1:]:
        part = part.when(u < upto, name)
    return rows.withColumn("part", part.otherwise(bounds[-1][0]))


def activate_model(registry: DataFrame, model_id: str) -> DataFrame:
    """The model becomes active, the one that was active its predecessor."""
    active = registry.filter(F.col("status") == "active").agg(F.max("model_id").alias("before"))
    this = F.col("model_id") == model_id
    return registry.crossJoin(F.broadcast(active)).select(
        *[c for c in registry.columns if c not in ("status", "previous_model_id")],
        F.when(this, "active").when(F.col("status") == "active", "inactive").otherwise(F.col("status")).alias("status"),
        F.when(this & (F.col("before") != F.col("model_id")), F.col("before")).otherwise(F.col("previous_model_id")).alias("previous_model_id"))


def rollback_model(registry: DataFrame) -> DataFrame:
    """The active model's predecessor becomes active, without a predecessor of its own; the one that was active is ready again.

    Without an active model, without a predecessor, or with one that the registry
    lacks, there is nothing to go back to, and that is an error.
    """
    active = registry.filter(F.col("status") == "active").select("model_id", "previous_model_id").limit(2).collect()
    if len(active) != 1:
        raise ValueError("no active model" if not active else "several active models")
    before = active[0]["previous_model_id"]
    if before is None or registry.filter(F.col("model_id") == before).isEmpty():
        raise ValueError("no previous model to go back to")
    this, last = F.col("model_id") == before, F.col("model_id") == active[0]["model_id"]
    return registry.withColumn("status", F.when(this, "active").when(last, "ready").otherwise(F.col("status"))).withColumn(
        "previous_model_id", F.when(this, F.lit(None)).otherwise(F.col("previous_model_id")))
