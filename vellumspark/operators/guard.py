"""Output guardrails: overlap of extracted text with its source, unsafe statements, entities.

Source bigrams and words are taken once a project and joined to its items, rather
than once an item.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import params as P
from ..functions import contract_text as C
from . import tables


def clause_overlap(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of an item's bigrams that its project's source has. items: project_id, item_id, text; sources: project_id, text.

    Bigrams are exploded and semi-joined, so a project's source is never one row.
    """
    words = C.words3(F.col("text")).alias("words")  # a column of its own: bigrams name it several times
    own = items.select("project_id", "item_id", words).select("project_id", "item_id", F.explode_outer(C.bigrams(F.col("words"))).alias("bigram"))
    wanted = own.select("project_id", "bigram").distinct()
    every = sources.select("project_id", words).select("project_id", F.explode(C.bigrams(F.col("words"))).alias("bigram"))
    known = every.join(wanted, ["project_id", "bigram"], "left_semi").distinct().withColumn("hit", F.lit(1))
    both = own.join(known, ["project_id", "bigram"], "left")
    return both.groupBy("project_id", "item_id").agg(F.coalesce(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.nullif(F.count("bigram"), F.lit(0)), 6), F.lit(0.0)).alias("overlap"))


def unsafe_statements(items: DataFrame) -> DataFrame:
    """Items with the labels of the unsafe statements that they hold."""
    found = F.array_compact(F.array(*[F.when(F.rlike("text", F.lit(p)), label) for label, p in P.UNSAFE.items()]))
    return items.select("project_id", "item_id", F.explode(found).alias("label"))


#: Phrases of a project that one automaton holds; texts that one task runs it over, about.
PHRASES, TEXTS = 50_000, 4096


def phrases_found(phrases: DataFrame, sources: DataFrame) -> DataFrame:
    """project_id, phrase: those of a project's phrases that occur anywhere in one of its texts. phrases: project_id, phrase; sources: project_id, text.

    A task builds one automaton of a block of a project's phrases and runs it over
    a part of the project's texts, each read once whatever the number of phrases. A
    project of many texts is many parts, one of many phrases many blocks. An empty
    phrase occurs in every text; null phrases and texts count for nothing.
    """
    wanted = phrases.select("project_id", "phrase").filter("phrase is not null").distinct()
    held = sources.select("project_id", "text").filter("text is not null")
    blocks = wanted.groupBy("project_id").agg(F.ceil(F.count("*") / PHRASES).cast("int").alias("blocks"))
    shape = tables.written(held.groupBy("project_id").agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("parts")).join(blocks, "project_id"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wanted.join(shape, "project_id").select("project_id", F.pmod(F.xxhash64("phrase"), F.col("blocks")).cast("int").alias("block"), every("parts").alias("part"), "phrase")
    right = held.join(shape, "project_id").select("project_id", every("blocks").alias("block"), F.pmod(F.xxhash64("text"), F.col("parts")).cast("int").alias("part"), "text")
    schema = StructType([phrases.schema["project_id"], StructField("phrase", StringType())])

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, texts: pa.Table) -> pa.Table:
        import ahocorasick

        seen: set[str] = set()
        automaton = ahocorasick.Automaton()
        for phrase in mine.column("phrase").to_pylist():
            automaton.add_word(phrase, phrase) if phrase else seen.add("")
        if len(automaton):
            automaton.make_automaton()
        for text in texts.column("text") if texts.num_rows else ():
            if len(automaton) and len(seen) < mine.num_rows:
                seen.update(phrase for _, phrase in automaton.iter(text.as_py()))
        found = sorted(seen) if texts.num_rows else []
        return pa.table({"project_id": pa.array([key[0].as_py()] * len(found), mine.schema.field("project_id").type), "phrase": pa.array(found, pa.string())})

    on = ("project_id", "block", "part")
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema).distinct()


def entity_overlap(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of an item's key entities that occur in its project's source, case-insensitively."""
    own = items.select("project_id", "item_id", F.explode(F.array_distinct(C.key_entities(F.col("text")))).alias("entity")).withColumn("phrase", F.lower("entity"))
    hits = phrases_found(own.select("project_id", "phrase"), sources.select("project_id", F.lower("text").alias("text"))).withColumn("hit", F.lit(1))
    both = own.join(hits, ["project_id", "phrase"], "left")
    return both.groupBy("project_id", "item_id").agg((F.count("hit") / F.count("*")).alias("overlap"))


def confidence(hallucinations, unsafe, weight: float = 0.1):
    """1 less the weighted counts, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - hallucinations * F.lit(weight) - unsafe * F.lit(0.2)))


def validate_clauses(items: DataFrame, sources: DataFrame, least: float = P.CLAUSE_OVERLAP) -> DataFrame:
    """project_id, hallucinations, unsafe, confidence, passed."""
    low = clause_overlap(items, sources).filter(F.col("overlap") < least).groupBy("project_id").agg(F.count("*").alias("hallucinations"))
    unsafe = unsafe_statements(items).groupBy("project_id").agg(F.count("*").alias("unsafe"))
    rows = items.select("project_id").distinct().join(low, "project_id", "left").join(unsafe, "project_id", "left").na.fill(0, ["hallucinations", "unsafe"])
    return rows.select("project_id", "hallucinations", "unsafe", F.round(confidence(F.col("hallucinations"), F.col("unsafe")), 6).alias("confidence"),
                       ((F.col("hallucinations") == 0) & (F.col("unsafe") == 0)).alias("passed"))


def _known_words(items: DataFrame, sources: DataFrame, pattern: str) -> DataFrame:
    """project_id, word (hit): the words of ``items`` (project_id, word) that the project's sources have."""
    wanted = items.select("project_id", "word").distinct()
    known = sources.select("project_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0))).alias("word"))
    return known.join(wanted, ["project_id", "word"], "left_semi").distinct().withColumn("hit", F.lit(1))


def validate_summaries(summaries: DataFrame, sources: DataFrame, least: float = P.SUMMARY_OVERLAP) -> DataFrame:
    """project_id, hallucinations, confidence, passed: claims of which too few key entities are words of the source. summaries: project_id, text."""
    said = summaries.select("project_id", F.monotonically_increasing_id().alias("summary"), F.posexplode(C.claims(F.col("text"))).alias("no", "claim"))
    entities = said.select("project_id", "summary", "no", F.explode(C.key_entities(F.col("claim"))).alias("entity")).withColumn("word", F.lower("entity"))
    known = _known_words(entities, sources, P.WORD3)
    each = entities.join(known, ["project_id", "word"], "left").groupBy("project_id", "summary", "no").agg((F.count("hit") / F.count("*")).alias("overlap"))
    return _verdict(summaries, each.filter(F.col("overlap") < least), 0.15)


def validate_risks(risks: DataFrame, sources: DataFrame, least: float = P.RISK_OVERLAP) -> DataFrame:
    """project_id, hallucinations, confidence, passed: risks of which too few terms occur in the source. risks: project_id, pos, title, description."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    terms = risks.select("project_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(P.WORD4), 0))).alias("word"))
    known = _known_words(terms, sources, P.WORD4)
    each = terms.join(known, ["project_id", "word"], "left").groupBy("project_id", "pos").agg((F.count("hit") / F.count("*")).alias("overlap"))
    return _verdict(risks, each.filter(F.col("overlap") < least), 0.1)


def _verdict(items: DataFrame, wrong: DataFrame, weight: float) -> DataFrame:
    counts = wrong.groupBy("project_id").agg(F.count("*").alias("hallucinations"))
    rows = items.select("project_id").distinct().join(counts, "project_id", "left").na.fill(0, ["hallucinations"])
    return rows.select("project_id", "hallucinations", F.round(confidence(F.col("hallucinations"), F.lit(0), weight), 6).alias("confidence"), (F.col("hallucinations") == 0).alias("passed"))


def needs_review(overall, hallucinations, unsafe_serious, missing):
    return (overall < P.JUDGE_LEAST) | (hallucinations > 0) | (unsafe_serious > 0) | (missing > 2)


def fabricated_entities(items: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """project_id, item_id, entities, fabricated: facts of an item, and those of them that its project's sources don't state.

    Facts of both sides are compared as sets, case aside; ``strict`` lower-cases the
    source before its facts are found and the items' not at all, so that whatever
    is capitalised counts as fabricated. Facts meet by project and fact.
    """
    fold = (lambda c: c) if strict else F.lower
    own = items.select("project_id", "item_id", F.explode_outer(F.array_distinct(F.transform(C.factual_entities(F.col("text")), fold))).alias("entity"))
    source = F.lower("text") if strict else F.col("text")
    stated = sources.select("project_id", F.explode(F.transform(C.factual_entities(source), fold)).alias("entity"))
    stated = stated.join(own.select("project_id", "entity").distinct(), ["project_id", "entity"], "left_semi").distinct().withColumn("hit", F.lit(1))
    each = own.join(stated, ["project_id", "entity"], "left").groupBy("project_id", "item_id")
    return each.agg(F.count("entity").alias("entities"), F.count_if(F.col("entity").isNotNull() & F.col("hit").isNull()).alias("fabricated"))


def fabrication_rates(items: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """project_id, items, fabricating, rate: items with a fact that the sources don't state."""
    each = fabricated_entities(items, sources, strict).groupBy("project_id")
    return each.agg(F.count("*").alias("items"), F.count_if(F.col("fabricated") > 0).alias("fabricating"), F.round(F.count_if(F.col("fabricated") > 0) / F.count("*"), 6).alias("rate"))
