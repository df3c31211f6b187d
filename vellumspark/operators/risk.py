"""Deterministic risk layer: clause dedupe, rule risks, risk dedupe and scoring.

Schemas: clauses (project_id, pos, clause_type, title, text), metadata
(project_id, contract_type, expiration_date), risks (project_id, pos, origin,
category, severity, title, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import contract_text as C
from . import ordered


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity_value(severity: Column) -> Column:
    return F.try_element_at(_map(P.SEVERITY_VALUE), severity)


def dedupe_clauses(clauses: DataFrame) -> DataFrame:
    """The longest text of each type, the first of equals; 'other' clauses once by title. One aggregate, no sort."""
    key = F.when(F.col("clause_type") == "other", F.concat(F.lit("other:"), F.lower(F.trim("title")))).otherwise(F.col("clause_type"))
    length = F.when(F.col("clause_type") == "other", 0).otherwise(F.length("text") if "text" in clauses.columns else F.col("chars"))
    best = F.max_by(F.struct(*clauses.columns), F.struct(length, -F.col("pos")))
    return clauses.groupBy("project_id", key.alias("key")).agg(best.alias("c")).select("c.*")


def clause_facts(clauses: DataFrame) -> DataFrame:
    """Clauses with what the rules ask of their texts in place of the texts, which are read once and where they are.

    Adds chars, renews (automatically, without adequate notice), uncapped and
    obligors; each pattern runs only over clauses of the type that it concerns.
    """
    text = F.col("text")
    of = lambda kind, value: F.when(F.col("clause_type") == kind, value)
    return clauses.select(
        "project_id", "pos", "clause_type", "title", F.length(text).alias("chars"), of("auto_renewal", C.renews_without_notice(text)).alias("renews"),
        of("liability", ~C.liability_cap(text)["has_cap"]).alias("uncapped"), of("indemnification", C.obligors(text)).alias("obligors"))


RISK = "struct<pos:int,category:string,severity:string,title:string,confidence:double>"


def assess(facts: DataFrame, metadata: DataFrame) -> DataFrame:
    """project_id, the penalties, rule_score and rule risks (an array of RISK, in rule order) of every project of ``metadata``.

    ``facts``: deduped ``clause_facts``; a project has one clause a type and its "other" clauses.
    """
    held = facts.groupBy("project_id").agg(
        F.collect_set("clause_type").alias("types"), F.count_if("renews").alias("renewals"), F.count_if("uncapped").alias("caps"),
        F.size(F.array_distinct(F.flatten(F.collect_set("obligors")))).alias("parties"))
    rows = metadata.join(held, "project_id", "left").na.fill(0, ["renewals", "caps"]).withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    kind = F.lower(F.coalesce("contract_type", F.lit("")))
    lacks = lambda t: ~F.array_contains("types", t)
    undated = F.coalesce(F.col("expiration_date"), F.lit("")) == ""

    def risk(place: int, category: str, severity: str, title: str, confidence: float) -> Column:
        return F.struct(F.lit(place).alias("pos"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(title).alias("title"),
                        F.lit(confidence).alias("confidence"))

    missing = "missing_clause"
    single = [F.when(lacks(t), risk(i, missing, "high" if t == "liability" else "medium", f"Missing {t.replace('_', ' ')} clause", 1.0)) for i, t in enumerate(P.CORE_CLAUSES)]
    single += [
        F.when(C.one_of(kind, P.TECH_WORDS) & lacks("intellectual_property"), risk(10, missing, "high", "Missing Intellectual Property ownership clause", 1.0)),
        F.when(C.one_of(kind, P.COMMERCE_WORDS) & lacks("payment"), risk(11, missing, "high", "Missing Payment terms clause", 1.0)),
        F.when(undated & lacks("termination"), risk(12, "operational", "medium", "No expiration date or termination clause", 1.0))]
    repeated = [F.array_repeat(risk(20, "unfavorable_terms", "high", "Auto-renewal without adequate opt-out notice", 0.95), F.col("renewals").cast("int")),
                F.array_repeat(risk(30, "financial", "high", "Uncapped liability", 0.90), F.col("caps").cast("int"))]
    one_sided = F.when(F.coalesce(F.col("parties") == 1, F.lit(False)), risk(40, "unfavorable_terms", "high", "One-sided indemnification obligation", 0.85))
    found = F.concat(F.array_compact(F.array(*single)), *repeated, F.array_compact(F.array(one_sided)))
    penalties = sum((lacks(t).cast("int") for t in P.PENALTY_CLAUSES), F.lit(0)) * 16
    rows = rows.select("project_id", penalties.alias("missing_penalty"), F.when(undated & lacks("termination"), 10).otherwise(0).alias("exit_penalty"),
                       F.when(F.col("renewals") > 0, 20).otherwise(0).alias("renewal_penalty"), found.cast(f"array<{RISK}>").alias("risks"))
    total = F.col("missing_penalty") + F.col("exit_penalty") + F.col("renewal_penalty")
    return rows.withColumn("rule_score", F.least(F.lit(100), total))


def _facts(clauses: DataFrame) -> DataFrame:
    return dedupe_clauses(clause_facts(clauses) if "text" in clauses.columns else clauses)


def listed_risks(assessed: DataFrame) -> DataFrame:
    """Risks of assessed projects as rows, with their place; rule_score goes along, and a project without risks keeps a row of nulls."""
    each = assessed.select("project_id", "rule_score", F.posexplode_outer("risks").alias("place", "r"))
    return each.select("project_id", "rule_score", F.col("place").alias("pos"), F.when(F.col("r").isNotNull(), "rule").alias("origin"), "r.category", "r.severity", "r.title", "r.confidence")


def rule_risks(clauses: DataFrame, metadata: DataFrame) -> DataFrame:
    """Risks that follow from which clauses there are and what they say, in rule order."""
    return listed_risks(assess(_facts(clauses), metadata)).filter("origin is not null").drop("rule_score")


def all_risks(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Rule risks, then a model's: its places follow all of the rules'. model: project_id, pos, category, severity, title, confidence."""
    after = 1_000_000
    found = model.withColumn("pos", F.col("pos") + after).withColumn("origin", F.lit("model"))
    return rules.unionByName(found, allowMissingColumns=True)


def dedupe_risks(risks: DataFrame, prefix: int = 40) -> DataFrame:
    """Of risks whose titles begin alike (40 characters, case and outer blanks aside) the first; rows without a title stay.

    A title of up to 40 characters is its own beginning, so that a title repeats
    another's whole or its beginning exactly when their beginnings are equal.
    """
    head = F.substring(F.lower(F.trim("title")), 1, prefix)
    titled = risks.filter(F.col("title").isNotNull()).groupBy("project_id", head.alias("head")).agg(F.min_by(F.struct(*risks.columns), "pos").alias("r")).select("r.*")
    return titled.unionByName(risks.filter(F.col("title").isNull()))


def rule_score(clauses: DataFrame, metadata: DataFrame) -> DataFrame:
    """project_id, missing_penalty, exit_penalty, renewal_penalty, rule_score."""
    return assess(_facts(clauses), metadata).select("project_id", "missing_penalty", "exit_penalty", "renewal_penalty", "rule_score")


def score(rules: DataFrame, risks: DataFrame) -> DataFrame:
    """Scores of every project of ``rules`` (project_id, rule_score) from its risks."""
    return score_rows(rules.select("project_id", "rule_score").join(risks.drop("rule_score"), "project_id", "left"))


def score_rows(risks: DataFrame) -> DataFrame:
    """project_id, rule_score, model_score, overall_score, risk_level, highest_severity, counts and the five greatest contributors.

    ``risks``: rows as of ``listed_risks``, a model's added; a project without risks has a row of nulls.
    """
    value = severity_value(F.col("severity"))
    found = F.when(F.col("origin") != "rule", value)
    counts = [F.count_if(F.coalesce(F.col("severity") == s, F.lit(False))).alias(f"{s}_count") for s in P.SEVERITY_VALUE]
    place = F.struct((-value).alias("v"), "pos", "title")
    rows = risks.groupBy("project_id").agg(
        F.max("rule_score").alias("rule_score"), F.coalesce((F.max(found) * F.lit(0.6) + F.avg(found) * F.lit(0.4)).cast("int"), F.lit(0)).alias("model_score"),
        *counts, F.max_by("severity", value).alias("highest"), F.slice(F.sort_array(F.collect_list(F.when(F.col("title").isNotNull(), place))), 1, 5).alias("ordered"))
    blend = F.bround(P.RULE_WEIGHT * F.col("rule_score") + P.MODEL_WEIGHT * F.col("model_score")).cast("int")
    best = F.greatest("rule_score", "model_score", blend)
    floor = F.when((F.col("critical_count") >= 1) & (F.col("high_count") >= 2), 91).when(F.col("high_count") >= 2, 76).otherwise(0)
    rows = rows.withColumn("overall_score", F.least(F.lit(100), F.greatest(F.lit(0), best, floor)))
    return rows.select("project_id", "rule_score", "model_score", "overall_score", C.report_band(F.col("overall_score")).alias("risk_level"),
                       F.coalesce("highest", F.lit("none")).alias("highest_severity"), *[f"{s}_count" for s in P.SEVERITY_VALUE],
                       F.transform("ordered", lambda x: x["title"]).alias("top_contributors"))


def features(clauses: DataFrame) -> DataFrame:
    """Per project: whether a liability cap is present, the shortest notice and whether indemnity is one-sided."""
    is_type = lambda *t: F.col("clause_type").isin(*t)
    indemnity = F.sort_array(F.collect_list(F.when(is_type("indemnification"), F.struct("pos", "text"))))
    return clauses.groupBy("project_id").agg(
        F.bool_or(is_type("liability") & C.liability_cap(F.col("text"))["has_cap"]).alias("cap_present"),
        F.min(F.when(is_type("termination", "auto_renewal"), C.notice_days(F.col("text")))).alias("min_notice_days"), indemnity.alias("i")).select(
        "project_id", "cap_present", "min_notice_days",
        C.one_sided_indemnity(F.array_join(F.transform("i", lambda x: x["text"]), " ")).alias("one_sided_indemnity"))


def merge_metadata(fragments: DataFrame, fields: tuple[str, ...] = ("contract_type", "effective_date", "expiration_date", "governing_law")) -> DataFrame:
    """project_id and the first non-empty value of each field, in the order of ``pos``. fragments: project_id, pos, fields..."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return fragments.groupBy("project_id").agg(*[F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("pos"))).alias(c) for c in fields])


def obligations_by_party(clauses: DataFrame) -> DataFrame:
    """project_id, party, what it owes, in order. clauses: project_id, pos, obligations array<struct<party,description,deadline>>."""
    each = clauses.select("project_id", "pos", F.posexplode("obligations").alias("n", "o"))
    text = F.concat("o.description", F.when(F.coalesce("o.deadline", F.lit("")) != "", F.concat(F.lit(" (by "), F.col("o.deadline"), F.lit(")"))).otherwise(""))
    parts = each.groupBy("project_id", F.col("o.party").alias("party")).agg(F.array_sort(F.collect_list(F.struct("pos", "n", text.alias("t")))).alias("l"))
    return parts.select("project_id", "party", F.transform("l", lambda x: x["t"]).alias("owes"))


def key_dates(clauses: DataFrame) -> DataFrame:
    """Distinct dates of each project, sorted. clauses: project_id, dates array<string>."""
    return clauses.select("project_id", F.explode("dates").alias("d")).groupBy("project_id").agg(F.sort_array(F.collect_set("d")).alias("key_dates"))


def apply_verdicts(risks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """High and critical risks by their verdict on the title (the last one given): drop, downgrade one step, or keep."""
    last = verdicts.groupBy(F.col("title").alias("t")).agg(F.max_by("verdict", "pos").alias("verdict"))
    lower = _map({"critical": "high", "high": "medium"})
    serious = F.col("severity").isin("high", "critical")
    rows = risks.join(last, F.col("title") == F.col("t"), "left").drop("t")
    rows = rows.filter(~(serious & F.col("verdict").eqNullSafe("drop")))
    return rows.withColumn("severity", F.when(serious & F.col("verdict").eqNullSafe("downgrade"), F.try_element_at(lower, F.col("severity"))).otherwise(F.col("severity"))).drop("verdict")


def corpus_hash(rows: DataFrame, group: str, text: str = "text") -> DataFrame:
    """One hash of each group's texts in sorted order (first 32 hex digits), read in order without holding them."""
    return ordered.ordered_digest(rows, [group], text, "\n---\n").select(group, F.substring("digest", 1, 32).alias("corpus_hash"))
