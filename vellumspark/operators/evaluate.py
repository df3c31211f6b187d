"""Evaluation metrics: precision and recall, rollups, run comparison, gates, consistency and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .. import params as P
from ..functions.contract_text import normal_type, words3
from . import ranks, tables


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), digits)


def f1(p: Column, r: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), digits)


def per_type(predicted: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Multiset hits by type. Both tables: keys..., type. Output: keys..., type, predicted, truth, hits."""
    keys = keys or []
    a = predicted.groupBy(*keys, "type").agg(F.count("*").alias("predicted"))
    b = truth.groupBy(*keys, "type").agg(F.count("*").alias("truth"))
    both = a.join(b, [*keys, "type"], "full_outer").na.fill(0, ["predicted", "truth"])
    return both.withColumn("hits", F.least("predicted", "truth"))


def micro(counts: DataFrame) -> DataFrame:
    sums = counts.agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "truth")])
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("truth"))
    return sums.select(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def macro(counts: DataFrame) -> DataFrame:
    """Means over types that the truth has."""
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("truth"))
    each = counts.filter("truth > 0").select(p.alias("p"), r.alias("r"), f1(p, r).alias("f"))
    return each.agg(F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("f"), 6).alias("f1"))


def set_scores(found: Column, expected: Column) -> Column:
    """Struct precision, recall, f1 of two label arrays as sets; nothing expected and nothing found is perfect."""
    hits = F.size(F.array_intersect(found, expected))
    nothing = (F.size(found) == 0) & (F.size(expected) == 0)
    p = F.when(nothing, 1.0).otherwise(ratio(hits, F.size(F.array_distinct(found))))
    r = F.when(nothing, 1.0).otherwise(ratio(hits, F.size(F.array_distinct(expected))))
    return F.struct(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def clause_scores(found: Column, expected: Column, unexpected: Column) -> Column:
    """Struct precision, recall, f1 of normalised clause types; only types that neither list names count as wrong finds."""
    fold = lambda c: F.array_distinct(F.transform(c, normal_type))
    f, e, u = fold(found), fold(expected), fold(unexpected)
    hits = F.size(F.array_intersect(f, e))
    p, r = ratio(hits, hits + F.size(F.array_except(F.array_except(f, e), u))), ratio(hits, F.size(e))
    return F.struct(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def title_scores(found: Column, expected: Column) -> Column:
    """Struct precision, recall of risk titles, case and outer blanks aside. With nothing expected recall is 1, and precision 1 only if nothing is found."""
    fold = lambda c: F.array_distinct(F.transform(c, lambda t: F.trim(F.lower(t))))
    f, e = fold(found), fold(expected)
    hits = F.size(F.array_intersect(f, e))
    none = F.size(e) == 0
    p = F.when(none, (F.size(f) == 0).cast("double")).otherwise(ratio(hits, F.size(f)))
    return F.struct(p.alias("precision"), F.when(none, 1.0).otherwise(ratio(hits, F.size(e))).alias("recall"))


def summary_scores(summary: Column, expected: Column, excluded: Column) -> Column:
    """Struct enough (half of the expected keywords or more), excluded (any excluded one), share of the expected; nothing expected is all found."""
    text = F.lower(F.coalesce(summary, F.lit("")))
    found = F.size(F.filter(expected, lambda w: F.contains(text, F.lower(w))))
    none = F.size(expected) == 0
    return F.struct((none | (found >= F.size(expected) * P.KEYWORD_SHARE)).alias("enough"), F.exists(excluded, lambda w: F.contains(text, F.lower(w))).alias("excluded"),
                    F.when(none, 1.0).otherwise(ratio(found, F.size(expected))).alias("share"))


def citation_validity(risks: DataFrame, sources: DataFrame, least: float = P.CITED_OVERLAP) -> DataFrame:
    """project_id, validity: share of high and critical risks with a quote of which ``least`` of the words occur in the source; 1 without such risks.

    risks: project_id, risk_id, severity, quotes (array); sources: project_id,
    text. A quote's words meet the source's distinct words by project and word,
    so no project's text is ever one row.
    """
    serious = risks.filter(F.col("severity").isin("high", "critical")).select("project_id", "risk_id", F.posexplode_outer("quotes").alias("quote_no", "quote"))
    asked = serious.select("project_id", "risk_id", "quote_no", F.explode_outer(F.array_distinct(words3(F.coalesce("quote", F.lit(""))))).alias("word"))
    wanted = asked.select("project_id", "word").distinct()
    known = sources.select("project_id", F.explode(F.array_distinct(words3(F.col("text")))).alias("word")).join(wanted, ["project_id", "word"], "left_semi")
    known = known.distinct().withColumn("hit", F.lit(1))
    each = asked.join(known, ["project_id", "word"], "left").groupBy("project_id", "risk_id", "quote_no").agg((F.count("hit") / F.nullif(F.count("word"), F.lit(0))).alias("overlap"))
    cited = each.groupBy("project_id", "risk_id").agg(F.coalesce(F.max("overlap") >= least, F.lit(False)).alias("cited"))
    rates = cited.groupBy("project_id").agg(F.round(F.count_if("cited") / F.count("*"), 6).alias("validity"))
    return risks.select("project_id").distinct().join(rates, "project_id", "left").select("project_id", F.coalesce("validity", F.lit(1.0)).alias("validity"))


def severity_error(predicted: Column, expected: Column) -> Column:
    """Distance of severities; nothing predicted counts from below 'low'; nothing expected is null."""
    order = F.create_map(*[F.lit(x) for pair in P.SEVERITY_ORDER.items() for x in pair])
    e = F.try_element_at(order, expected)
    return F.when(e.isNull(), None).otherwise(F.abs(F.coalesce(F.try_element_at(order, predicted), F.lit(1)) - e))


def rollup(results: DataFrame) -> DataFrame:
    """Totals of one table of eval results: pass rate, means over rows without error, and threshold flags."""
    ok = F.col("error").isNull()
    mean = lambda c, d=3: F.round(F.avg(F.when(ok, F.col(c))), d)
    sums = results.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~ok).alias("errors"),
        F.round(F.count_if("passed") / F.nullif(F.count("*"), F.lit(0)), 3).alias("pass_rate"), mean("judge_overall").alias("judge"), mean("clause_recall").alias("recall"),
        mean("clause_precision").alias("precision"), mean("clause_f1").alias("f1"), mean("severity_calibration_error").alias("severity_mae"))
    return sums.withColumn("meets", (F.col("judge") >= 0.7) & (F.col("recall") >= 0.6) & (F.col("precision") >= 0.6))


def calibration(results: DataFrame) -> DataFrame:
    """Means over rows without error, null where no row has a value: severity error, accuracy of risk bands, citation validity; and flags of low means."""
    ok = results.filter(F.col("error").isNull())
    mean = lambda c: F.round(F.avg(c), 3)
    sums = ok.agg(mean("severity_calibration_error").alias("severity_mae"), mean(F.col("risk_band_correct").cast("int")).alias("band_accuracy"),
                  F.coalesce(mean("citation_validity"), F.lit(1.0)).alias("citation_validity"), F.sum("hallucinations").alias("hallucinations"),
                  F.avg("judge_overall").alias("j"), F.avg("clause_recall").alias("r"), F.avg("clause_precision").alias("p"))
    return sums.select("severity_mae", "band_accuracy", "citation_validity", "hallucinations", (F.col("j") < 0.7).alias("low_judge"), (F.col("r") < 0.6).alias("low_recall"),
                       (F.col("p") < 0.6).alias("low_precision"))


def by_case_name(results: DataFrame) -> DataFrame:
    """part, name, n, pass_rate, judge: rows without error by contract type and by difficulty, the first two parts of the case's name."""
    parts = F.split("case_id", "_")
    named = lambda i: F.when(F.size(parts) > 1, F.get(parts, i)).otherwise("unknown")
    each = results.filter(F.col("error").isNull()).select("passed", "judge_overall", F.explode(F.array(
        F.struct(F.lit("contract_type").alias("part"), named(0).alias("name")), F.struct(F.lit("difficulty").alias("part"), named(1).alias("name")))).alias("b"))
    return each.groupBy("b.part", "b.name").agg(F.count("*").alias("n"), F.round(F.count_if("passed") / F.count("*"), 6).alias("pass_rate"), F.round(F.avg("judge_overall"), 6).alias("judge"))


def latencies(calls: DataFrame, value: str = "latency") -> DataFrame:
    """p50 (median), p95 and p99 (sorted[int(n * share)]) of the whole table."""
    n = ranks.numbers(calls, value).count()
    low, high, *rest = ranks.values_at(calls, value, [(n - 1) // 2, n // 2, *[min(int(n * s), n - 1) for s in (0.95, 0.99)]])
    row = (round((low + high) / 2, 6) if n else None, *rest)
    return calls.sparkSession.createDataFrame([row], StructType([StructField("p50", DoubleType()), *(StructField(p, calls.schema[value].dataType) for p in ("p95", "p99"))]))


def cases(rows: DataFrame, contract_type: str | None = None, difficulty: str | None = None, case_id: str | None = None) -> DataFrame:
    """Eval cases of a contract type, a difficulty, an id; what is not given is not asked."""
    for name, value in (("contract_type", contract_type), ("difficulty", difficulty), ("case_id", case_id)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows


_COUNTED = "array<string>"
JUDGED = ("overall_score double, clause_extraction struct<recall:double,precision:double>, risk_assessment struct<accuracy:double,severity_calibration:double>, "
          "summary_faithfulness struct<faithfulness:double,completeness:double>, "
          f"hallucinations struct<clause_hallucinations:{_COUNTED},summary_hallucinations:{_COUNTED},risk_hallucinations:{_COUNTED}>, "
          f"missing_content struct<missing_critical_clauses:{_COUNTED}>, unsafe_statements struct<severity:string>")


def judge_rows(judged: DataFrame) -> DataFrame:
    """A judge's nested JSON as one flat row of scores and counts. judged: analysis_id, output; output that doesn't parse gives nulls and zero counts."""
    o = judged.select("analysis_id", F.from_json("output", JUDGED).alias("o"))
    many = lambda path: F.coalesce(F.size(path), F.lit(0))
    found = sum((many(F.col(f"o.hallucinations.{k}_hallucinations")) for k in ("clause", "summary", "risk")), F.lit(0))
    return o.select(
        "analysis_id", F.col("o.overall_score").alias("overall_score"), F.col("o.clause_extraction.recall").alias("clause_recall"), F.col("o.clause_extraction.precision").alias("clause_precision"),
        F.col("o.risk_assessment.accuracy").alias("risk_accuracy"), F.col("o.risk_assessment.severity_calibration").alias("risk_severity_calibration"),
        F.col("o.summary_faithfulness.faithfulness").alias("summary_faithfulness"), F.col("o.summary_faithfulness.completeness").alias("summary_completeness"),
        found.alias("hallucination_count"), many(F.col("o.missing_content.missing_critical_clauses")).alias("missing_critical_clause_count"), F.col("o.unsafe_statements.severity").alias("unsafe_statement_severity"))


def breakdown(results: DataFrame, by: Column, name: str) -> DataFrame:
    return results.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.round(F.count_if("passed") / F.count("*"), 3).alias("pass_rate"),
                                               F.round(F.avg("clause_f1"), 3).alias("f1"))


def spread(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.25, 0.75, 0.95)) -> DataFrame:
    """Mean and values at int(n * share) of the sorted values (25, 75 and 95 percent); nulls are left out."""
    rows = tables.written(rows.select(value))  # each pass over the values would compute them anew
    sums = ranks.numbers(rows, value).agg(F.count("v").alias("n"), F.round(F.sum("v") / F.nullif(F.count("v"), F.lit(0)), 6).cast("double").alias("mean")).first()
    found = ranks.values_at(rows, value, [min(int(sums["n"] * s), sums["n"] - 1) for s in shares])
    schema = StructType([StructField("mean", DoubleType()), *(StructField(f"p{int(s * 100)}", rows.schema[value].dataType) for s in shares)])
    return rows.sparkSession.createDataFrame([(sums["mean"], *found)], schema)


def run_diff(base: DataFrame, current: DataFrame, drop: float = P.JUDGE_DROP) -> DataFrame:
    """case_id, change: regression, improvement, new, removed or same. Both: case_id, passed, judge_overall."""
    b = base.select("case_id", F.col("passed").alias("bp"), F.col("judge_overall").alias("bj"))
    c = current.select("case_id", F.col("passed").alias("cp"), F.col("judge_overall").alias("cj"))
    change = (F.when(F.col("bp").isNull(), "new").when(F.col("cp").isNull(), "removed")
              .when((F.col("bp") & ~F.col("cp")) | (F.col("bj") - F.col("cj") > drop), "regression")
              .when((~F.col("bp") & F.col("cp")) | (F.col("cj") - F.col("bj") > drop), "improvement").otherwise("same"))
    return b.join(c, "case_id", "full_outer").select("case_id", change.alias("change"))


def regressions(base: DataFrame, current: DataFrame, metrics: list[str], drop: float = P.REGRESSION_DROP) -> DataFrame:
    """metric, base, current, regressed for one-row tables of metrics."""
    a = base.unpivot([], metrics, "metric", "base")
    b = current.unpivot([], metrics, "metric", "current")
    return a.join(b, "metric").withColumn("regressed", (F.col("base") > 0) & (F.col("base") - F.col("current") > drop))


def gate(summary: DataFrame) -> DataFrame:
    """failures: names of the thresholds that a one-row summary misses. Columns are named as in params.GATE."""
    failed = [F.when(F.col(m) < t if m != "hallucinations" else F.col(m) > t, m) for m, t in P.GATE.items()]
    return summary.select(F.array_compact(F.array(*failed)).alias("failures"))


def consistency(outputs: DataFrame) -> DataFrame:
    """Share of chunks whose valid outputs are all equal, and share of outputs that are valid. outputs: chunk_id, output, valid."""
    each = outputs.groupBy("chunk_id").agg(F.count_distinct(F.when(F.col("valid"), F.col("output"))).alias("kinds"), F.count_if("valid").alias("valid"), F.count("*").alias("n"))
    return each.agg(F.round(F.count_if(F.col("kinds") == 1) / F.count("*"), 6).alias("consistency"), F.round(F.sum("valid") / F.sum("n"), 6).alias("compliance"))


def cost(calls: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Cost a call, a document and a thousand documents. calls: doc_id, tokens_in, tokens_out, latency."""
    price = (F.col("tokens_in") * input_price + F.col("tokens_out") * output_price) / 1e6
    sums = calls.agg(F.count("*").alias("calls"), F.count_distinct("doc_id").alias("documents"), F.sum(price).alias("cost"), F.round(F.median("latency"), 6).alias("p50"))
    return sums.select("calls", "documents", "p50", F.round(F.col("cost") / F.col("calls"), 9).alias("per_call"),
                       F.round(F.col("cost") / F.col("documents"), 9).alias("per_document"), F.round(F.col("cost") / F.col("documents") * 1000, 6).alias("per_thousand"))


#: Tokens in and out of a chunk's extraction and of an analysis besides, and prices of a million of each (fixed values).
CHUNK_TOKENS, FIXED_TOKENS, PRICES = (1100, 400), (3500, 1400), (5.0, 15.0)


def analysis_cost(chunks: Column) -> Column:
    """Struct tokens_in, tokens_out, cost: an estimate for an analysis of so many chunks."""
    used = [chunks * c + f for c, f in zip(CHUNK_TOKENS, FIXED_TOKENS)]
    return F.struct(used[0].alias("tokens_in"), used[1].alias("tokens_out"), F.round(used[0] / 1e6 * PRICES[0] + used[1] / 1e6 * PRICES[1], 6).alias("cost"))


def vision_cost(images: Column, price: float) -> Column:
    """Estimated cost of describing images at a price each."""
    return F.round(images * price, 6)
