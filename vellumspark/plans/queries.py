"""Queries over the supplied tables, one callable (spark, sf_dir) each.

Stand-ins: customers are projects, orders their analyses; documents are chunks
and contract texts (a contract sentence, then the document's text); embeddings
are dense vectors; conversations are chats; labels are ground truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import contract_text as C
from ..functions import models as M
from ..functions import training as T
from ..operators import chunking, dashboard, evaluate, guard, retrieval, risk, store
from ..sources import writers
from ..streaming import jobs
from .fixtures import CONTRACTS


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def analyses(spark: SparkSession, d: str) -> DataFrame:
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"),
        F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000)).cast("int").alias("overall_risk_score"),
        ((F.col("o_orderkey") % 11) / 10.0).alias("quality_score"), (F.col("o_orderpriority") == "1-URGENT").alias("flagged"),
        F.col("c_mktsegment").alias("segment"))


NOW = "2001-08-01"


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, source, text: a contract sentence and the document's whole text."""
    sentence = F.element_at(F.array(*[F.lit(s) for s in CONTRACTS]), (F.col("doc_id") % len(CONTRACTS)).cast("int") + 1)
    return _t(spark, d, "documents").select("doc_id", "lang", "source", F.concat(sentence, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


# --- dashboard ---------------------------------------------------------------


def dash_totals(spark, d):
    return dashboard.totals(analyses(spark, d))


def dash_risk_distribution(spark, d):
    return dashboard.risk_distribution(analyses(spark, d))


def dash_timeline(spark, d):
    return dashboard.timeline(analyses(spark, d), F.lit(NOW).cast("date"), P.TIMELINE_DAYS["all"])


def dash_trends(spark, d):
    return dashboard.trends(analyses(spark, d), F.lit(NOW).cast("date"), 30)


def dash_recent(spark, d):
    return dashboard.recent(analyses(spark, d)).select("id", "project_id", "created_at", "overall_risk_score")


def latest_per_project(spark, d):
    return dashboard.latest_per_project(analyses(spark, d)).select("project_id", "id", "status", "overall_risk_score")


def report_bands(spark, d):
    return analyses(spark, d).groupBy("segment", C.report_band(F.col("overall_risk_score")).alias("band")).agg(F.count("*").alias("n"))


def json_category_counts(spark, d):
    return dashboard.json_counts(_t(spark, d, "events"), "props", "k int", F.col("parsed.k"), "k")


def topn_types(spark, d):
    counts = _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return dashboard.top_n(counts, "event_type", 3)


def event_daily(spark, d):
    return jobs.daily_counts(_t(spark, d, "events"))


def event_sessions(spark, d):
    return jobs.sessions(_t(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def weekly_change(spark, d):
    daily = _t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return dashboard.weekly_change(daily)


def metric_trend(spark, d):
    rows = _t(spark, d, "events").select("ts", "value", F.length("props").cast("double").alias("props_length"))
    return dashboard.metric_trend(rows, ["value", "props_length"], F.lit("2024-01-31").cast("timestamp"), 14)


# --- text --------------------------------------------------------------------


def clause_types(spark, d):
    return contracts(spark, d).select("doc_id", C.clause_type(F.col("text")).alias("clause_type"))


def clause_type_counts(spark, d):
    return clause_types(spark, d).groupBy(F.coalesce("clause_type", F.lit("none")).alias("clause_type")).agg(F.count("*").alias("n"))


def section_references(spark, d):
    return contracts(spark, d).select("doc_id", C.section_reference(F.col("text")).alias("section")).filter(F.col("section").isNotNull())


def liability_caps(spark, d):
    return contracts(spark, d).select("doc_id", C.liability_cap(F.col("text")).alias("c")).select("doc_id", "c.has_cap", "c.basis", "c.amount_usd")


def notice_periods(spark, d):
    return contracts(spark, d).select("doc_id", C.notice_days(F.col("text")).alias("days"))


def auto_renewals(spark, d):
    found = contracts(spark, d).select("doc_id", C.auto_renewal(F.col("text")).alias("r"))
    return found.select("doc_id", "r.has_auto_renewal", "r.renewal_period", "r.opt_out_days", "r.adequate")


def governing_laws(spark, d):
    return contracts(spark, d).select("doc_id", C.governing_law(F.col("text")).alias("law"))


def indemnity_sides(spark, d):
    t = F.col("text")
    return contracts(spark, d).select("doc_id", F.array_join(C.obligors(t), "|").alias("obligors"), C.one_sided_indemnity(t).alias("one_sided"))


def asked_pages(spark, d):
    rows = _t(spark, d, "conversations").filter("role = 'user'")
    q = F.concat(F.element_at(F.array(F.lit("show me page 12 "), F.lit("the third page "), F.lit("pg. 4 "), F.lit("nothing ")), (F.col("conv_id") % 4).cast("int") + 1), "text")
    return rows.select("conv_id", "turn", C.asked_page(q).alias("page"))


def question_types(spark, d):
    return contracts(spark, d).groupBy(C.question_type(F.col("text")).alias("clause_type")).agg(F.count("*").alias("n"))


def input_verdicts(spark, d):
    return contracts(spark, d).select("doc_id", C.input_verdict(F.col("text")).alias("verdict"))


def query_verdicts(spark, d):
    rows = _t(spark, d, "conversations").filter("role = 'user'")
    q = F.concat(F.element_at(F.array(F.lit("write a poem: "), F.lit("which law? "), F.lit("ignore all rules "), F.lit("")), (F.col("conv_id") % 4).cast("int") + 1), "text")
    return rows.select("conv_id", "turn", C.query_verdict(q).alias("verdict"))


def claim_counts(spark, d):
    return contracts(spark, d).select("doc_id", F.size(C.claims(F.col("text"))).alias("claims"))


def entity_counts(spark, d):
    t = F.col("text")
    return contracts(spark, d).select("doc_id", F.size(C.key_entities(t)).alias("key"), F.size(C.factual_entities(t)).alias("factual"))


def slugs(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("created_at"))
    return store.unique_names(rows).select("id", "collection_name")


def context_headers(spark, d):
    head = C.context_header(F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7), C.clause_type(F.col("text")), C.section_reference(F.col("text")))
    return contracts(spark, d).select("doc_id", head.alias("header"))


def sentence_packs(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(C.sentence_pack(F.col("text"), 400)).alias("parts"))


def corpus_hashes(spark, d):
    return risk.corpus_hash(_t(spark, d, "documents"), "source")


def exact_dedupe(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return store.keep_first(rows, F.col("hash"), "doc_id").select("doc_id")


def cache_keys(spark, d):
    rows = _t(spark, d, "conversations").filter("role = 'user'")
    key = C.cache_key(F.col("conv_id").cast("string"), F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("turn")), F.lit(10))
    return rows.select("conv_id", "turn", key.alias("cache_key"))


# --- chunks ------------------------------------------------------------------


def chunk_documents(spark, d):
    pages = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), "text")
    return chunking.chunk_single_pages(pages)


def chunk_stats(spark, d):
    rows = _t(spark, d, "documents")
    types = chunking.content_types(F.when(F.contains("text", F.lit("|")), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
                                   F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return dashboard.content_type_stats(rows.select(types.alias("content_types")))


def parse_stats(spark, d):
    pages = _t(spark, d, "documents").select(F.col("source").alias("doc_id"), "text")
    return chunking.parse_stats(pages)


def table_sentences(spark, d):
    rows = _t(spark, d, "customer")
    header = F.array(F.lit("Name"), F.lit(""), F.lit("Segment"))
    cells = F.array("c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")), "c_mktsegment")
    return rows.select("c_custkey", chunking.row_sentence(header, cells).alias("sentence"))


# --- retrieval ---------------------------------------------------------------


def _dense(spark, d, k):
    """Every row whose id is divisible by 50 is searched against all rows."""
    e = _t(spark, d, "embeddings")
    return retrieval.dense_top(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")),
                               e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k, 6)


def dense_topk(spark, d):
    return _dense(spark, d, 10).select("qid", "id", "score", "rank")


def threshold_top1(spark, d):
    return retrieval.threshold(_dense(spark, d, 10), 0.9).select("qid", "id", "rank")


def rank_norm(spark, d):
    return retrieval.rank_score(_dense(spark, d, 8)).select("qid", "id", F.round("rank_score", 6).alias("rank_score"))


def _questions(spark, d):
    """Every item asks its whole text."""
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _items(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def bm25_topk(spark, d):
    return retrieval.bm25_top(_questions(spark, d), _items(spark, d), 10, digits=4).select("qid", "id", "score", "rank")


def rrf_topk(spark, d):
    sparse = retrieval.bm25_top(_questions(spark, d), _items(spark, d), 50, digits=4)
    dense = _dense(spark, d, 50)
    return retrieval.fuse(dense, sparse, 10).select("qid", "id", "score", "rank")


def rerank_overlap(spark, d):
    ranked = retrieval.bm25_top(_questions(spark, d), _items(spark, d), 20, digits=4)
    rows = ranked.join(_questions(spark, d), "qid").join(_items(spark, d), "id")
    return retrieval.rerank(rows, retrieval.overlap_score(F.col("question"), F.col("text")), 8).select("qid", "id", "rerank_score", "place")


def page_priority(spark, d):
    rows = _dense(spark, d, 8).withColumn("page_number", F.when(F.col("id") % 4 != 0, F.col("id") % 6))
    return retrieval.page_priority(rows, F.lit(2)).select("qid", "id", "place")


def contexts(spark, d):
    rows = _dense(spark, d, 4).join(contracts(spark, d), F.col("id") == F.col("doc_id"))
    return retrieval.assemble_context(rows.select("qid", "rank", F.col("source").alias("document"), C.clause_type(F.col("text")).alias("clause_type"),
                                                  C.section_reference(F.col("text")).alias("section"), (F.col("id") % 9).alias("page"), "text"))


def tfidf_near_duplicates(spark, d):
    return retrieval.tfidf_pairs(_items(spark, d), P.NEAR_DUPLICATE, 6).select("a", "b")


def knn_labels(spark, d):
    rows = _dense(spark, d, 10).join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    votes = rows.groupBy("qid", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("qid").agg(F.max(F.struct("votes", (-F.col("label")).alias("l"))).alias("m")).select("qid", (-F.col("m.l")).alias("label"), "m.votes")


# --- risk --------------------------------------------------------------------


def _clauses(spark, d):
    rows = contracts(spark, d)
    kind = C.clause_type(F.col("text"))
    kind = F.when(kind == "term_and_renewal", "auto_renewal").when(kind == "signatures", "other").otherwise(F.coalesce(kind, F.lit("other")))
    return rows.select(F.concat_ws("-", "source", (F.col("doc_id") % 7).cast("string")).alias("project_id"), F.col("doc_id").alias("pos"), kind.alias("clause_type"),
                       F.coalesce(C.section_reference(F.col("text")), F.lit("untitled")).alias("title"), "text")


def _metadata(spark, d):
    p = _t(spark, d, "documents").select(F.concat_ws("-", "source", (F.col("doc_id") % 7).cast("string")).alias("project_id")).distinct()
    last = F.substring("project_id", -1, 1).cast("int")
    return p.select("project_id", F.when(last < 3, "Software services").when(last < 5, "Lease").alias("contract_type"), F.when(last == 6, "2030-01-01").alias("expiration_date"))


def clause_dedupe(spark, d):
    narrow = _clauses(spark, d).select("project_id", "pos", "clause_type", "title", F.length("text").alias("chars"))
    return risk.dedupe_clauses(narrow).select("project_id", "pos", "clause_type")


def _rules(spark, d):
    return risk.rule_risks(_clauses(spark, d), _metadata(spark, d))


def model_risks(spark, d):
    """A model's findings: every third document of a project is one, of a severity and a title by its number."""
    rows = _t(spark, d, "documents").filter("doc_id % 3 = 0")
    severity = F.element_at(F.array(*[F.lit(s) for s in P.SEVERITY_VALUE]), (F.col("doc_id") % 4).cast("int") + 1)
    return rows.select(F.concat_ws("-", "source", (F.col("doc_id") % 7).cast("string")).alias("project_id"), F.col("doc_id").alias("pos"), F.lit("model").alias("category"),
                       severity.alias("severity"), F.concat(F.lit("Finding number "), (F.col("doc_id") % 11).cast("string")).alias("title"), F.lit(0.5).alias("confidence"))


def rule_risks(spark, d):
    return _rules(spark, d).groupBy("project_id", "category", "severity", "title").agg(F.count("*").alias("n"))


def rule_scores(spark, d):
    return risk.rule_score(_clauses(spark, d), _metadata(spark, d))


def risk_dedupe(spark, d):
    return risk.dedupe_risks(_rules(spark, d)).select("project_id", "pos", "title")


def risk_scores(spark, d):
    assessed = risk.assess(risk.dedupe_clauses(risk.clause_facts(_clauses(spark, d))), _metadata(spark, d))
    model = model_risks(spark, d).join(assessed.select("project_id").distinct(), "project_id", "left_semi")
    found = risk.dedupe_risks(risk.all_risks(risk.listed_risks(assessed), model))
    return risk.score_rows(found).withColumn("top_contributors", F.array_join("top_contributors", "|"))


def risk_features(spark, d):
    return risk.features(_clauses(spark, d))


def obligations(spark, d):
    rows = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("pos"),
        F.array(F.struct(F.col("l_returnflag").alias("party"), F.concat(F.lit("deliver "), F.col("l_partkey").cast("string")).alias("description"),
                         F.when(F.col("l_linestatus") == "O", F.col("l_shipdate").cast("date").cast("string")).alias("deadline"))).alias("obligations"))
    return risk.obligations_by_party(rows).withColumn("owes", F.array_join("owes", "; "))


def key_dates(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.array(F.col("l_shipdate").cast("date").cast("string")).alias("dates"))
    return risk.key_dates(rows).withColumn("key_dates", F.array_join("key_dates", ","))


# --- guardrails and evaluation -------------------------------------------------


def bigram_overlap(spark, d):
    items = _t(spark, d, "benchmark").select(F.lit("p").alias("project_id"), F.col("item_id"), "text")
    sources = _t(spark, d, "documents").select(F.lit("p").alias("project_id"), "text")
    return guard.clause_overlap(items, sources)


def clause_validation(spark, d):
    items = _t(spark, d, "benchmark").select((F.col("item_id") % 5).alias("project_id"), "item_id", "text")
    sources = _t(spark, d, "documents").select((F.col("doc_id") % 5).alias("project_id"), "text")
    return guard.validate_clauses(items, sources)


def _truth(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select("doc_id", "lang", F.col("quality").cast("string").alias("type"))


def _predicted(spark, d):
    guess = F.when(F.rlike("text", F.lit(r"\|| [^ ]{30,}")), "0").otherwise("1")
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select("doc_id", "lang", guess.alias("type"))


def prf_by_lang(spark, d):
    counts = evaluate.per_type(_predicted(spark, d), _truth(spark, d), ["lang"])
    p, r = evaluate.ratio(F.col("hits"), F.col("predicted")), evaluate.ratio(F.col("hits"), F.col("truth"))
    return counts.select("lang", "type", p.alias("precision"), r.alias("recall"), evaluate.f1(p, r).alias("f1"))


def prf_micro(spark, d):
    return evaluate.micro(evaluate.per_type(_predicted(spark, d), _truth(spark, d), ["doc_id"]))


def prf_macro(spark, d):
    counts = evaluate.per_type(_predicted(spark, d), _truth(spark, d), ["doc_id"]).groupBy("type").agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "truth")])
    return evaluate.macro(counts)


def _runs(spark, d, shift: int, parted: bool = False):
    """A run's results, one an order; ``parted`` runs each lack other cases, so that a comparison finds new and removed ones."""
    o = _t(spark, d, "orders")
    if parted:
        o = o.filter((F.col("o_orderkey") + shift) % 9 != 0)
    j = ((F.col("o_orderkey") * 37 + shift * 11) % 100) / 100.0
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("kind"), (j >= 0.4).alias("passed"), j.alias("judge_overall"),
        ((F.col("o_orderkey") * 13 + shift) % 90 / 100.0).alias("clause_recall"), ((F.col("o_orderkey") * 17 + shift) % 95 / 100.0).alias("clause_precision"),
        ((F.col("o_orderkey") * 19 + shift) % 93 / 100.0).alias("clause_f1"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3).cast("double").alias("severity_calibration_error"),
        F.when(F.col("o_orderkey") % 50 == 0, "timeout").alias("error"))


def run_diff(spark, d):
    return evaluate.run_diff(_runs(spark, d, 0, parted=True), _runs(spark, d, 1, parted=True)).groupBy("change").agg(F.count("*").alias("n"))


def eval_rollup(spark, d):
    return evaluate.rollup(_runs(spark, d, 0))


def eval_breakdown(spark, d):
    return evaluate.breakdown(_runs(spark, d, 0), F.col("kind"), "kind")


def metric_regressions(spark, d):
    names = ["pass_rate", "judge", "recall", "precision", "f1"]
    return evaluate.regressions(evaluate.rollup(_runs(spark, d, 0)).select(*names), evaluate.rollup(_runs(spark, d, 1)).select(*names), names)


def quality_gate(spark, d):
    r = evaluate.rollup(_runs(spark, d, 0)).select(F.col("f1").alias("clause_f1"), F.col("recall").alias("clause_recall"), F.col("precision").alias("clause_precision"),
                                                   "judge", "pass_rate", F.lit(0).alias("hallucinations"))
    return evaluate.gate(r).select(F.array_join("failures", ",").alias("failures"))


def severity_errors(spark, d):
    kinds = F.array(*[F.lit(s) for s in P.SEVERITY_VALUE])
    rows = _t(spark, d, "orders").select("o_orderkey", F.try_element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("p"),
                                         F.try_element_at(kinds, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("e"))
    return rows.agg(F.round(F.avg(evaluate.severity_error(F.col("p"), F.col("e"))), 6).alias("mae"))


def overlap_spread(spark, d):
    return evaluate.spread(_t(spark, d, "documents").withColumn("v", F.length("text")), "v")


def consistency(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("output"), (F.col("l_linestatus") == "O").alias("valid"))
    return evaluate.consistency(rows)


def call_costs(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"), F.col("l_quantity").alias("latency"))
    return evaluate.cost(rows, 0.15, 0.60)


# --- chat and training rows ----------------------------------------------------


def chat_history(spark, d):
    return writers.conversation_text(_t(spark, d, "conversations")).select("conv_id", F.sha2("transcript", 256).alias("hash"), F.length("transcript").alias("chars"))


def _messages(spark, d):
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def instruction_rows(spark, d):
    f = T.instruction_format(F.col("messages"))
    return _messages(spark, d).select("conv_id", f["prompt"].alias("prompt"), F.length(f["response"]).alias("response_chars"))


def valid_examples(spark, d):
    return _messages(spark, d).select("conv_id", T.valid_example(F.col("messages")).alias("valid"), (F.size("messages") >= 3).alias("long_enough"))


def intents(spark, d):
    return _t(spark, d, "conversations").filter("role = 'user'").groupBy(M.default_intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


def csv_lines(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", writers.csv_line(F.col("s_name"), F.concat(F.lit('a,"b" '), F.col("s_nationkey").cast("string")), F.lit(None).cast("string")).alias("line"))


# --- relational coverage -------------------------------------------------------


def visible_analyses(spark, d):
    a = analyses(spark, d).withColumn("document_hash", (F.col("project_id") % 3).cast("string"))
    hashes = _t(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 2).cast("string").alias("corpus_hash"))
    return store.visible_analyses(a, hashes).select("project_id", "id", "status")


def missing_core_types(spark, d):
    core = spark.createDataFrame([(t,) for t in P.CORE_CLAUSES], "clause_type string")
    held = _clauses(spark, d).select("project_id", "clause_type").distinct()
    return held.select("project_id").distinct().crossJoin(F.broadcast(core)).join(held, ["project_id", "clause_type"], "left_anti")


def project_cascade(spark, d):
    gone = _t(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("project_id"))
    left = store.delete_project(gone, analyses=analyses(spark, d))["analyses"]
    return left.groupBy("segment").agg(F.count("*").alias("n"))


def orphan_orders(spark, d):
    return store.orphans(_t(spark, d, "customer").withColumnRenamed("c_custkey", "k"), _t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k").select("k", "c_name")


def label_set_scores(spark, d):
    found = _clauses(spark, d).groupBy("project_id").agg(F.sort_array(F.collect_set("clause_type")).alias("found"))
    expected = F.array(*[F.lit(t) for t in P.CORE_CLAUSES])
    return found.select("project_id", evaluate.set_scores(F.col("found"), expected).alias("s")).select("project_id", "s.*")


def multiset_common(spark, d):
    p, t = _predicted(spark, d).select("lang", "type"), _truth(spark, d).select("lang", "type")
    return p.intersectAll(t).groupBy("lang", "type").agg(F.count("*").alias("n"))


def previous_run_delta(spark, d):
    w = Window.partitionBy("project_id").orderBy("created_at", "id")
    return analyses(spark, d).select("project_id", "id", (F.col("overall_risk_score") - F.lag("overall_risk_score").over(w)).alias("delta"))


def extra_revenue_rollup(spark, d):
    rows = (_t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum(revenue.cast("decimal(24,6)")), 2).cast("double").alias("revenue"))


QUERIES = {f.__name__: f for f in (
    dash_totals, dash_risk_distribution, dash_timeline, dash_trends, dash_recent, latest_per_project, report_bands, json_category_counts, topn_types, event_daily,
    event_sessions, weekly_change, metric_trend, clause_types, clause_type_counts, section_references, liability_caps, notice_periods, auto_renewals, governing_laws,
    indemnity_sides, asked_pages, question_types, input_verdicts, query_verdicts, claim_counts, entity_counts, slugs, context_headers, sentence_packs, corpus_hashes,
    exact_dedupe, cache_keys, chunk_documents, chunk_stats, parse_stats, table_sentences, dense_topk, threshold_top1, rank_norm, bm25_topk, rrf_topk, rerank_overlap,
    page_priority, contexts, tfidf_near_duplicates, knn_labels, clause_dedupe, rule_risks, rule_scores, risk_dedupe, risk_scores, risk_features, obligations, key_dates,
    bigram_overlap, clause_validation, prf_by_lang, prf_micro, prf_macro, run_diff, eval_rollup, eval_breakdown, metric_regressions, quality_gate, severity_errors,
    overlap_spread, consistency, call_costs, chat_history, instruction_rows, valid_examples, intents, csv_lines, visible_analyses, missing_core_types, project_cascade,
    orphan_orders, label_set_scores, multiset_common, previous_run_delta, extra_revenue_rollup)}
