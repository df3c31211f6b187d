"""Search modes, evidence, evaluation, guardrail and registry queries over the supplied tables, each with its SQL.

Stand-ins as in ``queries``; documents whose number is divisible by ten are gold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import contract_text as C
from ..functions import training as T
from ..operators import chunking, evaluate, guard, retrieval, risk, store
from .oracle import _TFIDF, ANALYSES, CONTRACT, DENSE, _bm25, _list, _s
from .queries import _dense, _items, _questions, _t, analyses, contracts


def _modes(spark, d):
    """Every search's mode; some name none that exists."""
    rows = _t(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"))
    return rows.withColumn("mode", F.element_at(F.array(F.lit("hybrid"), F.lit("semantic"), F.lit("keyword")), (F.col("qid") % 3).cast("int") + 1))


def search_modes(spark, d):
    sparse = retrieval.bm25_top(_questions(spark, d), _items(spark, d), 50, digits=4)
    return retrieval.search(_modes(spark, d), _dense(spark, d, 50), sparse, 10)


def search_without_sparse(spark, d):
    return retrieval.search(_modes(spark, d), _dense(spark, d, 50), None)


def search_filtered(spark, d):
    e = _t(spark, d, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 6).alias("page_number"),
                     chunking.content_types(F.when(F.col("vec_id") % 4 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.array().cast("array<int>")).alias("content_types"),
                     F.when(F.col("label") < 5, "liability").otherwise("payment").alias("clause_type"))
    kept = retrieval.filtered(items, 2, "table", "liability").select("id", "vec")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return retrieval.dense_top(asked, kept, 5, 6).select("qid", "id", "score", "rank")


def _probes(spark):
    return spark.createDataFrame([(i, k, q) for i, (k, q) in enumerate(P.RISK_PROBES.items())], "probe_place int, probe string, question string")


def probe_evidence(spark, d):
    items = contracts(spark, d).select(F.col("doc_id").alias("id"), "text")
    hits = retrieval.probe_hits(_probes(spark), items).withColumn("project_id", F.lit("p"))
    return retrieval.probe_evidence(hits)


def near_duplicates_removed(spark, d):
    return retrieval.near_duplicates_removed(_items(spark, d).withColumn("gold", F.col("id") % 10 == 0))


def risk_title_scores(spark, d):
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit(" Risk "), F.col("l_returnflag"), F.lit(" "))).alias("found"),
                                                              F.collect_list(F.when(F.col("l_linenumber") > 2, F.concat(F.lit("RISK "), F.col("l_linestatus")))).alias("expected"))
    return rows.select("l_orderkey", evaluate.title_scores(F.col("found"), F.col("expected")).alias("s")).select("l_orderkey", "s.*")


def summary_keywords(spark, d):
    rows = contracts(spark, d)
    expected = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Liability"), F.lit("notice"), F.lit("law")))
    return rows.select("doc_id", evaluate.summary_scores(F.col("text"), expected, F.array(F.lit("Poem"), F.lit("creativity"))).alias("s")).select("doc_id", "s.*")


def clause_set_scores(spark, d):
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("Type-"), F.col("l_returnflag"))).alias("found"),
                                                              F.collect_list(F.when(F.col("l_linenumber") > 2, F.concat(F.lit("type "), F.col("l_linestatus")))).alias("expected"))
    return rows.select("l_orderkey", evaluate.clause_scores(F.col("found"), F.col("expected"), F.array(F.lit("type_n"))).alias("s")).select("l_orderkey", "s.*")


def _found_risks(spark, d):
    """Benchmark items as risks with one or two quotes, their texts' parts."""
    rows = _t(spark, d, "benchmark")
    severity = F.element_at(F.array(*[F.lit(s) for s in P.SEVERITY_VALUE]), (F.col("item_id") % 4).cast("int") + 1)
    quotes = F.when(F.col("item_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("zzz"), F.col("text")))
    return rows.select((F.col("item_id") % 5).alias("project_id"), F.col("item_id").alias("risk_id"), severity.alias("severity"), quotes.alias("quotes"), "text")


def _sources(spark, d):
    return _t(spark, d, "documents").select((F.col("doc_id") % 5).alias("project_id"), "text")


def citation_validity(spark, d):
    return evaluate.citation_validity(_found_risks(spark, d), _sources(spark, d))


def _results(spark, d):
    o = _t(spark, d, "orders")
    kinds = F.element_at(F.array(F.lit("nda"), F.lit("lease"), F.lit("saas")), (F.col("o_orderkey") % 3).cast("int") + 1)
    levels = F.element_at(F.array(F.lit("easy"), F.lit("hard")), (F.col("o_orderkey") % 2).cast("int") + 1)
    name = F.when(F.col("o_orderkey") % 20 == 0, F.lit("plain")).otherwise(F.concat_ws("_", kinds, levels, F.col("o_orderkey").cast("string")))
    score = lambda a, m: (F.col("o_orderkey") * a % m) / 100.0
    return o.select(name.alias("case_id"), (score(37, 100) >= 0.4).alias("passed"), score(37, 100).alias("judge_overall"), score(13, 90).alias("clause_recall"), score(17, 95).alias("clause_precision"),
                    F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3).cast("double").alias("severity_calibration_error"),
                    F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 5 != 0).alias("risk_band_correct"), score(19, 101).alias("citation_validity"), (F.col("o_orderkey") % 3).alias("hallucinations"),
                    F.when(F.col("o_orderkey") % 50 == 0, "timeout").alias("error"))


def eval_calibration(spark, d):
    return evaluate.calibration(_results(spark, d))


def eval_by_case_name(spark, d):
    return evaluate.by_case_name(_results(spark, d))


def call_latencies(spark, d):
    return evaluate.latencies(_t(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("latency")))


def summary_validation(spark, d):
    summaries = contracts(spark, d).select((F.col("doc_id") % 5).alias("project_id"), "text")
    return guard.validate_summaries(summaries, _sources(spark, d))


def risk_validation(spark, d):
    risks = contracts(spark, d).select((F.col("doc_id") % 5).alias("project_id"), F.col("doc_id").alias("pos"), F.lit("Clause").alias("title"), F.col("text").alias("description"))
    return guard.validate_risks(risks, _sources(spark, d))


def review_flags(spark, d):
    rows = _t(spark, d, "orders")
    flag = guard.needs_review((F.col("o_orderkey") * 37 % 100) / 100.0, (F.col("o_orderkey") % 13 == 0).cast("int"), (F.col("o_orderkey") % 17 == 0).cast("int"), F.col("o_orderkey") % 4)
    return rows.select("o_orderkey", flag.alias("review"))


def parse_stats_full(spark, d):
    repeat = lambda m: F.array_repeat(F.lit(1), (F.col("doc_id") % m).cast("int"))
    return chunking.parse_stats(_t(spark, d, "documents").select(F.col("source").alias("doc_id"), "text", repeat(3).alias("images"), repeat(4).alias("tables")))


def dataset_stats(spark, d):
    clauses = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") < 6, F.col("l_returnflag")).alias("clause_type"))
    return store.dataset_stats(analyses(spark, d), clauses, P.ELIGIBLE_QUALITY)


def training_stats(spark, d):
    part = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3).cast("int") + 1)
    rows = _t(spark, d, "documents").select(part.alias("part"), "source", F.col("lang").alias("clause_type"), F.col("text").alias("line"))
    return store.training_stats(rows)


def _projects(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
                                           (F.col("c_custkey") % 7).alias("documents"), (F.col("c_custkey") * 37 % 1000).alias("created_at"))


def owner_projects(spark, d):
    return store.owned(_projects(spark, d), "BUILDING", "%00_1%").select("id", "name")


def project_search(spark, d):
    return store.find_projects(_projects(spark, d), "Mach", "documents").select("id", "documents")


def projects_after_ingest(spark, d):
    gone = _t(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project_id"))
    return store.invalidated(analyses(spark, d), gone).groupBy("status").agg(F.count("*").alias("n"))


def chat_with_projects(spark, d):
    turns = _t(spark, d, "conversations").join(_projects(spark, d), F.col("conv_id") == F.col("id"))
    return turns.groupBy("id", "name").agg(F.count("*").alias("turns"), F.max("turn").alias("last"))


def cache_inserts(spark, d):
    rows = _t(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") % 20).alias("project_id"), F.lit("Which law?").alias("question"), (F.col("turn") % 4).alias("k"),
                                                                        F.lit(10).alias("documents"), F.concat(F.lit("answer "), F.col("conv_id").cast("string")).alias("answer"), F.col("conv_id").alias("at"))
    return store.cache_rows(rows)


def slim_risks(spark, d):
    rows = _found_risks(spark, d)
    return rows.select("risk_id", F.md5(C.slim_risk(F.col("severity"), F.concat(F.lit("Risk "), F.col("risk_id").cast("string")), F.regexp_replace("text", '[^A-Za-z ]', ""), 40)).alias("hash"))


def payload_columns(spark, d):
    payload = F.concat(F.lit('{"raw_text":"t'), F.col("o_orderkey").cast("string"), F.lit('","page_numbers":['), (F.col("o_orderkey") % 9).cast("string"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(']}'))
    rows = chunking.promoted(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), payload.alias("payload")))
    return rows.select("id", "raw_text", F.element_at("page_numbers", 1).alias("page"))


def answer_sources(spark, d):
    rows = _dense(spark, d, 3).join(_t(spark, d, "documents"), F.col("id") == F.col("doc_id"))
    tables = F.when(F.col("id") % 2 == 0, F.lit(',"tables_html":["<table>"]')).otherwise("")
    payload = F.concat(F.lit('{"raw_text":"r'), F.col("id").cast("string"), F.lit('"'), tables, F.lit("}"))
    found = chunking.answer_sources(rows.select("qid", "rank", "text", payload.alias("payload"), F.col("source").alias("source_file"), F.col("score").alias("relevance_score")))
    return found.select("qid", "rank", "raw_text", "source_file", F.array_join("content_types", ",").alias("types"), "relevance_score")


def model_versions(spark, d):
    """Newest models first, as a registry lists them."""
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), (F.col("s_suppkey") * 31 % 97).alias("created_at")).orderBy(F.col("created_at").desc(), "model_id").limit(10)


def vision_costs(spark, d):
    rows = _t(spark, d, "documents").groupBy("source").agg(F.sum(F.col("doc_id") % 3).alias("images"))
    return rows.select("source", evaluate.vision_cost(F.col("images"), 0.00255).alias("cost"))


def eval_cases_of_a_kind(spark, d):
    rows = _results(spark, d).withColumn("contract_type", F.split("case_id", "_")[0]).withColumn("difficulty", F.when(F.size(F.split("case_id", "_")) > 1, F.split("case_id", "_")[1]))
    return evaluate.cases(rows, "nda", "hard").select("case_id", "passed")


def judge_rows(spark, d):
    k = F.col("o_orderkey")
    some = lambda m: F.when(k % m == 0, '["a","b"]').otherwise("[]")
    output = F.concat(F.lit('{"overall_score":'), ((k % 100) / 100.0).cast("string"), F.lit(',"hallucinations":{"clause_hallucinations":'), some(3), F.lit(',"risk_hallucinations":'), some(5),
                      F.lit('},"missing_content":{"missing_critical_clauses":'), some(4), F.lit('},"unsafe_statements":{"severity":"'), F.when(k % 7 == 0, "high").otherwise("none"), F.lit('"}}'))
    return evaluate.judge_rows(_t(spark, d, "orders").select(k.alias("analysis_id"), output.alias("output"))).select(
        "analysis_id", "overall_score", "clause_recall", "hallucination_count", "missing_critical_clause_count", "unsafe_statement_severity")


def merged_metadata(spark, d):
    rows = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("contract_type"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipdate").cast("date").cast("string")).otherwise(" ").alias("effective_date"), F.lit(None).cast("string").alias("expiration_date"),
        F.col("l_linestatus").alias("governing_law"))
    return risk.merge_metadata(rows)


def token_limits(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.within_limit(F.col("text")).alias("trainable"))


def rerank_sizes(spark, d):
    """Reranked items of each question; every third one asks about a page."""
    asked = _questions(spark, d).withColumn("page", F.when(F.col("qid") % 3 == 0, F.lit(2)))
    ranked = retrieval.bm25_top(_questions(spark, d), _items(spark, d), 20, digits=4).join(asked, "qid").join(_items(spark, d), "id")
    kept = retrieval.rerank(ranked, retrieval.overlap_score(F.col("question"), F.col("text")), retrieval.rerank_size(F.col("page")))
    return kept.groupBy("qid").agg(F.count("*").alias("n"))


def file_names(spark, d):
    return _t(spark, d, "pages").select("page_id", C.file_name(F.col("url")).alias("file"))


QUERIES = {f.__name__: f for f in (
    search_modes, search_without_sparse, search_filtered, probe_evidence, near_duplicates_removed, risk_title_scores, summary_keywords, clause_set_scores, citation_validity, eval_calibration,
    eval_by_case_name, call_latencies, summary_validation, risk_validation, review_flags, parse_stats_full, dataset_stats, training_stats, owner_projects, project_search, projects_after_ingest,
    chat_with_projects, cache_inserts, slim_risks, payload_columns, answer_sources, model_versions, vision_costs, file_names,
    eval_cases_of_a_kind, judge_rows, merged_metadata, token_limits, rerank_sizes)}

_MODES = "modes as (select vec_id as qid, ['hybrid', 'semantic', 'keyword'][cast(vec_id % 3 as integer) + 1] as asked from embeddings where vec_id % 50 = 0)"
_COSINE = "list_dot_product(cast(q.embedding as double[]), cast(e.embedding as double[])) / (sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))))"
_PROBES = "questions as (select * from (values " + ", ".join(f"({i}, '{k}', {_s(q)})" for i, (k, q) in enumerate(P.RISK_PROBES.items())) + ") v(qid, probe, text))"
_PROBED = _bm25(P.PROBE_K).replace("questions as (select item_id as qid, text from benchmark)", _PROBES).replace("from documents)", "from contracts)")
_RESULTS = """results as (select o_orderkey as k, case when o_orderkey % 20 = 0 then 'plain' else ['nda', 'lease', 'saas'][cast(o_orderkey % 3 as integer) + 1] || '_' || ['easy', 'hard'][cast(o_orderkey % 2 as integer) + 1] || '_' || o_orderkey end as case_id,
  (o_orderkey * 37 % 100) / 100.0 as judge, (o_orderkey * 13 % 90) / 100.0 as recall, (o_orderkey * 17 % 95) / 100.0 as prec, (o_orderkey * 19 % 101) / 100.0 as cited from orders where o_orderkey % 50 <> 0)"""
_W3 = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))"
_W4 = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}'))"
_PROJECTS = "projects as (select c_custkey as id, c_mktsegment as user_id, c_name as name, c_mktsegment as description, c_custkey % 7 as documents, c_custkey * 37 % 1000 as created_at from customer)"
_PAIRS = """g as (select l_orderkey, list_distinct(list({f})) as f, list_distinct(list({e}) filter (where l_linenumber > 2)) as e from lineitem group by 1), h as (select *, len(list_intersect(f, coalesce(e, []))) as hits from g)"""

SQL = {
    "token_limits": f"select doc_id, coalesce(ceil(length(text) / 4.0) <= {P.TOKEN_LIMIT}, true) as trainable from documents",
    "rerank_sizes": f"with {_bm25(20)} select qid, least(count(*), case when qid % 3 = 0 then {P.RERANK_PAGE_N} else {P.RERANK_N} end) as n from sparse group by qid",
    "eval_cases_of_a_kind": """select 'nda_hard_' || o_orderkey as case_id, (o_orderkey * 37 % 100) / 100.0 >= 0.4 as passed from orders where o_orderkey % 20 <> 0 and o_orderkey % 3 = 0 and o_orderkey % 2 = 1""",
    "judge_rows": """select o_orderkey as analysis_id, (o_orderkey % 100) / 100.0 as overall_score, cast(null as double) as clause_recall, (case when o_orderkey % 3 = 0 then 2 else 0 end) + (case when o_orderkey % 5 = 0 then 2 else 0 end) as hallucination_count,
      case when o_orderkey % 4 = 0 then 2 else 0 end as missing_critical_clause_count, case when o_orderkey % 7 = 0 then 'high' else 'none' end as unsafe_statement_severity from orders""",
    "merged_metadata": """select l_orderkey as project_id, min_by(l_returnflag, pos) filter (where l_linenumber > 2) as contract_type, min_by(cast(cast(l_shipdate as date) as varchar), pos) filter (where l_linestatus = 'O') as effective_date,
      cast(null as varchar) as expiration_date, min_by(l_linestatus, pos) as governing_law from (select *, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as pos from lineitem) q group by 1""",
    "search_modes": f"""with {_bm25(50)}, {DENSE}, {_MODES}, m as (select qid, case when asked = 'hybrid' and qid in (select qid from sparse) then 'hybrid' else 'semantic' end as mode from modes),
      fused as (select coalesce(d.qid, s.qid) as qid, coalesce(d.id, s.id) as id, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) as score from dense d full join sparse s on d.qid = s.qid and d.id = s.id),
      f as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from fused) r where rank <= 10)
      select qid, id, score, rank, mode from dense join m using (qid) where mode = 'semantic' and rank <= 10 union all select qid, id, score, rank, mode from f join m using (qid) where mode = 'hybrid'""",
    "search_without_sparse": f"with {DENSE} select qid, id, score, rank, 'semantic' as mode from dense where rank <= {P.POOL}",
    "search_filtered": f"""with s as (select q.vec_id as qid, e.vec_id as id, round({_COSINE}, 6) as score from embeddings q, embeddings e where q.vec_id % 50 = 0 and e.vec_id % 6 = 2 and e.vec_id % 4 = 0 and e.label < 5)
      select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) r where rank <= 5""",
    "probe_evidence": f"""with {CONTRACT}, {_PROBED}, r as (select s.qid, q.probe, s.rank, trim(c.text, ' ') as text, round(coalesce(len(list_intersect(list_distinct({_W3.format('q.text')}), {_W3.format('c.text')})) / cast(nullif(len(list_distinct({_W3.format('q.text')})), 0) as double), 0), 4) as score
        from sparse s join questions q using (qid) join contracts c on c.doc_id = s.id),
      k as (select *, row_number() over (partition by qid order by score desc, rank) as place from r), kept as (select * from k where place <= {P.PROBE_KEPT} and text <> ''),
      f as (select *, row_number() over (partition by substring(text, 1, 120) order by qid, place) as rn from kept),
      a as (select string_agg('[' || upper(probe) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by qid, place) as x from f where rn = 1)
      select 'p' as project_id, case when length(x) > {P.EVIDENCE_CHARS} then substring(x, 1, {P.EVIDENCE_CHARS}) || chr(10) || chr(10) || '[... passages truncated for context budget ...]' else x end as evidence from a""",
    "near_duplicates_removed": f"""with items as (select doc_id as id, text from documents), {_TFIDF}, gone as (select distinct case when a % 10 <> 0 and b % 10 = 0 then a else b end as id from near)
      select id, id not in (select id from gone) as kept from items""",
    "risk_title_scores": f"with {_PAIRS.format(f=chr(39) + 'risk ' + chr(39) + ' || lower(l_returnflag)', e=chr(39) + 'risk ' + chr(39) + ' || lower(l_linestatus)')}" + """
      select l_orderkey, case when coalesce(len(e), 0) = 0 then cast(len(f) = 0 as double) else round(hits / cast(len(f) as double), 6) end as precision, case when coalesce(len(e), 0) = 0 then 1.0 else round(hits / cast(len(e) as double), 6) end as recall from h""",
    "summary_keywords": f"""with {CONTRACT}, c as (select doc_id, lower(text) as t, case when doc_id % 5 = 0 then 0 else 3 end as n from contracts),
      f as (select *, case when n = 0 then 0 else cast(contains(t, 'liability') as integer) + cast(contains(t, 'notice') as integer) + cast(contains(t, 'law') as integer) end as found from c)
      select doc_id, n = 0 or found >= n * 0.5 as enough, contains(t, 'poem') or contains(t, 'creativity') as excluded, case when n = 0 then 1.0 else round(found / cast(n as double), 6) end as share from f""",
    "clause_set_scores": f"with {_PAIRS.format(f=chr(39) + 'type_' + chr(39) + ' || lower(l_returnflag)', e=chr(39) + 'type_' + chr(39) + ' || lower(l_linestatus)')}" + """,
      w as (select *, len(list_filter(f, lambda x: not list_contains(coalesce(e, []), x) and x <> 'type_n')) as wrong from h),
      s as (select l_orderkey, coalesce(round(hits / cast(nullif(hits + wrong, 0) as double), 6), 0) as p, coalesce(round(hits / cast(nullif(len(e), 0) as double), 6), 0) as r from w)
      select l_orderkey, p as precision, r as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from s""",
    "citation_validity": f"""with known as (select distinct doc_id % 5 as project_id, unnest({_W3.format('text')}) as word from documents),
      r as (select item_id % 5 as project_id, item_id, list_distinct({_W3.format('text')}) as w from benchmark where item_id % 4 >= 2),
      u as (select project_id, item_id, unnest(w) as word from r where item_id % 6 <> 0), o as (select item_id, count(k.word) / cast(count(*) as double) as overlap from u left join known k using (project_id, word) group by item_id),
      c as (select project_id, coalesce(overlap >= 0.8, false) as cited from r left join o using (item_id))
      select project_id, coalesce(round(count(*) filter (where cited) / cast(nullif(count(cited), 0) as double), 6), 1.0) as validity from (select distinct item_id % 5 as project_id from benchmark) p left join c using (project_id) group by project_id""",
    "eval_calibration": f"""with {_RESULTS} select round(avg(case when k % 4 <> 0 then k % 3 end), 3) as severity_mae, round(avg(case when k % 7 <> 0 then cast(k % 5 <> 0 as integer) end), 3) as band_accuracy,
      round(avg(cited), 3) as citation_validity, cast(sum(k % 3) as bigint) as hallucinations, avg(judge) < 0.7 as low_judge, avg(recall) < 0.6 as low_recall, avg(prec) < 0.6 as low_precision from results""",
    "eval_by_case_name": f"""with {_RESULTS}, b as (select 'contract_type' as part, case when contains(case_id, '_') then split_part(case_id, '_', 1) else 'unknown' end as name, judge from results
        union all select 'difficulty', case when contains(case_id, '_') then split_part(case_id, '_', 2) else 'unknown' end, judge from results)
      select part, name, count(*) as n, round(count(*) filter (where judge >= 0.4) / cast(count(*) as double), 6) as pass_rate, round(avg(judge), 6) as judge from b group by all""",
    "call_latencies": """with v as (select cast(l_extendedprice as double) as v, row_number() over (order by l_extendedprice) - 1 as i, count(*) over () as n from lineitem)
      select round(median(v), 6) as p50, max(v) filter (where i = least(cast(trunc(n * 0.95) as bigint), n - 1)) as p95, max(v) filter (where i = least(cast(trunc(n * 0.99) as bigint), n - 1)) as p99 from v""",
    "review_flags": "select o_orderkey, (o_orderkey * 37 % 100) / 100.0 < 0.7 or o_orderkey % 13 = 0 or o_orderkey % 17 = 0 or o_orderkey % 4 > 2 as review from orders",
    "risk_validation": f"""with {CONTRACT}, r as (select doc_id % 5 as project_id, doc_id as pos, list_distinct({_W4.format("'Clause ' || text")}) as w from contracts),
      known as (select distinct doc_id % 5 as project_id, unnest({_W4.format('text')}) as word from documents), u as (select project_id, pos, unnest(w) as word from r),
      o as (select project_id, pos, count(k.word) / cast(count(*) as double) as overlap from u left join known k using (project_id, word) group by all),
      h as (select project_id, count(*) filter (where overlap < 0.2) as hallucinations from o group by 1)
      select project_id, hallucinations, round(greatest(0, least(1, 1 - hallucinations * 0.1)), 6) as confidence, hallucinations = 0 as passed from h""",
    "parse_stats_full": """select source as doc_id, count(*) as pages, count(*) filter (where trim(text) <> '') as non_empty, cast(sum(length(text)) as bigint) as chars, cast(sum(doc_id % 3) as bigint) as images,
      cast(sum(doc_id % 4) as bigint) as tables from documents group by source""",
    "dataset_stats": f"""with {ANALYSES}, ok as (select id from analyses where status = 'completed' and quality_score >= {P.ELIGIBLE_QUALITY})
      select l_returnflag as clause_type, count(*) as clauses, (select count(*) from ok) as analyses from lineitem join ok on l_orderkey = id where l_linenumber < 6 group by 1""",
    "training_stats": """with e as (select ['train', 'val', 'test'][cast(doc_id % 3 as integer) + 1] as part, source, lang as clause_type, sha256(coalesce(text, '')) as h from documents),
      blocks as (select part, substring(h, 1, 3) as block, sha256(string_agg(h, '' order by h)) as h from e group by all),
      parts as (select part, sha256(string_agg(h, '' order by block)) as part_hash from blocks group by part)
      select e.part, source, clause_type, count(*) as examples, any_value(part_hash) as part_hash from e join parts on e.part = parts.part group by e.part, source, clause_type""",
    "owner_projects": f"with {_PROJECTS} select id, name from projects where user_id = 'BUILDING' and name ilike '%00_1%' order by created_at desc, id",
    "project_search": f"with {_PROJECTS} select id, documents from projects where contains(lower(name), 'mach') or contains(lower(description), 'mach') order by documents desc, id",
    "projects_after_ingest": f"with {ANALYSES} select status, count(*) as n from analyses where project_id % 3 <> 0 group by status",
    "chat_with_projects": f"with {_PROJECTS} select id, name, count(*) as turns, max(turn) as last from conversations join projects on conv_id = id group by id, name",
    "cache_inserts": """with r as (select sha256(concat_ws('|', cast(conv_id % 20 as varchar), 'which law?', cast(turn % 4 as varchar), '10')) as cache_key, 'answer ' || conv_id as answer, conv_id as asked from conversations where role = 'user')
      select cache_key, max_by(answer, asked) as answer, max(asked) as "at" from r group by cache_key""",
    "slim_risks": f"""select item_id as risk_id, md5('{{"severity":"' || {_list(P.SEVERITY_VALUE)}[cast(item_id % 4 as integer) + 1] || '","title":"Risk ' || item_id || '","description":"' || substring(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 40) || '"}}') as hash from benchmark""",
    "payload_columns": "select o_orderkey as id, case when o_orderkey % 11 <> 0 then 't' || o_orderkey end as raw_text, case when o_orderkey % 11 <> 0 then cast(o_orderkey % 9 as integer) end as page from orders",
    "answer_sources": f"""with {DENSE} select qid, rank, 'r' || id as raw_text, source as source_file, case when id % 2 = 0 then 'table,text' else 'text' end as types, score as relevance_score
      from dense join documents on id = doc_id where rank <= 3""",
    "model_versions": "select s_suppkey as model_id, s_suppkey * 31 % 97 as created_at from supplier order by created_at desc, model_id limit 10",
    "vision_costs": "select source, round(sum(doc_id % 3) * 0.00255, 6) as cost from documents group by source",
    "file_names": r"select page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') as file from pages",
}
