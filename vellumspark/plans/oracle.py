"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from .. import params as P
from .fixtures import CONTRACTS


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ANALYSES = """analyses as (
  select o_orderkey as id, o_custkey as project_id, case when o_orderstatus = 'P' then 'running' else 'completed' end as status, o_orderdate as created_at,
         cast(least(100, floor(o_totalprice / 5000)) as integer) as overall_risk_score, (o_orderkey % 11) / 10.0 as quality_score,
         o_orderpriority = '1-URGENT' as flagged, c_mktsegment as segment
  from orders join customer on o_custkey = c_custkey)"""
DONE = ANALYSES + ", done as (select * from analyses where status = 'completed')"
CONTRACT = f"""contracts as (
  select doc_id, lang, source, {_list(CONTRACTS)}[cast(doc_id % {len(CONTRACTS)} as integer) + 1] || ' ' || coalesce(text, '') as text from documents)"""


def _clause_type(text: str) -> str:
    """Best type as SQL: scores in list order, the first greatest wins."""
    scores = {k: " + ".join(f"cast(contains(lower({text}), {_s(w)}) as integer)" for w in words) for k, words in P.CLAUSE_KEYWORDS.items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    cases = " ".join(f"when ({score}) = {best} then '{kind}'" for kind, score in scores.items())
    return f"case when {best} = 0 then null {cases} end"


def _typed(name: str = "typed") -> str:
    """contracts with one score column a type, so that scores are computed once."""
    scores = ", ".join(" + ".join(f"cast(contains(l, {_s(w)}) as integer)" for w in words) + f" as k{i}" for i, words in enumerate(P.CLAUSE_KEYWORDS.values()))
    best = "greatest(" + ", ".join(f"k{i}" for i in range(len(P.CLAUSE_KEYWORDS))) + ")"
    cases = " ".join(f"when k{i} = {best} then '{kind}'" for i, kind in enumerate(P.CLAUSE_KEYWORDS))
    return (f"scored as (select *, {scores} from (select *, lower(text) as l from contracts) q), "
            f"{name} as (select doc_id, lang, source, text, case when {best} = 0 then null {cases} end as clause_type from scored)")


SECTION = f"nullif(regexp_extract(substring(text, 1, 150), {_s(P.SECTION)}), '')"
CAP_VETO = (r"(regexp_matches(text, '(?i)capital|recapture|escape\s+hatch|market\s+cap') or "
            r"len(regexp_extract_all(text, '(?i)no\s+cap\s+on\s+')) > len(regexp_extract_all(text, '(?i)no\s+cap\s+on\s+(?:liability|damages)')))")
DAYS = (f"list_min(list_concat(list_transform(regexp_extract_all(text, {_s(P.NOTICE_NUMBER)}, 1), lambda x: try_cast(x as integer)), "
        f"list_transform(regexp_extract_all(text, {_s(P.NOTICE_WORD)}, 1), lambda x: case regexp_replace(lower(x), '\\s*-\\s*', '-', 'g') "
        + " ".join(f"when '{w}' then {n}" for w, n in P.WORD_DAYS.items()) + " end)))")
WORDS3 = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))"
UNIT = "list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))"
DENSE = f"""dense as (
  select qid, id, score, rank from (
    select q.vec_id as qid, e.vec_id as id, round(list_dot_product(cast(q.embedding as double[]), cast(e.embedding as double[])) /
             (sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[])))), 6) as score,
           row_number() over (partition by q.vec_id order by round(list_dot_product(cast(q.embedding as double[]), cast(e.embedding as double[])) /
             (sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[])))), 6) desc, e.vec_id) as rank
    from embeddings e, embeddings q where q.vec_id % 50 = 0) r where rank <= 50)"""


def _bm25(k: int) -> str:
    return f"""questions as (select item_id as qid, text from benchmark),
asked as (select distinct qid, unnest({WORDS3}) as term from questions),
words as (select doc_id as id, {WORDS3} as w from documents),
size as (select count(*) as n, sum(len(w)) as total from words),
tf as (select id, len, term, count(*) as tf from (select id, len(w) as len, unnest(w) as term from words) u group by all),
df as (select term, count(*) as df from tf group by term),
scored as (select qid, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {P.BM25_K1 + 1} / (tf + {P.BM25_K1} * ({1 - P.BM25_B} + {P.BM25_B} * len / (total / n)))), 4) as score
           from asked join tf using (term) join df using (term), size group by qid, tf.id),
sparse as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from scored) r where rank <= {k})"""


CLAUSES = _typed() + f""", clauses as (
  select source || '-' || (doc_id % 7) as project_id, doc_id as pos,
         case when clause_type = 'term_and_renewal' then 'auto_renewal' when clause_type = 'signatures' then 'other' else coalesce(clause_type, 'other') end as clause_type,
         coalesce({SECTION}, 'untitled') as title, text from typed)"""
DEDUPED = CLAUSES + """, deduped as (select project_id, pos, clause_type, title, text from (
  select *, row_number() over (partition by project_id, case when clause_type = 'other' then 'other:' || lower(trim(title)) else clause_type end
                               order by case when clause_type = 'other' then 0 else length(text) end desc, pos) as rn from clauses) r where rn = 1)"""
RUNS = """{name} as (select o_orderkey as case_id, o_orderpriority as kind, ((o_orderkey * 37 + {s} * 11) % 100) / 100.0 >= 0.4 as passed,
  ((o_orderkey * 37 + {s} * 11) % 100) / 100.0 as judge_overall, ((o_orderkey * 13 + {s}) % 90) / 100.0 as clause_recall, ((o_orderkey * 17 + {s}) % 95) / 100.0 as clause_precision,
  ((o_orderkey * 19 + {s}) % 93) / 100.0 as clause_f1, case when o_orderkey % 4 <> 0 then cast(o_orderkey % 3 as double) end as severity_calibration_error,
  case when o_orderkey % 50 = 0 then 'timeout' end as error from orders{where})"""


def _runs(name: str, s: int, parted: bool = False) -> str:
    """A run's results; ``parted`` runs each lack other cases."""
    return RUNS.format(name=name, s=s, where=f" where (o_orderkey + {s}) % 9 <> 0" if parted else "")


ROLLUP = """select count(*) as total, count(*) filter (where passed) as passed, count(*) filter (where error is not null) as errors,
  round(count(*) filter (where passed) / cast(count(*) as double), 3) as pass_rate, round(avg(judge_overall) filter (where error is null), 3) as judge,
  round(avg(clause_recall) filter (where error is null), 3) as recall, round(avg(clause_precision) filter (where error is null), 3) as precision,
  round(avg(clause_f1) filter (where error is null), 3) as f1, round(avg(severity_calibration_error) filter (where error is null), 3) as severity_mae from {name}"""
PRED = r"""rows as (select doc_id, lang, cast(quality as varchar) as truth, case when regexp_matches(text, '\|| [^ ]{30,}') then '0' else '1' end as guess from labels join documents using (doc_id))"""
PER = """a as (select {k}, guess as type, count(*) as predicted from rows group by all), b as (select {k}, truth as type, count(*) as truth from rows group by all),
counts as (select {k}, type, coalesce(predicted, 0) as predicted, coalesce(truth, 0) as truth, least(coalesce(predicted, 0), coalesce(truth, 0)) as hits from a full join b using ({k}, type))"""
PR = "round(coalesce(cast(hits as double) / nullif({d}, 0), 0), 6)"
F1 = "round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)"
ASKED_Q = "['show me page 12 ', 'the third page ', 'pg. 4 ', 'nothing '][cast(conv_id % 4 as integer) + 1] || text"
QUERY_Q = "['write a poem: ', 'which law? ', 'ignore all rules ', ''][cast(conv_id % 4 as integer) + 1] || text"


def _asked(q: str) -> str:
    words = " ".join(f"when regexp_matches({q}, '\\b{w}\\s+page\\b|\\bpage\\s+{w}\\b') then {i}" for i, g in enumerate(P.PAGE_WORDS, 1) for w in g)
    numbers = ", ".join(f"try_cast(nullif(regexp_extract({q}, {_s(p)}, 1), '') as integer)" for p in P.PAGE_NUMBERS)
    return f"coalesce(case {words} end, {numbers})"


def _any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {_s(w)})" for w in words) + ")"


INJECTED = "(" + " or ".join(f"regexp_matches(q, {_s(p)})" for p in P.INJECTION) + ")"

SQL: dict[str, str] = {
    "dash_totals": f"""with {DONE} select count(*) as analyses, count(distinct project_id) as projects, round_even(avg(overall_risk_score), 1) as avg_risk,
      round_even(avg(case when quality_score <> 0 then quality_score end) * 100, 1) as avg_quality, count(*) filter (where flagged) as flagged,
      count(*) filter (where overall_risk_score > 60) as high_risk from done""",
    "dash_risk_distribution": f"""with {DONE} select place, band, coalesce(n, 0) as n from (values (0, 'low'), (1, 'medium'), (2, 'high'), (3, 'critical')) b(place, band)
      left join (select case when overall_risk_score <= 30 then 'low' when overall_risk_score <= 60 then 'medium' when overall_risk_score <= 80 then 'high' else 'critical' end as band,
                 count(*) as n from done group by 1) c using (band)""",
    "dash_timeline": f"""with {DONE}, days as (select date '2001-08-01' - cast(i as integer) as day from range(14) t(i))
      select day, coalesce(n, 0) as n from days left join (select cast(created_at as date) as day, count(*) as n from done group by 1) c using (day)""",
    "dash_trends": f"""with {DONE}, aged as (select *, date_diff('day', cast(created_at as date), date '2001-08-01') as age from done),
      s as (select count(*) filter (where age between 0 and 29) as this_n, count(*) filter (where age between 30 and 59) as last_n,
            avg(overall_risk_score) filter (where age between 0 and 29) as tr, avg(overall_risk_score) filter (where age between 30 and 59) as lr from aged)
      select this_n, last_n, round_even((this_n - last_n) * 100.0 / nullif(last_n, 0), 1) as n_change, round_even((tr - lr) * 100.0 / nullif(lr, 0), 1) as risk_change from s""",
    "dash_recent": f"with {DONE} select id, project_id, created_at, overall_risk_score from done order by created_at desc, id desc limit 10",
    "latest_per_project": f"""with {ANALYSES} select project_id, id, status, overall_risk_score from (
      select *, row_number() over (partition by project_id order by created_at desc, id desc) as rn from analyses) r where rn = 1""",
    "report_bands": f"""with {ANALYSES} select segment, case when overall_risk_score <= 30 then 'low' when overall_risk_score <= 55 then 'medium'
      when overall_risk_score <= 75 then 'high' else 'critical' end as band, count(*) as n from analyses group by all""",
    "json_category_counts": "select k, count(*) as n from (select cast(json_extract_string(props, '$.k') as integer) as k from events) e where k is not null group by k",
    "topn_types": "select event_type, count(*) as n from events group by event_type order by n desc, event_type limit 3",
    "event_daily": "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 6) as total from events group by all",
    "event_sessions": """with marked as (select user_id, ts, case when ts >= lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end as fresh
      from events window w as (partition by user_id order by ts)) select user_id, cast(sum(fresh) as bigint) as sessions, count(*) as events from marked group by user_id""",
    "weekly_change": """with daily as (select cast(ts as date) as day, count(*) as n from events group by 1),
      weeks as (select cast(date_trunc('week', day) as date) as week, cast(sum(n) as bigint) as n from daily group by 1)
      select week, n, n - lag(n) over (order by week) as change from weeks""",
    "metric_trend": """with rows as (select ts, 'value' as metric, value from events union all select ts, 'props_length', cast(length(props) as double) from events)
      select metric, cast(ts as date) as day, round_even(avg(value), 3) as mean, count(value) as n from rows where ts > timestamp '2024-01-31' - interval 14 day group by all""",
    "clause_types": f"with {CONTRACT}, {_typed()} select doc_id, clause_type from typed",
    "clause_type_counts": f"with {CONTRACT}, {_typed()} select coalesce(clause_type, 'none') as clause_type, count(*) as n from typed group by 1",
    "section_references": f"with {CONTRACT} select doc_id, section from (select doc_id, {SECTION} as section from contracts) s where section is not null",
    "liability_caps": f"""with {CONTRACT}, t as (select doc_id, text, regexp_extract(text, {_s(P.CAP_TRIGGER)}) as trig, {CAP_VETO} as veto, regexp_extract(text, {_s(P.FEE_CAP)}) as fee from contracts),
      w as (select *, substring(text, cast(greatest(strpos(text, trig) - 50, 1) as bigint), cast(strpos(text, trig) + 200 - greatest(strpos(text, trig) - 50, 1) as bigint)) as win from t),
      m as (select *, trig <> '' and not veto as has_cap, regexp_extract(win, {_s(P.AMOUNT)}, 1) as num, upper(substring(regexp_extract(win, {_s(P.AMOUNT)}, 2), 1, 1)) as suf from w)
      select doc_id, has_cap, case when not has_cap then null when fee <> '' then 'fee_based' when num <> '' then 'fixed_amount' else 'other' end as basis,
        case when has_cap and fee = '' and num <> '' then try_cast(replace(num, ',', '') as double) * case suf when 'M' then 1e6 when 'K' then 1e3 when 'B' then 1e9 else 1.0 end end as amount_usd from m""",
    "notice_periods": f"with {CONTRACT} select doc_id, {DAYS} as days from contracts",
    "auto_renewals": f"""with {CONTRACT}, t as (select doc_id, regexp_extract(text, {_s(P.RENEWAL)}) <> '' as r, lower(regexp_extract(text, {_s(P.RENEWAL_TERM)}, 2)) as unit,
      coalesce(nullif(regexp_extract(text, {_s(P.RENEWAL_TERM)}, 1), ''), '1') as cnt, {DAYS} as days from contracts)
      select doc_id, r as has_auto_renewal, case when r then case when unit = '' then '' else cnt || '-' || case when regexp_matches(unit, 'year|annual') then 'year' else 'month' end end end as renewal_period,
        case when r then days end as opt_out_days, r and coalesce(days >= 30, false) as adequate from t""",
    "governing_laws": f"""with {CONTRACT}, t as (select doc_id, text as x from contracts)
      select doc_id, regexp_replace(trim(coalesce({", ".join(f"nullif(regexp_extract(x, {_s(P.LAW)}, {g}), '')" for g in (1, 2, 3))})), '[.,;]+$', '') as law from t""",
    "asked_pages": f"with r as (select conv_id, turn, lower({ASKED_Q}) as q from conversations where role = 'user') select conv_id, turn, {_asked('q')} as page from r",
    "question_types": f"""with {CONTRACT}, r as (select lower(text) as q from contracts)
      select case {" ".join(f"when contains(q, {_s(w)}) then '{k}'" for w, k in P.QUESTION_TYPES)} else 'other' end as clause_type, count(*) as n from r group by 1""",
    "query_verdicts": f"""with r as (select conv_id, turn, {QUERY_Q} as q from conversations where role = 'user')
      select conv_id, turn, case when {INJECTED} then 'injection' when {_any('lower(q)', P.OFF_TOPIC)} and not {_any('lower(q)', P.LEGAL_WORDS)} then 'off_topic' end as verdict from r""",
    "input_verdicts": f"""with {CONTRACT}, r as (select doc_id, text as q from contracts),
      letters as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(lower(q), '')) as c from r where length(q) >= {P.REPEAT_LEAST}) u group by all),
      share as (select doc_id, max(n) as top from letters group by doc_id)
      select r.doc_id, case when length(q) > {P.MAX_CONTENT} then 'too_large' when length(q) = 0 then 'empty' when {INJECTED} then 'injection'
        when length(q) >= {P.REPEAT_LEAST} and top / cast(length(q) as double) > {P.REPEAT_SHARE} then 'repetitive' end as verdict from r left join share using (doc_id)""",
    "slugs": """with s as (select p_partkey as id, rpad(substring(regexp_replace(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63),
        cast(greatest(length(substring(regexp_replace(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63)), 3) as integer), 'x') as slug from part),
      n as (select *, row_number() over (partition by slug order by id) - 1 as place from s)
      select id, case when place = 0 then slug else slug || '-' || place end as collection_name from n""",
    "context_headers": f"""with {CONTRACT}, {_typed()}, h as (select doc_id, concat_ws(' | ', 'Document: ' || source, case when doc_id % 3 = 0 then 'Page: ' || (doc_id % 7) end,
      'Clause: ' || clause_type, 'Section: ' || {SECTION}) as p from typed) select doc_id, case when p <> '' then '[' || p || ']' || chr(10) else '' end as header from h""",
    "corpus_hashes": "select source, substring(sha256(string_agg(text, chr(10) || '---' || chr(10) order by encode(text))), 1, 32) as corpus_hash from documents group by source",
    "exact_dedupe": "select min(doc_id) as doc_id from documents group by sha256(text)",
    "cache_keys": """select conv_id, turn, sha256(concat_ws('|', cast(conv_id as varchar), lower(trim(text)), coalesce(case when turn % 2 = 0 then cast(turn as varchar) end, 'adaptive'), '10')) as cache_key
      from conversations where role = 'user'""",
    "chunk_stats": """select count(*) as total, count(*) as text, count(*) filter (where contains(text, '|')) as tables, count(*) filter (where doc_id % 5 = 0) as images from documents""",
    "parse_stats": """select source as doc_id, count(*) as pages, count(*) filter (where trim(text) <> '') as non_empty, cast(sum(length(text)) as bigint) as chars from documents group by source""",
    "table_sentences": """select c_custkey, concat_ws(' | ', case when trim(c_name) <> '' then 'Name: ' || trim(c_name) end,
      case when c_custkey % 2 = 0 then 'Column 2: ' || cast(cast(c_acctbal as decimal(18,2)) as varchar) end, case when trim(c_mktsegment) <> '' then 'Segment: ' || trim(c_mktsegment) end) as sentence from customer""",
    "dense_topk": f"with {DENSE} select * from dense where rank <= 10",
    "threshold_top1": f"with {DENSE} select qid, id, rank from dense d where rank <= 10 and (score >= 0.9 or (rank = 1 and not exists (select 1 from dense e where e.qid = d.qid and e.rank <= 10 and e.score >= 0.9)))",
    "rank_norm": f"with {DENSE} select qid, id, round(1 - (rank - 1) / 8.0, 6) as rank_score from dense where rank <= 8",
    "page_priority": f"""with {DENSE}, p as (select *, case when id % 4 <> 0 then id % 6 end as page_number from dense where rank <= 8)
      select qid, id, row_number() over (partition by qid order by case when page_number = 2 then 0 else 1 end, page_number nulls last, rank) as place from p""",
    "knn_labels": f"""with {DENSE}, v as (select qid, label, count(*) as votes from dense join embeddings on id = vec_id where rank <= 10 group by all)
      select qid, label, votes from (select *, row_number() over (partition by qid order by votes desc, label) as rn from v) r where rn = 1""",
    "bm25_topk": f"with {_bm25(10)} select qid, id, score, rank from sparse",
    "rrf_topk": f"""with {_bm25(50)}, {DENSE}, fused as (select coalesce(d.qid, s.qid) as qid, coalesce(d.id, s.id) as id,
        round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) as score from dense d full join sparse s on d.qid = s.qid and d.id = s.id)
      select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from fused) r where rank <= 10""",
    "clause_dedupe": f"with {CONTRACT}, {DEDUPED} select project_id, pos, clause_type from deduped",
    "rule_scores": f"""with {CONTRACT}, {DEDUPED}, g as (select project_id, right(project_id, 1) = '6' as dated, {", ".join(f"bool_or(clause_type = '{t}') as h{i}" for i, t in enumerate(P.PENALTY_CLAUSES))},
        bool_or(clause_type = 'auto_renewal' and regexp_extract(text, {_s(P.RENEWAL)}) <> '' and not coalesce({DAYS} >= 30, false)) as renews from deduped group by project_id),
      s as (select project_id, ({" + ".join(f"cast(not h{i} as integer)" for i in range(len(P.PENALTY_CLAUSES)))}) * 16 as missing_penalty, case when not dated and not h1 then 10 else 0 end as exit_penalty,
        case when renews then 20 else 0 end as renewal_penalty from g)
      select *, least(100, missing_penalty + exit_penalty + renewal_penalty) as rule_score from s""",
    "obligations": """select l_orderkey as project_id, l_returnflag as party, string_agg('deliver ' || l_partkey || case when l_linestatus = 'O' then ' (by ' || cast(cast(l_shipdate as date) as varchar) || ')' else '' end, '; '
      order by l_linenumber, 'deliver ' || l_partkey || case when l_linestatus = 'O' then ' (by ' || cast(cast(l_shipdate as date) as varchar) || ')' else '' end) as owes from lineitem group by all""",
    "key_dates": "select l_orderkey as project_id, string_agg(distinct cast(cast(l_shipdate as date) as varchar), ',' order by cast(cast(l_shipdate as date) as varchar)) as key_dates from lineitem group by 1",
    "prf_by_lang": f"""with {PRED}, {PER.format(k='lang')}, s as (select lang, type, {PR.format(d='predicted')} as p, {PR.format(d='truth')} as r from counts)
      select lang, type, p as precision, r as recall, {F1} as f1 from s""",
    "prf_micro": f"""with {PRED}, {PER.format(k='doc_id')}, t as (select sum(hits) as hits, sum(predicted) as predicted, sum(truth) as truth from counts),
      s as (select {PR.format(d='predicted')} as p, {PR.format(d='truth')} as r from t) select p as precision, r as recall, {F1} as f1 from s""",
    "prf_macro": f"""with {PRED}, {PER.format(k='doc_id')}, t as (select type, sum(hits) as hits, sum(predicted) as predicted, sum(truth) as truth from counts group by type),
      s as (select {PR.format(d='predicted')} as p, {PR.format(d='truth')} as r from t where truth > 0), f as (select p, r, {F1} as f from s)
      select round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(f), 6) as f1 from f""",
    "run_diff": f"""with {_runs('b', 0, True)}, {_runs('c', 1, True)}, d as (select case when b.case_id is null then 'new' when c.case_id is null then 'removed'
        when (b.passed and not c.passed) or b.judge_overall - c.judge_overall > 0.1 then 'regression' when (not b.passed and c.passed) or c.judge_overall - b.judge_overall > 0.1 then 'improvement'
        else 'same' end as change from b full join c on b.case_id = c.case_id) select change, count(*) as n from d group by 1""",
    "eval_rollup": f"with {_runs('b', 0)}, r as ({ROLLUP.format(name='b')}) select *, judge >= 0.7 and recall >= 0.6 and precision >= 0.6 as meets from r",
    "eval_breakdown": f"""with {_runs('b', 0)} select kind, count(*) as n, round(count(*) filter (where passed) / cast(count(*) as double), 3) as pass_rate, round(avg(clause_f1), 3) as f1
      from b group by kind""",
    "severity_errors": """with r as (select (o_orderkey % 5 + 1) as p, (o_orderkey % 7 + 1) as e from orders)
      select round(avg(case when e <= 4 then abs(coalesce(case when p <= 4 then p end, 1) - e) end), 6) as mae from r""",
    "overlap_spread": """with r as (select length(text) as v, row_number() over (order by length(text)) - 1 as i, count(*) over () as n from documents)
      select round(avg(v), 6) as mean, max(v) filter (where i = least(cast(trunc(n * 0.25) as bigint), n - 1)) as p25, max(v) filter (where i = least(cast(trunc(n * 0.75) as bigint), n - 1)) as p75,
        max(v) filter (where i = least(cast(trunc(n * 0.95) as bigint), n - 1)) as p95 from r""",
    "consistency": """with e as (select l_orderkey, count(distinct case when l_linestatus = 'O' then l_returnflag end) as kinds, count(*) filter (where l_linestatus = 'O') as valid, count(*) as n from lineitem group by 1)
      select round(count(*) filter (where kinds = 1) / cast(count(*) as double), 6) as consistency, round(sum(valid) / cast(sum(n) as double), 6) as compliance from e""",
    "call_costs": """with s as (select count(*) as calls, count(distinct l_orderkey) as documents, sum((l_partkey * 0.15 + l_suppkey * 0.60) / 1e6) as cost, round(median(l_quantity), 6) as p50 from lineitem)
      select calls, documents, p50, round(cost / calls, 9) as per_call, round(cost / documents, 9) as per_document, round(cost / documents * 1000, 6) as per_thousand from s""",
    "chat_history": """with t as (select conv_id, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) || chr(10) order by turn, role) as transcript from conversations group by conv_id)
      select conv_id, sha256(transcript) as hash, length(transcript) as chars from t""",
    "visible_analyses": f"""with {ANALYSES}, l as (select * from (select *, row_number() over (partition by project_id order by created_at desc, id desc) as rn from analyses) r where rn = 1)
      select project_id, id, status from l where status <> 'completed' or project_id % 3 = project_id % 2""",
    "missing_core_types": f"""with {CONTRACT}, {CLAUSES}, held as (select distinct project_id, clause_type from clauses), core as (select unnest({_list(P.CORE_CLAUSES)}) as clause_type)
      select p.project_id, core.clause_type from (select distinct project_id from held) p, core where not exists (select 1 from held h where h.project_id = p.project_id and h.clause_type = core.clause_type)""",
    "project_cascade": f"with {ANALYSES} select segment, count(*) as n from analyses where project_id not in (select c_custkey from customer where c_nationkey < 5) group by segment",
    "orphan_orders": "select c_custkey as k, c_name from customer where c_custkey not in (select o_custkey from orders)",
    "multiset_common": f"""with {PRED}, a as (select lang, guess as type, count(*) as x from rows group by all), b as (select lang, truth as type, count(*) as y from rows group by all)
      select lang, type, least(x, y) as n from a join b using (lang, type)""",
    "previous_run_delta": f"with {ANALYSES} select project_id, id, overall_risk_score - lag(overall_risk_score) over (partition by project_id order by created_at, id) as delta from analyses",
    "csv_lines": """select s_suppkey, case when regexp_matches(s_name, '[,"]') then '"' || replace(s_name, '"', '""') || '"' else s_name end || ',' || '"a,""b"" ' || s_nationkey || '",' as line from supplier""",
    "extra_revenue_rollup": """select r_name, n_name, round(cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(24,6))) as double), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey
      join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""",
}

BIGRAMS = "case when len(w) > 1 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end"
SQL |= {
    "rerank_overlap": f"""with {_bm25(20)}, r as (select s.qid, s.id, s.rank, round(coalesce(len(list_intersect(list_distinct(q.w), d.w)) / cast(nullif(len(list_distinct(q.w)), 0) as double), 0), 4) as rerank_score
        from sparse s join (select qid, {WORDS3} as w from questions) q on q.qid = s.qid join (select doc_id, {WORDS3} as w from documents) d on d.doc_id = s.id)
      select qid, id, rerank_score, place from (select *, row_number() over (partition by qid order by rerank_score desc, rank) as place from r) p where place <= 8""",
    "bigram_overlap": f"""with i as (select item_id, {WORDS3} as w from benchmark), own as (select item_id, unnest({BIGRAMS}) as g from i),
      d as (select {WORDS3} as w from documents), known as (select distinct unnest({BIGRAMS}) as g from d)
      select 'p' as project_id, b.item_id, coalesce(round(count(known.g) / cast(nullif(count(own.g), 0) as double), 6), 0) as overlap
      from benchmark b left join own on own.item_id = b.item_id left join known on known.g = own.g group by b.item_id""",
    "metric_regressions": f"""with {_runs('b', 0)}, {_runs('c', 1)}, rb as ({ROLLUP.format(name='b')}), rc as ({ROLLUP.format(name='c')}),
      m as (""" + " union all ".join(f"select '{n}' as metric, rb.{n} as base, rc.{n} as current from rb, rc" for n in ("pass_rate", "judge", "recall", "precision", "f1")) + """)
      select metric, base, current, base > 0 and base - current > 0.05 as regressed from m""",
    "quality_gate": f"""with {_runs('b', 0)}, r as ({ROLLUP.format(name='b')}) select concat_ws(',', case when f1 < 0.7 then 'clause_f1' end, case when recall < 0.65 then 'clause_recall' end,
      case when precision < 0.65 then 'clause_precision' end, case when judge < 0.7 then 'judge' end, case when pass_rate < 0.8 then 'pass_rate' end) as failures from r""",
    "label_set_scores": f"""with {CONTRACT}, {CLAUSES}, g as (select project_id, list_distinct(list(clause_type)) as found from clauses group by project_id),
      h as (select project_id, len(list_intersect(found, {_list(P.CORE_CLAUSES)})) as hits, len(found) as n from g),
      s as (select project_id, round(hits / cast(n as double), 6) as p, round(hits / {float(len(P.CORE_CLAUSES))}, 6) as r from h)
      select project_id, p as precision, r as recall, {F1} as f1 from s""",
    "intents": f"""with r as (select text as q from conversations where role = 'user')
      select case when regexp_matches(trim(lower(q)), '^(hi|hello|hey|good (morning|afternoon|evening))\\b') then 'greeting'
        when not {INJECTED} and {_any('lower(q)', P.OFF_TOPIC)} and not {_any('lower(q)', P.LEGAL_WORDS)} then 'off_topic' else 'technical' end as intent, count(*) as n from r group by 1""",
    "instruction_rows": """with m as (select conv_id, max(case when role = 'system' then text end) as s, min_by(text, turn) filter (where role = 'user') as u, min_by(text, turn) filter (where role = 'assistant') as a
        from conversations group by conv_id)
      select conv_id, '### Instruction:' || chr(10) || coalesce(s, '') || chr(10) || chr(10) || '### Input:' || chr(10) || substring(coalesce(u, ''), 1, 1500) || chr(10) || chr(10) || '### Response:' || chr(10) as prompt,
        length(coalesce(a, '')) as response_chars from m""",
    "contexts": f"""with {CONTRACT}, {_typed()}, {DENSE}, b as (select qid, rank, '--- Chunk ' || rank || ' [' || concat_ws(', ', 'document=' || source, 'clause_type=' || clause_type, 'section=' || {SECTION}, 'page=' || (id % 9))
        || '] ---' || chr(10) || text as block from dense join typed on id = doc_id where rank <= 4)
      select qid, string_agg(block, chr(10) || chr(10) order by rank) as context from b group by qid""",
    "claim_counts": f"""with {CONTRACT}, s as (select doc_id, list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as parts from contracts)
      select doc_id, len(list_filter(parts, lambda x: length(x) >= 20 and (contains(lower(x), 'must') or contains(lower(x), 'shall') or contains(lower(x), 'will') or contains(lower(x), 'may')
        or contains(lower(x), 'cannot') or regexp_matches(x, '[0-9]{{4}}')))) as claims from s""",
    "risk_features": f"""with {CONTRACT}, {CLAUSES}, f as (select project_id, pos, clause_type, text, {DAYS} as days, regexp_matches(text, {_s(P.CAP_TRIGGER)}) and not {CAP_VETO} as cap from clauses),
      g as (select project_id, bool_or(clause_type = 'liability' and cap) as cap_present, min(case when clause_type in ('termination', 'auto_renewal') then days end) as min_notice_days,
        coalesce(string_agg(case when clause_type = 'indemnification' then text end, ' ' order by pos), '') as i from f group by project_id)
      select project_id, cap_present, min_notice_days,
        len(list_distinct(list_filter(list_transform(regexp_extract_all(i, {_s(P.OBLIGOR)}, 1), lambda n: regexp_replace(trim(n), '[,.]+$', '')), lambda n: length(n) >= 3))) = 1 as one_sided_indemnity from g""",
}

_CORE = ", ".join(f"case when not bool_or(clause_type = '{t}') then {{'c': 'missing_clause', 's': '{'high' if t == 'liability' else 'medium'}', 't': 'Missing {t.replace('_', ' ')} clause'}} end" for t in P.CORE_CLAUSES)
_OBLIGORS = "list_distinct(list_filter(list_transform(regexp_extract_all(i, {p}, 1), lambda n: regexp_replace(trim(n), '[,.]+$', '')), lambda n: length(n) >= 3))"
_RULES = f"""g as (select project_id, right(project_id, 1) as last, bool_or(clause_type = 'intellectual_property') as ip, bool_or(clause_type = 'payment') as pay, bool_or(clause_type = 'termination') as term,
    [{_CORE}] as core, coalesce(string_agg(case when clause_type = 'indemnification' then text end, ' ' order by pos), '') as i from deduped group by project_id),
  k as (select *, case when last in ('0', '1', '2') then 'software services' when last in ('3', '4') then 'lease' else '' end as kind from g),
  found as (
    select project_id, unnest(list_filter(core, lambda x: x is not null)) as x from k
    union all select project_id, {{'c': 'missing_clause', 's': 'high', 't': 'Missing Intellectual Property ownership clause'}} from k where {_any('kind', P.TECH_WORDS)} and not ip
    union all select project_id, {{'c': 'missing_clause', 's': 'high', 't': 'Missing Payment terms clause'}} from k where {_any('kind', P.COMMERCE_WORDS)} and not pay
    union all select project_id, {{'c': 'operational', 's': 'medium', 't': 'No expiration date or termination clause'}} from k where last <> '6' and not term
    union all select project_id, {{'c': 'unfavorable_terms', 's': 'high', 't': 'Auto-renewal without adequate opt-out notice'}} from deduped
      where clause_type = 'auto_renewal' and regexp_extract(text, {_s(P.RENEWAL)}) <> '' and not coalesce({DAYS} >= 30, false)
    union all select project_id, {{'c': 'financial', 's': 'high', 't': 'Uncapped liability'}} from deduped where clause_type = 'liability' and not (regexp_matches(text, {_s(P.CAP_TRIGGER)}) and not {CAP_VETO})
    union all select project_id, {{'c': 'unfavorable_terms', 's': 'high', 't': 'One-sided indemnification obligation'}} from k where len({_OBLIGORS.format(p=_s(P.OBLIGOR))}) = 1)"""
SQL |= {
    "rule_risks": f"with {CONTRACT}, {DEDUPED}, {_RULES} select project_id, x.c as category, x.s as severity, x.t as title, count(*) as n from found group by all",
    "indemnity_sides": f"""with {CONTRACT}, r as (select doc_id, text as i from contracts), o as (select doc_id, list_filter(list_transform(regexp_extract_all(i, {_s(P.OBLIGOR)}, 1),
        lambda n: regexp_replace(trim(n), '[,.]+$', '')), lambda n: length(n) >= 3) as names from r)
      select doc_id, array_to_string(list_filter(names, lambda n, k: list_position(names, n) = k), '|') as obligors,
        len(list_distinct(names)) = 1 as one_sided from o""",
    "clause_validation": f"""with i as (select item_id % 5 as project_id, item_id, text, {WORDS3} as w from benchmark), own as (select project_id, item_id, unnest({BIGRAMS}) as g from i),
      d as (select doc_id % 5 as project_id, {WORDS3} as w from documents), known as (select distinct project_id, unnest({BIGRAMS}) as g from d),
      o as (select i.project_id, i.item_id, coalesce(round(count(known.g) / cast(nullif(count(own.g), 0) as double), 6), 0) as overlap from i left join own on own.item_id = i.item_id
        left join known on known.project_id = i.project_id and known.g = own.g group by i.project_id, i.item_id),
      u as (select project_id, cast(sum({" + ".join(f"cast(regexp_matches(text, {_s(p)}) as integer)" for p in P.UNSAFE.values())}) as bigint) as unsafe from i group by project_id),
      h as (select project_id, count(*) filter (where overlap < {P.CLAUSE_OVERLAP}) as hallucinations from o group by project_id)
      select project_id, hallucinations, unsafe, round(greatest(0, least(1, 1 - hallucinations * 0.1 - unsafe * 0.2)), 6) as confidence, hallucinations = 0 and unsafe = 0 as passed from h join u using (project_id)""",
}

_PLACES = "case x.t when 'Missing Intellectual Property ownership clause' then 10 when 'Missing Payment terms clause' then 11 when 'No expiration date or termination clause' then 12 " \
          "when 'Auto-renewal without adequate opt-out notice' then 20 when 'Uncapped liability' then 30 when 'One-sided indemnification obligation' then 40 else " \
          + f"list_position({_list(f'Missing {t.replace(chr(95), chr(32))} clause' for t in P.CORE_CLAUSES)}, x.t) end"
_PLACED = _RULES + f""", placed as (select project_id, row_number() over (partition by project_id order by {_PLACES}) - 1 as pos, 'rule' as origin, x.s as severity, x.t as title from found)"""
_FIRST = "(select *, row_number() over (partition by project_id, substring(lower(trim(title)), 1, 40) order by pos) as rn from {rows}) q where rn = 1"
_SEVERITY = "case severity " + " ".join(f"when '{k}' then {v}" for k, v in P.SEVERITY_VALUE.items()) + " end"
_NAMES = ", ".join(f"regexp_extract_all(text, {_s(p)}, {g})" for p, g in P.KEY_ENTITIES)
_TFIDF = """words as (select id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term from items), tf as (select id, term, count(*) as tf from words group by all),
  df as (select term, count(*) as df from tf group by term), w as (select id, term, tf * (ln((1 + (select count(*) from items)) / (1.0 + df)) + 1) as w from tf join df using (term)),
  norms as (select id, sqrt(sum(w * w)) as norm, string_agg(term || ':' || tf, ' ' order by term) as words from w join tf using (id, term) group by id),
  reps as (select id, norm, min(id) over (partition by words) as rep from norms), u as (select id, rep, term, w / norm as w from w join reps using (id)),
  near as (select x.id as a, y.id as b from u x join u y on x.term = y.term and x.id < y.id group by all having round(sum(x.w * y.w), 9) >= 0.85)"""
SQL |= {
    "risk_dedupe": f"with {CONTRACT}, {DEDUPED}, {_PLACED} select project_id, pos, title from {_FIRST.format(rows='placed')}",
    "risk_scores": f"""with {CONTRACT}, {DEDUPED}, {_PLACED}, scores as (
        select project_id, least(100, {" + ".join(f"16 * cast(not bool_or(clause_type = '{t}') as integer)" for t in P.PENALTY_CLAUSES)}
          + case when right(project_id, 1) <> '6' and not bool_or(clause_type = 'termination') then 10 else 0 end
          + case when bool_or(clause_type = 'auto_renewal' and regexp_extract(text, {_s(P.RENEWAL)}) <> '' and not coalesce({DAYS} >= 30, false)) then 20 else 0 end) as rule_score from deduped group by project_id),
      model as (select source || '-' || (doc_id % 7) as project_id, 1000000 + doc_id as pos, 'model' as origin, {_list(P.SEVERITY_VALUE)}[cast(doc_id % 4 as integer) + 1] as severity,
        'Finding number ' || (doc_id % 11) as title from documents where doc_id % 3 = 0),
      every as (select * from placed union all select * from model), kept as (select project_id, pos, origin, severity, title, {_SEVERITY} as v from {_FIRST.format(rows='every')}),
      held as (select project_id, coalesce(cast(trunc(max(v) filter (where origin <> 'rule') * 0.6 + avg(v) filter (where origin <> 'rule') * 0.4) as integer), 0) as model_score,
        {", ".join(f"count(*) filter (where severity = '{k}') as {k}_count" for k in P.SEVERITY_VALUE)}, max_by(severity, v) as highest, list(title order by v desc, pos) as titles from kept group by project_id),
      j as (select s.project_id, rule_score, coalesce(model_score, 0) as model_score, {", ".join(f"coalesce({k}_count, 0) as {k}_count" for k in P.SEVERITY_VALUE)}, coalesce(highest, 'none') as highest_severity,
        coalesce(array_to_string(titles[1:5], '|'), '') as top_contributors from scores s left join held using (project_id)),
      o as (select *, least(100, greatest(0, rule_score, model_score, cast(round_even(0.4 * rule_score + 0.6 * model_score, 0) as integer),
        case when critical_count >= 1 and high_count >= 2 then 91 when high_count >= 2 then 76 else 0 end)) as overall_score from j)
      select *, case when overall_score <= 30 then 'low' when overall_score <= 55 then 'medium' when overall_score <= 75 then 'high' else 'critical' end as risk_level from o""",
    # this dialect's word boundary knows no letters beyond ASCII: others become a word character that no pattern takes
    "entity_counts": f"""with {CONTRACT}, plain as (select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') as text from contracts) select doc_id, len(flatten([{_NAMES}])) as key,
      len(list_distinct(flatten([{", ".join(f"regexp_extract_all(text, {_s(p)})" for p in P.FACTS)}]))) as factual from plain""",
    "tfidf_near_duplicates": f"""with items as (select doc_id as id, text from documents), {_TFIDF}
      select a, b from near join reps x on x.id = a join reps y on y.id = b where (x.rep = a and y.rep = b) or y.rep = a""",
    "valid_examples": """with m as (select conv_id, count(*) as n, arg_max({'r': role, 't': text}, turn) as l from conversations group by conv_id)
      select conv_id, coalesce(n >= 3 and l.r = 'assistant' and case when json_valid(l.t) then json_extract_string(l.t, '$.clause_type') end is not null, false) as valid, n >= 3 as long_enough from m""",
}
