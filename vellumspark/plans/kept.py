"""Queries over kept structures: indexes, versioned stores, streams, partial sums and documents read in order.

Stand-ins beyond those of ``queries``: a user's events of a day are a job's;
conversations are documents, their turns pages, with a table for each assistant's
turn and an image for each third user's turn.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..operators import chunking, evaluate, folders, guard, partials, sampling, store, tables
from ..operators.dense_index import DenseIndex
from ..operators.points import PointStore, rebuild_sparse
from ..operators.sparse_index import SparseIndex
from ..streaming import invalidation, machine
from .oracle import CONTRACT, DONE, SQL as BASE, _s
from .queries import NOW, _items, _questions, _t, analyses, contracts


def _fresh(frame: DataFrame, label: str) -> str:
    return f"{tables.shared_dir(frame)}/vellum-{label}-{uuid.uuid4().hex}"


# --- indexes -------------------------------------------------------------------


def _vectors(spark, d):
    e = _t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def dense_index_topk(spark, d):
    """About the ten nearest vectors of every id divisible by 50, by the kept index, with exact cosines."""
    items, questions = _vectors(spark, d)
    return DenseIndex.kept(items, "dense").search(questions, 10, 6).select("qid", "id", "score", "rank")


def bm25_index_topk(spark, d):
    """The rows of ``bm25_topk``, from the kept index."""
    return SparseIndex.kept(_items(spark, d), "sparse").search(_questions(spark, d), 10, digits=4).select("qid", "id", "score", "rank")


# --- versioned stores ------------------------------------------------------------


def points_after_changes(spark, d):
    """A store of suppliers after an upsert of all, one of every third with a new balance, a deletion of a nation and a rebuild of sparse vectors."""
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("page_content"),
                                           F.lit(None).cast("map<string,int>").alias("sparse"))
    held = PointStore.create(spark, _fresh(rows, "points"), rows.schema, buckets=16)
    held.upsert(rows)
    held.upsert(rows.filter("id % 3 = 0").withColumn("balance", F.lit(0.0)))
    held.delete(F.col("nation") == 7)
    rebuild_sparse(held)
    return held.read().select("id", "nation", "balance", F.array_join(F.sort_array(F.map_keys("sparse")), ",").alias("words"))


# --- streams and partial sums ------------------------------------------------------


def job_events(events: DataFrame) -> DataFrame:
    """job_id, seq, ts, step, status of rows of ``events``; each seventh event is the job's own."""
    k = F.col("event_id")
    names = F.array(*[F.lit(s) for s in (*machine.STEPS, "Archiving")])
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return events.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("job_id"), k.alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                         F.when(k % 7 != 0, F.element_at(names, (k % 6).cast("int") + 1)).alias("step"), status.alias("status"))


def job_states_stream(spark, d):
    """The states of all jobs as a stateful stream over the events leaves them."""
    table = _t(spark, d, "events")
    root = _fresh(table, "jobs")
    source = spark.readStream.schema(table.schema)
    if folders.is_file(spark, f"{d}/events.parquet"):  # a stream reads folders
        stream = source.option("pathGlobFilter", "events.parquet").parquet(d)
    else:
        stream = source.parquet(f"{d}/events.parquet")
    machine.run_jobs(job_events(stream), f"{root}/out", f"{root}/state")
    return machine.latest_states(machine.sent(spark, f"{root}/out"))


def _figures(spark, d, parts: int = 3):
    """Partials of all analyses, taken in as batches; the last is given twice."""
    rows = analyses(spark, d)
    held = partials.create(spark, _fresh(rows, "figures"))
    for k in [*range(parts), parts - 1]:
        partials.take_in(held, rows.filter(F.pmod("id", F.lit(parts)) == k), "analyses", k)
    return held


def dash_merged_totals(spark, d):
    return partials.totals(_figures(spark, d).read())


def dash_merged_timeline(spark, d):
    return partials.timeline(_figures(spark, d).read(), F.lit(NOW).cast("date"), P.TIMELINE_DAYS["all"])


def dash_overview(spark, d):
    """An owner's projects, documents and analyses of the last 90 days."""
    projects = _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 7).cast("int").alias("files"))
    files = projects.filter("files > 0").select("project_id", F.explode(F.sequence(F.lit(1), "files")).alias("file"))
    return partials.overview(partials.partials(analyses(spark, d)), projects, files, F.date_sub(F.lit(NOW).cast("date"), 89))


def figures_after_ingests(spark, d):
    """Totals after every project whose id is divisible by three was ingested anew; the batch is replayed."""
    rows = analyses(spark, d).withColumn("created_at", F.to_date("created_at"))
    held = PointStore.create(spark, _fresh(rows, "analyses"), rows.schema)
    held.upsert(rows)
    figures = partials.create(spark, _fresh(rows, "figures"))
    partials.take_in(figures, rows, "analyses", 0)
    ingests = _t(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project_id"))
    for _ in range(2):
        invalidation.apply_ingests(held, figures, ingests, 0)
    left = held.read().agg(F.count("*").alias("stored"))
    return partials.totals(figures.read()).crossJoin(F.broadcast(left))


# --- documents read in order ---------------------------------------------------------


def conversation_parts(spark, d):
    """(pages, tables, images) of conversations."""
    rows = _t(spark, d, "conversations")
    base = rows.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), "role", "text")
    shown = base.filter("role = 'assistant'").select("doc_id", "page_number", F.lit(0).alias("pos"), chunking.row_sentence(F.array(F.lit("Role"), F.lit(""), F.lit("Turn")), F.array("role", F.lit(None).cast("string"), F.col("page_number").cast("string"))).alias("text"))
    seen = base.filter("role = 'user' and page_number % 3 = 0").select("doc_id", "page_number", F.lit(0).alias("pos"), F.concat(F.lit("Image of turn "), F.col("page_number").cast("string")).alias("text"))
    return base.select("doc_id", "page_number", "text"), shown, seen


def chunk_conversations(spark, d):
    return chunking.chunk_in_order(*conversation_parts(spark, d))


# --- phrases and facts in sources, samples, costs -------------------------------------


def _pairs(spark, d):
    """(items, sources): a source's contract texts as items, its documents as sources."""
    items = contracts(spark, d).select(F.col("source").alias("project_id"), F.col("doc_id").alias("item_id"), "text")
    return items, _t(spark, d, "documents").select(F.col("source").alias("project_id"), "text")


def entity_overlaps(spark, d):
    """How many of the key entities of each contract text its project's documents have."""
    return guard.entity_overlap(*_pairs(spark, d)).select("project_id", "item_id", F.round("overlap", 6).alias("overlap"))


def fabrication_rates(spark, d):
    return guard.fabrication_rates(*_pairs(spark, d))


def overlap_stats(spark, d):
    """Mean and percentiles of the items' overlaps with their source."""
    items = _t(spark, d, "benchmark").select(F.lit("p").alias("project_id"), F.col("item_id"), "text")
    return evaluate.spread(guard.clause_overlap(items, _t(spark, d, "documents").select(F.lit("p").alias("project_id"), "text")), "overlap")


def training_split(spark, d):
    """Forty test rows, and 85 and 15 percent of the other documents whose text isn't among them."""
    return sampling.sample_and_split(_t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "part")


def analysis_costs(spark, d):
    """Estimated tokens and cost of analysing each project, a document a chunk."""
    chunks = _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunks"))
    return chunks.select("source", evaluate.analysis_cost(F.col("chunks")).alias("c")).select("source", "c.*")


def models_after_rollback(spark, d):
    """Suppliers as models, each trained from the one before: the state after the newest is activated and rolled back."""
    key = F.col("s_suppkey")
    models = _t(spark, d, "supplier").select(key.alias("model_id"), F.when(key == 1, "active").otherwise("ready").alias("status"), F.lit(None).cast("long").alias("previous_model_id"))
    newest = models.agg(F.max("model_id").alias("m")).first()["m"]
    return store.rollback_model(store.activate_model(models, newest)).groupBy("status").agg(F.count("*").alias("n"), F.min("model_id").alias("first"), F.count("previous_model_id").alias("with_previous"))


QUERIES = {f.__name__: f for f in (entity_overlaps, fabrication_rates, overlap_stats, training_split, analysis_costs, models_after_rollback, dense_index_topk, bm25_index_topk, points_after_changes, job_states_stream, dash_merged_totals, dash_merged_timeline, dash_overview, figures_after_ingests, chunk_conversations)}

_STEPS = "[" + ", ".join(f"'{s}'" for s in machine.STEPS) + "]"
_FIGURES = """count(*) as analyses, count(distinct project_id) as {}, round_even(avg(overall_risk_score), 1) as avg_risk,
      round_even(cast(sum(case when quality_score <> 0 then cast(quality_score as decimal(18, 6)) end) as double) / nullif(count(*) filter (where quality_score <> 0), 0) * 100, 1) as avg_quality, count(*) filter (where flagged) as flagged, count(*) filter (where overall_risk_score > 60) as high_risk"""

_PLAIN = "regexp_replace({}, '[^\\x00-\\x7F]', '_', 'g')"


def _facts(text: str) -> str:
    """The lower-cased facts of a text as SQL."""
    return "list_transform(list_distinct(flatten([" + ", ".join(f"regexp_extract_all({text}, {_s(p)})" for p in P.FACTS) + "])), lambda x: lower(x))"


def _named(text: str) -> str:
    """The distinct key entities of a text as SQL."""
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all({text}, {_s(p)}, {g})" for p, g in P.KEY_ENTITIES) + "]))"


SQL: dict[str, str] = {
    "entity_overlaps": f"""with {CONTRACT}, own as (select source as project_id, doc_id as item_id, unnest({_named(_PLAIN.format('text'))}) as entity from contracts),
      wanted as (select distinct project_id, lower(entity) as phrase from own),
      found as (select distinct project_id, phrase from wanted join documents on source = project_id and contains(lower(text), phrase))
      select own.project_id, item_id, round(count(found.phrase) / cast(count(*) as double), 6) as overlap from own left join found on found.project_id = own.project_id and found.phrase = lower(entity) group by all""",
    "fabrication_rates": f"""with {CONTRACT}, own as (select source as project_id, doc_id as item_id, list_distinct({_facts(_PLAIN.format('text'))}) as facts from contracts),
      stated as (select source as project_id, list_distinct(flatten(list({_facts(_PLAIN.format('text'))}))) as known from documents group by source),
      each as (select project_id, item_id, len(list_filter(facts, lambda x: not list_contains(known, x))) > 0 as bad from own join stated using (project_id))
      select project_id, count(*) as items, count(*) filter (where bad) as fabricating, round(count(*) filter (where bad) / cast(count(*) as double), 6) as rate from each group by project_id""",
    "overlap_stats": f"""with o as ({BASE['bigram_overlap']}), r as (select overlap as v, row_number() over (order by overlap) - 1 as i, count(*) over () as n from o)
      select round(avg(v), 6) as mean, """ + ", ".join(f"max(v) filter (where i = least(cast(trunc(n * cast({p} as double)) as bigint), n - 1)) as p{round(p * 100)}" for p in (0.25, 0.75, 0.95)) + " from r",
    "training_split": """with r as (select doc_id, text, row_number() over (order by sha256('42|' || coalesce(text, '')), doc_id) - 1 as p from documents), test as (select * from r where p < 40),
      rest as (select doc_id, row_number() over (order by p) - 1 as q, count(*) over () as n from r where p >= 40 and not exists (select 1 from test where test.text is not distinct from r.text))
      select doc_id, 'test' as part from test union all select doc_id, case when q < cast(trunc(n * cast(0.85 as double)) as bigint) then 'train' else 'val' end as part from rest""",
    "analysis_costs": """select source, count(*) * 1100 + 3500 as tokens_in, count(*) * 400 + 1400 as tokens_out, round((count(*) * 1100 + 3500) / 1e6 * 5 + (count(*) * 400 + 1400) / 1e6 * 15, 6) as cost
      from documents group by source""",
    "models_after_rollback": """select case when s_suppkey = 1 then 'active' else 'ready' end as status, count(*) as n, min(s_suppkey) as "first", 1 - max(cast(s_suppkey = 1 as integer)) as with_previous from supplier group by 1""",
    "bm25_index_topk": BASE["bm25_topk"],
    "points_after_changes": """select s_suppkey as id, s_nationkey as nation, case when s_suppkey % 3 = 0 then 0.0 else s_acctbal end as balance,
      array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(s_name), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}')))), ',') as words from supplier where s_nationkey <> 7""",
    "job_states_stream": f"""with e as (select user_id * 100 + day(ts) as job_id, event_id as seq, ts, case when event_id % 7 <> 0 then list_append({_STEPS}, 'Archiving')[cast(event_id % 6 as integer) + 1] end as step,
        case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status from events),
      jobs as (select job_id, arg_max(status, seq) filter (where step is null) as said, count(*) filter (where step = 'Archiving') as warnings, count(*) as seen, max(ts) as last from e group by job_id),
      ended as (select *, case when said in ('completed', 'failed') then said else 'running' end as job_status from jobs),
      held as (select job_id, step, arg_max(status, seq) as status from e where step is not null group by all),
      steps as (select unnest({_STEPS}) as step)
      select ended.job_id, steps.step, case when job_status = 'completed' and coalesce(status, 'pending') in ('pending', 'running') then 'completed' when job_status = 'failed' and status = 'running' then 'failed'
        else coalesce(status, 'pending') end as status, job_status, warnings, seen, job_status = 'running' and last + interval {int(machine.STUCK.total_seconds() // 3600)} hour <= (select max(ts) from e) - interval 1 day as stuck
      from ended cross join steps left join held on held.job_id = ended.job_id and held.step = steps.step""",
    "dash_merged_totals": BASE["dash_totals"],
    "dash_merged_timeline": BASE["dash_timeline"],
    "dash_overview": f"""with {DONE}, own as (select c_custkey as id, c_custkey % 7 as files from customer where c_mktsegment = 'BUILDING'),
      figures as (select {_FIGURES.format('analysed_projects')} from done where project_id in (select id from own) and cast(created_at as date) >= date '{NOW}' - 89)
      select figures.*, (select sum(files) from own) as documents, (select count(*) from own) as total_projects from figures""",
    "figures_after_ingests": f"""with {DONE} select {_FIGURES.format('projects')}, (select count(*) from analyses where project_id % 3 <> 0) as stored from done where project_id % 3 <> 0""",
}
