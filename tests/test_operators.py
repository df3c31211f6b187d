"""Operators on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import chunking, dashboard, evaluate, guard, retrieval, risk, store
from vellumspark.sources import readers, writers
from vellumspark.streaming import jobs


def test_split_text():
    assert chunking.split_text("A" * 2000, 512) == ["A" * 512] * 3 + ["A" * 464]
    pieces = chunking.split_text("word " * 200, 100)
    assert all(len(p) <= 100 for p in pieces) and " ".join(" ".join(pieces).split()) == " ".join(["word"] * 200)
    assert chunking.split_text("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"]
    assert chunking.split_text("x" * 50 + " " + "y" * 3000, 1024)[1:] == ["y" * 1024, "y" * 1024, "y" * 952]


def test_chunks_of_single_pages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.lit(1).alias("page_number"), "text")
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    assert rows(chunking.chunk_single_pages(docs)) == rows(chunking.chunk_pages(docs)) and chunking.chunk_single_pages(docs.filter("false")).count() == 0


def test_chunk_pages(spark):
    pages = [("d", 1, "alpha beta. " * 200), ("d", 2, "   "), ("d", 3, "gamma."), ("e", 1, "")]
    rows = chunking.chunk_pages(spark.createDataFrame(pages, "doc_id string, page_number int, text string")).orderBy("chunk_index").collect()
    assert {r.doc_id for r in rows} == {"d"} and [r.chunk_index for r in rows] == list(range(len(rows)))
    expected = list(chunking.chunk_document([(1, pages[0][2]), (2, pages[1][2]), (3, pages[2][2])]))
    assert [(r.page_number, r.text) for r in rows] == expected
    assert rows[-1].text.endswith("gamma.") and rows[-1].page_number == 1  # mostly the tail of page 1


def test_tables_and_merge(spark):
    row = spark.range(1).select(chunking.row_sentence(F.array(F.lit("A"), F.lit("")), F.array(F.lit("1"), F.lit("2"))), chunking.table_markdown(F.array(F.array(F.lit("h"), F.lit("k")), F.array(F.lit("1"), F.lit(None).cast("string")))),
                                chunking.table_html(F.array(F.array(F.lit("x")))), chunking.file_kind(F.lit("/a/b.DOCX"))).first()
    assert tuple(row) == ("A: 1 | Column 2: 2", "| h | k |\n| --- | --- |\n| 1 |  |", "<table><tr><td>x</td></tr></table>", "docx")
    text = spark.createDataFrame([("d", 0, 1, "t0"), ("d", 1, 2, "t1")], "doc_id string, chunk_index int, page_number int, text string")
    other = spark.createDataFrame([("d", 1, 0, "tab")], "doc_id string, page_number int, pos int, text string")
    merged = chunking.merge_chunks(text, other, other.withColumn("text", F.lit("img"))).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.text) for r in merged] == [(0, "t0"), (1, "t1"), (2, "tab"), (3, "img")]


def test_images(spark):
    images = [(0, b"x" * 6000, "jpg", 200, 200), (1, b"x" * 100, "png", 200, 200), (2, b"x" * 6000, "gif", 200, 200), (3, b"x" * 6000, "png", 50, 200)]
    pages = spark.createDataFrame([("d", 1, images)], "doc_id string, page_number int, images array<struct<img_index:int,image_bytes:binary,image_ext:string,width:int,height:int>>")
    assert [(r.img_index, r.image_ext) for r in chunking.usable_images(pages).collect()] == [(0, "jpeg")]


def test_threshold_and_pages(spark):
    ranked = spark.createDataFrame([(1, 1, 0.8, 1, 3), (1, 2, 0.3, 2, None), (2, 3, 0.2, 1, 1), (2, 4, 0.1, 2, 2), (3, 5, None, 1, 1)], "qid int, id int, score double, rank int, page_number int")
    assert sorted(r.id for r in retrieval.threshold(ranked, 0.5).collect()) == [1, 3, 5]
    placed = {r.id: r.place for r in retrieval.page_priority(ranked, F.lit(2)).collect()}
    assert placed[4] == 1 and placed[3] == 2 and placed[1] == 1 and placed[2] == 2


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "qid int, id int, rank int")
    got = [(r.id, r.score) for r in retrieval.fuse(a, b).orderBy("rank").collect()]
    assert got == [(11, round(1 / 62 + 1 / 61, 9)), (10, round(1 / 61, 9)), (12, round(1 / 62, 9))]
    assert sorted(got) == sorted((r.id, r.score) for r in retrieval.fuse(b, a).collect())


def test_tfidf_pairs_by_brute_force(spark, data):
    import math
    import re
    from collections import Counter

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 90").collect()]
    tf = {i: Counter(re.findall(r"[^\W]{2,}", t.lower())) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    vec = {i: {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in c.items()} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    expected = {(a, b) for a in vec for b in vec if a < b and sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) >= 0.85 * norm[a] * norm[b]}
    found = {(r.a, r.b) for r in retrieval.tfidf_pairs(spark.createDataFrame(docs, "id long, text string")).collect()}
    rep = {i: min(j for j, c in tf.items() if c == tf[i]) for i in tf}  # copies are paired with their representative only
    assert found == {(a, b) for a, b in expected if rep[a] == a and rep[b] in (a, b)} and expected


def test_near_duplicate_removal_keeps_gold_else_the_earlier(spark):
    base = "the party shall pay all fees within thirty days of the invoice date without any delay"
    rows = [(1, base, False), (2, base + " now", False), (3, base + " now", True), (4, "an entirely different text of other words", False), (5, base + " now", True), (6, "", False), (7, None, False)]
    found = {r.id: r.kept for r in retrieval.near_duplicates_removed(spark.createDataFrame(rows, "id long, text string, gold boolean")).collect()}
    assert found == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}


def test_search_falls_back_to_meaning(spark):
    dense = spark.createDataFrame([(q, i, 1.0 - i / 10, i) for q in (1, 2, 3) for i in range(1, 4)], "qid long, id long, score double, rank int")
    sparse = spark.createDataFrame([(1, 3, 5.0, 1), (3, 2, 4.0, 1)], "qid long, id long, score double, rank int")
    modes = spark.createDataFrame([(1, "hybrid"), (2, "hybrid"), (3, "other")], "qid long, mode string")
    assert {r.qid: r["mode"] for r in retrieval.search(modes, dense, sparse, 2).collect()} == {1: "hybrid", 2: "semantic", 3: "semantic"}
    assert {r["mode"] for r in retrieval.search(modes, dense, None).collect()} == {"semantic"}
    with pytest.raises(ValueError, match="content type"):
        retrieval.filtered(dense, content_type="audio")


def test_summaries_are_held_against_words_of_the_source(spark):
    summaries = spark.createDataFrame([(1, "Acme Holdings shall pay the whole fee."), (1, "Zeta Corp must deliver goods at once."), (2, "nothing here")], "project_id long, text string")
    sources = spark.createDataFrame([(1, "ACME pays."), (1, "zeta")], "project_id long, text string")
    found = {r.project_id: (r.hallucinations, r.confidence) for r in guard.validate_summaries(summaries, sources).collect()}
    assert found == {1: (2, 0.7), 2: (0, 1.0)}  # a phrase of two words is no word of the source


def test_probe_evidence_without_passages(spark):
    hits = spark.createDataFrame([("p", "financial", 0, 1, " a cap "), ("p", "compliance", 1, 1, "a cap"), ("p", "compliance", 1, 2, "other"), ("q", "financial", 0, 1, None)], "project_id string, probe string, probe_place int, place int, text string")
    found = {r.project_id: r.evidence for r in retrieval.probe_evidence(hits).collect()}
    assert found == {"p": "[FINANCIAL]\na cap\n\n---\n\n[COMPLIANCE]\nother", "q": "(retrieval returned no passages)"}


def test_chat_pairs_and_cache_rows(spark):
    rows = spark.createDataFrame([(1, 5, "Which law?", "Ohio", None, 3), (1, 6, " which LAW? ", "Utah", None, 3)], "project_id long, at long, question string, answer string, k int, documents int")
    assert [(r.turn, r.role, r.text) for r in store.chat_pair(rows.limit(1)).orderBy("turn").collect()] == [(0, "user", "Which law?"), (1, "assistant", "Ohio")]
    fresh = store.cache_rows(rows)
    assert [r.answer for r in fresh.collect()] == ["Utah"] and store.cache_rows(rows, fresh).count() == 0


def clauses(spark, *rows):
    return spark.createDataFrame([("p", i, k, "t", x) for i, (k, x) in enumerate(rows)], "project_id string, pos int, clause_type string, title string, text string")


def test_rules_and_scores(spark):
    meta = spark.createDataFrame([("p", "SaaS agreement", None)], "project_id string, contract_type string, expiration_date string")
    c = clauses(spark, ("liability", "Provider is liable."), ("auto_renewal", "This automatically renews with 10 days notice."), ("indemnification", "Provider shall indemnify Customer."))
    found = risk.rule_risks(c, meta).collect()
    assert [r.title for r in found] == ["Missing confidentiality clause", "Missing termination clause", "Missing governing law clause", "Missing dispute resolution clause",
                                        "Missing Intellectual Property ownership clause", "Missing Payment terms clause", "No expiration date or termination clause",
                                        "Auto-renewal without adequate opt-out notice", "Uncapped liability", "One-sided indemnification obligation"]
    rules = risk.rule_score(c, meta)
    assert rules.first().rule_score == 4 * 16 + 10 + 20
    one = risk.score(rules, risk.rule_risks(c, meta)).first()
    assert (one.overall_score, one.risk_level, one.model_score, one.high_count) == (94, "critical", 0, 5)


@pytest.mark.parametrize("severities,rule,expected", [(["low"], 0, 10), (["high", "high"], 0, 76), (["critical", "high", "high"], 0, 91), (["medium"], 50, 50), ([], 0, 0)])
def test_score_floors(spark, severities, rule, expected):
    risks = spark.createDataFrame([("p", i, "model", "x", s, f"t{i}", 0.5) for i, s in enumerate(severities)], "project_id string, pos int, origin string, category string, severity string, title string, confidence double")
    rules = spark.createDataFrame([("p", rule)], "project_id string, rule_score int")
    assert risk.score(rules, risks).first().overall_score == expected


def test_dedupes(spark):
    c = clauses(spark, ("payment", "short"), ("payment", "the longer one"), ("payment", "the longer two"), ("other", "a"), ("other", "b"))
    assert sorted(r.pos for r in risk.dedupe_clauses(c).collect()) == [1, 3]
    long = "x" * 45
    risks = spark.createDataFrame([("p", 0, long + "1"), ("p", 1, long + "2"), ("p", 2, "Short"), ("p", 3, " short ")], "project_id string, pos int, title string")
    kept = risk.dedupe_risks(risks)
    assert [r.pos for r in kept.orderBy("pos").collect()] == [0, 2]
    assert risk.dedupe_risks(kept).count() == 2


def test_verdicts(spark):
    risks = spark.createDataFrame([("a", "high"), ("b", "critical"), ("c", "low"), ("d", "high")], "title string, severity string")
    verdicts = spark.createDataFrame([(0, "a", "keep"), (1, "a", "drop"), (0, "b", "downgrade"), (0, "c", "drop")], "pos int, title string, verdict string")
    assert {(r.title, r.severity) for r in risk.apply_verdicts(risks, verdicts).collect()} == {("b", "high"), ("c", "low"), ("d", "high")}


def test_guard(spark):
    items = spark.createDataFrame([("p", 1, "the payment falls due monthly"), ("p", 2, "unrelated words entirely here"), ("p", 3, "you hereby waive all your rights")], "project_id string, item_id int, text string")
    source = spark.createDataFrame([("p", "The payment falls due monthly. Acme Holdings paid $500 on 2024-01-02.")], "project_id string, text string")
    assert {r.item_id: r.overlap for r in guard.clause_overlap(items, source).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    row = guard.validate_clauses(items, source).first()
    assert (row.hallucinations, row.unsafe, row.confidence, row.passed) == (2, 1, 0.6, False)
    facts = spark.createDataFrame([("p", 1, "Acme Holdings paid $500 not $900")], "project_id string, item_id int, text string")
    assert guard.fabricated_entities(facts, source).first().fabricated == 1
    assert guard.fabricated_entities(facts, source, strict=True).first().fabricated == 2
    assert guard.entity_overlap(facts, source).first().overlap == 1.0


def test_evaluate(spark):
    p = spark.createDataFrame([("a",), ("a",), ("b",)], "type string")
    t = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "type string")
    row = evaluate.micro(evaluate.per_type(p, t)).first()
    assert (row.precision, row.recall) == (round(2 / 3, 6), 0.5)
    values = spark.createDataFrame([(i,) for i in range(1, 21)], "v int")
    assert tuple(evaluate.spread(values, "v").first()) == (10.5, 6, 16, 20)
    s = spark.createDataFrame([(0.7, 0.5, 0.9, 0.8, 0.9, 0)], "clause_f1 double, clause_recall double, clause_precision double, judge double, pass_rate double, hallucinations int")
    assert evaluate.gate(s).first().failures == ["clause_recall"]


def test_store(spark):
    projects = spark.createDataFrame([(1, "My Deal", 1), (2, "my deal!", 2), (3, "Other", 3)], "id int, name string, created_at int")
    assert {r.id: r.collection_name for r in store.unique_names(projects).collect()} == {1: "my-deal", 2: "my-deal-1", 3: "other"}
    models = spark.createDataFrame([("a", "active", None), ("b", "ready", None)], "model_id string, status string, previous_model_id string")
    assert {r.model_id: (r.status, r.previous_model_id) for r in store.activate_model(models, "b").collect()} == {"a": ("inactive", None), "b": ("active", "a")}
    parts = store.hash_split(spark.range(4000), "id", {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("part").count().collect()
    assert {r.part: round(r["count"] / 4000, 1) for r in parts} == {"train": 0.8, "val": 0.1, "test": 0.1}
    events = spark.createDataFrame([("p", 1, "c", None), ("p", 2, None, "r")], "project_id string, seq int, clauses string, risk string")
    assert tuple(store.progressive(events, ["clauses", "risk"]).first()) == ("p", "c", "r")


def test_jobs(spark):
    events = spark.createDataFrame([("j", 1, "parse", "running"), ("j", 2, "embed", "pending"), ("j", 3, None, "completed"), ("k", 1, "parse", "running"), ("k", 2, "embed", "pending"), ("k", 3, None, "failed")],
                                   "job_id string, seq int, step string, status string")
    got = {(r.job_id, r.step): r.status for r in jobs.job_states(events).collect()}
    assert got == {("j", "parse"): "completed", ("j", "embed"): "completed", ("k", "parse"): "failed", ("k", "embed"): "pending"}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"messages": [{"role": "user", "content": "x"}]}\nnot json\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases/one.json").write_text('[{"case_id": "1"}, {"case_id": "2"}]')
    (tmp_path / "cases/two.json").write_text('{"case_id": "3"}')
    assert sorted(r.case_id for r in readers.eval_cases(spark, str(tmp_path / "cases")).collect()) == ["1", "2", "3"]
    (tmp_path / "cuad.json").write_text('{"data": [{"title": "T", "paragraphs": [{"context": "c", "qas": [{"id": "q", "question": "Any cap on liability?", "answers": [{"text": "a", "answer_start": 0}]}]}]}]}')
    assert readers.annotated_contracts(spark, str(tmp_path / "cuad.json")).first().clause_type == "liability"
    assert {r.name for r in readers.listing(spark, str(tmp_path)).collect()} >= {"a.jsonl", "one.json"}
    points = spark.createDataFrame([("c1", 1, "f"), ("c2", 2, "f")], "collection_name string, x int, source_file string")
    root = str(tmp_path / "points")
    writers.replace_collection(points, root)
    writers.replace_collection(points.filter("x = 1").withColumn("x", F.lit(9)), root)
    assert sorted((r.x, r.collection_name) for r in spark.read.parquet(root).collect()) == [(2, "c2"), (9, "c1")]
    assert readers.collection(spark, root, "c2").count() == 1
    line = spark.createDataFrame([('say "hi", now', None, 3)], "a string, b string, c int").select(writers.csv_line(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert line == '"say ""hi"", now",,3'
    assert "| a |" in writers.markdown_table(spark.range(1).select(F.lit("a").alias("h")))


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    source = str(tmp_path / "in")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
    stream = jobs.daily_counts(jobs.read_events(spark, source))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, jobs.daily_counts(events).collect()))


def test_dashboard_windows(spark):
    rows = [(i, i % 2, "completed", d, 40, 0.5 if i else 0.0, False) for i, d in enumerate(["2024-01-10", "2024-01-09", "2024-01-02", "2023-12-01"])]
    a = spark.createDataFrame(rows, "id int, project_id int, status string, created_at string, overall_risk_score int, quality_score double, flagged boolean").withColumn("created_at", F.to_timestamp("created_at"))
    row = dashboard.trends(a, F.lit("2024-01-10").cast("date")).first()
    assert (row.this_n, row.last_n, row.n_change) == (2, 1, 100.0)
    assert dashboard.timeline(a, F.lit("2024-01-10").cast("date"), 14).count() == 14
    assert dashboard.totals(a).first().avg_quality == 50.0


def docx(paragraphs, tables=()):
    import io
    import zipfile

    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:p><w:r><w:t>{t[:3]}</w:t></w:r><w:r><w:t xml:space='preserve'>{t[3:]}</w:t></w:r></w:p>" for t in paragraphs)
    body += "".join("<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx_pages(spark, tmp_path):
    from vellumspark.sources import documents

    table = [["H", "V"], ["a", "1"]]
    made = {"long.docx": docx([f"par {i}" if i % 10 else "  " for i in range(100)], [table] * 5), "empty.docx": docx([]), "tables.docx": docx([], [table]), "broken.docx": b"no zip"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    found = {(r.doc_id, r.page_number): r for r in documents.docx_pages(readers.files(spark, str(tmp_path))).collect()}
    assert sorted(found) == [("broken.docx", 1), ("empty.docx", 1), ("long.docx", 1), ("long.docx", 2), ("long.docx", 3), ("tables.docx", 1)]
    assert [len(found["long.docx", k].text.split("\n")) for k in (1, 2, 3)] == [40, 40, 10] and found["long.docx", 1].text.startswith("par 1\npar 2")
    assert [len(found["long.docx", k].tables) for k in (1, 2, 3)] == [1, 1, 3]  # five tables over three pages: one each, what is left on the last
    assert found["tables.docx", 1].tables[0].html.startswith("<table><tr><td>H") and found["empty.docx", 1].text == "" and found["broken.docx", 1].error


def test_retry_failover_and_skips(spark):
    from vellumspark.functions import models

    pauses, answers = [], iter([TimeoutError(), TimeoutError(), "third"])

    def call(x):
        out = next(answers)
        if isinstance(out, Exception):
            raise out
        return out + x

    assert models.with_retry(call, (TimeoutError,), pause=pauses.append)("!") == "third!" and pauses == [1, 2]

    def down(x):
        raise TimeoutError

    with pytest.raises(TimeoutError):
        models.with_retry(down, (TimeoutError,), pause=pauses.append)("!")
    assert models.with_failover([down, lambda x: x * 2], (TimeoutError,))("a") == "aa"
    rows = spark.createDataFrame([(" skip ", "the cat sat", "the cat sat down"), ("A chart.", "unrelated words", "nothing of the kind")], "d string, answer string, source string")
    found = rows.select(models.described(F.col("d")).alias("d"), models.default_judgement(F.col("answer"), F.col("source")).alias("j")).collect()
    assert [r.d for r in found] == [None, "A chart."] and [r.j.grounded for r in found] == [True, False]


def test_files_in_order(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{1 - k}.jsonl").write_text(f'{{"messages": [], "metadata": {{"n": "{k}"}}}}\n')
    found = readers.json_lines_in_order(spark, [str(tmp_path / "1.jsonl"), str(tmp_path / "0.jsonl")]).orderBy("source_no").collect()
    assert [(r.source_no, r.metadata["n"]) for r in found] == [(0, "0"), (1, "1")]


def test_chunks_are_sent_on_in_bounded_steps(spark, monkeypatch):
    """However few characters a task splits at once, a text's chunks keep their places; nulls and blank texts give none."""
    rows = [(1, "one. two"), (2, None), (3, " "), (4, "x" * 2500), (5, "five"), (6, "six words stand here")]
    docs = spark.createDataFrame([(k, 7, t) for k, t in rows], "doc_id long, page_number int, text string").coalesce(1)
    found = []
    for chars in (1, 20, 1 << 22):
        monkeypatch.setattr(chunking, "SPLIT_CHARS", chars)
        chunks = chunking.chunk_single_pages(docs)
        assert "ArrowEvalPython" not in chunks._jdf.queryExecution().executedPlan().toString()
        found.append([tuple(r) for r in chunks.collect()])
    assert found[0] == found[1] == found[2] and [(d, i, p, len(t)) for d, i, p, t in found[0]] == [("1", 0, 7, 8), ("4", 0, 7, 1024), ("4", 1, 7, 1024), ("4", 2, 7, 452), ("5", 0, 7, 4), ("6", 0, 7, 20)]


def test_values_of_a_spread_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    values = spark.createDataFrame([(i,) for i in range(1, 21)], "v int").mapInArrow(run, "v int")
    assert tuple(evaluate.spread(values, "v").first()) == (10.5, 6, 16, 20) and seen.value == 20
