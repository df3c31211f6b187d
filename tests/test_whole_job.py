"""Queries over whole tables and whole texts, against SQL that must not cut them."""

import pytest

from tests.test_queries import TABLES, duck, table_of  # noqa: F401
from vellumspark.operators import retrieval
from vellumspark.plans.oracle import SQL
from vellumspark.plans.queries import QUERIES


def uncut(name, *cuts):
    """The query's SQL, which must hold none of the cuts."""
    assert not any(cut in SQL[name] for cut, _ in cuts)
    return SQL[name]


def same(spark, duck, data, name, *cuts):  # noqa: F811
    frame, answer = QUERIES[name](spark, data), duck.sql(uncut(name, *cuts))
    rows = frame.collect()
    assert table_of(frame.columns, rows) == table_of(answer.columns, answer.fetchall())
    return rows


SEARCHED = ("where q.vec_id < 5", "where q.vec_id % 50 = 0")


@pytest.mark.parametrize("name", ["dense_topk", "threshold_top1", "rank_norm", "page_priority", "knn_labels"])
def test_every_search_is_answered(spark, duck, data, name):  # noqa: F811
    rows = same(spark, duck, data, name, SEARCHED)
    assert {r.qid for r in rows} == {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}


def test_dense_blocks(spark, duck, data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 60)
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 4)
    same(spark, duck, data, "dense_topk", SEARCHED)


def test_dense_vectors_without_a_score(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [3.0, 4.0])], "id long, vec array<float>")
    found = retrieval.dense_top(spark.createDataFrame([(7, [2.0, 0.0])], "qid long, qvec array<float>"), items, 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [(1, 1.0), (5, 0.6), (2, None), (3, None), (4, None)]
    assert retrieval.dense_top(spark.createDataFrame([(7, None)], "qid long, qvec array<float>"), items.limit(0), 5).count() == 0


@pytest.mark.parametrize("name", ["eval_rollup", "eval_breakdown", "metric_regressions", "quality_gate"])
def test_rollups_take_every_order(spark, duck, data, name):  # noqa: F811
    rows = same(spark, duck, data, name, *((f" where (o_orderkey + {s}) % 9 <> 0", "") for s in (0, 1)))
    if name == "eval_rollup":
        assert rows[0].total == spark.read.parquet(f"{data}/orders.parquet").count()


ASKED = ("substring(text, 1, 120) as text from benchmark where item_id < 12", "text from benchmark")


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_topk", "rerank_overlap"])
def test_every_item_asks_its_whole_text(spark, duck, data, name):  # noqa: F811
    rows = same(spark, duck, data, name, ASKED, SEARCHED)
    assert {r.qid for r in rows} >= {r.item_id for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}


@pytest.mark.parametrize("name, cuts", [
    ("governing_laws", [("substring(text, 1, 200) as x", "text as x")]), ("indemnity_sides", [("substring(text, 1, 200) as i", "text as i")]),
    ("question_types", [("substring(text, 1, 110)", "text")])])
def test_extractors_read_whole_texts(spark, duck, data, name, cuts):  # noqa: F811
    same(spark, duck, data, name, *cuts)


def test_extractors_find_what_stands_late(spark, tmp_path):
    late = "word " * 100 + ("This is governed by the laws of the State of Ohio. Beta Company shall indemnify Gamma. Is the premium for insurance due? "
                            "The ACME Holdings paid $5,000 on 2024.")
    spark.createDataFrame([(16, "Alpha Company shall indemnify Beta. " + late, "en", "s0"), (6, late, "en", "s1"), (33, "word " * 100 + "is insurance due?", "en", "s1")], "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    row = lambda name: {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert "Ohio" in row("governing_laws")[6].law
    assert not row("indemnity_sides")[16].one_sided and "Beta Company" in row("indemnity_sides")[6].obligors
    assert "insurance" in {r.clause_type for r in QUERIES["question_types"](spark, str(tmp_path)).collect()}
    assert row("entity_counts")[6].key > 0 and row("entity_counts")[6].factual > 0


WHOLE_CLAUSE = ("substring(text, 1, 200) as text from typed", "text from typed")


@pytest.mark.parametrize("name", ["clause_dedupe", "rule_scores", "rule_risks", "risk_features"])
def test_risks_read_whole_clauses(spark, duck, data, name):  # noqa: F811
    same(spark, duck, data, name, WHOLE_CLAUSE)


def test_contexts_hold_whole_chunks(spark, duck, data):  # noqa: F811
    same(spark, duck, data, "contexts", ("substring(text, 1, 60) as block", "text as block"), SEARCHED)


def test_longest_clause_is_kept(spark, tmp_path):
    cap = " word" * 100 + " The aggregate liability shall not exceed $5,000."
    rows = [(0, "x" * 300, "en", "s0"), (119, "x" * 300 + cap, "en", "s0")]  # both liability clauses of one project
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = QUERIES["clause_dedupe"](spark, str(tmp_path)).filter("clause_type = 'liability'").collect()
    assert [r.pos for r in kept] == [119]
