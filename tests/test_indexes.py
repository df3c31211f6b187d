"""Kept indexes against exact searches."""

import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.operators import dense_index, folders, retrieval, sparse_index


@pytest.fixture()
def embedded(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def hits(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.qid, []).append((r.rank, r.id, r.score))
    return {q: sorted(rows) for q, rows in found.items()}


def recall(found, exact):
    return np.mean([len({i for _, i, _ in found.get(q, [])} & {i for _, i, _ in rows}) / len(rows) for q, rows in exact.items()])


def test_dense_index(spark, embedded, tmp_path):
    items, questions = embedded
    exact = hits(retrieval.dense_top(questions, items, 10, 6))
    early = items.filter("id % 3 <> 0")
    index = dense_index.DenseIndex.create(spark, f"{tmp_path}/dense", early)
    before = folders.read_text(spark, f"{tmp_path}/dense/model.json")
    index.add(items.filter("id % 3 = 0"))
    assert folders.read_text(spark, f"{tmp_path}/dense/model.json") == before  # no refit
    found = hits(dense_index.DenseIndex(spark, f"{tmp_path}/dense").search(questions, 10, 6))
    assert set(found) == set(exact) and recall(found, exact) >= 0.9
    for q, rows in found.items():
        assert rows[0][1:] == (q, 1.0) or rows[0][2] == 1.0  # itself, those added later too
        assert [r for r, _, _ in rows] == list(range(1, 11))
        scores = dict((i, s) for _, i, s in exact[q])
        assert all(abs(scores[i] - s) < 1e-5 for _, i, s in rows if i in scores)
    everything = hits(index.search(questions, 10, 6, pool=items.count(), probes=10**9))
    assert {q: [i for _, i, _ in rows] for q, rows in everything.items()} == {q: [i for _, i, _ in rows] for q, rows in exact.items()}


def test_only_visited_cells_are_read(spark, embedded, tmp_path):
    items, questions = embedded
    index = dense_index.DenseIndex.create(spark, f"{tmp_path}/dense", items)
    one = questions.limit(1)
    visited = {r.cell for r in index.visits(one, 2).collect()}
    plan = index.rows().filter(F.col("cell").isin(sorted(visited))).select("id", "code")._jdf.queryExecution().toString()
    assert len(visited) == 2 and "PartitionFilters: [cell" in plan and "unit" not in plan.split("ReadSchema")[-1]
    assert {r.cell for r in index.candidates(one, 5, 2).collect()} <= visited


def test_dense_index_of_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 12)))]
    odd = [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0]), (1004, [None] * 12)]
    items = spark.createDataFrame(rows + odd, "id long, vec array<double>")
    index = dense_index.DenseIndex.create(spark, f"{tmp_path}/dense", items)
    questions = spark.createDataFrame([(1, rows[5][1]), (2, None), (3, [0.0] * 12)], "qid long, qvec array<double>")
    found = hits(index.search(questions, 3))
    assert set(found) == {1} and found[1][0] == (1, 5, 1.0)
    assert index.rows().count() == 300
    with pytest.raises(ValueError):
        dense_index.DenseIndex.create(spark, f"{tmp_path}/none", items.filter("id >= 1000"))


def test_crowded_cells_are_read_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense_index, "BLOCK", 20)
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(8) + (rng.normal(0, 0.05, 8) if i > 400 else 0)).tolist()) for i in range(600)]  # most are one vector
    items = spark.createDataFrame(rows, "id long, vec array<double>")
    index = dense_index.DenseIndex.create(spark, f"{tmp_path}/dense", items)
    questions = spark.createDataFrame([(1, rows[0][1])], "qid long, qvec array<double>")
    assert [r.id for r in index.search(questions, 10, 6).orderBy("rank").collect()] == list(range(10))


@pytest.fixture()
def asked(spark, data):
    items = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return items, spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def test_sparse_index_equals_the_full_scan(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(sparse_index, "RANGE", 8)
    monkeypatch.setattr(sparse_index, "FIRST_POSTINGS", 40)
    items, questions = asked
    odd = spark.createDataFrame([(100_000, None), (100_001, "")], "id long, text string")
    items = items.unionByName(odd)
    index = sparse_index.SparseIndex.create(spark, f"{tmp_path}/sparse", items.filter("id % 4 <> 0"))
    index.add(items.filter("id % 4 = 0"))
    index.add(items.filter("false"))
    for k in (3, 10):
        passes = index.passes(questions, k, digits=4)
        assert hits(passes["hits"]) == hits(retrieval.bm25_top(questions, items, k, digits=4))
        assert passes["read"].count() < 0.8 * passes["asked"].count()  # the other blocks' postings stay unread but for items that can win
    unknown = spark.createDataFrame([(1, "zzzzqqq xxyyzz"), (2, None), (3, "")], "qid long, question string")
    assert index.search(unknown).count() == 0


def test_indexes_are_kept_and_read_no_text(spark, data):
    items = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    name = f"test-{uuid.uuid4().hex}"  # the session's shared folder outlives it
    first, second = (sparse_index.SparseIndex.kept(items, name) for _ in range(2))
    assert first.path == second.path and len(folders.names(spark, f"{first.path}/batches")) == 1
    plan = second.search(spark.createDataFrame([(1, "the")], "qid long, question string"))._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan
    folders.write_text(spark, f"{first.path}/blocks/batch=torn", "")  # a batch that isn't listed is never read
    assert second.blocks().count() == first.blocks().count()


def test_bm25_of_sent_questions_equals_the_join(spark, monkeypatch):
    """Few questions are scored within tasks, without a row for each question and item; ties, repeated words, texts without words and ids of strings included."""
    rng = random.Random(5)
    words = [a + b for a in ("lease", "term", "court", "law") for b in ("abc", "def", "ghi", "jkl", "mno")]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(120)] + ["leaseabc leaseabc", "leaseabc leaseabc", "", None, "12 ab"]
    items = spark.createDataFrame([(f"d{k:03}", t) for k, t in enumerate(texts)], "id string, text string").repartition(3)
    questions = spark.createDataFrame([(k, " ".join(rng.choices(words, k=3))) for k in range(7)] + [(7, "leaseabc unknown"), (8, "zzz"), (9, None)], "qid long, question string")
    found = []
    for cells, scores in ((retrieval.SENT_CELLS, retrieval.SCORE_CELLS), (retrieval.SENT_CELLS, 1), (0, 1)):
        monkeypatch.setattr(retrieval, "SENT_CELLS", cells)
        monkeypatch.setattr(retrieval, "SCORE_CELLS", scores)
        top = retrieval.bm25_top(questions, items, 3, digits=4)
        assert ("MapInArrow" in top._jdf.queryExecution().executedPlan().toString()) == (cells > 0)
        found.append({tuple(r) for r in top.select("qid", "id", "score", "rank").collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 24
    assert retrieval.bm25_top(questions.filter("qid = 9"), items, 3).count() == 0


def test_what_grows_with_the_index_is_not_broadcast(spark, tmp_path):
    """However small its tables look as Parquet, postings and their items are joined by merging."""
    items = spark.createDataFrame([(k, f"lease court {'abc' * (k % 3 + 1)}") for k in range(30)], "id long, text string")
    index = sparse_index.SparseIndex.create(spark, f"{tmp_path}/index", items)
    top = index.search(spark.createDataFrame([(1, "lease abc"), (2, "court")], "qid long, question string"), 3, digits=4)
    plan = top._jdf.queryExecution().executedPlan().toString()
    for keys in (r"term#\d+, range#\d+", r"term#\d+, range#\d+, id#\d+L"):
        assert re.search(rf"SortMergeJoin \[{keys}\]", plan) and not re.search(rf"BroadcastHashJoin \[{keys}\]", plan)
    assert top.count() == 6


def test_vectors_are_sent_once_to_a_pair_of_blocks(spark, monkeypatch):
    """Small blocks and parts of them find the pairs that all cosines give; ids of strings."""
    rng = random.Random(3)
    words = [a + b for a in "abcdefgh" for b in "pqrstuv"]
    texts = [rng.choices(words, k=30) for _ in range(12)]
    texts = [" ".join(t[: 30 - k]) for t in texts for k in range(5)]
    items = spark.createDataFrame([(f"d{k:02}", t) for k, t in enumerate(texts)], "id string, text string")
    rows = {r.rep: dict(zip(r.terms, r.weights)) for r in retrieval.tfidf_vectors(items).collect()}
    alike = {(a, b): round(sum(w * rows[b].get(t, 0.0) for t, w in rows[a].items()), 6) for a in rows for b in rows if a < b}
    wanted = {p: s for p, s in alike.items() if s >= 0.85}
    for block, pairs, at_once in ((16_384, 2_000_000, 4096), (7, 5, 2)):
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
        monkeypatch.setattr(retrieval, "VERIFY_PAIRS", pairs)
        monkeypatch.setattr(retrieval, "VERIFY_BLOCK", at_once)
        found = {(r.a, r.b): r.similarity for r in retrieval.tfidf_pairs(items, 0.85, 6).collect()}
        assert found.keys() == wanted.keys() and len(found) > 20
        assert all(abs(found[p] - s) < 2e-6 for p, s in wanted.items())


def test_similar_vectors_move_neither_candidates_nor_vectors(spark, monkeypatch):
    """Blocks are read from their files by every task; terms of one item aren't kept; rows of one id are one item; copies are left to their representative."""
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 4)
    monkeypatch.setattr(retrieval, "MET_CELLS", 6)
    texts = ["a court heard the lease dispute today", "a court heard the lease dispute today", "a court heard the lease dispute then", "quite other words stand here alone", "", None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10 + k, f"only{k} word{k} in{k} this{k}") for k in range(9)] + [(30, "a court heard the"), (30, "lease dispute today")]
    items = spark.createDataFrame(rows, "id long, text string")
    packed = retrieval.packed_vectors(items)
    assert {(r.rep, r.id) for r in packed.members.collect() if r.rep != r.id} == {(0, 1), (0, 30)}
    found = retrieval.similar_vectors(packed, 0.7, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert [(r.a, r.b) for r in found.collect()] == [(0, 2)]
    vectors = {r.rep: r.terms for r in retrieval.tfidf_vectors(items).collect()}
    assert len(vectors[0]) == 6 and len(vectors[2]) == 5 and not vectors[3] and not any(vectors[10 + k] for k in range(9)) and 4 not in vectors


def test_outlines_leave_few_pairs_to_multiply(spark, monkeypatch):
    """Long texts of the same common words are told apart by short outlines of any length and in any chunks; no pair is lost."""
    rng = random.Random(5)
    words = [a + b + c for a in "abcdefgh" for b in "pqrstuv" for c in "klmnoijxyz"]
    texts = [rng.choices(words, [1 / (k + 20) for k in range(len(words))], k=rng.choice((40, 150, 700, 1500))) for _ in range(150)]
    texts += [t[: len(t) - len(t) // 10] for t in texts[:20]]
    packed = retrieval.packed_vectors(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string"))
    table = packed.blocks.toArrow()
    block = retrieval._Block({c: table.column(c)[0] for c in table.schema.names}, packed.frequencies)
    assert table.num_rows == 1 and block.n == len(texts) and (np.diff(block.sizes) >= 0).all()
    whole = np.zeros((block.n, packed.frequencies.terms))
    whole[np.repeat(np.arange(block.n), block.sizes), block.numbers] = block.weights
    alike = {(a, b) for a, b in np.argwhere(np.triu(whole @ whole.T, 1) >= 0.85).tolist()}
    assert len(alike) >= 20
    for shortest, longest, cells in ((128, 8192, 2_000_000), (4, 64, 700), (1, 8, 1)):
        monkeypatch.setattr(retrieval, "OUTLINE", shortest)
        monkeypatch.setattr(retrieval, "LONGEST_OUTLINE", longest)
        monkeypatch.setattr(retrieval, "MET_CELLS", cells)
        met = [(int(min(p)), int(max(p))) for a, b in retrieval._candidates(block, block, 0.85) for p in zip(a, b) if p[0] != p[1]]
        apart = [(int(p), int(q)) for a, b in retrieval._candidates(block, retrieval._Block({c: table.column(c)[0] for c in table.schema.names}, packed.frequencies), 0.85) for p, q in zip(a, b)]
        assert len(apart) == len(set(apart)) and {(min(p), max(p)) for p in apart if p[0] != p[1]} == set(met) >= alike
        if cells > 700:
            assert len(set(met)) < 1.5 * len(alike)  # keys of the rarest terms let 11,427 of 14,365 pass
    found = {(r.a, r.b) for r in retrieval.similar_vectors(packed, 0.85).collect()}
    reps = table.column("reps")[0].as_py()
    assert found == {(min(reps[a], reps[b]), max(reps[a], reps[b])) for a, b in alike}


def test_every_two_blocks_meet_once_and_evenly(spark):
    p, q = (spark.range(9).withColumnRenamed("id", c) for c in "pq")
    met = [(r.p, r.q) for r in p.crossJoin(q).filter(retrieval._once(F.col("p"), F.col("q"))).collect()]
    assert sorted((min(m), max(m)) for m in met) == [(a, b) for a in range(9) for b in range(a, 9)]
    assert {sum(m[0] == k for m in met) for k in range(9)} == {5}  # p <= q gave 1 to 9


def test_similar_vectors_without_common_terms(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, ""), (4, None)], "id long, text string")
    for some in (items, items.limit(0)):
        assert retrieval.tfidf_pairs(some).count() == 0
        assert all(r.kept for r in retrieval.near_duplicates_removed(some.withColumn("gold", F.lit(False))).collect())


def test_parts_send_on_the_best_of_all_their_cells(spark, embedded, tmp_path, monkeypatch):
    """What is ranked is a question's best of each part, in tasks whose number grows with it; small parts and steps change nothing."""
    items, questions = embedded
    index = dense_index.DenseIndex.create(spark, f"{tmp_path}/dense", items)
    found = []
    for parts, cells, ranked in ((1, 8_000_000, 500_000), (5, 300, 40)):
        monkeypatch.setattr(dense_index, "PARTS", parts)
        monkeypatch.setattr(dense_index, "SCORE_CELLS", cells)
        monkeypatch.setattr(dense_index, "RANKED", ranked)
        top = index.candidates(questions, 12)
        assert "salt" not in top._jdf.queryExecution().executedPlan().toString()
        assert top.rdd.getNumPartitions() == max(parts, -(-questions.count() * parts * 12 // ranked))
        found.append(sorted((r.qid, r.id, round(r.score, 9)) for r in top.collect()))
    assert found[0] == found[1] and len(found[0]) == 12 * questions.count()
