"""The pipeline's stages, each on what the one before kept, against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import brute_classes
from tests.llm.test_text_operators import brute_secrets, plain_cosines, plain_prototypes
from vellumspark.llm import langid


def test_stages(spark, odd, tmp_path):
    source = odd.select("doc_id", "text", "lang", "source", "n_chars")
    more = [(None, "a row without an id, token = abcdefgh", "en", "s0", 1), (None, "another row that no id names at all", None, "s1", 1),
            (3, "an id that another text has as well, and which must stay", "en", "s1", 1), (None, source.filter("doc_id = 4").first().text, "en", "s0", 1),
            (900, " ".join("жзщшцчфхъыьэюяздйлмнпрсту"[k % 11 : k % 11 + 3 + k % 7] for k in range(60)), None, "s0", 1), (901, "жзщ шцч", None, "s0", 1)]
    source = source.unionByName(spark.createDataFrame(more, source.schema))
    source.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == source.columns
    assert len(corpus_pipeline.STAGES) in (4, 5)

    learned = plain_prototypes([(r.text, r.lang) for r in source.collect()])
    first = {(r.doc_id, r.text) for r in kept["language_id"]}
    expected = set()
    for r in source.collect():
        if any(c.isalpha() for c in r.text or ""):
            cosines, n = ({}, 0) if len(r.text) > 100_000 else plain_cosines(r.text, learned)  # the very long one repeats a word of "en" rows
            if n < langid.LEAST_TRIGRAMS or max(cosines.values()) >= corpus_pipeline.LEAST_COSINE:
                expected.add((r.doc_id, r.text))
    assert first == expected and 900 not in {i for i, _ in first} and 901 in {i for i, _ in first}  # seven letters prove nothing

    # classes over rows: equal in id and text is one row, and null ids come last
    rows = sorted(first, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    classes = brute_classes([(k, t) for k, (_, t) in enumerate(rows)])
    heads = Counter(rows[k] for k, (_, c) in classes.items() if c == k)
    second = [r.doc_id for r in kept["jaccard_join"]]
    assert Counter((r.doc_id, r.text) for r in kept["jaccard_join"]) == heads
    assert (3, more[2][1]) in heads and second.count(None) == 2

    third = kept["secret_scan"]
    assert Counter(r.doc_id for r in third) == Counter(second)
    assert not any(brute_secrets(r.text) for r in third) and all(r.n_chars == len(r.text) for r in third)
    clean = {x for x in heads if not brute_secrets(x[1])}
    assert clean <= {(r.doc_id, r.text) for r in third}

    texts = {(r.doc_id, r.text) for r in third}
    fourth = Counter((r.doc_id, r.text) for r in kept["source_mixing"])
    assert max(fourth.values()) <= 3 and set(fourth) <= texts
    size = {x: len(re.findall(r"[^\x20\x09-\x0D]+", x[1])) for x in texts}
    source_of = {(r.doc_id, r.text): r.source for r in third}
    held, taken = Counter(), Counter()
    for x in texts:
        held[source_of[x]] += size[x]
        taken[source_of[x]] += size[x] * fourth[x]
    assert all(taken[x] <= 3 * held[x] for x in held)
    assert abs(sum(taken.values()) - sum(held.values())) <= max(size.values())  # a source misses its target by less than its largest document

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(model.encode(t, add_special_tokens=False).ids) + 1 for _, t in fourth.elements())
    assert sum(r.length for r in kept["best_fit_packing"]) == tokens
    fill = defaultdict(int)
    for r in kept["best_fit_packing"]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.2 * np.ceil(tokens / 1024) + 1


def test_stages_keep_columns_of_any_name(spark, odd, tmp_path):
    """Columns named like the stages' own, and one with a dot, come through with their values."""
    extra = [F.lit(k).alias(c) for k, c in enumerate(("__row_key", "__own", "__starts", "__ends", "__n", "__copies", "row", "key", "key2", "copies", "copy", "own", "blob", "starts", "found_id", "a.b"))]
    source = odd.filter("doc_id between 20 and 44").select("doc_id", "text", "lang", "source", "n_chars", *extra)
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == source.columns and docs.count() > 0
        assert [tuple(r) for r in docs.select(*[F.col(f"`{c}`") for c in source.columns[5:]]).distinct().collect()] == [tuple(range(16))]


def test_run_and_empty_tables(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id < 12").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    none = tmp_path / "none"
    odd.select("doc_id", "text", "lang", "source", "n_chars").filter("false").write.parquet(f"{none}/documents.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0
