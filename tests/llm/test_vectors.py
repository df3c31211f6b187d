"""Whitening and vector codes against plain integer loops; sentence pieces against the library."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from vellumspark.llm import codes, integers, pieces, registry, whitening
from vellumspark.llm.common import Scratch, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "vec_id long, embedding array<float>, label int, vec string, x int, own string, moved int, same int, component int"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows):
    """A table with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, v, label, "v", 1, "o", 2, 3, 4) for i, v, label in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (90, 24)) @ np.diag(np.geomspace(3, 0.01, 24)) + 7
    rows = [(i, v.astype(np.float32).tolist(), None if i % 6 == 0 else i % 3) for i, v in enumerate(base)]
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 0), (201, rows[3][1], 0), (None, rows[8][1], 2), (None, rows[9][1], None)]  # copies, repeated rows, null ids
    rows += [(300, None, 1), (301, [NAN] + [0.0] * 23, 1), (302, [INF] + [0.0] * 23, 1), (303, [None] + [0.0] * 23, 1), (304, [1.0] * 5, 1), (305, [], 1)]
    return rows


def usable(rows):
    whole = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = Counter(len(v) for _, v, _ in whole)
    length = min(n, key=lambda k: (-n[k], k))
    return [r for r in whole if len(r[1]) == length]


def plain_whitening(rows, k=4):
    ints = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    fit = sorted(set(map(tuple, ints)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(n * x - s, n) for x, s in zip(row, sums)] for row in fit]
    cov = [[sum(r[i] * r[j] for r in centred) / n for j in range(len(sums))] for i in range(len(sums))]
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    trace = float(sum(cov[i][i] for i in range(len(sums))))
    out = []
    for (i, _, _), row in zip(rows, ints):
        dev = sum((n * x - s) ** 2 for x, s in zip(row, sums))
        w = [float(sum((x - s / n) * u for x, s, u in zip(row, sums, vectors[:, -c]))) / math.sqrt(values[-c]) for c in range(1, k + 1)]
        out.append((i, n, dev, w, [values[-c] / trace for c in range(1, k + 1)]))
    return out


def by_row(found, k=4):
    groups = defaultdict(list)
    for r in found:
        groups[r.vec_id, r.deviation, r.component].append(r)
    return groups


def test_whitening_of_odd_rows(spark, odd_rows):
    found = whitening.whiten(vectors_of(spark, odd_rows)).collect()
    wanted = plain_whitening(usable(odd_rows))
    assert len(found) == 4 * len(wanted)
    groups = by_row(found)
    signs = {}
    for i, n, dev, w, explained in wanted:
        for c in range(1, 5):
            r = groups[i, dev, c][0]
            sign = signs.setdefault(c, math.copysign(1, r.whitened * w[c - 1]))
            assert r.n == n and r.whitened == pytest.approx(sign * w[c - 1], rel=1e-9, abs=1e-9) and r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert r.identity_error < 1e-10
    assert len({r.identity_error for r in found}) == 1


def test_whitening_of_the_given_table(spark, data):
    rows = [(r.vec_id, r.embedding, None) for r in table(spark, data, "embeddings").limit(60).collect()]
    found = by_row(whitening.whiten(vectors_of(spark, rows)).collect())
    for i, n, dev, w, explained in plain_whitening(usable(rows)):
        for c in range(1, 5):
            r = found[i, dev, c][0]
            assert r.n == n and abs(r.whitened) == pytest.approx(abs(w[c - 1]), rel=1e-8, abs=1e-8) and r.explained == pytest.approx(explained[c - 1], rel=1e-9)
    assert registry.op11_digit_slice_whitening(spark, data).count() == 4 * table(spark, data, "embeddings").filter("embedding is not null").count()


def test_small_eigenvalues_beside_large_ones_and_large_offsets(spark):
    """Floating-point covariance keeps nothing of the second to fourth component here."""
    rng = np.random.default_rng(2)
    free = rng.integers(-3, 4, (400, 5))
    rows = [(i, [float(2**30 * v[0]), float(2**20 + v[1] / 256), 2.0**20 + v[2] / 128, v[3] / 256, v[4] / 256 + 5], 0) for i, v in enumerate(free.tolist())]
    schema = SCHEMA.replace("array<float>", "array<double>")
    frame = spark.createDataFrame([(i, v, label, "v", 1, "o", 2, 3, 4) for i, v, label in rows], schema)
    found = whitening.whiten(frame).collect()
    assert len(found) == 1600 and found[0].identity_error < 1e-6
    fit = np.array(sorted({tuple(math.floor(256 * x) for x in v) for _, v, _ in rows}), dtype=object)
    n = len(fit)
    centred = fit * n - fit.sum(axis=0)
    exact = (centred.T @ centred) // n  # n^2 times the covariance
    small = exact[1:, 1:].astype(float) - np.outer(exact[1:, 0].astype(float), exact[0, 1:].astype(float)) / float(exact[0, 0])
    values = sorted(np.linalg.eigvalsh(small))[::-1]
    for c in (2, 3, 4):
        e = next(r.explained for r in found if r.component == c)
        assert e == pytest.approx(values[c - 2] / float(np.trace(exact)), rel=1e-4)


def test_whitening_without_anything_to_divide_by(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    line = whitening.whiten(vectors_of(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)])).collect()  # one direction only
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    far = whitening.whiten(vectors_of(spark, [(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [1.0, 2.0], 0)])).collect()
    assert {r.deviation is None for r in far} == {True, False} and {r.component for r in far} == {1, 2}


def test_exact_products():
    rng = np.random.default_rng(0)
    for scale in (3, 10**6, 2**62):
        a, b = rng.integers(-scale, scale, (7, 300)), rng.integers(-scale, scale, (300, 5))
        assert (integers.exact_product(a, b) == a.astype(object) @ b.astype(object)).all()
        assert (integers.unpack(integers.pack(a), 300) == a).all()
    assert integers.pack(np.array([[-128, 127], [-129, 0], [2**63 - 1, -(2**63)]])).to_pylist()[0] == b"\x80\x7f"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    cuts = [list(c) for c in np.array_split(range(len(ints[0])), parts)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[[ints[i][c] for c in cut] for i in order] for cut in cuts]
    near = lambda v, book: min(range(len(book)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(v, book[k])), k))
    for k in range(rounds + 1):
        own = [[near([row[c] for c in cut], book) for cut, book in zip(cuts, books)] for row in ints]
        if k == rounds:
            break
        for p, cut in enumerate(cuts):
            for e in range(len(books[p])):
                members = [[row[c] for c in cut] for row, o in zip(ints, own) if o[p] == e]
                if members:
                    books[p][e] = [sum(col) // len(members) for col in zip(*members)]
    errors = [sum(sum((row[c] - b) ** 2 for c, b in zip(cut, book[o])) for cut, book, o in zip(cuts, books, mine)) for row, mine in zip(ints, own)]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return Counter((i, "".join(f"{o:02x}" for o in mine), e, by_label[label], digest) for (i, _, label), mine, e in zip(rows, own, errors))


def coded(frame):
    found = codes.compress_vectors(frame).withColumn("code", F.lower(F.hex("code"))).collect()
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found)


def test_codes_of_odd_rows(spark, odd_rows):
    assert coded(vectors_of(spark, odd_rows)) == plain_codes(usable(odd_rows))


def test_codes_of_ties(spark):
    """Small whole components: many entries are equal or equally near, and some are never used."""
    rng = np.random.default_rng(4)
    rows = [(i, (v / 4096).astype(np.float32).tolist(), i % 2) for i, v in enumerate(rng.integers(-2, 3, (400, 19)))]
    assert coded(vectors_of(spark, rows)) == plain_codes(rows)


def test_codes_of_the_given_table(spark, data):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, data, "embeddings").collect()]
    found = registry.op13_hamerly_codes(spark, data).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == plain_codes(usable(rows))


def test_codes_of_few_rows_and_large_components(spark, monkeypatch):
    assert coded(vectors_of(spark, [])) == Counter()
    few = [(5, [1.0, -2.5, 3.0], 1), (4, [0.5, 0.25, -1.0], None)]
    assert coded(vectors_of(spark, few)) == plain_codes(few)
    monkeypatch.setattr(codes, "SENT_LABELS", 0)  # labels over the bound are joined, dealt over tasks
    rng = np.random.default_rng(8)
    rows = [(i, (v * 2.0**12).astype(np.float32).tolist(), None if i % 3 else 7) for i, v in enumerate(rng.normal(0, 1, (60, 8)))]
    assert coded(vectors_of(spark, rows)) == plain_codes(rows)
    far = codes.compress_vectors(vectors_of(spark, [(i, [3e38 * (-1) ** i, float(i)], 0) for i in range(40)])).collect()
    assert len(far) == 40


def test_bounds_spare_comparisons(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (16, 32))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.05, 32)).astype(np.float32).tolist(), 0) for i in range(3000)]
    vectors, length = integers.usable_vectors(vectors_of(spark, rows), vec_id="vec_id", label="label", vec="embedding")
    _, _, scans = codes.train_codes(vectors, length, 8, 16, 6, 4096, Scratch(spark, "test"))
    assert scans[0] == 3000 * 8 and sum(scans[1:]) < 0.2 * 6 * scans[0]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_of_whole_texts(spark, data, odd, none, library):
    for docs in (table(spark, data, "documents"), odd):
        given = Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
        wanted = Counter((i, tuple(library.encode(t)), library.decode(library.encode(t)) if t else "") for i, t in given.elements())
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.sentence_pieces(docs, PIECES).collect()) == wanted
    assert pieces.sentence_pieces(none, PIECES).count() == 0


def test_piece_digests(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, data, "documents").collect()}
    for r in registry.op12_prefix_table_pieces(spark, data).collect():
        ids = library.encode(texts[r.doc_id])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else ""))


def test_pieces_of_random_strings(library):
    encoder, rng = pieces.PrefixEncoder(PIECES), random.Random(7)
    signs = ["a", "b", "t", "h", "e", " ", "   ", "\n", "\t", "▁", "é", "日本", "😀", "\0", "​", "<s>", "<0x0A>", "</s>", "ing", "the", "0", "\r", "\x85", "　", "ﬁ", "<unk>", "é"]
    words = list(encoder.id_of)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(4000)]
    texts += [" " * n for n in range(70)] + ["ab" * 20_000, " " * 20_000 + "x", "日本" * 5_000, "=" * 333, "long " * 50_000]
    for text in texts:
        ids = encoder.ids(text)
        assert ids.tolist() == library.encode(text) and encoder.text(ids) == (library.decode(ids.tolist()) if text else "")


def test_tables_start_afresh(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 5)
    encoder = pieces.PrefixEncoder(PIECES)
    for text in ("one two three four five six seven", "one two", "eight nine ten eleven twelve one"):
        assert encoder.ids(text).tolist() == library.encode(text)
