"""Embedding links, byte repeats, Jaccard classes, components and page extraction against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumspark.llm import forest, graph, jaccard, suffixes, wrapper
from vellumspark.llm.common import Scratch, table


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(300, 360)]
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    expected = roots(361, links)
    assert all(found.get(i, i) == expected[i] for i in range(361))


def links_of(vectors, labels, threshold=0.93):
    out = []
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if labels[i] is None or labels[i] != labels[j] or a is None or b is None or len(a) != len(b):
                continue
            a64, b64 = np.array(a, float), np.array(b, float)
            if not (np.isfinite(a64).all() and np.isfinite(b64).all() and a64.any() and b64.any()):
                continue
            if a64 @ b64 / np.sqrt(a64 @ a64) / np.sqrt(b64 @ b64) >= threshold:
                out.append((i, j))
    return out


@pytest.mark.parametrize("large", [False, True])
def test_embedding_links(spark, monkeypatch, large):
    if large:  # groups are split over the cluster, trees split and blocks pair up
        for name, value in (("GROUP", 50), ("WIDE_LEAF", 40), ("BLOCK", 16)):
            monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 64))
    vectors = [(centres[i % 12] + rng.standard_normal(64) * (0.05 + 0.2 * (i % 3 == 0))).astype(np.float32).tolist() for i in range(240)]
    vectors += rng.standard_normal((200, 64)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [None] * 64, [1.0, 2.0]]
    labels = [i % 2 if i % 17 else None for i in range(len(vectors))]
    rows = [(i, v, k, "x") for i, (v, k) in enumerate(zip(vectors, labels))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, leaf string")
    if large:  # a label of another type
        frame = frame.withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    clean = [None if v is None or any(x is None for x in v) else v for v in vectors]
    links = links_of(clean, labels)
    count, root = np.bincount(np.array(links).ravel(), minlength=len(vectors)), roots(len(vectors), links)
    found = {r.vec_id: r for r in forest.near_duplicates(frame).collect()}
    assert len(found) == len(vectors)
    assert [(found[i].n_links, found[i].component_id, found[i].kept) for i in range(len(vectors))] == [(count[i], root[i], root[i] == i) for i in range(len(vectors))]
    assert forest.near_duplicates(frame.filter("false")).count() == 0


def near_the_threshold(n, dimensions=64, seed=8):
    """n vectors in pairs whose cosine is 0.9301 to 0.935, and n more that are alone."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n // 2, dimensions))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.935, (n // 2, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * side, rng.standard_normal((n, dimensions))])


def test_recall_at_production_parameters(spark):
    x = near_the_threshold(6000)  # 12,000 vectors of one label
    frame = spark.createDataFrame([(i, v.tolist(), "one") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    found = {r.vec_id: r for r in forest.near_duplicates(frame).collect()}
    hit = sum(found[i + 3000].component_id == i for i in range(3000))
    assert hit >= 0.99 * 3000 and sum(r.n_links for r in found.values()) >= 2 * hit
    assert any(len(rows) < 6000 for rows in forest.tree_leaves(x[:6000] @ forest.directions(0, 64), forest.margin(0.93, 64), forest.LEAF))


def test_recall_of_groups_beyond_one_task_at_production_parameters(spark):
    x = near_the_threshold(10_000)  # 20,000 vectors of one label, split over the cluster
    assert len(x) > forest.GROUP
    frame = spark.createDataFrame([(i, v.tolist(), "one") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    found = {r.vec_id: r.component_id for r in forest.near_duplicates(frame).collect()}
    assert sum(found[i + 5000] == i for i in range(5000)) >= 0.99 * 5000


def test_a_pair_exactly_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.93, float(np.sqrt(1 - 0.93**2))], 0), (3, [0.0, 1.0], 0), (4, [1e200, 0.0], 0), (5, [1e-200, 0.0], 0)]
    found = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    linked = float(np.dot([1.0, 0.0], np.array(rows[1][1]) / np.linalg.norm(rows[1][1]))) >= 0.93
    assert (found[2].component_id == 1) == linked and found[3].n_links == 0 and found[4].component_id == found[5].component_id == 1


@pytest.mark.parametrize("large", [False, True])
def test_links_of_a_dense_label(spark, monkeypatch, large):
    if large:
        for name, value in (("GROUP", 500), ("WIDE_LEAF", 64), ("BLOCK", 128)):
            monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 64))
    x = np.sqrt(0.06) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += np.sqrt(0.94)  # cosines of about 0.94
    x = x.astype(np.float32)
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r.n_links for r in forest.near_duplicates(frame).collect()}
    assert [found[i] for i in range(900)] == ((y @ y.T >= forest.THRESHOLD).sum(axis=1) - 1).tolist()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)))
def test_longest_previous_factors(data):
    expected = [max((k for q in range(p) for k in range(len(data) - p + 1) if data[q : q + k] == data[p : p + k]), default=0) for p in range(len(data))]
    assert suffixes.longest_previous_factors(data).tolist() == expected
    assert suffixes.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=40).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=6), st.randoms())
def test_previous_factors_of_a_bucket(parts, random):
    """Factors, up to the length, of windows of several runs against plain comparison."""
    length = 11
    data = np.frombuffer(b"".join(parts), np.uint8)
    windows, at = [], 0
    for k, part in enumerate(parts):
        windows += [(at + s, k, s) for s in range(len(part) - length + 1)]
        at += len(part)
    random.shuffle(windows)
    starts, doc, place = (np.array(c, np.int64) for c in zip(*windows))
    found = suffixes.previous_factors(starts, data, (doc, place), length)
    raw = data.tobytes()
    for i, (s, d, p) in enumerate(windows):
        earlier = [raw[x : x + length] for x, e, q in windows if (e, q) < (d, p)]
        mine = raw[s : s + length]
        assert found[i] == max((next((k for k in range(length) if w[k] != mine[k]), length) for w in earlier), default=0)


def test_spans_come_from_the_factors(spark, monkeypatch):
    passage = "a passage that two documents share, " * 5
    frame = spark.createDataFrame([(1, "first " + passage), (2, "second " + passage + " end")], "doc_id long, text string")
    assert [r.n_removed > 0 for r in suffixes.remove_repeats(frame).orderBy("doc_id").collect()] == [True, True]
    monkeypatch.setattr(suffixes, "previous_factors", lambda starts, *rest: np.zeros(len(starts), np.int64))
    assert [r.n_removed for r in suffixes.remove_repeats(frame).collect()] == [0, 0]


def test_one_id_with_two_texts_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1)  # thousands of buckets
    words = [f"word{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (1, " ".join(words[50:])), (2, " ".join(words[:120]))]
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes > 0) for r in found) == [(1, True), (1, True), (2, True)]
    assert [r.n_removed for r in found if r.doc_id == 2] == [len(rows[2][1])]


def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(set(docs), key=lambda x: x[0]):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(c and not p for p, c in zip(b"\0" + covered, covered))
        out[i] = (len(raw), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(raw, covered) if not c)).hexdigest())
    return out


def test_repeats(odd, none, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 700)
    monkeypatch.setattr(suffixes, "PART_WINDOWS", 50)
    short = [(i, t) for i, t in texts if len(t or "") < 100_000]
    expected = brute_repeats(short)
    found = suffixes.remove_repeats(odd.filter("coalesce(length(text), 0) < 100000")).collect()
    assert len(found) == len(short)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id
    assert suffixes.remove_repeats(none).count() == 0


def test_a_line_of_all_documents_costs_its_bucket_a_mark_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_DOCS", 50)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 20_000)
    line = " ".join(f"licence{i}" for i in range(14))
    rng = np.random.default_rng(5)
    noise = lambda: " ".join("".join(w) for w in rng.choice(list("abcdefghij"), (12, 8)))
    rows = [(i, f"{noise()}\n{line}\n{noise()}" if i % 2 else f"same head\n{line}\nsame tail {noise()}") for i in range(1200)]
    rows += [rows[7], (2000, rows[8][1]), (None, rows[9][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    marks, chunks = [], 0
    for r in suffixes.deal_anchors(frame, 16, 100, 50).collect():
        if r.bucket < 0:
            chunks += 1
        else:
            marks += [(r.bucket, t) for t in suffixes._wide([bytes(r.tokens)]).tolist()]
    most = max(marks.count(m) for m in set(marks))
    assert 24 <= chunks < 40 and 4 <= most <= chunks  # and not 1,200
    expected = brute_repeats([r for r in rows if r[0] is not None])
    for r in suffixes.remove_repeats(frame).collect():
        if r.doc_id is None:
            assert r.n_removed == r.n_bytes
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id


def test_equal_runs_of_a_task_are_sent_once(spark):
    passage = " ".join(f"passage{i}" for i in range(60))
    texts = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{i} {passage} {i}") for i in range(200)], "first long, text string").coalesce(1)
    keys = np.unique(suffixes._key(*suffixes._bucket_key(suffixes.window_keys(np.frombuffer(passage.encode(), np.uint8), suffixes._Grams(), 100, 50)[0], 16)[::-1]))
    dealt = suffixes.deal_runs(texts.selectExpr("unhex(sha2(text, 256)) sha", "first", f"X'{keys.tobytes().hex()}' keys", "text"), 16, 100, 50).collect()
    sent = sum(len(r.data) for r in dealt if r.bucket >= 0)
    spans = sum(len(r.starts) // 8 for r in dealt if r.bucket < 0)
    runs = sum(len(r.starts) // 8 for r in dealt if r.bucket >= 0)
    assert spans > 10 * 199 and runs < 3 * 200 + 20 and sent < 200 * len(passage)


def shingle_set(text, n=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_classes(docs):
    ids = sorted({i for i, _ in docs})
    sets = {i: shingle_set(t) for i, t in docs}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (common := len(sets[ids[k]] & sets[ids[ids.index(b)]])) and 100 * common >= 75 * len(sets[a] | sets[b])]
    place = {i: k for k, i in enumerate(ids)}
    root = roots(len(ids), [(place[a], place[b]) for a, b in links])
    return {i: (len(sets[i]), ids[root[place[i]]]) for i in ids}


@pytest.mark.parametrize("cell, left", [(48, 0.5), (1, 1e9), (1, 0)])  # pair by pair, split again and again, and block against block
def test_classes(spark, odd, none, texts, data, monkeypatch, cell, left):
    for name, value in (("SMALL_CELL", cell), ("LEAF_CELL", cell), ("PAIRS_LEFT", left), ("LEVELS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 4096)
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(80)]
    copies = []
    for k in range(40):
        words = list(base)
        for p in rng.integers(0, 80, int(rng.integers(0, 5))):
            words[p] = f"edit{k}"
        copies.append((1000 + k, " ".join(words)))
    more = spark.createDataFrame([(i, t, "en", "s", 0, "n", 1, 2, "b", "c", 3) for i, t in copies], odd.schema)
    expected = brute_classes(texts + copies)
    found = jaccard.jaccard_classes(odd.unionByName(more)).collect()
    assert len(found) == len(texts) + len(copies)
    for r in found:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id], r.doc_id
    assert jaccard.jaccard_classes(none).count() == 0


def random_cell(n=400, seed=1):
    """Documents of a cell: several families that share shingles, and their sets."""
    rng = np.random.default_rng(seed)
    base = np.arange(60)
    out = []
    for k in range(n):
        family = rng.integers(0, 6)
        own = np.where(np.arange(60) < 10 * family, 1000 * (family + 1), 0) + base  # families differ in a part
        change = rng.random(60) < rng.choice([0.02, 0.1, 0.2])
        out.append(np.unique(np.where(change, 100_000 + 60 * k + base, own)))
    return out


def test_voronoi_cells_bring_every_linked_pair_together(spark):
    sets = random_cell()
    rows = [(b"%04d" % i, len(x), [int(v) for v in x], 0.0, b"%04d" % i) for i, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node binary, n long, tokens array<long>, central double, component binary")
    large = frame.select(F.lit(5).cast("long").alias("cell"), "node", "n", "central", "component", F.lit(len(rows)).cast("long").alias("size"))
    tries = jaccard.try_pivots(large, frame.select("node", "n", "tokens"), Scratch(spark, "test"))
    assert tries.select("pivot").distinct().count() == jaccard.PIVOTS
    cells = jaccard.voronoi_cells(tries).collect()
    held = {}
    for r in cells:
        held.setdefault(int(bytes(r.node)), set()).add(r.cell)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))]
    assert len(links) > 100 and all(held[i] & held[j] for i, j in links)
    assert len(cells) < 0.9 * len(rows) * jaccard.PIVOTS  # windows leave cells out
    for cell, left in ((48, 0.5), (4, 1e9), (4, 0)):
        with pytest.MonkeyPatch.context() as m:
            for name, value in (("SMALL_CELL", cell), ("LEAF_CELL", cell), ("PAIRS_LEFT", left), ("LEVELS", 2)):
                m.setattr(jaccard, name, value)
            found = jaccard.join_cells(large.drop("size"), frame.select("node", "n", "tokens"), Scratch(spark, "test")).collect()
        assert roots(len(sets), [(int(bytes(r.a)), int(bytes(r.b))) for r in found]) == roots(len(sets), links)


def test_a_family_of_many_near_copies(spark):
    """Work follows the family's size: every copy meets the pivots, and those outside the main class meet the rest in blocks."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(6000):
        words = [f"w{i}" for i in range(120)]
        for p in rng.integers(0, 120, int(rng.integers(0, 7))):
            words[p] = f"e{k}x{p}"
        texts.append((k, " ".join(words)))
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).collect()}
    sets = [shingle_set(t) for _, t in texts]
    shared = {g: k for k, g in enumerate(sorted(g for g, n in Counter(g for s in sets for g in s).items() if n > 1))}
    has = np.zeros((len(sets), len(shared)), np.float32)
    for i, s in enumerate(sets):
        has[i, [shared[g] for g in s if g in shared]] = 1
    common, sizes = has @ has.T, np.array([len(s) for s in sets])
    linked = 100 * common >= 75 * (sizes[:, None] + sizes[None, :] - common)
    classes = {}
    for i in range(len(sets)):  # the smallest document of a class comes first and reaches the others
        if i not in classes:
            reached, edge = np.arange(len(sets)) == i, np.array([i])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(axis=0) & ~reached)
                reached[edge] = True
            classes |= dict.fromkeys(np.flatnonzero(reached).tolist(), i)
    assert max(Counter(classes.values()).values()) > 3000 and found == classes


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="notice">We use cookies {n}</div><div>All rights kept by the house</div><article><h1>Title &amp; {n}</h1><p>First   <b>bold</b>
text {n}.<p>Second&nbsp;one {n}<br>after break</article><section class="comments"><p>nice post {n}</p></section><form><p>Sign up {n}</p></form><footer>c {n}</footer></body></html>"""
PLAIN = """<html><body><div class="top">Our weekly letter about gardens</div><div class="body"><p>Plain story number {n}</p></div><aside>side {n}</aside></body></html>"""


def test_pages(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.replace("{n}", str(i))) for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", PLAIN.replace("{n}", str(i))) for i in range(8)]
    rows += [(200, "http://c.example/1", None), (201, None, "<p>no host &am"), (202, "http://c.example/2", ""), (203, "http://c.example/3", "<p>cut <b>off &lt;")]
    found = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows)
    assert found[3] == "Title & 3\n\nFirst bold text 3.\n\nSecond one 3 after break"
    assert found[104] == "Plain story number 4"  # the constant heading is template, the aside is dropped
    assert found[200] == found[202] == "" and found[201] == "no host &am" and found[203] == "cut off <"


WORDS = "north river stone garden market winter letter window bridge summer morning evening village harbour island meadow".split()


def site(kind, k, rng):
    """(html, main text) of a page: menus and teasers that vary, notices that don't, none with a telling name."""
    say = lambda n: " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))
    menu = "".join(f"<li><a href='/{k}'>{say(1)} {k}</a></li>" for _ in range(int(rng.integers(3, 7))))
    paragraphs = [f"{say(int(rng.integers(25, 60)))} {k}." for _ in range(int(rng.integers(1, 6)))]
    title = f"{say(4)} {k}"
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    if kind == 0:
        page = f"<div class='x1'><ul>{menu}</ul></div><div class='x2'>Opening hours are nine to five</div><div class='x3'><h1>{title}</h1>{body}<div>All texts are checked twice</div></div><div class='x4'>{say(5)}</div>"
    elif kind == 1:
        page = f"<table><tr><td>{say(3)}</td><td><ul>{menu}</ul></td></tr></table><h1>{title}</h1><div id='q'>{body}</div><div id='r'><p>Kept by the house since 1900</p><p>{say(4)}</p></div>"
    else:
        more = f"<div class='opt'><p>{say(6)}</p></div>" if k % 2 else ""
        page = f"<div><div><p>Members pay nothing here</p></div><div class='z'>{say(3)} {k}</div>{more}<section class='c'><section class='d'><h1>{title}</h1><div class='text'>{body}</div></section></section></div>"
    return f"<html><head><title>t {k}</title></head><body>{page}</body></html>", "\n\n".join([title, *paragraphs])


def sites(n=12):
    rng = np.random.default_rng(9)
    return [(100 * kind + k, f"https://h{kind}.example/{k}", *site(kind, k, rng)) for kind in range(3) for k in range(n)]


def test_induction_decides(spark):
    rows = sites()
    frame = spark.createDataFrame([r[:3] + ("a", 1, "b", "c", 2) for r in rows], "page_id long, url string, html string, host string, salt int, reference string, template string, counts int")
    found = {r.page_id: r.text for r in wrapper.main_text(frame).collect()}
    assert found == {i: text for i, _, _, text in rows}
    # without induction the lists let menus, teasers and notices through on every page
    assert all("\n\n".join(wrapper.content_by_lists(wrapper.parse(h))) != text for _, _, h, text in rows)
    # and without lists induction alone is right
    for kind in range(3):
        own = [r for r in rows if r[0] // 100 == kind]
        reference = wrapper.parse(own[0][2])
        numbers = wrapper.numbered(reference)
        counts = {}
        for r in own:
            for number, v in enumerate(wrapper.vote(reference, len(numbers), wrapper.parse(r[2]), lists=False)):
                n, same, varying = counts.get(number, (0, 0, 0))
                counts[number] = (n + (v != 0), same + (v == -1), varying + max(v, 0))
        made = wrapper.Wrapper(reference, numbers, counts)
        assert all("\n\n".join(wrapper.content(wrapper.parse(h), made, lists=False)) == text for _, _, h, text in own)


def test_few_pages_fall_back_to_the_lists(spark):
    rows = [(i, "https://few.example/", PAGE.replace("{n}", str(i))) for i in range(3)]
    found = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[2] == "Title & 2\n\nFirst bold text 2.\n\nSecond one 2 after break"


def test_deep_wide_and_odd_pages(spark):
    deep = ["<div>" * 3000 + f"<p>deep story {k}</p>" + "</div>" * 3000 for k in range(5)]
    wide = ["".join(f"<p>{k} {j}</p><div>x {j * k}</div>" for j in range(3000)) for k in range(5)]
    open_ = ["<b><p><i>" * 4000 + f"end {k}" for k in range(5)]
    rows = [(i, f"https://{name}.example/{i}", h) for name, pages in (("deep", deep), ("wide", wide), ("open", open_)) for i, h in enumerate(pages, {"deep": 0, "wide": 10, "open": 20}[name])]
    rows += [(30, "https://odd.example/", "&am<b>p;</b> &amp;<!-- -->lt; <p>\ud83d\ude00</p><"), (31, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.text, r.n_chars) for r in wrapper.main_text(frame).collect()}
    assert all(found[i][0] == f"deep story {i}" for i in range(5)) and all(found[20 + i][0] == f"end {i}" for i in range(5))
    assert all("1 2999" in found[11][0] and found[10 + i][1] > 9000 for i in range(5))
    assert found[30][0].startswith("&am p; &lt;") or found[30][0].startswith("&amp; &lt;")
    assert found[31] == ("", 0)
    assert wrapper.main_text(frame.filter("false")).count() == 0
    salted = wrapper._with_host(frame.withColumn("host", F.lit("h")), spark.createDataFrame([("h", "r")], "host string, reference string"), 7)
    assert salted.count() == len(rows) and salted.filter("reference is null").count() == 0


def test_copies_make_no_template(spark):
    rows = [(i, "http://d.example/x", PLAIN.replace("{n}", "7")) for i in range(30)] + [(99, "http://d.example/y", PLAIN.replace("{n}", "8"))]
    found = {r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Plain story number" in t for t in found)


def test_tree_matching_is_the_best_one():
    a, b = wrapper.parse("<div><h1>x</h1><p>1</p><ul><li>a</li></ul><p>2</p></div>"), wrapper.parse("<div><p>1</p><p>2</p><ul><li>b</li><li>c</li></ul></div>")
    pairs = [(p.text, q.text) for p, q in wrapper.aligned(a, b) if isinstance(p, wrapper.Text)]
    assert ("a", "b") in pairs and len(pairs) == 2


def test_given_tables(spark, data):
    docs = table(spark, data, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute_classes(rows)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in jaccard.jaccard_classes(docs).collect())


def test_first_regions_and_the_rest_hold_every_linked_pair(spark):
    """Whatever pivots there are: a linked pair shares a region, or both are far and meet by rare shingles."""
    sets = random_cell(300, seed=4)
    rows = [(b"%04d" % i, len(x), 0.0, [int(v) for v in x]) for i, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node binary, n long, central double, tokens array<long>")
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))]
    for chosen in ((), (0,), (3, 50, 200), range(0, 300, 9)):
        cells, far = {}, set()
        found = jaccard.voronoi_regions(frame, [(b"%04d" % i, len(sets[i]), np.sort(sets[i].astype(np.int64))) for i in chosen]).collect()
        for r in found:
            node = int(bytes(r.node))
            cells.setdefault(node, set()).add(r.cell)
            far |= {node} if r.far else set()
            if r.linked:
                pivot = int(bytes(r.pivot))
                assert 4 * len(np.intersect1d(sets[node], sets[pivot])) >= 3 * len(np.union1d(sets[node], sets[pivot]))
        assert all((cells[i] & cells[j]) - {None} or {i, j} <= far for i, j in links)
        assert set(cells) >= far and (len(chosen) < 3 or sum(len(c - {None}) for c in cells.values()) > 100)


def test_voronoi_regions_decide_on_the_given_table(spark, data, monkeypatch):
    """Pivots found in the table take documents into regions and link them; the result equals the full comparison with and without pivots."""
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    real = jaccard.voronoi_regions
    monkeypatch.setattr(jaccard, "voronoi_regions", lambda c, p, percent: seen.append((len(p), real(c, p, percent))) or seen[-1][1])
    expected = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    for pivots in (256, 2, 0):
        monkeypatch.setattr(jaccard, "FIRST_PIVOTS", pivots)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()} == expected
        n, cells = seen[-1]
        assert n == min(pivots, seen[0][0]) and (cells.filter("cell is not null").count() > 0) == (pivots > 0)
    assert seen[0][0] > 2 and seen[0][1].filter("linked and node <> pivot").count() > 0
