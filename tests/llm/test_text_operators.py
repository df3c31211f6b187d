"""Language ID, quality, secrets, media, packing and mixing against brute force and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumspark.llm import langid, media, mixing, packing, quality, secrets
from vellumspark.llm.common import Scratch, crc_mod, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_language_on_held_out_rows(spark, data):
    docs = table(spark, data, "documents")
    found = langid.identify(docs, crc_mod("doc_id", 4) != 2).join(docs.select("doc_id", "lang"), "doc_id").filter(crc_mod("doc_id", 4) == 2).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95


def test_language_of_odd_rows(odd, none):
    found = {r.doc_id: r for r in langid.identify(odd, F.lit(True)).collect()}
    assert len(found) == odd.select("doc_id").distinct().count()
    for i in (30, 31, 32, 35):  # null, empty, blank, no letter
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.identify(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}  # nothing learned
    kept = langid.keep_identified(odd, langid.train_prototypes(odd), 0.0)
    assert kept.columns == odd.columns and {30, 31, 32, 35}.isdisjoint(r.doc_id for r in kept.collect())


def test_lettered_texts_stay_where_no_language_is_named(odd):
    kept = langid.keep_identified(odd, langid.train_prototypes(odd.filter("lang is null and false")), 0.0)
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in odd.collect())


def plain_vector(text):
    """A text's vector by loops over its trigrams, from the letter vectors alone."""
    encoder = langid.Encoder()
    letters = encoder.third.astype(int)
    codes = [0] + encoder.codes(text).tolist() + [0]
    total = np.zeros(letters.shape[1])
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b or (a and c):
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total, sum(bool(b or (a and c)) for a, b, c in zip(codes, codes[1:], codes[2:]))


def plain_prototypes(rows):
    sums = {}
    for text, lang in rows:
        if lang is not None and any(c.isalpha() for c in text or ""):
            v, n = plain_vector(text)
            sums[lang] = sums.get(lang, 0) + v / n
    return {k: v / np.linalg.norm(v) for k, v in sums.items()}


def plain_cosines(text, prototypes):
    v, n = plain_vector(text)
    return {k: float(p @ v / np.linalg.norm(v)) for k, p in sorted(prototypes.items())}, n


def test_language_by_a_plain_recomputation(spark):
    rows = [(0, "the cat sat on the mat and the dog ran after it", "en"), (1, "der Hund lief schnell über die alte Straße nach Hause", "de"),
            (2, "où est la bibliothèque de la ville près d'ici", "fr"), (3, "the dog and the house", None), (4, "die Straße nach der alten Stadt", "xx"),
            (5, "", "en"), (6, None, "de"), (7, "!!", "fr"), (8, "日本語 😀 text", None), (3, "la ville", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = plain_prototypes([(t, x) for i, t, x in rows if i < 3])
    found = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.identify(frame, F.col("doc_id") < 3).collect())
    expected = Counter()
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            expected[i, "und", 0.0] += 1
            continue
        cosines, _ = plain_cosines(t, learned)
        best = max(cosines, key=cosines.get)
        expected[i, best, round(max(0.0, min(1.0, cosines[best])), 4)] += 1
    assert found == expected


def test_junk_is_rejected_and_clean_rows_stay(spark, data):
    docs = table(spark, data, "documents")
    rng = np.random.default_rng(6)
    junk = ["".join(chr(c) for c in rng.integers(low, high, 400)) for low, high in ((0x430, 0x450), (0x5D0, 0x5EA), (97, 123)) for _ in range(20)]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string"))
    kept = Counter(r.doc_id for r in langid.keep_identified(rows, langid.train_prototypes(docs), 0.12).collect())
    assert sum(i < 0 for i in kept) <= 2
    assert {i for i in kept if i >= 0} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


def test_language_slices_join_up(monkeypatch):
    text = "der schnelle Fuchs springt über den faulen Hund " * 40
    whole = langid.Encoder().trigrams(text)
    monkeypatch.setattr(langid, "SLICE", 64)
    parts = langid.Encoder().trigrams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_quality_on_held_out_rows(spark, data):
    labels = table(spark, data, "labels")
    found = quality.classify_quality(table(spark, data, "documents"), labels, crc_mod("label_id", 3) != 1).join(labels, "doc_id").filter(crc_mod("doc_id", 3) == 1).collect()
    assert sum(r.quality == r.predicted for r in found) / len(found) > 0.9


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(40, None)], "doc_id long, quality int")
    found = quality.classify_quality(odd, labels, F.lit(True)).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert {r.score for r in quality.classify_quality(odd, labels.filter("false"), F.lit(True)).collect()} == {0.5}
    assert quality.classify_quality(none, labels, F.lit(True)).count() == 0


def test_trees_walk_like_one_row_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.random((400, 5), dtype=np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit_trees(x, y, trees=30, depth=3)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    for row, score in zip(x[:20], model.score(x[:20])):
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > c[k])
            total += v[k - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, "hex", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets_by_brute_force(odd, none, texts):
    ledger = secrets.scan_history(odd)
    assert sum(ledger.scanned) == ledger.findings.count() == len({t or "" for _, t in texts})  # a blob is scanned once
    found = secrets.span_digest(secrets.findings_by_path(ledger)).collect()
    assert sorted((r.doc_id, r.spans) for r in found) == sorted((i, brute_secrets(t or "")) for i, t in texts)
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and r.n_hex == r.spans.count("hex:") for r in found)
    assert secrets.scan_history(none).findings.count() == 0


def test_ledger_is_incremental(odd, texts):
    blobs = lambda keep: {t or "" for i, t in texts if keep(i)}
    even, whole = blobs(lambda i: i % 2 == 0), blobs(lambda i: True)
    first = secrets.scan_increment(odd.filter("doc_id % 2 = 0"))
    both = secrets.scan_increment(odd.filter("doc_id % 2 = 1"), first)
    assert both.scanned == [len(even), len(whole - even)]  # only what the first had not
    again = secrets.scan_increment(odd, both)
    assert again.scanned[-1] == 0 and again.findings.count() == len(whole)
    key = lambda ledger: sorted((r.doc_id, r.blob, tuple(r.starts)) for r in secrets.findings_by_path(ledger).collect())
    assert key(both) == key(secrets.scan_history(odd, increments=1)) == key(secrets.scan_history(odd, increments=3))
    assert len(key(again)) == 2 * odd.count()  # paths of all increments get their findings
    following = secrets.scan_increment(odd, both, rule_version="next")
    assert following.scanned[-1] == len(whole) and following.findings.count() == 2 * len(whole)
    twice = secrets.Ledger(both.paths, both.findings.unionByName(both.findings))
    assert key(twice) == key(both)


def test_a_kept_ledger_is_reopened_in_another_session(spark, odd, texts, tmp_path):
    """One changed document and one changed rule are all that later sessions scan."""
    path, whole = f"{tmp_path}/ledger", {t or "" for _, t in texts}
    assert secrets.open_ledger(spark, path) is None
    first = secrets.keep_increment(path, odd, "monday")
    assert first.scanned == [len(whole)]
    other = spark.newSession()
    docs = other.createDataFrame(odd.collect(), odd.schema)
    again = secrets.keep_increment(path, docs, "tuesday")
    assert again.scanned == [len(whole), 0]
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 1, "new: password = hunter22x").otherwise(F.col("text")))
    third = secrets.keep_increment(path, changed, "wednesday")
    assert third.scanned[-1] == 1
    versions = {r.at: r.blob for r in third.paths.filter("doc_id = 1").collect()}
    assert versions["monday"] == versions["tuesday"] != versions["wednesday"]
    newest = {r.doc_id: (r.blob, r.at) for r in secrets.latest_versions(third).collect()}
    assert newest[1] == (versions["wednesday"], "wednesday") and {at for _, at in newest.values()} == {"wednesday"}
    rules = secrets.Rules((("pin", r"\bpin \d{4}\b"),))
    assert rules.version not in (secrets.BASE.version, secrets.Rules((("pin", r"\bpin \d{5}\b"),)).version)
    more = changed.unionByName(changed.limit(1).withColumn("doc_id", F.lit(5000).cast("long")).withColumn("text", F.lit("my pin 1234 and token=abcdef12")))
    fourth = secrets.keep_increment(path, more, "thursday", rules)
    assert fourth.scanned[-1] == more.select(F.coalesce("text", F.lit(""))).distinct().count()  # every blob anew, at the new rules
    assert secrets.keep_increment(path, more, "friday", rules).scanned[-1] == 0
    found = [r for r in secrets.findings_by_path(fourth, rules.version).filter("doc_id = 5000").collect()]
    assert [list(r.kinds) for r in found] == [["pin", "assign"]]
    base = secrets.findings_by_path(fourth).filter("doc_id = 1").select("blob", "starts").distinct().collect()
    assert {r.blob for r in base} == set(versions.values())


def test_masking(spark, odd):
    masked = secrets.redact_spans(odd, secrets.findings_by_path(secrets.scan_history(odd)))
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert not any(brute_secrets(r.text or "") for r in masked.collect())
    two = spark.createDataFrame([(1, "password = abcdefgh"), (1, "clean"), (None, "password = abcdefgh")], "doc_id long, text string")
    found = secrets.redact_spans(two, secrets.findings_by_path(secrets.scan_history(two)))
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == [(0, "[secret]"), (1, "[secret]"), (1, "clean")]


def test_gif_round_trip(odd, none, texts):
    found = {r.doc_id: r for r in media.text_payload_columns(odd).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        gif = media.write_gif(padded)
        assert (r.media_bytes, r.media_sha256) == (len(gif), hashlib.sha256(gif).hexdigest())
        hist = np.bincount(np.frombuffer(padded, np.uint8) // 16, minlength=16)  # grey: a byte is its luminance
        share = hist[hist > 0] / len(padded)
        frames = -(-len(padded) // 65_536)
        assert r.feature == (f"gif;frames={frames};width=64;rows={len(padded) // 64};delay_cs={4 * frames};"
                             f"entropy={-(share * np.log2(share)).sum() + 0.0:.4f};hist={','.join(map(str, hist))}")
    assert all(found[i].media_bytes < found[i].payload_bytes for i, t in texts if len(t or "") > 100_000)
    assert media.text_payload_columns(none).count() == 0


def lzw_encode(data: bytes, bits: int) -> bytes:
    """A plain compressing encoder, to hold the decoder against."""
    clear = 1 << bits
    acc = used = 0
    width, table = bits + 1, {bytes([i]): i for i in range(clear)}
    free = clear + 2

    def emit(code):
        nonlocal acc, used
        acc |= code << used
        used += width

    emit(clear)
    word = b""
    for b in data:
        c = bytes([b])
        if word + c in table:
            word += c
            continue
        emit(table[word])
        if free < 4096:
            table[word + c] = free
            free += 1
            if free - 1 == 1 << width and width < 12:
                width += 1
        else:
            emit(clear)
            width, table, free = bits + 1, {bytes([i]): i for i in range(clear)}, clear + 2
        word = c
    emit(table[word])
    if free == 1 << width and width < 12:
        width += 1
    emit(clear + 1)
    return acc.to_bytes((used + 7) // 8, "little")


@pytest.mark.parametrize("bits", [2, 4, 8])
@pytest.mark.parametrize("n", [1, 300, 30_000])
def test_lzw_decodes_compressed_streams(bits, n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 1 << bits, n, dtype=np.uint8), np.zeros(n, np.uint8)):
        assert (media.lzw_decode(lzw_encode(data.tobytes(), bits), bits, n) == data).all()


@pytest.mark.parametrize("n", [0, 1, 2, 255, 5000, 70_000])
def test_lzw_encoder(n):
    rng = np.random.default_rng(n)
    for bits in (2, 4, 8):
        for data in (rng.integers(0, 1 << bits, n, dtype=np.uint8), np.zeros(n, np.uint8), (np.arange(n) % 3).astype(np.uint8)):
            stream = media.lzw_encode(data.tobytes(), bits)
            assert (media.lzw_decode(stream, bits, n) == data).all()
            if n and max(map(len, media.lzw_segments(data.tobytes(), bits))) < 4096 - (1 << bits):
                assert stream == lzw_encode(data.tobytes(), bits)
    assert len(media.lzw_encode(bytes(70_000))) < 2000


def test_payload_of_one_id_with_two_texts(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "doc_id long, text string")
    found = media.text_payload_columns(rows).collect()
    assert len({r.media_sha256 for r in found}) == 2 and len(found) == 3


def gif(frames, size=(4, 2), palette=bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])):
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + bytes([0x81, 0, 0]) + palette
    for left, top, w, h, pixels, disposal, transparent, delay in frames:
        flags = disposal << 2 | (transparent is not None)
        out += bytes([0x21, 0xF9, 4, flags]) + delay.to_bytes(2, "little") + bytes([transparent or 0, 0])
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + b"\0\x02"
        stream = lzw_encode(bytes(pixels), 2)
        out += bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def test_gif_disposal_and_transparency():
    data = gif([(0, 0, 4, 2, [0] * 8, 1, None, 5), (1, 0, 2, 1, [1, 3], 2, 3, 7), (0, 1, 1, 1, [2], 3, None, 9), (3, 1, 1, 1, [1], 0, None, 1)])
    canvases = [f.canvas for _, _, f in media.iter_gif(data)]
    red, green, blue, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert (canvases[0] == red).all()
    assert canvases[1][0].tolist() == [red, green, red, red]  # index 3 is transparent
    assert canvases[2][0].tolist() == [red, clear, clear, red]  # the frame before was cleared
    assert canvases[2][1, 0].tolist() == blue and canvases[3][1, 0].tolist() == red  # and this one taken back
    assert canvases[3][1, 3].tolist() == green


def test_gif_columns(spark):
    good = gif([(0, 0, 4, 2, [0] * 8, 1, None, 5)])
    rows = {r.id: r for r in media.gif_columns(spark.createDataFrame([(1, good), (2, good[:40]), (3, None), (4, b"no")], "id long, media binary")).collect()}
    assert rows[1].frames[0].delay_cs == 5 and sum(rows[1].frames[0].histogram) == 8 and rows[1].error is None
    assert rows[2].error and rows[4].error and rows[3].frames is None


def test_mixing(odd, none, texts, spark, data):
    for docs in (odd, table(spark, data, "documents")):
        rows = mixing.mix_documents(docs).collect()
        assert len(rows) == docs.count()
        sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
        assert all(r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in rows)
        total, size_of = sum(r["size"] for r in rows), defaultdict(int)
        for r in rows:
            size_of[r.source] += r["size"]
        order = sorted(size_of, key=lambda s: (s is None, (s or "").encode()))
        weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(order)
        while open_:  # capped shares, by rounds
            left = total - sum(target.values())
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * size_of[s]}
            target |= {s: 3 * size_of[s] for s in over} if over else share
            open_ = open_ - over if over else set()
        taken = Counter()
        for r in rows:
            taken[r.source] += r.taken
            assert r.source_size == size_of[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, total)
        if docs is not odd:
            assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in order)
        again = mixing.mix_documents(docs).collect()
        assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_documents(none).count() == 0


def test_rates_are_the_duals_optimum(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 200))), f"s{int(i % 11) % 4}") for i in range(600)]
    found = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        size, rate, target = np.array([r["size"] for r in own], float), np.array([r.rate for r in own]), own[0].target
        if target >= 3 * size.sum():
            assert (rate == 3).all()
            continue
        low, high = -50.0, 50.0  # plain bisection on the one multiplier of the source
        for _ in range(200):
            lam = (low + high) / 2
            total = (size * np.minimum(3, np.exp(np.minimum(lam * size / size.mean(), 50)))).sum()
            low, high = (low, lam) if total > target else (lam, high)
        assert np.abs(rate - np.minimum(3, np.exp(lam * size / size.mean()))).max() < 1e-4
        assert abs(sum(r.taken for r in own) - target) <= 0.02 * target + 1


def test_mixing_refuses_what_it_can_not_settle(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_documents(odd)
    monkeypatch.undo()
    sizes = spark.createDataFrame([("a", 5, 3), ("a", 50, 2)], "s string, size long, n long")
    totals = spark.createDataFrame([("a", 115, 5, 170.0)], "source string, source_size long, n_docs long, target double")
    with pytest.raises(RuntimeError, match="settled"):
        mixing.solve_dual(sizes, totals, Scratch(spark, "test"), max_iterations=1)


def test_mixing_stays_in_the_jvm(spark, data):
    plan = mixing.document_sizes(table(spark, data, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_word_cache_gives_the_tokenizers_ids(texts):
    model = Tokenizer.from_file(PATH)
    mine = packing.WordCachedTokenizer(PATH)
    for t in [x or "" for _, x in texts] + ["a  b", " a", "a ", "a\n\nb", "a \nb", "it's <|endoftext|> x", "hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>\nb <|endoftext| >", "　x y", "a\tb c"]:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def test_packing(odd, none, texts):
    model = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(odd, PATH, pieces_a_group=16).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t in dict(texts).items():
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]})
        assert [p for p, *_ in own] == list(range(len(own))) and sum(n for _, _, n, _ in own) == len(ids)
        assert all(crc == zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, crc in own)
        assert all(n == 1024 for _, _, n, _ in own[1:])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(none, PATH).count() == 0


def test_one_id_with_two_texts_is_scored_and_packed_twice(spark):
    rows = spark.createDataFrame([(1, "a first text"), (1, "and another one, longer than the first text"), (None, "without an id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted((r.doc_id or 0) for r in quality.classify_quality(rows, labels, F.lit(True)).collect()) == [0, 1, 1]
    packed = packing.pack_documents(rows, PATH).collect()
    assert sorted((r.doc_id or 0) for r in packed) == [0, 1, 1] and len({r.ids_crc32 for r in packed}) == 3
    assert sorted((r.offset, r.length) for r in packed)[0][0] == 0 and len({r.sequence_id for r in packed}) == 1


def test_best_two_fit_improves_on_greedy():
    # greedy takes 60 + 30 and leaves 10; 60 + 25 + 15 fills the bin
    bins, offsets = packing.best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert bins[0] == bins[2] == bins[3] and bins[1] != bins[0]
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1025, 3000)
    bins, _ = packing.best_two_fit(sizes)
    assert np.bincount(bins, weights=sizes).max() <= 1024
    assert bins.max() + 1 <= 1.05 * sizes.sum() / 1024
