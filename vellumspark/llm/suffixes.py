"""Removal of repeated byte strings with suffix order and previous factors.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier in the corpus, in a document of smaller id or earlier in its own. The
first copy of every string stays.

The longest previous factor of a position is the longest string there that also
starts earlier. With the suffixes sorted, the nearest one before and the nearest
one after that have a smaller position are the two candidates, and the least
common prefix on the way to them is the length of the match. ``longest_previous_factors``
gives the array of one text. For a corpus factors are needed up to ``length``
only, and suffixes that could match that far are brought together first:

1. Anchors. Of each window of ``length`` bytes the least hash of its ``GRAM``-byte
   strings is its key. Equal windows have equal keys, wherever they stand. Key
   hashes are dealt into buckets by value, which return those that occur twice.
   What occurs twice within a task's chunk of documents is settled there, and one
   mark of it goes to its bucket: a line of every document costs its bucket one
   mark a chunk.
2. Runs. Neighbouring windows with one key form a run. The texts are read again,
   and each run with a repeated key sends its bytes to its key's bucket. Of equal
   runs a task sends the earliest it holds; the others are repeats throughout.
   Equal texts are one text here: all rows but the first of an equal text lose all.
3. Previous factors. A bucket sorts the suffixes at all window starts, to
   ``length`` bytes, takes the common prefixes of neighbours, finds for each the
   previous and the next smaller position in that order, and from them its
   previous factor. A window whose factor reaches ``length`` is a repeat.

Hashes only bring windows together; equality is decided on the bytes themselves.

Defined results: a null text is empty; texts shorter than ``length`` keep all;
of rows with equal text those of the smallest id are the first copy, and all of
them keep it; a null id comes after all others; matches never cross documents; an
empty table gives an empty table; texts of any length are used whole, in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, text_rows

LENGTH = 100
GRAM = 50
#: Text bytes that one bucket stands for.
BUCKET_BYTES = 12 << 20
LEAST_BUCKETS = 16
CHUNK_ANCHORS, CHUNK_DOCS = 1_000_000, 20_000
#: Bytes of runs that a task holds back to send them together.
CHUNK_BYTES = 24 << 20
SLICE_BYTES = 1 << 20
#: Windows that are sorted together, about; a key's windows are never parted.
PART_WINDOWS = 400_000
LAST = (1 << 63) - 1  # stands for a null id

_LETTER = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of all suffixes in their order, by prefix doubling."""
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - k)] = rank[k:]
        order = np.lexsort((second, rank))
        changed = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(changed)])
        rank = fresh
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def _match_with_smaller(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order, its common prefix with the nearest one before it of a smaller rank (position); 0 without one.

    ``common`` holds the prefixes of neighbours. Each suffix points to the one
    before it, and follows pointers over suffixes of greater rank, all at once:
    what lies between a suffix and its pointer always has a greater rank.
    """
    to = np.arange(-1, len(rank) - 1)
    low = np.concatenate([[0], common])[: len(rank)]
    active = np.flatnonzero(to >= 0)
    active = active[rank[to[active]] > rank[active]]
    while len(active):
        over = to[active]
        further, shared = to[over], np.minimum(low[active], low[over])
        to[active], low[active] = further, np.where(further >= 0, shared, 0)
        active = active[further >= 0]
        active = active[rank[to[active]] > rank[active]]
    return low


def factors_in_order(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors, in suffix order, from positions' ranks and neighbours' common prefixes."""
    return np.maximum(_match_with_smaller(rank, common), _match_with_smaller(rank[::-1], common[::-1])[::-1])


def longest_previous_factors(data: bytes) -> np.ndarray:
    """For each position the length of the longest string there that also starts earlier."""
    order = suffix_array(data)
    n = len(order)
    common = np.zeros(max(0, n - 1), np.int64)
    padded = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64), np.full(1, -1)])
    a, b, open_ = order[:-1].copy(), order[1:].copy(), np.arange(max(0, n - 1))
    while len(open_):  # neighbours' common prefixes, a byte a round
        longer = (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        a, b, open_ = a[longer] + 1, b[longer] + 1, open_[longer]
        common[open_] += 1
    out = np.zeros(n, np.int64)
    out[order] = factors_in_order(order, common)
    return out


class _Grams:
    """Hashes of all GRAM-byte strings of a slice."""

    def __init__(self):
        n = SLICE_BYTES + 4 * LENGTH
        self.up, self.down = (np.cumprod(np.array([1] + [b] * n, np.uint64), dtype=np.uint64) for b in (_BASE, _INVERSE))

    def of(self, data: np.ndarray, gram: int) -> np.ndarray:
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * self.up[:n], dtype=np.uint64, out=total[1:])
        h = (total[gram:] - total[:-gram]) * self.down[: n - gram + 1]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return h


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours."""
    pick_of = np.minimum if least else np.maximum
    have = 1
    while have * 2 <= width:
        x = pick_of(x[:-have], x[have:])
        have *= 2
    return x if have == width else pick_of(x[: len(x) - (width - have)], x[width - have :])


def slices(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first window start, bytes) of slices that hold every window of the text once."""
    for at in range(0, len(raw) - length + 1, SLICE_BYTES):
        yield at, np.frombuffer(raw, np.uint8, min(len(raw) - at, SLICE_BYTES + length - 1), at)


def window_keys(data: np.ndarray, grams: _Grams, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of each window, hashes at the anchors, one an occurrence)."""
    g = grams.of(data, gram)
    width = length - gram + 1
    keys = _sliding(g, width, least=True)
    # a gram is an anchor if it is the least of some window that holds it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), keys, np.zeros(width - 1, np.uint64)])
    return keys, g[_sliding(padded, width, least=False) == g]


def _bucket_key(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 40 more bits) of a hash."""
    return (h % np.uint64(buckets)).astype(np.int64), h >> np.uint64(24)


def _key(token: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """64 bits: a hash's 40 and its bucket's lowest 24."""
    return (token << np.uint64(24)) | (np.asarray(bucket).astype(np.uint64) & np.uint64(0xFFFFFF))


def _cuts(ordered: np.ndarray) -> np.ndarray:
    """Where stretches of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, np.int64)


ANCHOR_SCHEMA = "bucket int, chunk binary, tokens binary, places binary, settled binary, owners binary"
ANCHOR_KINDS = (pa.int32(), *[pa.binary()] * 5)
ANCHOR_NAMES = ["bucket", "chunk", "tokens", "places", "settled", "owners"]
#: Place of an anchor that its chunk has settled; a chunk has fewer documents.
SETTLED = 0xFFFF


def deal_anchors(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Anchor hashes of all documents, packed by chunk and bucket, and a directory of each chunk at a bucket below 0.

    A hash that occurs once in its chunk goes to its bucket with its document's
    place; one that occurs more often is repeated wherever else it stands. Its
    documents are listed with the directory, and its bucket gets one mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        found: list[np.ndarray] = []
        ids: list = []
        shas: list[bytes] = []
        sizes: list[int] = []
        met: set[bytes] = set()  # equal texts are one text: a chunk's copies have no anchors of their own
        held = 0

        def emit() -> pa.RecordBatch:
            chunk = hashlib.blake2b(b"".join(shas), digest_size=16).digest()
            known = np.array([i is not None for i in ids], np.uint8).tobytes()
            numbers = np.array([i or 0 for i in ids], np.int64).tobytes()
            bucket, token = _bucket_key(np.concatenate(found), buckets)
            place = np.repeat(np.arange(len(found), dtype=np.uint16), [len(f) for f in found])
            whole = (bucket.astype(np.uint64) << np.uint64(40)) | token
            order = np.argsort(whole, kind="stable")
            bucket, token, place, whole = (x[order] for x in (bucket, token, place, whole))
            again = np.concatenate([[False], whole[1:] == whole[:-1], [False]])[: len(whole) + 1]
            head, many = ~again[:-1], again[1:] | again[:-1]
            same_place = np.concatenate([[False], place[1:] == place[:-1]])[: len(many)]
            owner = many & ~(again[:-1] & same_place)
            settled = _key(token[owner], bucket[owner])
            cuts = _cuts(settled)
            rows = [(-1 - int.from_bytes(chunk[:4], "little") % buckets, chunk, b"".join(shas), np.array(sizes, np.int64).tobytes() + numbers + known,
                     settled[cuts[:-1]].tobytes(), np.diff(cuts).astype(np.uint32).tobytes() + place[owner].tobytes())]
            place = np.where(many, np.uint16(SETTLED), place)[head]
            bucket, token = bucket[head], token[head]
            cuts = _cuts(bucket)
            narrow = np.ascontiguousarray(token).view(np.uint8).reshape(-1, 8)[:, :5]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows.append((int(bucket[x]), chunk, narrow[x:y].tobytes(), place[x:y].tobytes(), None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), ANCHOR_KINDS)], names=ANCHOR_NAMES)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                sha = hashlib.sha256(raw).digest()
                own = [window_keys(data, grams, length, gram)[1] for _, data in slices(raw, length)] if sha not in met else []
                found.append(np.concatenate(own) if own else np.zeros(0, np.uint64))
                ids.append(key.as_py())
                shas.append(sha)
                met.add(sha)
                sizes.append(len(raw))
                held += len(found[-1])
                if held >= CHUNK_ANCHORS or len(found) >= CHUNK_DOCS:
                    yield emit()
                    found, ids, shas, sizes, met, held = [], [], [], [], set(), 0
        if found:
            yield emit()

    return docs.mapInArrow(run, ANCHOR_SCHEMA)


def _wide(raw: list[bytes]) -> np.ndarray:
    narrow = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :5] = narrow
    return wide.view("<u8").ravel()


def keep_repeated(dealt: DataFrame) -> DataFrame:
    """Of each bucket the anchors whose hash occurs at least twice, but for marks; directories pass through."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        tokens = _wide(table.column("tokens").to_pylist())
        order = np.argsort(tokens)
        ranked = tokens[order]
        same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
        repeated = np.empty(len(tokens), bool)
        repeated[order] = same[1:] | same[:-1]
        out, at = [], 0
        for chunk, places in zip(table.column("chunk").to_pylist(), table.column("places").to_pylist()):
            place = np.frombuffer(places, np.uint16)
            part = slice(at, at + len(place))
            at += len(place)
            own = repeated[part] & (place != SETTLED)
            if own.any():
                narrow = np.ascontiguousarray(tokens[part][own]).view(np.uint8).reshape(-1, 8)[:, :5]
                out.append((key[0].as_py(), chunk, narrow.tobytes(), place[own].tobytes(), None, None))
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, ANCHOR_KINDS)], names=ANCHOR_NAMES)

    return dealt.groupBy("bucket").applyInArrow(run, ANCHOR_SCHEMA)


def _directory(shas: bytes, rest: bytes) -> tuple[list[bytes], np.ndarray, list]:
    n = len(shas) // 32
    known = np.frombuffer(rest, np.uint8, n, 16 * n)
    ids = np.frombuffer(rest, np.int64, n, 8 * n)
    return [shas[32 * i : 32 * i + 32] for i in range(n)], np.frombuffer(rest, np.int64, n), [int(i) if k else None for i, k in zip(ids, known)]


def documents_of(repeated: DataFrame) -> DataFrame:
    """doc_id, sha (of the text's bytes), n_bytes of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                shas, sizes, ids = _directory(a.as_py(), b.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array(sizes)], names=["doc_id", "sha", "n_bytes"])

    return repeated.filter("bucket < 0").select("tokens", "places").mapInArrow(run, "doc_id long, sha binary, n_bytes long")


def keys_of(repeated: DataFrame) -> DataFrame:
    """sha and its repeated keys (64-bit), for texts that have any."""

    def run(table: pa.Table) -> pa.Table:
        shas: list[bytes] = []
        parts = []
        for r in table.to_pylist():
            if r["bucket"] < 0:
                shas = _directory(r["tokens"], r["places"])[0]
                keys = np.frombuffer(r["settled"], np.uint64)
                times = np.frombuffer(r["owners"], np.uint32, len(keys))
                parts.append((np.repeat(keys, times), np.frombuffer(r["owners"], np.uint16, -1, 4 * len(keys))))
            else:
                parts.append((_key(_wide([r["tokens"]]), r["bucket"]), np.frombuffer(r["places"], np.uint16)))
        out: dict[bytes, bytes] = {}
        if parts and shas:
            token, place = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(place, kind="stable")
            token, cuts = token[order], np.searchsorted(place[order], np.arange(len(shas) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                out.setdefault(shas[i], np.sort(token[cuts[i] : cuts[i + 1]]).tobytes())
        return pa.table([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["sha", "keys"])

    return repeated.groupBy("chunk").applyInArrow(run, "sha binary, keys binary")


RUN_SCHEMA = "bucket int, keys binary, shas binary, firsts binary, starts binary, counts binary, data binary"


def _position(run: tuple) -> tuple[int, int, int]:
    """What orders runs: the id, eight bytes of the text's hash, the start."""
    _, sha, first, start, _ = run
    return first, int.from_bytes(sha[:8], "little"), start


def deal_runs(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Runs with repeated keys, packed by bucket. texts: sha, first (id), keys, text.

    Equal runs of a task are folded to the earliest; the spans of the others
    (``starts``, and their ends as ``counts``) stand at a bucket below 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        held: dict[int, dict[bytes, tuple]] = {}
        repeats: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            rows = []
            for b, r in held.items():
                columns = list(zip(*r.values()))
                rows.append((b, np.array(columns[0], np.uint64).tobytes(), b"".join(columns[1]), np.array(columns[2], np.int64).tobytes(),
                             np.array(columns[3], np.int64).tobytes(), np.array(columns[4], np.int64).tobytes(), b"".join(r)))
            if repeats:
                sha, start, end = zip(*repeats)
                rows.append((-1 - int.from_bytes(sha[0][:4], "little") % buckets, None, b"".join(sha), None,
                             np.array(start, np.int64).tobytes(), np.array(end, np.int64).tobytes(), None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))],
                                              names=["bucket", "keys", "shas", "firsts", "starts", "counts", "data"])

        for batch in batches:
            for sha, first, known, text in zip(*(batch.column(k) for k in range(4))):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                sha, first = sha.as_py(), first.as_py()
                wanted = np.frombuffer(known.as_py(), np.uint64)
                for at, data in slices(raw, length):
                    h = window_keys(data, grams, length, gram)[0]
                    cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
                    bucket, token = _bucket_key(h[cuts[:-1]], buckets)
                    key = _key(token, bucket)
                    place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    for i in np.flatnonzero(wanted[place] == key).tolist():
                        s, e = int(cuts[i]), int(cuts[i + 1])
                        part = raw[at + s : at + e - 1 + length]
                        new = (int(key[i]), sha, first, at + s, e - s)
                        runs = held.setdefault(int(bucket[i]), {})
                        old = runs.setdefault(part, new)
                        if old is new:
                            size += len(part) + 72
                        elif _position(old) != _position(new):  # equal positions: one row read twice
                            runs[part], later = sorted((old, new), key=_position)
                            repeats.append((later[1], later[3], later[3] + len(part)))
                            size += 48
                    if size >= CHUNK_BYTES:
                        yield emit()
                        held, repeats, size = {}, [], 0
        if held:
            yield emit()

    return texts.select("sha", "first", "keys", "text").mapInArrow(run, RUN_SCHEMA)


def previous_factors(starts: np.ndarray, data: np.ndarray, position: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """Longest previous factors, up to ``length`` bytes, of the suffixes at ``starts`` (of ``data``), among themselves.

    Suffixes are sorted to ``length`` bytes, as big-endian words, ties by
    position. ``position`` says which of two suffixes is earlier.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = []
    for at in range(0, length, 8):
        w = np.ascontiguousarray(eight[starts + at]).view(">u8").ravel().astype(np.uint64)
        if at + 8 > length:
            w &= np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (at + 8 - length))) & 0xFFFFFFFFFFFFFFFF)
        words.append(w)
    earlier = np.empty(len(starts), np.int64)
    earlier[np.lexsort(position[::-1])] = np.arange(len(starts))
    order = np.lexsort((earlier, *words[::-1]))
    common = np.zeros(max(0, len(starts) - 1), np.int64)
    open_ = np.arange(len(common))  # neighbours that have agreed so far
    for w in words:
        ranked = w[order]
        differ = ranked[open_ + 1] ^ ranked[open_]
        common[open_] += 8
        ends = np.flatnonzero(differ)
        for k in range(8):  # less the bytes from the first that differs on
            common[open_[ends]] -= (differ[ends] >> np.uint64(8 * k)) > 0
        open_ = open_[differ == 0]
    out = np.empty(len(starts), np.int64)
    out[order] = factors_in_order(earlier[order], np.minimum(common, length))
    return out


def _by_text(sha_raw: np.ndarray, of: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Table:
    """The union of each text's spans: sha, starts, ends. Span i is one of the text ``sha_raw[of[i]]``."""
    if not len(of):
        return pa.table([pa.array([], pa.binary())] * 3, names=["sha", "starts", "ends"])
    names, place = np.unique(sha_raw, axis=0, return_inverse=True)
    text = place.ravel()[of]
    order = np.lexsort((s, text))
    text, s, e = text[order], s[order], e[order]
    reach = np.maximum.accumulate(e + text * (1 << 40)) - text * (1 << 40)  # a text is far shorter than that
    heads = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (s[1:] > reach[:-1])]))
    tails = np.concatenate([heads[1:], [len(s)]]) - 1
    text, s, e = text[heads], s[heads], reach[tails]
    cuts = _cuts(text)
    out = [(names[text[x]].tobytes(), s[x:y].tobytes(), e[x:y].tobytes()) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return pa.table([pa.array(c, pa.binary()) for c in zip(*out)], names=["sha", "starts", "ends"])


def find_repeats(runs: DataFrame, length: int) -> DataFrame:
    """sha, starts, ends (64-bit, packed) of repeated stretches, one row a text and bucket."""

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        column = lambda c: b"".join(table.column(c).to_pylist())
        if group[0].as_py() < 0:  # spans that tasks have settled
            s, e = (np.frombuffer(column(c), np.int64) for c in ("starts", "counts"))
            return _by_text(np.frombuffer(column("shas"), np.uint8).reshape(-1, 32), np.arange(len(s)), s, e)
        key, first, start, count = (np.frombuffer(column(c), k) for c, k in (("keys", np.uint64), ("firsts", np.int64), ("starts", np.int64), ("counts", np.int64)))
        sha_raw = np.frombuffer(column("shas"), np.uint8).reshape(-1, 32)
        sha = np.ascontiguousarray(sha_raw[:, :8]).view("<u8").ravel()
        data = np.frombuffer(column("data"), np.uint8)
        size = count + length - 1
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        # equal runs in the order of positions: the first stands for all, the others are repeats throughout
        mark = np.array([hash_of(data[a : a + s]) for a, s in zip(at.tolist(), size.tolist())], dtype="V16").view("<u8").reshape(-1, 2)
        order = np.lexsort((start, sha, first, mark[:, 1], mark[:, 0], size))
        again = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        again[a] = (size[a] == size[b]) & (mark[a] == mark[b]).all(axis=1)
        twice = np.zeros(len(order), bool)  # one row read twice
        ranked = np.lexsort((start, sha, first))
        a, b = ranked[1:], ranked[:-1]
        twice[a] = (start[a] == start[b]) & (sha[a] == sha[b]) & (first[a] == first[b])
        spans_of, spans_start, spans_end = [], [], []
        whole = np.flatnonzero(again & ~twice)
        spans_of.append(whole)
        spans_start.append(start[whole])
        spans_end.append(start[whole] + size[whole])
        # equal windows have one key: whole keys are taken until a part has enough windows
        lone = np.flatnonzero(~again)
        lone = lone[np.argsort(key[lone], kind="stable")]
        firsts = np.flatnonzero(np.concatenate([[True], key[lone][1:] != key[lone][:-1]])) if len(lone) else lone
        before = np.concatenate([[0], np.cumsum(count[lone])])[firsts]
        heads = firsts[np.concatenate([[True], np.diff(before // PART_WINDOWS) > 0])] if len(lone) else lone
        for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(lone)]):
            part = lone[x:y]
            n = count[part]
            owner = np.repeat(part, n)
            shift = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
            hit = previous_factors(at[owner] + shift, data, (first[owner], sha[owner], start[owner] + shift), length) >= length
            spans_of.append(owner[hit])
            spans_start.append((start[owner] + shift)[hit])
            spans_end.append((start[owner] + shift)[hit] + length)
        of, s, e = (np.concatenate(x) for x in (spans_of, spans_start, spans_end))
        return _by_text(sha_raw, of, s, e)

    return runs.groupBy("bucket").applyInArrow(run, "sha binary, starts binary, ends binary")


def hash_of(part: np.ndarray) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of a union of stretches."""
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    heads = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[heads], reach[np.concatenate([heads[1:], [len(s)]]) - 1] if len(s) else reach


SPAN_SCHEMA = "sha binary, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def cut_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """What is left of each text with repeats: SPAN_SCHEMA. texts: sha, text; spans: sha, starts, ends."""
    gathered = spans.groupBy("sha").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sha, text, starts, ends in zip(*(batch.column(k) for k in range(4))):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                s, e = merged(np.frombuffer(b"".join(starts.as_py()), np.int64), np.frombuffer(b"".join(ends.as_py()), np.int64))
                left = hashlib.sha256()
                at = 0
                for x, y in zip(s.tolist(), e.tolist()):
                    left.update(raw[at:x])
                    at = y
                left.update(raw[at:])
                out.append((sha.as_py(), int((e - s).sum()), len(s), left.hexdigest(), s.tolist(), e.tolist()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["sha", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names=names)

    return texts.select("sha", "text").join(gathered, "sha").select("sha", "text", "starts", "ends").mapInArrow(run, SPAN_SCHEMA).dropDuplicates(["sha"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed stretches (starts, ends) of every row."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = text_rows(pick(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    repeated = scratch.save(keep_repeated(deal_anchors(rows, buckets, length, gram)))
    documents = scratch.save(documents_of(repeated))
    firsts = scratch.save(documents.groupBy("sha").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("first")))
    keyed = keys_of(repeated).dropDuplicates(["sha"]).join(firsts, "sha")
    keyed = scratch.save(keyed)
    own = rows.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.coalesce("doc_id", F.lit(LAST)).alias("first"), "text")
    texts = scratch.save(own.join(keyed, ["sha", "first"]).select("sha", "first", "keys", "text"))
    scratch.drop(repeated, keyed)
    spans = scratch.save(find_repeats(deal_runs(texts, buckets, length, gram), length))
    cut = scratch.save(cut_texts(texts, spans))
    copy = (F.coalesce("doc_id", F.lit(LAST)) != F.col("first")) & (F.col("n_bytes") >= length)
    whole = lambda c: F.when(copy, c)
    return documents.join(firsts, "sha").join(cut, "sha", "left").select(
        "doc_id", "n_bytes",
        whole(F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        whole(F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        whole(F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        whole(F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", F.array().cast("array<long>"))).alias("starts"),
        whole(F.array(F.col("n_bytes"))).otherwise(F.coalesce("ends", F.array().cast("array<long>"))).alias("ends"))
