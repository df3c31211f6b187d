"""Best-two-fit packing of tokenised documents into fixed-length sequences.

``tokenised_pieces`` turns texts into token pieces, ``best_two_fit`` packs one
group of pieces, ``pack_documents`` runs both over a whole table.

Defined results: a null or empty text is the end token alone; repeated rows are
packed once each; a null document id is carried through as null; an empty table
gives an empty table; a text of any length is tokenised whole. Only documents of
more than ``capacity`` tokens are cut, the remainder coming first.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, text_rows, worker_cache

CAPACITY = 1024
END_ID = 2
#: Pieces that one packing task gets on average; a task loses about one partly filled sequence.
PIECES_A_GROUP = 8192
#: Entries that a worker's token cache may hold before it starts afresh (memory only; no effect on results).
CACHE_ENTRIES = 300_000

#: The byte-level pre-tokeniser's pieces (a fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


class WordCachedTokenizer:
    """Token ids of whole texts, each space-separated word encoded once.

    The pre-tokeniser starts a new piece at a space that stands between two
    non-space characters, and cuts out a line feed that does. Words between such
    places are therefore encoded independently of their neighbours, and the ids
    of a text are those of its words in order. A text with any other white space
    next to such a place is encoded in one call.

    A byte-level BPE file whose merges are listed in the order of their ids is
    run by tiktoken, which gives the same ids in a fraction of the time; any
    other, and every text that holds a string of an added token, by the
    tokenizers library, which gives such a string its own id.
    """

    def __init__(self, path: str):
        self._core, self._added, self._whole = _byte_bpe(path)
        self.cache: dict[str, bytes | None] = {}

    @classmethod
    def shared(cls, path: str) -> WordCachedTokenizer:
        """The worker process's own, loaded once."""
        kept = worker_cache()
        if ("tokenizer", path) not in kept:
            kept["tokenizer", path] = cls(path)
        return kept["tokenizer", path]

    def _encode(self, text: str) -> bytes:
        return array("I", self._core(text)).tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE_ENTRIES:
            self.cache.clear()
        for w in words:
            body = w[1:] if w[:1] == "\n" else w
            if not body or body[0].isspace() or body[-1].isspace():
                self.cache[w] = None  # white space touches the cut: only whole texts are safe
            else:
                self.cache[w] = self._encode(w if w[0] == "\n" else " " + w)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if not text:
            return b""
        if self._added and self._added.search(text):
            return array("I", self._whole(text)).tobytes()
        first, *words = text.replace("\n", " \n").split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return self._encode(text)
        known = self.cache
        try:
            return self._encode(first) + b"".join(map(known.__getitem__, words))
        except KeyError:
            self._learn(set(words).difference(known) if len(words) < CACHE_ENTRIES else set(words))
        except TypeError:
            return self._encode(text)
        parts = [known.get(w) for w in words]
        return self._encode(text) if None in parts else self._encode(first) + b"".join(parts)


def _byte_bpe(path: str) -> tuple[Callable[[str], list[int]], re.Pattern | None, Callable[[str], list[int]]]:
    """The file's encoding of texts without added tokens, what finds such tokens, and the library's own encoding."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    whole = lambda text: loaded.encode(text, add_special_tokens=False).ids
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    added = {a["content"] for a in spec.get("added_tokens", ())}
    merged = [(m if isinstance(m, str) else " ".join(m)).replace(" ", "") for m in model.get("merges", ())]
    plain = (model.get("type") == "BPE" and not model.get("dropout") and not spec.get("normalizer") and before.get("type") == "ByteLevel"
             and before.get("use_regex") and not before.get("add_prefix_space"))
    if not plain or any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merged)):
        return whole, re.compile("(?s)."), whole
    import tiktoken

    # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    core = tiktoken.Encoding("byte-bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return core, re.compile("|".join(map(re.escape, sorted(added)))) if added else None, whole


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens, the remainder first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (head if s == 0 and head else capacity)) for s in starts]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordCachedTokenizer.shared(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0), []
            source = []
            for i, text in enumerate(batch.column(1)):
                raw = model.ids(text.as_py() or "") + end
                for k, (start, length) in enumerate(piece_bounds(len(raw) // 4, capacity)):
                    rows.append((k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    source.append(i)
            cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(source, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, j]) for j in (1, 2, 3))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return text_rows(pick(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)


def _best_pair(count: np.ndarray, room: int) -> tuple[int, int]:
    """Two available sizes whose sum is as large as room allows; (0, 0) if there are none."""
    sizes = np.arange(room + 1)
    largest = np.maximum.accumulate(np.where(count[: room + 1] > 0, sizes, 0))  # largest available size up to each
    a = np.flatnonzero(count[: room + 1])
    b = largest[room - a]
    lone = (b == a) & (count[a] < 2)
    b = np.where(lone, largest[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    if not len(total) or total.max() == 0:
        return 0, 0
    k = int(total.argmax())
    return int(a[k]), int(b[k])


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item.

    A bin is filled greedily with the largest item that fits. While a gap is
    left, its smallest item makes room, and the two unpacked items that fill the
    widened gap best take its place if they leave less of it empty. Items of one
    size are interchangeable, so the search runs over sizes, not over items.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    left = count.copy()
    open_sizes = sum(1 << int(s) for s in np.flatnonzero(left))
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)

    def take(size: int) -> None:
        nonlocal open_sizes
        left[size] -= 1
        if not left[size]:
            open_sizes &= ~(1 << size)

    number = 0
    while open_sizes:
        items: list[int] = []
        gap = capacity
        while True:
            fitting = open_sizes & ((1 << (gap + 1)) - 1)
            if not fitting:
                break
            size = fitting.bit_length() - 1
            take(size)
            items.append(size)
            gap -= size
        while gap and open_sizes:
            smallest = items[-1]
            a, b = _best_pair(left, gap + smallest)
            if a + b <= smallest:
                break
            take(a)
            take(b)
            left[smallest] += 1
            open_sizes |= 1 << smallest
            items[-1:] = [a, b]
            items.sort(reverse=True)
            gap = gap + smallest - a - b
        at = 0
        for size in items:
            item = order[first[size]]
            first[size] += 1
            bins[item], offsets[item] = number, at
            at += size
        number += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset. Pieces are dealt evenly over ``groups`` and packed group by group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets = best_two_fit(lengths, capacity)
        group = table.column("grp")[0].as_py()
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offsets))

    grp = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("long")
    return pieces.withColumn("grp", grp).groupBy("grp").applyInArrow(run, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   pieces_a_group: int = PIECES_A_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``capacity`` tokens.

    Texts never move: they are tokenised where they are read, and only five
    numbers a piece are written and shuffled. The number of packing tasks grows
    with the number of pieces, so a task's size does not.
    """
    pieces = Scratch(docs.sparkSession, "packing").save(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    return pack_pieces(pieces, max(1, -(-pieces.count() // pieces_a_group)), capacity)
