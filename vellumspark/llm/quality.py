"""Quality classification: histogram gradient-boosted trees over document statistics.

``document_statistics`` measures every text, ``fit_trees`` boosts regression trees
on binned statistics with logistic loss, ``FlatTrees`` holds all trees in arrays
and scores a batch of rows by one vectorised walk, level by level.

Statistics are taken in one pass over the texts; they are written once, for the
labelled rows to be learned from and for all rows to be scored.

Defined results: a null text counts as empty, and empty texts are scored by the
same trees; rows without a label teach nothing; a document with several labels
teaches once for each; repeated rows are scored alike; without any usable label,
or with one class only, every score is the class's share (0.5 without any); an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, text_rows

STATISTICS = (
    "bytes", "words", "mean_word", "sd_word", "longest_word", "distinct_words", "lines", "mean_line", "distinct_lines", "repeated_line_bytes",
    "upper", "digit", "punctuation", "symbol", "space", "wide", "control", "stop_like", "short_lines", "bullet_lines", "ends_sentence", "commas",
    "periods", "pipes", "runs", "capital_words", "digit_words", "symbol_words", "top_word", "top_line", "byte_entropy", "deflated",
)
#: Rows that the fit takes at most, counted after labels have met their documents; chosen by a hash.
SAMPLE_ROWS = 100_000
BINS = 64
TREES = 120
DEPTH = 5
RATE = 0.1
LEAF_ROWS = 20
RIDGE = 1.0

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 punctuation, 5 symbol, 6 space, 7 wide, 8 control
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (7 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 6 if _c in " \t\n\r\x0b\f"
                 else 8 if _b < 32 or _b == 127 else 4 if _c in ".,;:!?'\"()-" else 5)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of one whole text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=9)
    kind = _KIND[data]
    n = len(raw)
    words = raw.split()
    w = len(words) or 1
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = raw.split(b"\n")
    line_counts = Counter(lines)
    distinct_lines = line_counts.keys()
    repeated = n - sum(map(len, distinct_lines)) - len(lines) if len(distinct_lines) < len(lines) else 0
    seen = Counter(words)
    share = counts[counts > 0] / n
    # the eight most frequent words' share stands for function words in any language
    top = [c for _, c in seen.most_common(8)]
    starts = np.flatnonzero((kind[1:] != 6) & (kind[:-1] == 6)) + 1  # of words, but for one at the text's start
    first = np.bincount(kind[starts], minlength=9)
    ends = np.flatnonzero((kind[:-1] != 6) & (kind[1:] == 6))
    capital, digits, symbols = first[2], first[3], int((kind[ends] == 5).sum())
    runs = int((data[1:] == data[:-1]).sum())
    return [
        float(n), float(len(words)), float(lengths.mean()), float(lengths.std()), float(lengths.max()), len(seen) / w,
        float(len(lines)), n / len(lines), len(distinct_lines) / len(lines), max(0, repeated) / n,
        kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, sum(top) / w,
        sum(len(x) < 20 for x in lines) / len(lines), sum(x[:1] in (b"-", b"*") for x in lines) / len(lines),
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), counts[44] / n, counts[46] / n, counts[124] / n, runs / n,
        capital / w, digits / w, symbols / w, (top[0] if top else 0) / w, max(line_counts.values()) / len(lines),
        float(-(share * np.log2(share)).sum()), len(zlib.compress(raw, 1)) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array ``stats`` of every row. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return text_rows(pick(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<float>")


class FlatTrees:
    """All trees as full binary trees in arrays of shape (trees, nodes): feature, cut, leaf value."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.cut, self.value, self.base = feature, cut, value, base

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics; all rows walk all trees at once."""
        n, (trees, inner) = len(rows), self.feature.shape
        total = np.full(n, self.base)
        for at in range(0, n, 4096):
            part = rows[at : at + 4096]
            each = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            tree = np.arange(trees)[None, :]
            while node[0, 0] < inner:
                node = 2 * node + 1 + (part[each, self.feature[tree, node]] > self.cut[tree, node])
            total[at : at + 4096] += self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit_trees(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
              leaf_rows: int = LEAF_ROWS, ridge: float = RIDGE) -> FlatTrees:
    """Boost on binned statistics. Each level's histograms of gradient and curvature are one bincount over (node, feature, bin)."""
    n, width = rows.shape if len(rows) else (0, len(STATISTICS))
    inner = (1 << depth) - 1
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf, np.float32)
    value = np.zeros((trees, inner + 1))
    share = labels.mean() if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        base = 0.0 if n == 0 else (50.0 if share else -50.0)
        return FlatTrees(feature, cut, value, base)
    base = float(np.log(share / (1 - share)))
    edges = np.full((width, bins - 1), np.inf, np.float32)
    binned = np.zeros((n, width), np.int64)
    for f in range(width):
        own = np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))
        edges[f, : len(own)] = own
        binned[:, f] = np.searchsorted(own, rows[:, f], side="left")  # row <= edge falls in the edge's bin or before
    flat = binned + np.arange(width) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = p - labels, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            where = ((node - first)[:, None] * (width * bins) + flat).ravel()
            size = many * width * bins
            g, h, c = (np.bincount(where, weights=np.repeat(x, width), minlength=size).reshape(many, width, bins).cumsum(axis=2)
                       for x in (gradient, curve, np.ones(n)))
            left_g, left_h, left_c = g[:, :, :-1], h[:, :, :-1], c[:, :, :-1]
            all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_c < leaf_rows) | (all_c - left_c < leaf_rows)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            top = gain.reshape(many, -1)[np.arange(many), best]
            f, b = best // (bins - 1), best % (bins - 1)
            split = top > 1e-9
            feature[t, first : first + many] = np.where(split, f, 0)
            cut[t, first : first + many] = np.where(split, edges[f, b], np.inf)
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > cut[t, node])
        leaf = node - inner
        sums = np.bincount(leaf, weights=gradient, minlength=inner + 1)
        curves = np.bincount(leaf, weights=curve, minlength=inner + 1)
        value[t] = -rate * sums / (curves + ridge)
        margin += value[t][leaf]
    return FlatTrees(feature, cut, value, base)


def fit_on_labels(stats: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS, label_col: str = "quality",
                  id_col: str = "doc_id") -> FlatTrees:
    """Fit on the labelled rows that ``learn`` selects, ``sample_rows`` of them at most: those of the least hash. A label counts once an id."""
    known = pick(labels, label_id=id_col, label=label_col).filter(F.col("label").isNotNull()).filter(learn).distinct()
    rows = stats.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "stats", "label")
    n, place = rows.count(), F.xxhash64("doc_id", "label")
    if n > sample_rows:  # about half as many again, then exactly so many
        share = F.pmod(place, F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.5 * sample_rows / n)) + 1000
        rows = rows.filter(share).orderBy(F.pmod(place, F.lit(1_000_000)), "doc_id", "label", "stats").limit(sample_rows)
    rows = rows.toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    x = np.array(rows["stats"].tolist(), dtype=np.float32).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, rows["label"].to_numpy(dtype=np.float64))


def score_statistics(stats: DataFrame, model: FlatTrees) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float32).reshape(batch.num_rows, len(STATISTICS))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score, predicted for every document. ``learn`` is a condition on ``label_id``."""
    stats = Scratch(docs.sparkSession, "quality").save(document_statistics(docs, id_col, text_col))
    return score_statistics(stats, fit_on_labels(stats, labels, learn, sample_rows, label_col, id_col))
