"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds the
permuted (rotated) vectors of its letters by elementwise product; a text's vector
bundles (sums) the vectors of its trigrams; a language's prototype bundles the
trigrams of its training texts, each text with equal weight. A text gets the
language whose prototype has the greatest cosine with it.

Prototypes are sums over all training rows, gathered as partial sums of one
vector a language and task, so what is shuffled does not grow with the texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
rows with a null language teach nothing; equal texts get equal results; ties go
to the language that comes first; without any training row all texts are ``und``;
an empty table gives an empty table; texts are used whole, in slices that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_rows, worker_cache

DIMENSIONS = 512
SEED = 20_240
ALPHABET = 64
#: Code points in one slice of a long text; neighbouring slices share two.
SLICE = 1 << 18
UNDETERMINED = "und"
#: Trigrams of a text under which its cosines are left out of account when texts are rejected.
LEAST_TRIGRAMS = 150

PREDICTION_SCHEMA = "doc_id long, lang_pred string, score double"


class Encoder:
    """Texts to document vectors. Symbol 0 is the word boundary; a-z are 1 to 26, other letters are spread over the rest."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (ALPHABET, dimensions), dtype=np.int8) * 2 - 1
        self.first = np.roll(letters, 2, axis=1)
        self.second = np.roll(letters, 1, axis=1)
        self.third = letters.astype(np.float32)
        self.pairs = (self.first[:, None, :] * self.second[None, :, :]).reshape(-1, dimensions).astype(np.float32)
        self.symbols = np.zeros(0x3000, np.uint8)
        for cp in range(0x3000):
            self.symbols[cp] = self._symbol(cp)

    @classmethod
    def shared(cls, dimensions: int, seed: int) -> "Encoder":
        """The worker process's own, made once."""
        kept = worker_cache()
        if ("encoder", dimensions, seed) not in kept:
            kept["encoder", dimensions, seed] = cls(dimensions, seed)
        return kept["encoder", dimensions, seed]

    @staticmethod
    def _symbol(cp: int) -> int:
        c = chr(cp).lower()[0]
        if not c.isalpha():
            return 0
        return ord(c) - 96 if "a" <= c <= "z" else 27 + (ord(c) * 2654435761 >> 7) % (ALPHABET - 27)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = self.symbols[np.minimum(points, 0x2FFF)]
        far = np.flatnonzero(points >= 0x2FFF)
        for i in far.tolist():
            codes[i] = self._symbol(int(points[i]))
        return codes

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams of the whole text, with counts; None without a letter."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        letters = False
        for at in range(0, max(1, len(text)), SLICE):
            codes = self.codes(text[max(0, at - 2) : at + SLICE]).astype(np.int32)
            letters = letters or bool(codes.any())
            if at == 0:
                codes = np.concatenate([[0], codes]).astype(np.int32)
            if at + SLICE >= len(text):
                codes = np.concatenate([codes, [0]]).astype(np.int32)
            grams = (codes[:-2] * ALPHABET + codes[1:-1]) * ALPHABET + codes[2:]
            grams = grams[(codes[1:-1] != 0) | ((codes[:-2] != 0) & (codes[2:] != 0))]  # not two boundaries in a row
            found.append(np.unique(grams, return_counts=True))
        if not letters:
            return None
        if len(found) == 1:
            return found[0]
        grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        return grams, np.bincount(place, weights=np.concatenate([c for _, c in found])).astype(np.int64)

    def vector(self, text: str | None) -> np.ndarray | None:
        """Unit vector of a text; None if it has no letter."""
        found = self.trigrams(text) if text else None
        if found is None:
            return None
        total = self.bundle(*found)
        norm = float(np.linalg.norm(total))
        return total / norm if norm else total

    def bundle(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of trigram vectors."""
        total = np.zeros(self.third.shape[1], np.float64)
        weights = weights.astype(np.float32)
        for at in range(0, len(grams), 1024):
            g = grams[at : at + 1024]
            bound = self.pairs[g // ALPHABET]
            bound *= self.third[g % ALPHABET]
            total += weights[at : at + 1024] @ bound
        return total


def train_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS,
                     seed: int = SEED) -> dict[str, list[float]]:
    """Unit prototype of each non-null language of ``docs``.

    Every text is used. A task sends one partial sum a language; sums are of
    whole millionths, so their order does not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(dimensions, seed)
        weights: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                found = encoder.trigrams(text.as_py())
                if found is not None:
                    grams, counts = found
                    own = weights.setdefault(lang.as_py(), np.zeros(ALPHABET**3))
                    own[grams] += counts / counts.sum()
        langs = sorted(weights)
        for x in langs:
            grams = np.flatnonzero(weights[x])
            total = np.rint(encoder.bundle(grams, weights[x][grams]) * 1e6).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["lang", "sums"])

    rows = text_rows(pick(docs, text=text_col, lang=lang_col)).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    parts = rows.select("text", "lang").mapInArrow(run, "lang string, sums array<long>")
    at = parts.select("lang", F.posexplode("sums").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    gathered = at.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("kv")).select("lang", F.col("kv.v").alias("sums"))
    out = {}
    for row in gathered.collect():  # one vector a language
        v = np.array(row["sums"], dtype=np.float64)
        norm = float(np.linalg.norm(v))
        out[row["lang"]] = (v / norm if norm else v).tolist()
    return out


def predict_language(docs: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text",
                     dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred, score (cosine, at least 0) of every row. One pass, no shuffle."""
    langs = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in langs], dtype=np.float32).reshape(len(langs), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(dimensions, seed)
        for batch in batches:
            pred, score = [], []
            for text in batch.column(1):
                p, s = classify(encoder, matrix, langs, text.as_py())
                pred.append(p)
                score.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return text_rows(pick(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PREDICTION_SCHEMA)


def classify(encoder: Encoder, matrix: np.ndarray, langs: list[str], text: str | None) -> tuple[str, float]:
    v = encoder.vector(text) if langs else None
    if v is None:
        return UNDETERMINED, 0.0
    cosines = matrix @ v
    best = int(np.argmax(cosines))
    return langs[best], float(min(1.0, max(0.0, cosines[best])))


def identified(encoder: Encoder, matrix: np.ndarray, text: str | None, least_score: float, least_trigrams: int) -> bool:
    """Whether a text has a letter and is not, by at least so many trigrams, unlike every prototype."""
    found = encoder.trigrams(text) if text else None
    if found is None:
        return False
    if not len(matrix) or int(found[1].sum()) < least_trigrams:
        return True
    v = encoder.bundle(*found)
    return float((matrix @ v).max()) >= least_score * float(np.linalg.norm(v))


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that ``learn`` selects, then predict every row."""
    prototypes = train_prototypes(docs.filter(learn), text_col, lang_col)
    return predict_language(docs, prototypes, id_col, text_col)


def keep_identified(docs: DataFrame, prototypes: dict[str, list[float]], least_score: float, least_trigrams: int = LEAST_TRIGRAMS,
                    text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """The rows whose text has a language, with all their columns.

    A text without a letter has none, nor has one whose cosine with every
    prototype is under ``least_score``. Fewer than ``least_trigrams`` trigrams
    prove nothing against a text, and without prototypes nothing can be told
    apart: such texts stay if they have a letter.
    """
    langs = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in langs], dtype=np.float32).reshape(len(langs), dimensions)
    text_rows(docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"))  # columns of any name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(dimensions, seed)
        for batch in batches:
            texts = batch.column(0).field(text_col)
            yield batch.filter(pa.array([identified(encoder, matrix, t.as_py(), least_score, least_trigrams) for t in texts], pa.bool_()))

    kept = packed.mapInArrow(run, packed.schema)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
