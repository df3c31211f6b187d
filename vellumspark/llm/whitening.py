"""Whitening of embeddings with an exact covariance, by digit-slice matrix products.

Entries become integers floor(256 * c). Tasks multiply blocks of integer rows by
float64 BLAS on digit slices small enough that no product is rounded, put slices
together as big integers and send one matrix a task; its rows are merged side by
side. What reaches the driver is the sum, a square of the dimension. Centring
happens on integers too: n^2 * covariance = n * sum(x x') - S S'. Eigenvectors
start from LAPACK and are refined on the integers, by the same exact products,
so that small eigenvalues beside large ones keep their digits.

The fit list holds each distinct integer vector once; copies fold in their task
before anything is shuffled, and vectors travel as a byte or two an entry.

Defined results: a vector that is null or holds a null or non-finite entry is left
out, and so is one of another length than most have (the smaller of equally
common lengths); repeated rows are returned each, and counted once in the fit;
a null id stays null; entries beyond 64 bits become the nearest 64-bit integer,
and a deviation beyond 64 bits is null; components whose eigenvalue is zero are
not returned, as nothing can be divided by it, so fewer than two distinct vectors
give no rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import Scratch
from .integers import bit_length, exact_product, floors, pack, sums_of_squares, unpack, usable_vectors

SCALE = 256
COMPONENTS = 4
#: Rows of one matrix product.
BLOCK = 4096
#: Bits of one word of a merged big integer; a sum over 2^31 tasks still fits a long.
WORD_BITS = 32
#: Fractional bits of refined eigenvectors, beyond those of the trace of n^2 * covariance; of these, what an eigenvalue that isn't zero reaches.
EXTRA_BITS, ZERO_BITS = 64, 20
#: Rounds of refinement at most; two or three settle.
REFINEMENTS = 12


def fit_list(vectors: DataFrame, length: int, scale: int, scratch: Scratch) -> DataFrame:
    """x binary: each distinct integer vector once, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pack(floors(batch.column(0), length, scale))], names=["x"])

    return scratch.save(vectors.select("vec").mapInArrow(run, "x binary").distinct())


def _words(values: list[int], count: int) -> list[int]:
    """Big integers as ``count`` words each, least first; the last has the sign."""
    mask = (1 << WORD_BITS) - 1
    return [(v >> (WORD_BITS * k)) & mask if k < count - 1 else v >> (WORD_BITS * k) for v in values for k in range(count)]


def gram(fit: DataFrame, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, sum of outer products) of the fit list, exact.

    A task sends the upper triangle of [1 x]'[1 x], row by row; rows of one
    place are added in a group of one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length + 1, length + 1), dtype=object)
        for batch in batches:
            rows = unpack(batch.column(0), length)
            for part in np.split(rows, range(BLOCK, len(rows), BLOCK)):
                extended = np.hstack([np.ones((len(part), 1), np.int64), part])
                total = total + exact_product(np.ascontiguousarray(extended.T), extended)
        if total[0, 0]:
            count = max(1, -(-(bit_length(total) + 1) // WORD_BITS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(length + 1), pa.int32()), pa.array([_words(total[i, i:].tolist(), count) for i in range(length + 1)], pa.list_(pa.int64()))], names=["place", "words"])

    def merge(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        width = length + 1 - place
        parts: dict[int, np.ndarray] = {}
        for words in table.column("words"):
            values = words.values.to_numpy().reshape(width, -1)
            parts[values.shape[1]] = parts.get(values.shape[1], 0) + values
        summed = sum(p[:, k].astype(object) * (1 << (WORD_BITS * k)) for p in parts.values() for k in range(p.shape[1]))
        return pa.table({"place": pa.array([place], pa.int32()), "sums": pa.array([[str(v) for v in summed.tolist()]], pa.list_(pa.string()))})

    partial = fit.mapInArrow(run, "place int, words array<long>")
    merged = partial.groupBy("place").applyInArrow(merge, "place int, sums array<string>").collect()
    full = np.zeros((length + 1, length + 1), dtype=object)
    for row in merged:
        i = row["place"]
        full[i, i:] = full[i:, i] = [int(v) for v in row["sums"]]
    return int(full[0, 0]), full[0, 1:], full[1:, 1:]


def _jacobi(s: np.ndarray, floor: float) -> np.ndarray:
    """A rotation that makes a nearly diagonal positive matrix diagonal, each pair relative to its own two entries."""
    s, turn = s.copy(), np.eye(len(s))
    for _ in range(30):
        moved = False
        scale = np.sqrt(np.maximum(np.diag(s), floor))
        for p, q in zip(*np.nonzero(np.triu(np.abs(s) > 1e-18 * np.outer(scale, scale), 1))):
            if abs(s[p, q]) <= 1e-17 * np.sqrt(max(s[p, p], floor) * max(s[q, q], floor)):
                continue
            moved = True
            half = (s[q, q] - s[p, p]) / (2 * s[p, q])
            t = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(half, 1.0))
            c = 1 / np.hypot(t, 1.0)
            for m in (s.T, s, turn.T):  # columns of s, then its rows, then the turn's columns
                a, b = m[p].copy(), m[q].copy()
                m[p], m[q] = c * a - t * c * b, t * c * a + c * b
            s[p, q] = s[q, p] = 0.0
        if not moved:
            break
    return turn


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors * 2^bits as integers, bits) of a positive integer matrix, by falling value; zero values left out.

    LAPACK's vectors are made orthonormal and turned, by exact products, until
    every off-diagonal entry of X'AX is small beside its own two eigenvalues.
    """
    size = len(a)
    trace = sum(a[i, i] for i in range(size))
    if not trace:
        return np.zeros(0), np.zeros((size, 0), dtype=object), 0
    bits = trace.bit_length() + EXTRA_BITS
    one, floor = 1 << bits, 2.0**-ZERO_BITS
    scaled = lambda m, by: np.array([[v / by for v in row] for row in m.tolist()])
    fixed = lambda m: np.array([[int(v * 2.0**60) << (bits - 60) for v in row] for row in m.tolist()], dtype=object)
    x = fixed(np.linalg.eigh(scaled(a, trace))[1])
    for _ in range(REFINEMENTS):
        for _ in range(3):
            lack = np.diag([3 * one * one] * size).astype(object) - exact_product(x.T, x)
            x = exact_product(x, lack) >> (2 * bits + 1)
        s = scaled(exact_product(x.T, exact_product(a, x)), one * one)
        root = np.sqrt(np.maximum(np.diag(s), floor))
        off = np.abs(s) / np.outer(root, root)
        np.fill_diagonal(off, 0.0)
        if off.max() < 1e-17:
            break
        x = exact_product(x, fixed(_jacobi((s + s.T) / 2, floor))) >> bits
    values = np.diag(s)
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > floor]
    return values[order], x[:, order], bits


@dataclass
class Whitening:
    """What a fit gives: integers S, vectors * 2^bits, and each component's divisor."""

    length: int
    scale: int
    n: int
    sums: np.ndarray
    vectors: np.ndarray
    bits: int
    roots: np.ndarray
    explained: np.ndarray

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, as 64-bit integers where they hold it."""
        if bit_length(rows) + self.n.bit_length() < 62 and bit_length(self.sums) < 62:
            return rows * np.int64(self.n) - self.sums.astype(np.int64)
        return rows.astype(object) * self.n - self.sums

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values: exact projections, rounded once."""
        return exact_product(centred, self.vectors).astype(np.float64) / (2.0**self.bits * self.roots)


def fit_whitening(vectors: DataFrame, length: int, scale: int, components: int, scratch: Scratch) -> tuple[Whitening, DataFrame]:
    """The fit and its written list."""
    fit = fit_list(vectors, length, scale, scratch)
    n, sums, outer = gram(fit, length)
    scatter = n * outer - np.outer(sums, sums)
    values, found, bits = eigenvectors(scatter)
    trace = sum(scatter[i, i] for i in range(length))
    kept = slice(0, components)
    return Whitening(length, scale, n, sums, found[:, kept], bits, np.sqrt(values[kept]), np.array([v / float(trace) for v in values[kept]])), fit


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; whitened values are centred already."""
    k = model.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k)), False
        for batch in batches:
            seen = True
            w = model.project(model.centred(unpack(batch.column(0), model.length)))
            total += w.T @ w
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    summed = fit.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return max(abs(r["value"] / model.n - (r["place"] // k == r["place"] % k)) for r in summed)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    vectors, length = usable_vectors(embeddings, vec_id=id_col, vec=vector_col)
    schema = StructType([vectors.schema["vec_id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
                         StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    scratch = Scratch(embeddings.sparkSession, "whitening")
    model, fit = fit_whitening(vectors, length, scale, components, scratch) if length else (None, None)
    k = model.vectors.shape[1] if model else 0
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, model)
    scratch.drop(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = model.centred(floors(batch.column(1), length, scale))
            m = len(centred)
            deviations = [d if d < 1 << 63 else None for d in sums_of_squares(centred)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                 pa.array(deviations, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.project(centred).ravel()),
                 pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))], names=schema.names)

    return vectors.select("vec_id", "vec").mapInArrow(run, schema)
