"""Vectors as exact integers: usable rows, floors, compact rows of bytes, products by digit slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Widths in bytes of a packed entry; a row takes the least that holds all its entries.
WIDTHS = (1, 2, 4, 8)


def usable(frame: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return frame.filter(F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False)))


def usual_length(frame: DataFrame, vector: str) -> int:
    """The length that most vectors have, the smaller of several; 0 without a vector."""
    row = frame.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), "length").first()
    return row["length"] if row else 0


def usable_vectors(frame: DataFrame, **columns: str) -> tuple[DataFrame, int]:
    """The named columns of rows whose ``vec`` is usable and of the usual length, and that length."""
    rows = usable(pick(frame, **columns), "vec")
    length = usual_length(rows, "vec")
    return rows.filter(F.size("vec") == length), length


def floors(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """floor(scale * entry) of each vector as 64-bit integers; what they can't hold becomes the nearest they can."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, length)
    top = 2.0**63
    if x.size and max(x.max(), -x.min()) >= top:
        out = np.where(np.abs(x) < top, x, 0).astype(np.int64)
        out[x >= top] = np.iinfo(np.int64).max
        out[x < -top] = np.iinfo(np.int64).min
        out[x == -top] = np.iinfo(np.int64).min
        return out
    return x.astype(np.int64)


def pack(rows: np.ndarray) -> pa.Array:
    """Each row as bytes, in the least width that holds it: equal rows have equal bytes, others others."""
    out: list[bytes] = [b""] * len(rows)
    if rows.size:
        high = np.maximum(rows.max(axis=1), -(rows.min(axis=1) + 1))
        width = np.select([high < 1 << 7, high < 1 << 15, high < 1 << 31], WIDTHS[:3], WIDTHS[3])
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            raw, size = rows[at].astype(f"<i{w}").tobytes(), w * rows.shape[1]
            for k, i in enumerate(at.tolist()):
                out[i] = raw[k * size : (k + 1) * size]
    return pa.array(out, pa.binary())


def unpack(packed: pa.Array, length: int) -> np.ndarray:
    """The rows that ``pack`` packed."""
    rows = packed.to_pylist()
    out = np.zeros((len(rows), length), np.int64)
    if length and rows:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            out[at] = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), f"<i{size // length}").reshape(-1, length)
    return out


def bit_length(values: np.ndarray) -> int:
    """Bits of the largest magnitude."""
    return max(int(values.max()).bit_length(), int(values.min()).bit_length()) if values.size else 0


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Digit slices of integers, least first: values = sum of slice * 2^(bits * place). Only the last has a sign."""
    count = max(1, -(-bit_length(values) // bits))
    mask = (1 << bits) - 1
    slices = [(values >> (bits * k)) & mask for k in range(count - 1)] + [values >> (bits * (count - 1))]
    return [s.astype(np.float64) for s in slices]


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two integer matrices, exact, as Python integers.

    Slices are so small that a float64 product of two of them, summed over the
    inner dimension, stays under 2^53: BLAS rounds nothing. Slice products of
    one place are added as 64-bit integers, places as big integers.
    """
    inner = a.shape[1]
    bits = (53 - max(0, inner - 1).bit_length()) // 2
    left, right = limbs(a, bits), limbs(b, bits)
    places: dict[int, np.ndarray] = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            part = (x @ y).astype(np.int64)
            places[i + j] = places[i + j] + part if i + j in places else part
    total = places[0].astype(object)
    for place in range(1, len(left) + len(right) - 1):
        total = total + places[place].astype(object) * (1 << (bits * place))
    return total


def sums_of_squares(rows: np.ndarray) -> list[int]:
    """Each row's sum of squares, exact."""
    inner = rows.shape[1]
    if 2 * bit_length(rows) + max(1, inner).bit_length() < 63:
        return (rows.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in rows.astype(object).tolist()]
