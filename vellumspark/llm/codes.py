"""Compression of vectors to codebook indexes: Lloyd rounds with Hamerly's bounds.

Vectors become integers floor(4096 * x) and are cut into consecutive parts; each
part position has a codebook that Lloyd's rounds move. Every part keeps its entry,
an upper bound on its distance to it and a lower bound on the distance to any
other. After entries have moved, a part whose upper bound is still strictly under
its lower bound (or under half the gap around its entry) has one nearest entry,
the one it had; otherwise the upper bound is made exact, and only if that fails
too are integer distances to all entries taken, ties to the lower index. Bounds
are rounded outwards, so they never decide a tie.

State is a Parquet table a round, written in the shared folder and read by the
next: integers, entries and bounds. A task writes beside its rows what moved from
entry to entry, as counts and sums; only these are added up over the cluster, and
only codebooks reach the driver.

Defined results: a vector that is null or holds a null or non-finite component is
left out, and so is one of another length than most have (the smaller of equally
common lengths); a length that the parts don't divide makes the first parts one
longer; fewer vectors than entries give fewer entries; among equal ids the
smaller vector comes first, null ids come last; repeated rows count each; equal
entries are told apart by their index; null labels are one label; components
beyond 64 bits become the nearest 64-bit integer, and an error or a label's error
beyond 64 bits is null; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, DecimalType, FloatType, IntegerType, LongType, StructField, StructType

from .common import Scratch
from .integers import bit_length, floors, pack, sums_of_squares, unpack, usable_vectors

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Labels up to which their errors are sent to all tasks; beyond, rows of a label are dealt over SALTS tasks.
SENT_LABELS, SALTS = 100_000, 64

Book = list[list[list[int]]]  # part, entry, component


def _outward(exact: np.ndarray | float, up: bool) -> np.ndarray:
    """32-bit bounds at or beyond 64-bit ones that may be off by a few units in their last place."""
    wide = np.nextafter(np.asarray(exact, np.float64) * (1 + 2.0**-50 if up else 1 - 2.0**-50), np.inf if up else -np.inf)
    narrow = wide.astype(np.float32)
    wrong = narrow < wide if up else narrow > wide
    return np.where(wrong, np.nextafter(narrow, np.float32(np.inf if up else -np.inf)), narrow).astype(np.float32)


@dataclass
class Step:
    """One round's codebooks, with how far entries moved since the last round and half the gaps between them."""

    book: Book
    before: Book | None

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entries, moved, farthest moved of the others, half the gap to the nearest other) of a part position."""
        entries = np.array(self.book[p], dtype=object)
        k = len(entries)
        gap = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
        moved = np.array([gap(a, b) for a, b in zip(self.book[p], self.before[p])]) if self.before else np.zeros(k)
        others = np.array([max([moved[j] for j in range(k) if j != i], default=0.0) for i in range(k)])
        half = np.array([min([gap(self.book[p][i], self.book[p][j]) for j in range(k) if j != i], default=np.inf) / 2 for i in range(k)])
        return entries, moved, others, half


def _distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    bits = 2 * (max(bit_length(rows), bit_length(entries)) + 1) + rows.shape[1].bit_length()
    kind = np.int64 if bits < 63 else object
    gaps = rows.astype(kind)[:, None, :] - entries.astype(kind)[None, :, :]
    return (gaps * gaps).sum(axis=2)


def assign(rows: np.ndarray, step: Step, bounds: list[np.ndarray], own: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Entries of all parts of the rows, and how many parts were compared with all entries; bounds are updated in place."""
    found = np.zeros((len(rows), len(bounds)), np.int8) if own is None else own.copy()
    scans = 0
    for p, columns in enumerate(bounds):
        part = rows[:, columns]
        entries, moved, others, half = step.part(p)
        todo = np.arange(len(rows))
        if own is not None:
            mine = own[:, p]
            upper[:, p] = _outward(upper[:, p] + moved[mine], True)
            lower[:, p] = _outward(lower[:, p] - others[mine] * (1 + 2.0**-50), False)
            clear = np.maximum(lower[:, p], _outward(half, False)[mine])
            todo = np.flatnonzero(~(upper[:, p] < clear))
            exact = np.sqrt(np.array(sums_of_squares(part[todo].astype(object) - entries[mine[todo]]) if len(todo) else [], np.float64))
            upper[todo, p] = _outward(exact, True)
            todo = todo[~(upper[todo, p] < clear[todo])]
        if len(todo):
            scans += len(todo)
            d = _distances(part[todo], entries)
            best = d.argmin(axis=1)  # the lowest index of equal distances
            found[todo, p] = best
            upper[todo, p] = _outward(np.sqrt(d[np.arange(len(todo)), best].astype(np.float64)), True)
            lower[todo, p] = _outward(np.sqrt(np.partition(d.astype(np.float64), 1, axis=1)[:, 1]), False) if len(entries) > 1 else np.inf
    return found, scans


def _moves(rows: np.ndarray, bounds: list[np.ndarray], entries: int, old: np.ndarray | None, new: np.ndarray, counts: np.ndarray, totals: list[np.ndarray]) -> None:
    """Add what the rows bring to their new entries and take from their old ones."""
    for p, columns in enumerate(bounds):
        changed = np.arange(len(rows)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        part = rows[changed][:, columns]
        kind = np.int64 if bit_length(part) + len(part).bit_length() < 62 else object
        for side, sign in ((new, 1),) if old is None else ((new, 1), (old, -1)):
            at = side[changed, p]
            counts[p] += sign * np.bincount(at, minlength=entries)
            block = np.zeros((entries, len(columns)), kind)
            np.add.at(block, at, part.astype(kind))
            totals[p] += sign * block.astype(object)


def _first_books(vectors: DataFrame, length: int, scale: int, bounds: list[np.ndarray], entries: int) -> Book:
    """The parts of the vectors of the smallest ids."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    rows = floors(pa.array([r["vec"] for r in first], pa.list_(pa.float64())), length, scale).tolist()
    return [[[row[c] for c in columns] for row in rows] for columns in bounds]


def train_codes(vectors: DataFrame, length: int, parts: int, entries: int, rounds: int, scale: int, scratch: Scratch) -> tuple[DataFrame, Book, list[int]]:
    """(state of the last assignment, final codebooks, parts that each round compared with all entries)."""
    bounds = [np.asarray(c) for c in np.array_split(np.arange(length), parts)]
    book = _first_books(vectors, length, scale, bounds, entries)
    entries = len(book[0])
    id_field, label_field = vectors.schema["vec_id"], vectors.schema["label"]
    moved = StructType([StructField("part", IntegerType()), StructField("entry", IntegerType()), StructField("n", LongType()), StructField("totals", ArrayType(DecimalType(38, 0)))])
    schema = StructType([id_field, label_field, StructField("x", BinaryType()), StructField("own", ArrayType(ByteType())), StructField("upper", ArrayType(FloatType())),
                         StructField("lower", ArrayType(FloatType())), StructField("moved", ArrayType(moved)), StructField("scans", LongType())])

    def stage(step: Step):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, totals, scans, kinds = np.zeros((parts, entries), np.int64), [np.zeros((entries, len(c)), dtype=object) for c in bounds], 0, None
            listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, parts, dtype=np.int32)), pa.array(values.ravel(), kind))
            for batch in batches:
                if not batch.num_rows:
                    continue
                kinds = batch.schema.field(0).type, batch.schema.field(1).type
                if batch.num_columns == 3:
                    rows, own = floors(batch.column(2), length, scale), None
                    upper, lower = (np.zeros((len(rows), parts), np.float32) for _ in range(2))
                    packed = pack(rows)
                else:
                    packed = batch.column(2)
                    rows = unpack(packed, length)
                    own, upper, lower = (batch.column(c).flatten().to_numpy().reshape(-1, parts).copy() for c in (3, 4, 5))
                found, seen = assign(rows, step, bounds, own, upper, lower)
                _moves(rows, bounds, entries, own, found, counts, totals)
                scans += seen
                none = pa.nulls(len(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, listed(found, pa.int8()), listed(upper, pa.float32()), listed(lower, pa.float32()),
                                                  none.cast(moved_type), none.cast(pa.int64())], names=schema.names)
            if kinds:
                brought = [{"part": p, "entry": e, "n": int(counts[p, e]), "totals": [Decimal(v) for v in totals[p][e].tolist()]}
                           for p in range(parts) for e in range(entries) if counts[p, e] or any(totals[p][e])]
                none = [pa.nulls(1, kind) for kind in (*kinds, pa.binary(), pa.list_(pa.int8()), pa.list_(pa.float32()), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([*none, pa.array([brought], moved_type), pa.array([scans], pa.int64())], names=schema.names)

        moved_type = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("totals", pa.list_(pa.decimal128(38, 0)))]))
        return run

    counts = [[0] * entries for _ in bounds]
    totals = [[[0] * len(c) for _ in range(entries)] for c in bounds]
    before, state, scanned = None, vectors.select("vec_id", "label", "vec"), []
    for k in range(rounds + 1):
        following = scratch.save(state.mapInArrow(stage(Step(book, before)), schema))
        if k:
            scratch.drop(saved)
        saved, state = following, following.filter("moved is null").select("vec_id", "label", "x", "own", "upper", "lower")
        tasks = saved.filter("moved is not null")
        scanned.append(tasks.agg(F.sum("scans")).first()[0] or 0)
        if k == rounds:
            break
        brought = tasks.select(F.explode("moved").alias("m")).select("m.part", "m.entry", "m.n", F.posexplode("m.totals").alias("place", "total"))
        for r in brought.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            totals[r["part"]][r["entry"]][r["place"]] += int(r["total"])
            if r["place"] == 0:
                counts[r["part"]][r["entry"]] += r["n"]
        before, book = book, [[[t // n for t in total] if n else entry for entry, n, total in zip(*of_part)] for of_part in zip(book, counts, totals)]
    return state, book, scanned


def books_digest(book: Book) -> str:
    """sha256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for part in book for entry in part for v in entry).encode()).hexdigest()


def _with_label_errors(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row with the errors of its label summed; a label's rows are added in their tasks first."""
    sums = scratch.save(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(
        F.col("label").alias("same"), F.expr("try_cast(total as bigint)").alias("label_error")), few_rows=True)
    if sums.count() <= SENT_LABELS:
        return coded.join(F.broadcast(sums), coded["label"].eqNullSafe(sums["same"]), "left").drop("same")
    dealt = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("own_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, salted["label"].eqNullSafe(dealt["same"]) & (salted["own_salt"] == dealt["salt"]), "left").drop("same", "salt", "own_salt")


def compress_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                     id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code (one byte a part), error, label_error, codebooks_sha256."""
    vectors, length = usable_vectors(embeddings, vec_id=id_col, label=label_col, vec=vector_col)
    scratch = Scratch(embeddings.sparkSession, "codes")
    schema = StructType([vectors.schema["vec_id"], vectors.schema["label"], StructField("code", BinaryType()), StructField("error", LongType())])
    if not length:
        empty = embeddings.sparkSession.createDataFrame([], schema)
        return empty.withColumn("label_error", F.lit(None).cast("long")).withColumn("codebooks_sha256", F.lit(books_digest([])))
    state, book, _ = train_codes(vectors, length, parts, entries, rounds, scale, scratch)
    bounds = np.array_split(np.arange(length), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(b, dtype=object) for b in book]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, own = unpack(batch.column(2), length), batch.column(3).flatten().to_numpy().reshape(-1, parts)
            gaps = np.hstack([rows[:, c] - tables[p][own[:, p]] for p, c in enumerate(bounds)])
            errors = [e if e < 1 << 63 else None for e in sums_of_squares(gaps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in own], pa.binary()), pa.array(errors, pa.int64())], names=schema.names)

    coded = scratch.save(state.select("vec_id", "label", "x", "own").mapInArrow(run, schema))
    return _with_label_errors(coded, scratch).withColumn("codebooks_sha256", F.lit(books_digest(book)))
