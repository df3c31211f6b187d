"""A kept inverted file of dense vectors, for approximate cosine search.

Coarse cells come from k-means on unit vectors; what is left of a vector after its
cell's centre is cut into parts, each coded by one byte. Cells and codes are fitted
on a bounded sample that covers all rows (``SAMPLE`` rows, the least hashes of the
id); every row is then assigned and written, one folder a cell. The number of cells
that a question visits is found when the index is fitted: the least that gives
``RECALL`` of the sample's true neighbours.

A search reads ids and codes of the visited cells only, which the scan shows as a
partition filter, scores them by tables of partial products, and settles the best
``POOL`` of each question on whole vectors. A cell is read in blocks of bounded
size, so a crowded one is many tasks'. Vectors added later are coded with the kept
model and found at once.

Defined results: a vector that is null, zero, of another length than the model's or
holds a null or non-finite entry has no cosine and isn't indexed; a question of
that kind has no hits; a batch counts once it is listed; ids are expected once;
ties go to the smaller id.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from . import folders, tables
from .retrieval import cosine, top_of, unit_rows

#: Rows of the fitting sample at most; cells at most; bytes of a code; values of a byte.
SAMPLE, MOST_CELLS, CODE_BYTES, CODE_VALUES = 100_000, 4096, 8, 256
#: Share of true neighbours that the sample's questions must find in the visited cells; how many questions and neighbours are tried.
RECALL, TRIED, NEIGHBOURS = 0.98, 500, 10
#: Candidates of a question that are settled on whole vectors; rows of a cell that one task scores.
POOL, BLOCK = 200, 16_384
#: Parts that cells are dealt over at least, rows of a part about; scores that a part holds at once; candidates that one task ranks.
PARTS, PART_ROWS, SCORE_CELLS, RANKED = 16, 262_144, 8_000_000, 500_000
#: Number of the layout on disk; an index of another isn't taken for a kept one.
FORMAT = 1


@dataclass
class Cells:
    """A fitted model: unit centres, and for each part of what is left its code values."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    @property
    def cuts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.centres.shape[1]), len(self.books))

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n cells of each vector whose centres agree with it most."""
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, :n]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.nearest(unit, 1)[:, 0] if len(unit) else np.zeros(0, np.int64)
        left = unit - self.centres[cell]
        codes = np.stack([_closest(left[:, cut], book) for cut, book in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        return cell, codes

    def scores(self, question: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of unit questions with a cell's coded vectors."""
        total = np.repeat((question @ self.centres[cell])[:, None], len(codes), axis=1)
        for p, (cut, book) in enumerate(zip(self.cuts, self.books)):
            total += (question[:, cut] @ book.T)[:, codes[:, p]]
        return total

    def as_json(self) -> dict:
        return {"centres": self.centres.tolist(), "books": [b.tolist() for b in self.books], "probes": self.probes}

    @classmethod
    def from_json(cls, value: dict) -> Cells:
        return cls(np.array(value["centres"]), [np.array(b) for b in value["books"]], value["probes"])


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in blocks."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(part @ centres.T - half).argmax(axis=1) for part in np.array_split(rows, max(1, len(rows) // 8192))])


def _kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        own = _closest(rows, centres)
        order = np.argsort(own, kind="stable")
        filled, starts = np.unique(own[order], return_index=True)
        centres = centres.copy()
        centres[filled] = np.add.reduceat(rows[order], starts, axis=0) / np.diff([*starts, len(rows)])[:, None]
    return centres


def fit_cells(sample: np.ndarray, rows: int, seed: int = 11) -> Cells:
    """Fit on unit vectors of a sample of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    k = int(min(MOST_CELLS, max(1, len(sample) // 16), max(1, round(np.sqrt(rows)))))
    centres = _kmeans(sample, k, 12, rng)
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / np.where(norms == 0, 1, norms)
    model = Cells(centres, [], len(centres))
    own = model.nearest(sample, 1)[:, 0]
    left = sample - centres[own]
    cuts = np.array_split(np.arange(sample.shape[1]), min(CODE_BYTES, sample.shape[1]))
    model.books = [_kmeans(left[:, cut], min(CODE_VALUES, max(1, len(sample) // 4)), 8, rng) for cut in cuts]
    asked = rng.choice(len(sample), min(TRIED, len(sample)), replace=False)
    near = np.argsort(-(sample[asked] @ sample.T), axis=1)[:, :NEIGHBOURS]
    visited = model.nearest(sample[asked], len(centres))
    place = np.argsort(visited, axis=1)  # at which visit a question comes to each cell
    needed = np.take_along_axis(place, own[near], axis=1).ravel() + 1
    model.probes = int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])
    return model


@dataclass
class DenseIndex:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, items: DataFrame) -> DenseIndex:
        """An index of items (id, vec) in a new folder. The sample is all that the driver holds."""
        length = items.filter("vec is not null").groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
        if length is None or not length["length"]:
            raise ValueError("an index needs vectors to be fitted on")
        fitting = items.filter(F.size("vec") == length["length"])
        n, place = fitting.count(), F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        if n > SAMPLE:
            fitting = fitting.filter(place < int(min(1.0, 1.2 * SAMPLE / n) * (1 << 30)) + 1)
        kept = fitting.orderBy(place, "id").limit(SAMPLE).select("vec").toArrow()
        unit = unit_rows(kept.column("vec").combine_chunks(), length["length"])
        unit = unit[np.isfinite(unit).all(axis=1)]
        if not len(unit):
            raise ValueError("an index needs vectors to be fitted on")
        folders.write_json(spark, f"{path}/model.json", fit_cells(unit, n).as_json() | {"id": items.schema["id"].dataType.simpleString()})
        return cls(spark, path).add(items)

    @classmethod
    def kept(cls, items: DataFrame, name: str) -> DenseIndex:
        """The index of these files in the session's shared folder, made if there is none yet."""
        spark = items.sparkSession
        path = f"{tables.shared_dir(items)}/vellum-index-{name}-{folders.fingerprint(items, FORMAT, SAMPLE, MOST_CELLS, CODE_BYTES)}"
        if not folders.exists(spark, f"{path}/model.json"):
            fresh = f"{path}-{uuid.uuid4().hex}"
            cls.create(spark, fresh, items)
            if not folders.rename(spark, fresh, path):  # another session was first
                folders.delete(spark, fresh)
        return cls(spark, path)

    def model(self) -> Cells:
        return Cells.from_json(folders.read_json(self.spark, f"{self.path}/model.json"))

    def add(self, items: DataFrame) -> DenseIndex:
        """Assign, code and write more items (id, vec) as one batch; the model stays."""
        model, batch = self.model(), uuid.uuid4().hex
        schema = StructType([items.schema["id"], StructField("code", BinaryType()), StructField("unit", ArrayType(DoubleType())), StructField("cell", IntegerType())])

        def run(batches):
            for rows in batches:
                unit = unit_rows(rows.column(1), model.centres.shape[1])
                fits = np.flatnonzero(np.isfinite(unit).all(axis=1))
                cell, codes = model.encode(unit[fits])
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, unit[fits].size + 1, unit.shape[1], dtype=np.int32)), pa.array(unit[fits].ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(fits)), pa.array([c.tobytes() for c in codes], pa.binary()), vectors, pa.array(cell.astype(np.int32))], names=schema.names)

        coded = items.select("id", "vec").mapInArrow(run, schema)
        dealt = coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8)))  # a crowded cell is eight tasks'
        dealt.sortWithinPartitions("cell", "id").write.partitionBy("cell").option("compression", "zstd").parquet(f"{self.path}/cells/batch={batch}")
        folders.write_json(self.spark, f"{self.path}/batches/{batch}.json", {})
        return self

    def rows(self) -> DataFrame:
        """id, code, unit, cell of all listed batches."""
        kind = folders.read_json(self.spark, f"{self.path}/model.json")["id"]
        parts = [f"{self.path}/cells/batch={name.removesuffix('.json')}" for name in folders.names(self.spark, f"{self.path}/batches")]
        return self.spark.read.schema(f"id {kind}, code binary, unit array<double>, cell int").option("basePath", f"{self.path}/cells").parquet(*parts)

    def visits(self, questions: DataFrame, probes: int | None = None) -> DataFrame:
        """qid, qunit, cell: the cells that each question (qid, qvec) visits."""
        model = self.model()
        n = min(len(model.centres), probes or model.probes)
        schema = StructType([questions.schema["qid"], StructField("qunit", ArrayType(DoubleType())), StructField("cell", IntegerType())])

        def run(batches):
            for rows in batches:
                unit = unit_rows(rows.column(1), model.centres.shape[1])
                fits = np.flatnonzero(np.isfinite(unit).all(axis=1))
                cells = model.nearest(unit[fits], n) if len(fits) else np.zeros((0, n), np.int64)
                each = np.repeat(np.arange(len(fits)), n)
                vectors = pa.array(unit[fits][each].tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(fits[each])), vectors, pa.array(cells.ravel().astype(np.int32))], names=schema.names)

        return questions.select("qid", "qvec").mapInArrow(run, schema)

    def candidates(self, questions: DataFrame, pool: int = POOL, probes: int | None = None) -> DataFrame:
        """qid, id, cell, score: the best of the visited cells by their codes.

        Cells, and blocks of crowded ones, are dealt over parts. A part sends on a
        question's best of all its cells, not of each, so what is ranked grows with
        the questions and parts, however many cells there are.
        """
        model, visits = self.model(), tables.written(self.visits(questions, probes))
        cells = sorted(r["cell"] for r in visits.select("cell").distinct().collect())  # MOST_CELLS at most
        coded = self.rows().filter(F.col("cell").isin(cells)).select("id", "code", "cell")
        blocks = tables.written(coded.groupBy("cell").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # a row a cell
        parts = max(PARTS, -(-(blocks.agg(F.sum("rows")).first()[0] or 0) // PART_ROWS))
        part = F.pmod(F.xxhash64("cell", "block"), F.lit(parts)).cast("int").alias("part")
        placed = blocks.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("cell", part).distinct()
        dealt = coded.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "code").select(part, "cell", "id", "code")
        asked = visits.join(F.broadcast(placed), "cell").groupBy("part", "qid").agg(F.first("qunit").alias("qunit"), F.collect_list("cell").alias("cells"))
        schema = StructType([questions.schema["qid"], coded.schema["id"], StructField("cell", IntegerType()), StructField("score", DoubleType())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.sort_by("id").combine_chunks(), right.combine_chunks()
            who, what, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            own = left.column("cell").to_numpy()
            if left.num_rows and right.num_rows:
                codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, len(model.books))
                units = right.column("qunit").combine_chunks().flatten().to_numpy().reshape(right.num_rows, -1)
                lists = right.column("cells").combine_chunks()
                visitor, visited = np.repeat(np.arange(right.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
                members = {c: np.flatnonzero(own == c) for c in np.unique(own).tolist()}
                step = max(1, min(256, SCORE_CELLS // left.num_rows))
                for start in range(0, right.num_rows, step):
                    s = np.full((min(step, right.num_rows - start), left.num_rows), -np.inf)
                    span = slice(*np.searchsorted(visitor, [start, start + len(s)]))
                    for c, rows in members.items():
                        asking = np.unique(visitor[span][visited[span] == c])
                        if len(asking):
                            s[np.ix_(asking - start, rows)] = model.scores(units[asking], c, codes[rows])
                    for q, row in enumerate(s, start):
                        least = np.partition(row, -pool)[-pool] if len(row) > pool else -np.inf
                        near = np.flatnonzero((row >= least) & (row > -np.inf))
                        near = near[np.argsort(-row[near], kind="stable")[:pool]]  # ids decide ties
                        who.append(np.full(len(near), q))
                        what.append(near)
                        scores.append(row[near])
            who, what = np.concatenate(who), np.concatenate(what)
            return pa.table({"qid": right.column("qid").take(pa.array(who)), "id": left.column("id").take(pa.array(what)), "cell": pa.array(own[what].astype(np.int32)), "score": pa.array(np.concatenate(scores))})

        scored = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(run, schema)
        spread = max(PARTS, -(-questions.count() * parts * pool // RANKED))
        order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
        best = scored.repartition(spread, "qid").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool)
        return best.select("qid", "id", "cell", "score")

    def search(self, questions: DataFrame, k: int = 10, digits: int = 9, pool: int = POOL, probes: int | None = None) -> DataFrame:
        """qid, id, score, rank of about the k best items of each question (qid, qvec), with their exact cosines."""
        found = tables.written(self.candidates(questions, max(k, pool), probes))
        cells = sorted(r["cell"] for r in found.select("cell").distinct().collect())
        vectors = self.rows().filter(F.col("cell").isin(cells)).select("cell", "id", "unit")
        wanted = found.select("qid", "id", "cell").join(vectors, ["cell", "id"]).join(questions.select("qid", "qvec"), "qid")
        return top_of(wanted.select("qid", "id", F.round(cosine(F.col("qvec"), F.col("unit")), digits).alias("score")), k)
