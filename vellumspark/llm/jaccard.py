"""Exact n-gram Jaccard join as a metric-space join.

Jaccard distance is a metric: with a link at similarity t, linked documents lie
within r = 1 - t of each other.

1. Shared shingles. Shingle hashes are dealt into buckets by value; a bucket sees
   each of its shingles with all its documents and returns those that at least
   two have. A document of which less than t is shared can't have a partner: it
   is its own class. The others are candidates.
2. Voronoi regions. Central documents of the largest groups, chosen apart from
   each other, are pivots, and every candidate gets its exact distance to each. It
   is at home in the region of its nearest pivot p. Its partners lie within r, so
   by the triangle inequality one that is at home with q has (d(x, q) - d(x, p)) / 2
   <= r: the document is replicated to the regions of all such q less than 1 - r
   away, and documents within r of their pivot are linked to it. Every linked pair
   of which one document lies less than 1 - 2r from its pivot meets so.
3. The rest. Far out pivots tell little, and at distance 1 nothing. Documents that
   lie 1 - 2r or more from all pivots, and only these, meet by their rarest shared
   shingles, as many as a partner can't all lack: each such shingle is a region,
   its most central document the pivot.
   Equal regions are one. A region whose documents are all in one component is settled.
   A region that is not and is over a bound gets several pivots of its own, from
   different components, and is split like the whole; cells are split again.
4. Leaf cells. Small cells are joined pair by pair, others of a bounded size in
   blocks. A cell whose documents lie so close together that windows would leave
   most pairs together is not split further and joined in blocks as well:
   documents outside its largest component are compared with all others, so that
   its work grows with the one number times the other.

Pairs inside one component are not compared further: they can't change a class.

Defined results: a null text, or one without words, has an empty set and its own
class; with fewer words than n the whole sequence is one shingle; equal sets are
one node, however many rows have it; a null id is no smallest id and has a null
class unless another id is in it; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, text_rows
from .graph import connected_components

WORDS = 5
PERCENT = 75
#: Input bytes (of texts) that one bucket of shingles stands for.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 16
#: A task hands on its shingles after so many of them, or so many documents.
CHUNK_SHINGLES, CHUNK_DOCS = 1_500_000, 20_000
SLICE_BYTES = 4 << 20
#: Documents in a cell that is joined pair by pair, and in one that is joined in blocks; larger ones are split.
SMALL_CELL, LEAF_CELL = 48, 1024
#: Pivots of the whole, how many are tried for them, shingles of one at most, and their least distance from each other.
FIRST_PIVOTS, TRIED_PIVOTS, PIVOT_TOKENS, APART = 256, 1024, 4096, 0.5
#: Pivots of a cell, and parts over which its documents meet them.
PIVOTS, SALTS = 8, 16
#: Documents that meet one copy of a pivot's set.
MEETINGS = 1024
#: Meetings of shingles with first pivots that a task holds at once; one document's are never parted.
MET_AT_ONCE = 1_000_000
#: A split is undone if its cells have more than this share of the pairs that the whole had; so often a cell is split at most.
PAIRS_LEFT, LEVELS = 0.5, 12
#: Documents of a block, and shingles of a strip, in block joins.
BLOCK, STRIP = 1024, 4096

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_COMBINE = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.array([1] + [b] * (size - 1), np.uint64), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, powers: _Powers) -> np.ndarray:
    """64-bit hashes of the words (runs of anything but ASCII white space) of lower-cased bytes, in order."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE_BYTES)
        while end < len(raw) and not _SPACE[raw[end]]:  # a slice ends at white space
            end += 1
        data = np.frombuffer(raw, np.uint8, end - at, at)
        space = np.concatenate([[True], _SPACE[data], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, stops = edges[::2], edges[1::2]
        up, down = powers.upto(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[:-1], dtype=np.uint64)])
        out.append(_mix((total[stops] - total[starts]) * down[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int, powers: _Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower(), powers)  # bytes.lower() is A-Z only
    if not len(h):
        return h
    n = min(words, len(h))
    m = len(h) - n + 1
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total = total + h[k : k + m] * _COMBINE[k % 64]
    return np.unique(_mix(total))


def _chunk(texts: list[np.ndarray], nodes: list[bytes], ids: list, buckets: int) -> Iterator[tuple]:
    """Rows (bucket, chunk, tokens, places) of a chunk, its directory first, at a bucket below 0."""
    sizes = np.array([len(t) for t in texts], np.uint32)
    chunk = hashlib.blake2b(b"".join(nodes), digest_size=16).digest()
    known = np.array([i is not None for i in ids], np.uint8)
    numbers = np.array([i or 0 for i in ids], np.int64)
    yield -1 - int.from_bytes(chunk[:4], "little") % buckets, chunk, b"".join(nodes), sizes.tobytes() + known.tobytes() + numbers.tobytes()
    hashes = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    place = np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)[order]
    token = hashes[order].astype("<u8")
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist() if len(bucket) else []
    for s, e in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[s]), chunk, token[s:e].tobytes(), place[s:e].tobytes()


def _directory(row_nodes: bytes, row_sizes: bytes) -> tuple[list[bytes], np.ndarray, list]:
    n = len(row_nodes) // 16
    nodes = [row_nodes[16 * i : 16 * i + 16] for i in range(n)]
    sizes = np.frombuffer(row_sizes, np.uint32, n)
    known = np.frombuffer(row_sizes, np.uint8, n, 4 * n)
    ids = np.frombuffer(row_sizes[5 * n :], np.int64, n)
    return nodes, sizes, [int(i) if k else None for i, k in zip(ids, known)]


CHUNK_SCHEMA = "bucket int, chunk binary, tokens binary, places binary"


def deal_shingles(docs: DataFrame, buckets: int, words: int = WORDS) -> DataFrame:
    """Shingle hashes of all documents, packed by chunk of documents and bucket. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        texts: list[np.ndarray] = []
        nodes: list[bytes] = []
        ids: list = []
        held = 0

        def emit() -> pa.RecordBatch:
            rows = list(zip(*_chunk(texts, nodes, ids, buckets)))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["bucket", "chunk", "tokens", "places"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                found = shingles(text.as_py(), words, powers)
                texts.append(found)
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                ids.append(key.as_py())
                held += len(found)
                if held >= CHUNK_SHINGLES or len(texts) >= CHUNK_DOCS:
                    yield emit()
                    texts, nodes, ids, held = [], [], [], 0
        if texts:
            yield emit()

    return docs.mapInArrow(run, CHUNK_SCHEMA)


def keep_shared(dealt: DataFrame) -> DataFrame:
    """Of each bucket the shingles that at least two documents have, with their document counts; directories pass through."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.append_column("counts", pa.nulls(table.num_rows, pa.binary()))
        chunks = table.column("chunk").to_pylist()
        raw = [np.frombuffer(t, "<u8") for t in table.column("tokens").to_pylist()]
        lengths = [len(r) for r in raw]
        tokens = np.concatenate(raw)
        del raw
        order = np.argsort(tokens)
        ranked = tokens[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        starts = np.flatnonzero(new)
        count = np.diff(np.concatenate([starts, [len(ranked)]]))
        each = np.empty(len(tokens), np.uint16)
        each[order] = np.minimum(np.repeat(count, count), 65_535)  # an order of rarity, not a cap on documents
        cuts = np.cumsum([0] + lengths)
        out = []
        for i, places in enumerate(table.column("places").to_pylist()):
            part = slice(cuts[i], cuts[i + 1])
            shared = each[part] >= 2
            if shared.any():
                out.append((key[0].as_py(), chunks[i], tokens[part][shared].tobytes(), np.frombuffer(places, np.uint16)[shared].tobytes(),
                            each[part][shared].tobytes()))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "tokens", "places", "counts"])

    return dealt.groupBy("bucket").applyInArrow(run, CHUNK_SCHEMA + ", counts binary")


def documents_of(shared: DataFrame) -> DataFrame:
    """doc_id, node, n of all documents, from the directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes_raw, sizes_raw in zip(batch.column(0), batch.column(1)):
                nodes, sizes, ids = _directory(nodes_raw.as_py(), sizes_raw.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sizes.astype(np.int64))], names=["doc_id", "node", "n"])

    return shared.filter("bucket < 0").select("tokens", "places").mapInArrow(run, "doc_id long, node binary, n long")


def candidates_of(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, n, tokens (its shared shingles), keys (its region keys) and central of each document that can have a partner.

    ``central`` is the mean logarithm of how many documents have a shingle: of a
    text and its edited copies the text itself has the most.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        nodes, sizes = [], np.zeros(0, np.uint32)
        parts = []
        for r in rows:
            if r["bucket"] < 0:
                nodes, sizes, _ = _directory(r["tokens"], r["places"])
            else:
                parts.append((np.frombuffer(r["tokens"], "<i8"), np.frombuffer(r["places"], np.uint16), np.frombuffer(r["counts"], np.uint16)))
        out: list[tuple] = []
        if parts and nodes:
            token, place, count = (np.concatenate(p) for p in zip(*parts))
            shared_of = np.bincount(place, minlength=len(nodes))
            able = (100 * shared_of >= percent * sizes.astype(np.int64)) & (shared_of > 0)
            keep = able[place]
            token, place, count = token[keep], place[keep], count[keep]
            order = np.lexsort((token, count, place))
            token, place, count = token[order], place[order], count[order]
            done: set[bytes] = set()
            cuts = np.searchsorted(place, np.arange(len(nodes) + 1))
            for i in np.flatnonzero(able).tolist():
                if nodes[i] in done:
                    continue
                done.add(nodes[i])
                own = token[cuts[i] : cuts[i + 1]]
                n = int(sizes[i])
                # the rarest n - ceil(t n) + 1 of all its shingles; those that no other document has come first and are no region
                prefix = n - -(-percent * n // 100) + 1 - (n - len(own))
                central = float(np.log(count[cuts[i] : cuts[i + 1]].astype(np.float64)).sum() / n)
                out.append((nodes[i], n, np.sort(own).tolist(), own[:prefix].tolist(), round(central, 6)))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "n", "tokens", "keys", "central"])

    return shared.groupBy("chunk").applyInArrow(run, "node binary, n long, tokens array<long>, keys array<long>, central double")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, common, n_x, n_y of distinct pairs. A y of very many x is several parts, each with a copy of its set for MEETINGS of them."""
    sx = sets.select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("tokens").alias("t_x"))
    sy = sets.select(F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("tokens").alias("t_y"))
    parts = pairs.groupBy("y").agg(F.ceil(F.count("*") / MEETINGS).cast("int").alias("parts"))
    sy = sy.join(parts, "y").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(parts, "y").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).drop("parts")
    return dealt.join(sy, ["y", "part"]).join(sx, "x").select("x", "y", F.size(F.array_intersect("t_x", "t_y")).cast("long").alias("common"), "n_x", "n_y")


def _linked(percent: int):
    return 100 * F.col("common") >= percent * (F.col("n_x") + F.col("n_y") - F.col("common"))


def choose_pivots(heads: DataFrame, sets: DataFrame) -> list[tuple[bytes, int, np.ndarray]]:
    """(node, n, tokens) of documents at the centre of the largest groups, each at least ``APART`` from the others.

    heads: size, p (central, node, n). What reaches the driver is bounded by
    TRIED_PIVOTS rows of at most PIVOT_TOKENS shingles.
    """
    tried = heads.filter(F.col("p.n") <= PIVOT_TOKENS).groupBy(F.col("p.node").alias("node")).agg(F.max("size").alias("size")).orderBy(F.desc("size"), "node").limit(TRIED_PIVOTS)
    rows = tried.join(sets, "node").collect()
    chosen: list[tuple[bytes, int, np.ndarray]] = []
    for r in sorted(rows, key=lambda r: (-r["size"], bytes(r["node"]))):
        tokens = np.sort(np.array(r["tokens"], np.int64))
        far = True
        for _, n, other in chosen:
            common = len(np.intersect1d(tokens, other, assume_unique=True))
            far = far and common <= (1 - APART) * (r["n"] + n - common)
        if far and len(chosen) < FIRST_PIVOTS:
            chosen.append((bytes(r["node"]), r["n"], tokens))
    return chosen


REGION_SCHEMA = "cell long, node binary, n long, central double, pivot binary, linked boolean, far boolean"


def voronoi_regions(candidates: DataFrame, pivots: list[tuple[bytes, int, np.ndarray]], percent: int = PERCENT) -> DataFrame:
    """REGION_SCHEMA: a row for each region that a candidate is at home in or replicated to; ``far`` marks one that pivots alone don't settle.

    A candidate that no region takes is one far row without a cell.
    """
    token = np.concatenate([t for _, _, t in pivots]) if pivots else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(pivots)), [len(t) for _, _, t in pivots])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    names, sizes = [n for n, _, _ in pivots], np.array([n for _, n, _ in pivots], np.int64)
    radius = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, k = batch.num_rows, len(names)
            lists, own = batch.column(3), batch.column(1).to_numpy()
            flat, who = lists.flatten().to_numpy(), np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy()))
            first, last = np.searchsorted(token, flat, "left"), np.searchsorted(token, flat, "right")
            many = last - first
            common = np.zeros((m, k), np.int64)
            met = np.concatenate([[0], np.cumsum(many)])
            ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=m))])  # where each document's shingles end
            s = 0
            while s < m:  # so many documents at a time that their meetings with pivots are bounded
                e = min(m, max(s + 1, int(np.searchsorted(met[ends], met[ends[s]] + MET_AT_ONCE, "right")) - 1))
                part = slice(ends[s], ends[e])
                at = np.repeat(first[part] - (met[part] - met[ends[s]]), many[part]) + np.arange(met[ends[e]] - met[ends[s]])
                place = np.repeat(who[part] - s, many[part]) * max(1, k) + owner[at]
                common[s:e] = np.bincount(place, minlength=(e - s) * max(1, k)).reshape(e - s, -1)[:, :k]
                s = e
            union = own[:, None] + sizes[None, :] - common
            distance = 1 - common / np.maximum(union, 1)
            nearest = distance.min(axis=1, initial=1.0)
            inside = (distance < 1 - radius + 1e-9) & ((distance - nearest[:, None]) / 2 <= radius + 1e-9)
            far = nearest >= 1 - 2 * radius - 1e-9
            row, cell = np.nonzero(inside)
            lone = np.flatnonzero(far & ~inside.any(axis=1))
            linked = np.concatenate([100 * common[row, cell] >= percent * union[row, cell], np.zeros(len(lone), bool)])
            row, none = np.concatenate([row, lone]), len(lone)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*cell.tolist(), *[None] * none], pa.int64()), *(batch.column(c).take(pa.array(row)) for c in (0, 1, 2)),
                 pa.array([*(names[c] for c in cell.tolist()), *[None] * none], pa.binary()), pa.array(linked), pa.array(far[row])],
                names=["cell", "node", "n", "central", "pivot", "linked", "far"])

    return candidates.select("node", "n", "central", "tokens").mapInArrow(run, REGION_SCHEMA)


def link_components(candidates: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(node, component) of all nodes with a link."""
    candidates = scratch.save(candidates.dropDuplicates(["node"]))
    sets = candidates.select("node", "n", "tokens")
    members = candidates.select(F.explode("keys").alias("region"), "node", "n", "central")
    place = F.max(F.struct("central", "node", "n")).alias("p")
    every = scratch.save(members.groupBy("region").agg(F.count("*").alias("size"), place).filter("size > 1"))
    cells = scratch.save(voronoi_regions(candidates, choose_pivots(every, sets), percent))
    near = cells.filter(F.col("linked") & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"))

    # far documents meet by rare shingles; keys that the same documents have are one region: their members' hashes have the same sums
    rest = members.join(cells.filter("far").select("node").distinct(), "node", "left_semi")
    sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (1, 2)]
    heads = rest.groupBy("region").agg(F.count("*").alias("size"), place, *sums).filter("size > 1")
    heads = heads.groupBy("size", "sum1", "sum2").agg(F.min("region").alias("region"), F.first("p").alias("p"))
    heads = scratch.save(heads.select("region", F.col("p.node").alias("pivot")))
    regions = scratch.save(rest.join(heads, "region").filter(F.col("node") != F.col("pivot")))
    measured = _measured(regions.select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct(), sets)
    links = measured.filter(_linked(percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    components = scratch.save(connected_components(scratch.save(near.unionByName(links)), scratch))
    both = cells.filter("cell is not null").select(F.xxhash64(F.lit("pivot"), "cell").alias("cell"), "node", "n", "central").unionByName(regions.select(F.col("region").alias("cell"), "node", "n", "central"))
    placed = both.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = join_cells(placed, sets, scratch, percent)
    if found.isEmpty():
        return components
    return scratch.save(_merged(components, connected_components(found, scratch)))


CELL = ["cell", "node", "n", "central", "component", "size"]


def _open_cells(placed: DataFrame) -> DataFrame:
    """The rows of cells that hold several components, with their cell's size."""
    cells = placed.groupBy("cell").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    return placed.join(cells.filter("low <> high").select("cell", "size"), "cell").select(*CELL)


def join_cells(placed: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """Links (a, b between components) among the documents of each cell. placed: cell, node, n, central, component.

    Each level splits the cells that are still large. What pivots link is merged
    before the next level, so cells settle as early as they can.
    """
    placed = scratch.save(_open_cells(placed))
    small, dense, links = [], [], []
    for level in range(LEVELS):
        small.append(placed.filter(F.col("size") <= SMALL_CELL))
        dense.append(placed.filter((F.col("size") > SMALL_CELL) & (F.col("size") <= LEAF_CELL)))
        large = placed.filter(F.col("size") > max(SMALL_CELL, LEAF_CELL))
        if large.isEmpty():
            break
        tries = scratch.save(try_pivots(large, sets, scratch, percent))
        links.append(scratch.save(tries.filter("linked").select(F.greatest("component", "to").alias("a"), F.least("component", "to").alias("b"))
                                  .filter("a <> b").distinct().coalesce(8)))
        split = scratch.save(voronoi_cells(tries, percent))
        sizes = split.groupBy("parent", "cell").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        pairs = sizes.groupBy("parent").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("left"), F.first("size").cast("double").alias("size"))
        close = scratch.save(pairs.filter(F.col("left") > PAIRS_LEFT * F.col("size") * F.col("size")).select(F.col("parent").alias("cell")))
        dense.append(large.join(close, "cell").select(*CELL))
        apart = split.join(close.withColumnRenamed("cell", "parent"), "parent", "left_anti").drop("parent", "size")
        merged = connected_components(_union(links), scratch).select(F.col("node").alias("component"), F.col("component").alias("root"))
        apart = apart.join(merged, "component", "left").withColumn("component", F.coalesce("root", "component"))
        placed = scratch.save(_open_cells(apart.select(*CELL[:-1])))
    else:
        dense.append(placed)  # whatever is left is joined as it is
    found = [*links, _small_cells(_union(small), sets, scratch, percent), _dense_cells(_union(dense), sets, percent)]
    return scratch.save(_union(found).distinct().coalesce(8))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def try_pivots(large: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """Each row of each cell with each pivot of the cell: pivot, to (its component), distance and whether they are linked.

    Components are dealt to ``PIVOTS`` slots, and the most central document of a
    slot is a pivot. Rows and pivots meet by cell and salt.
    """
    slot = F.pmod(F.xxhash64("component"), F.lit(PIVOTS))
    pivots = large.groupBy("cell", slot.alias("slot")).agg(F.max(F.struct("central", "node", "component")).alias("p"))
    pivots = pivots.select("cell", F.col("p.node").alias("pivot"), F.col("p.component").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    tries = large.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(pivots, ["cell", "salt"]).drop("salt")
    tries = scratch.save(tries)
    pairs = tries.filter(F.col("node") != F.col("pivot")).select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct()
    measured = _measured(pairs, sets).select(F.col("x").alias("node"), F.col("y").alias("pivot"), _linked(percent).alias("linked"),
                                             (1 - F.col("common") / (F.col("n_x") + F.col("n_y") - F.col("common"))).alias("distance"))
    return tries.join(measured, ["node", "pivot"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("distance", F.coalesce("distance", F.lit(0.0)))


def voronoi_cells(tries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """parent, size (the parent's) and CELL columns of every document at home in its nearest pivot's cell and in those its window reaches."""
    seen = tries.groupBy("cell", "node").agg(*[F.first(c).alias(c) for c in ("n", "central", "component", "size")],
                                             F.collect_list(F.struct("distance", "pivot")).alias("seen"))
    nearest = F.array_min("seen")["distance"]
    reached = F.filter("seen", lambda p: (p["distance"] - nearest) / 2 <= F.lit(1 - percent / 100 + 1e-9))
    split = seen.withColumn("p", F.explode(reached))
    return split.select(F.col("cell").alias("parent"), F.xxhash64("cell", "p.pivot").alias("cell"), "node", "n", "central", "component", "size")


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes allow a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _small_cells(placed: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b between components) of cells of a bounded size, pair by pair."""
    other = placed.select("cell", F.col("node").alias("y"), F.col("n").alias("m"), F.col("component").alias("b"))
    pairs = placed.select("cell", F.col("node").alias("x"), "n", F.col("component").alias("a")).join(other, "cell")
    pairs = pairs.filter((F.col("x") > F.col("y")) & (F.col("a") != F.col("b")) & _alike(F.col("n"), F.col("m"), percent))
    pairs = scratch.save(pairs.select("x", "y", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    linked = _measured(pairs.select("x", "y").distinct(), sets).filter(_linked(percent)).select("x", "y")
    return pairs.join(linked, ["x", "y"]).select("a", "b")


def _dense_cells(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b between components) of cells that windows don't separate, block against block.

    Documents of a cell's largest component are not compared among themselves. A
    block pair's intersections are one product of 0/1 matrices of documents and
    shingles; shingles of one document only are left out, the others taken in
    strips. Pairs never become rows.
    """
    parts = placed.groupBy("cell", "component").agg(F.count("*").alias("held"))
    main = parts.groupBy("cell").agg(F.max(F.struct("held", "component")).alias("m")).select("cell", F.col("m.component").alias("main"), F.col("m.held").alias("held"))
    others = F.ceil((F.col("size") - F.col("held")) / BLOCK).cast("int")
    rows = placed.join(main, "cell").withColumn("others", others).withColumn("blocks", F.col("others") + F.ceil(F.col("held") / BLOCK).cast("int"))
    outside = F.col("component") != F.col("main")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("own", F.when(outside, deal(F.col("others"))).otherwise(F.col("others") + deal(F.col("blocks") - F.col("others"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("blocks")).otherwise(F.col("others")) - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "node", "n", "component")
    rows = rows.join(sets.select("node", "tokens"), "node")

    def run(table: pa.Table) -> pa.Table:
        m = table.num_rows
        lists = table.column("tokens").combine_chunks()
        who = np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy()))
        token, place, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = count[place] > 1
        who, place = who[shared], np.cumsum(count > 1)[place[shared]] - 1
        order = np.argsort(place, kind="stable")
        who, place = who[order], place[order]
        common = np.zeros((m, m), np.float32)
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, STRIP):
            s, e = np.searchsorted(place, (at, at + STRIP))
            strip = np.zeros((m, STRIP), np.float32)
            strip[who[s:e], place[s:e] - at] = 1
            common += strip @ strip.T
        n = table.column("n").to_numpy()
        linked = 100 * common.astype(np.int64) >= percent * (n[:, None] + n[None, :] - common.astype(np.int64))
        component = table.column("component").combine_chunks().dictionary_encode()
        names, code = component.dictionary.to_pylist(), component.indices.to_numpy()
        linked &= code[:, None] < code[None, :]
        pairs = np.unique(np.stack([code[i] for i in np.nonzero(linked)], axis=1), axis=0)
        both = [(max(names[i], names[j]), min(names[i], names[j])) for i, j in pairs.tolist()]
        return pa.table([pa.array(c, pa.binary()) for c in (list(zip(*both)) or [[], []])], names=["a", "b"])

    return rows.groupBy("cell", "first", "second").applyInArrow(run, "a binary, b binary")


def _merged(components: DataFrame, roots: DataFrame) -> DataFrame:
    """Components after links between components; a node that had no link before is its own."""
    fresh = roots.select("node").join(components, "node", "left_anti").select("node", F.col("node").alias("component"))
    moved = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return components.unionByName(fresh).join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = text_rows(pick(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    shared = scratch.save(keep_shared(deal_shingles(rows, buckets, words)))
    components = link_components(candidates_of(shared, percent), scratch, percent)
    found = scratch.save(
        documents_of(shared).join(components, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("class")))
    least = found.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return found.join(least, "class", "left").select("doc_id", "n_shingles", own.alias("component_id"))
