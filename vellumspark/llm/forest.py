"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors are compared within groups of one label and length. Each tree splits a
group again and again at the median of its vectors' projections on a random
direction; a vector within a margin of the split goes to both sides (spill), so
that close vectors part only if the split falls between them by more than two
margins. Pairs are compared within leaves, in double precision, and a pair that
meets in several leaves counts once. Links are united to components.

A group of a bounded size is one task's: its trees are grown and its leaves are
compared there, and the pairs of all trees meet in one bit matrix. A larger group
is split over the cluster. Vectors stay in one table; what is routed is a vector's
number and its projections on all levels of a tree, made by one matrix product.
Splits are fitted on a bounded sample, every vector is routed, and a leaf that is
still too large is a group of the next round. A pair that meets in several leaves
counts in the least of them. Only a leaf that no split divides (a dense cluster)
stays large, and is compared in blocks; a group that some tree leaves whole holds
all its pairs in that one leaf, and the other trees drop it.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do rows with a null label or vectors of
different lengths; equal vectors of one label are linked; repeated rows count as
vectors of their own; labels of any type are compared as text; a null id never is
a component's least id unless it is alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick
from .graph import connected_components

THRESHOLD = 0.93
TREES = 8
SEED = 77
#: Vectors, and components of vectors, up to which a group is one task's.
GROUP, GROUP_VALUES = 16_384, 1 << 22
#: A leaf beyond this is split again: in a task, and over the cluster, where splits of a sample stop at half of it.
LEAF, WIDE_LEAF = 32, 1024
#: Vectors that the splits of one group are fitted on, about.
SAMPLE = 8192
#: Margin around a split, in units of the spread of the projected difference of two vectors that just link.
SPILL = 0.75
#: A split that leaves more than this share on a side divides nothing: it would part too many linked pairs for its use.
#: With SPILL, a split parts at most about 1.2 % of the pairs that just link.
USELESS = 0.65
#: Directions of a tree, one a level.
LEVELS = 40
ROUNDS = 12
BLOCK = 1024

STATE = "node binary, group long, p array<float>, tree int, leaf long, level int, closed boolean"
STATE_COLUMNS = ["node", "group", "p", "tree", "leaf", "level", "closed"]


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def directions(tree: int, dimensions: int, seed: int = SEED) -> np.ndarray:
    """Unit directions of a tree's levels, one column each; all splits of a level share one."""
    d = np.random.default_rng([seed, tree]).standard_normal((dimensions, LEVELS))
    return d / np.linalg.norm(d, axis=0)


def margin(threshold: float, dimensions: int) -> float:
    """Spread of the projected difference of two unit vectors of that cosine, times SPILL."""
    return SPILL * np.sqrt(2 - 2 * threshold) / np.sqrt(dimensions)


def halves(own: np.ndarray, gap: float) -> tuple[float, np.ndarray, np.ndarray] | None:
    """The cut at the median and who goes left and right, or None if it divides too little."""
    cut = float(np.median(own))
    left, right = own <= cut + gap, own > cut - gap
    if max(left.sum(), right.sum()) > USELESS * len(own):
        return None
    return cut, left, right


# --- a group in one task -------------------------------------------------------


def tree_leaves(p: np.ndarray, gap: float, leaf: int) -> Iterator[np.ndarray]:
    """Rows of each leaf of a tree over the projections p; a part that no level divides is a leaf of its own."""
    todo = [(np.arange(len(p)), 0)]
    while todo:
        rows, level = todo.pop()
        split = None
        while len(rows) > leaf and level < p.shape[1] and split is None:
            split = halves(p[rows, level], gap)
            level += 1
        if split is None:
            yield rows
        else:
            todo += [(rows[split[1]], level), (rows[split[2]], level)]


class PairBits:
    """Linked pairs of n vectors, a bit each, both ways."""

    def __init__(self, n: int):
        self.n, self.bits = n, np.zeros((n, -(-n // 8)), np.uint8)

    def compare(self, x: np.ndarray, rows: np.ndarray, threshold: float) -> None:
        """Set the links among ``rows``."""
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            linked = x[part] @ x[rows].T >= threshold
            if len(rows) <= 256:
                i, j = np.nonzero(linked)
                np.bitwise_or.at(self.bits, (part[i], rows[j] >> 3), (128 >> (rows[j] & 7)).astype(np.uint8))
            else:
                wide = np.zeros((len(part), self.n), bool)
                wide[:, rows] = linked
                self.bits[part] |= np.packbits(wide, axis=1)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their links as booleans) of the rows that have any."""
        some = np.flatnonzero(self.bits.any(axis=1))
        for at in range(0, len(some), BLOCK):
            part = some[at : at + BLOCK]
            yield part, np.unpackbits(self.bits[part], axis=1, count=self.n).view(bool)

    def settle(self) -> None:
        """Both ways, and no vector with itself."""
        for part, linked in self.blocks():
            i, j = np.nonzero(linked)
            np.bitwise_or.at(self.bits, (j, part[i] >> 3), (128 >> (part[i] & 7)).astype(np.uint8))
        every = np.arange(self.n)
        self.bits[every, every >> 3] &= ~(128 >> (every & 7)).astype(np.uint8)

    def counts(self, copies: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for part, linked in self.blocks():
            out[part] = linked @ copies
        return out

    def roots(self) -> np.ndarray:
        """Least index that each vector reaches."""
        label = np.arange(self.n, dtype=np.int32)
        while True:
            before = label.copy()
            for part, linked in self.blocks():
                least = np.minimum(label[part], np.where(linked, label[None, :], self.n).min(axis=1))
                label[part] = least
            label = np.minimum(label, label[label])
            if (label == before).all():
                return label


def group_links(x: np.ndarray, threshold: float, trees: int) -> PairBits:
    """Linked pairs that meet in a leaf of some tree."""
    pairs, gap = PairBits(len(x)), margin(threshold, x.shape[1])
    for tree in range(trees):
        leaves = list(tree_leaves(x @ directions(tree, x.shape[1]), gap, LEAF))
        for rows in leaves:
            pairs.compare(x, rows, threshold)
        if len(leaves) == 1:  # undivided: all pairs have met
            break
    pairs.settle()
    return pairs


NAMED = "node binary, links long, component_id long"


def link_groups(nodes: DataFrame, threshold: float, trees: int) -> DataFrame:
    """node, links (copies counted), component_id of groups that are one task's each. nodes: node, group, vector, copies, least."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = _unit(table.column("vector").combine_chunks().flatten().to_numpy(), table.num_rows)
        pairs = group_links(x, threshold, trees)
        root = pairs.roots()
        known = table.column("least").is_valid().to_numpy(zero_copy_only=False)
        last = np.iinfo(np.int64).max
        least = np.full(len(x), last)
        np.minimum.at(least, root, np.where(known, table.column("least").fill_null(0).to_numpy(), last))
        least = least[root]
        return pa.table({"node": table.column("node"), "links": pa.array(pairs.counts(table.column("copies").to_numpy())),
                         "component_id": pa.array(least, mask=least == last)})

    return nodes.groupBy("group").applyInArrow(run, NAMED)


# --- a group over the cluster ----------------------------------------------------


def fit_splits(p: np.ndarray, population: int, gap: float) -> dict[int, float]:
    """Cut by node of one tree (root 1, children 2k and 2k + 1) for a sample's projections that stand for ``population`` vectors."""
    cuts: dict[int, float] = {}
    if len(p) < 2:
        return cuts
    scale, levels = population / len(p), p.shape[1]
    todo = [(1, 0, np.arange(len(p)))]
    while todo:
        node, level, rows = todo.pop()
        if len(rows) * scale <= WIDE_LEAF / 2 or len(rows) < 8:
            continue
        for at in range(level, levels):  # a direction that divides nothing is passed over by a one-sided cut
            split = halves(p[rows, at], gap)
            if split is not None:
                cuts[node] = split[0]
                todo += [(2 * node, at + 1, rows[split[1]]), (2 * node + 1, at + 1, rows[split[2]])]
                break
            cuts[node] = np.inf
            node *= 2
        else:
            while node > 1 and cuts.get(node // 2) == np.inf:  # none divides: the node is a leaf
                node //= 2
                del cuts[node]
    return cuts


def route(p: np.ndarray, cuts: dict[int, float], gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf node, level) triples for rows with projections p."""
    rows, leaves, levels = [], [], []
    todo = [(1, 0, np.arange(len(p)))]
    while todo:
        node, level, own = todo.pop()
        if not len(own):
            continue
        cut = cuts.get(node)
        if cut is None:
            rows.append(own)
            leaves.append(np.full(len(own), node, np.uint64))
            levels.append(np.full(len(own), level, np.int32))
            continue
        at = p[own, level]
        todo.append((2 * node, level + 1, own[at <= cut + gap]))
        if cut != np.inf:
            todo.append((2 * node + 1, level + 1, own[at > cut - gap]))
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(levels)


def _projections(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def project(nodes: DataFrame, trees: int) -> DataFrame:
    """STATE of every vector at the root of every tree. nodes: node, group, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                n, group = part.num_rows, part.column("group").to_numpy()
                x = _unit(part.column("vector").flatten().to_numpy(), n)
                for tree in range(trees):
                    p = (x @ directions(tree, d)).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, LEVELS, dtype=np.int32)), pa.array(p.ravel()))
                    leaf = _mix(group.view(np.uint64) ^ np.uint64(tree + 1)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("group"), lists, pa.array(np.full(n, tree, np.int32)), pa.array(leaf),
                         pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool))], names=STATE_COLUMNS)

    return nodes.select("node", "group", "vector").mapInArrow(run, STATE)


def _split_leaves(state: DataFrame, open_leaves: DataFrame, round_number: int, gaps: DataFrame) -> DataFrame:
    """Leaves of all rows in ``open_leaves`` (leaf, size), by splits fitted on a sample of each. gaps: group, gap."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        level = table.column("level")[0].as_py()
        cuts = fit_splits(_projections(table.column("p"))[:, level:], table.column("size")[0].as_py(), table.column("gap")[0].as_py())
        return pa.table({"leaf": table.column("leaf").slice(0, 1), "nodes": pa.array([list(cuts)], pa.list_(pa.int64())),
                         "cuts": pa.array([list(cuts.values())], pa.list_(pa.float64()))})

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            for g in np.unique(leaf).tolist():
                part = batch.take(pa.array(np.flatnonzero(leaf == g)))
                cuts = dict(zip(part.column("nodes")[0].as_py() or [], part.column("cuts")[0].as_py() or []))
                level = part.column("level")[0].as_py()
                rows, nodes, deeper = route(_projections(part.column("p"))[:, level:], cuts, part.column("gap")[0].as_py())
                moved = part.take(pa.array(rows))
                number = _mix(np.uint64(g & (2**64 - 1)) ^ _mix(nodes + np.uint64(round_number << 56))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(moved.column(c) for c in STATE_COLUMNS[:4]), pa.array(number), pa.array(deeper + np.int32(level)),
                     pa.array(np.full(len(rows), not cuts))], names=STATE_COLUMNS)

    rows = state.join(open_leaves, "leaf").join(gaps, "group")
    share = F.pmod(F.xxhash64("node", "leaf"), F.lit(1_000_000)) * F.col("size") < F.lit(SAMPLE * 1_000_000)
    models = rows.filter(share).groupBy("leaf").applyInArrow(fit, "leaf long, nodes array<long>, cuts array<double>")
    return rows.drop("size").join(models, "leaf").mapInArrow(move, STATE)


def plant_forest(nodes: DataFrame, gaps: DataFrame, scratch: Scratch, trees: int = TREES) -> DataFrame:
    """node, group, leaf of every vector in each of its leaves. nodes: node, group, vector; gaps: group, gap."""
    state = scratch.save(project(nodes, trees))
    for number in range(ROUNDS):
        sizes = state.filter(~F.col("closed")).groupBy("leaf").agg(F.count("*").alias("size")).filter(F.col("size") > WIDE_LEAF)
        sizes = scratch.save(sizes)
        if sizes.isEmpty():
            break
        rest = state.join(sizes.select("leaf"), "leaf", "left_anti").select(*STATE_COLUMNS)
        moved = _split_leaves(state.filter(~F.col("closed")), sizes, number, gaps).select(*STATE_COLUMNS)
        following = scratch.save(rest.unionByName(moved))
        scratch.drop(state)
        state = following
        if not number:
            state = scratch.save(_once_if_whole(state))
            scratch.drop(following)
    return state.select("node", "group", "leaf")


def _once_if_whole(state: DataFrame) -> DataFrame:
    """After the first round: groups that some tree left whole (closed) stay in the least such tree only."""
    whole = state.filter("closed").groupBy("group").agg(F.min("tree").alias("only"))
    return state.join(whole, "group", "left").filter("only is null or tree = only").select(*STATE_COLUMNS)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index reachable, for a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def compare_leaves(state: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, links (copies counted), root (a node that it reaches within the leaf), by leaf and block pair.

    Vectors are joined here, once. Large leaves are compared block by block: each
    vector goes to the pairs of blocks that its own block is part of.
    """
    leaves = state.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    sizes = state.groupBy("group", "leaf").agg(F.count("*").alias("size")).filter("size > 1")
    rows = state.join(sizes, ["group", "leaf"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.join(leaves, "node").join(nodes.select("node", "vector", "copies"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", "leaf", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "node", "vector", "copies", "leaves")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        n = table.num_rows
        copies, own = table.column("copies").to_numpy(), table.column("own").to_numpy()
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        x = _unit(table.column("vector").combine_chunks().flatten().to_numpy(), n)
        linked = x @ x.T >= threshold
        linked &= linked.T
        if first != second:
            linked &= own[:, None] != own[None, :]
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            return pa.table({"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        linked = linked[np.ix_(some, some)]
        here = table.column("leaf")[0].as_py()
        lists = table.column("leaves").take(pa.array(some)).combine_chunks()
        flat = lists.flatten().to_numpy()
        who = np.repeat(np.arange(len(some)), np.diff(lists.offsets.to_numpy()))
        earlier = flat < here
        place = np.unique(flat[earlier], return_inverse=True)[1]
        both = np.zeros((len(some), place.max() + 1 if len(place) else 1), np.float32)
        both[who[earlier], place] = 1
        counted = linked & (both @ both.T == 0)  # pairs that meet in no lesser leaf
        node = table.column("node").take(pa.array(some))
        return pa.table({"node": node, "links": pa.array(counted.astype(np.int64) @ copies[some]), "root": node.take(pa.array(_roots(linked)))})

    return rows.groupBy("group", "leaf", "first", "second").applyInArrow(run, "node binary, links long, root binary")


def link_large_groups(nodes: DataFrame, scratch: Scratch, threshold: float, trees: int) -> DataFrame:
    """NAMED for groups of any size. nodes: node, group, vector, copies, least."""
    spread = SPILL * float(np.sqrt(2 - 2 * threshold))
    gaps = nodes.groupBy("group").agg((F.lit(spread) / F.sqrt(F.max(F.size("vector")))).alias("gap"))
    state = plant_forest(nodes, scratch.save(gaps), scratch, trees)
    found = scratch.save(compare_leaves(state, nodes, threshold))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "least").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(links, "node", "left").join(least, "component").select("node", F.coalesce("links", F.lit(0)).alias("links"), "component_id")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch(vectors.sparkSession, "forest")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists("vector", lambda v: v != 0)
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col).select(
        F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"), F.col("label").cast("string"))
    usable = F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))
    # equal vectors of a label are one node: two independent hashes name it
    name = F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("label", "vector"), F.xxhash64(F.lit(SEED), "vector", "label"))]))
    rows = rows.withColumn("node", F.when(usable, name))
    group = F.xxhash64("label", F.size("vector"))
    nodes = scratch.save(
        rows.filter(F.col("node").isNotNull()).withColumn("group", group).groupBy("node").agg(
            F.first("group").alias("group"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    bound = F.least(F.lit(GROUP), F.floor(F.lit(GROUP_VALUES) / F.max(F.size("vector"))))
    large = scratch.save(nodes.groupBy("group").agg(F.count("*").alias("size"), bound.alias("bound")).filter("size > bound").select("group"))
    if large.isEmpty():
        named = link_groups(nodes, threshold, trees)
    else:
        wide = scratch.save(nodes.join(large, "group").select(*nodes.columns))
        named = link_groups(nodes.join(large, "group", "left_anti"), threshold, trees).unionByName(link_large_groups(wide, scratch, threshold, trees))
    named = scratch.save(named.join(nodes.select("node", "copies"), "node").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = rows.filter(F.col("node").isNotNull()).select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("node").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
