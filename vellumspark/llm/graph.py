"""Connected components of links, without ever gathering them in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Links in one file of an intermediate table; few links are few tasks.
EDGES_A_FILE = 200_000


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` has columns a and b of one orderable type; nulls and loops count for
    nothing. Large-star and small-star rounds alternate: each node's neighbours
    are hung on the least of them until nothing changes, which takes a number of
    rounds logarithmic in the components' size. Least neighbours are found by
    partial aggregation, so a node with very many links is no hot key. Should
    ``max_rounds`` not be enough, it raises rather than give a part of the answer.
    """
    edges = scratch.save(
        links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        files = max(4, state[0] // EDGES_A_FILE)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large.coalesce(files))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e"))
        following = hung.filter("e.x <> e.m").select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).distinct()
        following = scratch.save(following.coalesce(files))
        scratch.drop(large, edges)
        before, state, edges = state, _state(following), following
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
