"""Exact samples and splits: rows at global positions of a repeatable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

#: Rows held out for tests, share of the others to train on, seed of the order.
TEST_ROWS, TRAIN_SHARE, SEED = 40, 0.85, 42


def with_positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``position`` from 0 in the order, in two passes: places within range partitions are written, then what lies before each partition is added.

    No task holds more than its partition. Rows that are equal in all of the order
    take consecutive positions, in any way among them.
    """
    keyed = rows.select("*", F.struct(*order).alias("_order"))
    placed = keyed.repartitionByRange("_order").sortWithinPartitions("_order").drop("_order").withColumn("_id", F.monotonically_increasing_id())
    placed = tables.written(placed)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, listed = 0, []
    for p, n in sizes:
        listed.append((p, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(listed, "_part long, _before long"))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn("position", F.col("_before") + place).drop("_id", "_part", "_before")


def seeded(content: str, seed: int = SEED) -> Column:
    """What decides a row's place: a hash of the seed and its content, so that reruns and other partitions agree."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(content), F.lit(""))), 256)


def sample_and_split(rows: DataFrame, content: str, key: str, test: int = TEST_ROWS, share: float = TRAIN_SHARE, seed: int = SEED) -> DataFrame:
    """The rows with ``part``: exactly ``test`` rows are 'test'; of the others int(n * share) are 'train' and the rest 'val', by position.

    ``key`` tells rows of equal content apart. Rows that aren't in the sample but
    have the content of one that is (null is a content) are in no part and left
    out, so that nothing held out is trained on. Fewer rows than ``test`` are all 'test'.
    """
    order = [seeded(content, seed), F.col(key)]
    placed = tables.written(with_positions(rows, order))
    sample = placed.filter(F.col("position") < test).withColumn("part", F.lit("test"))
    same = sample.select(F.col(content).alias("_content")).distinct()
    rest = placed.filter(F.col("position") >= test).drop("position")
    rest = rest.join(same, rest[content].eqNullSafe(same["_content"]), "left_anti")
    rest = tables.written(with_positions(rest, order))
    train = int(rest.count() * share)
    others = rest.withColumn("part", F.when(F.col("position") < train, "train").otherwise("val"))
    return sample.unionByName(others).select(*rows.columns, "part")
