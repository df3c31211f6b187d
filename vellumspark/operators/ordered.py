"""Digests of a group's texts in sorted order, with constant memory a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def ordered_digest(rows: DataFrame, group: list[str], text: str, separator: str = "") -> DataFrame:
    """group columns, digest: SHA-256 of the group's texts, sorted by their bytes and joined; null texts count for nothing.

    Rows are dealt by group and sorted within partitions, on disk where they don't
    fit; a task then reads them in order and holds one digest and one batch. A
    hash over an ordered set is a chain, so a group is one task's, but never in
    its memory.
    """
    out = StructType([*(rows.schema[g] for g in group), StructField("digest", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, empty = None, None, True
        for batch in batches:
            done = []
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(group))]))
            for key, t in zip(keys, batch.column(len(group)).to_pylist()):
                if digest is None or key != current:
                    if digest is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest, empty = key, hashlib.sha256(), True
                if t is not None:
                    digest.update(t.encode() if empty else separator.encode() + t.encode())
                    empty = False
            yield _batch(done, batch.schema, out)
            last = batch.schema
        if digest is not None:
            yield _batch([(*current, digest.hexdigest())], last, out)

    def _batch(found: list[tuple], kinds: pa.Schema, schema: StructType) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(schema.names)
        types = [*(kinds.field(k).type for k in range(len(group))), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    return rows.select(*group, text).repartition(*group).sortWithinPartitions(*group, text).mapInArrow(run, out)
