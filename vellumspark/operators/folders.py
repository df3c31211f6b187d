"""Folders of kept tables: markers written last, listings, fingerprints, through Hadoop's file systems."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.getFileStatus(p).isFile()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Whether the source now has the target's name; a target that is there already stays."""
    fs, p = _path(spark, source)
    _, q = _path(spark, target)
    if fs.exists(q):
        return False
    fs.mkdirs(q.getParent())
    return fs.rename(p, q)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file; an existing one is an error."""
    fs, p = _path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value))


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def fingerprint(frame: DataFrame, *more) -> str:
    """A short name for what a frame's files hold now: their paths, sizes and times, and further values."""
    spark, seen = frame.sparkSession, hashlib.sha256(repr(more).encode())
    for file in sorted(frame.inputFiles()):
        fs, p = _path(spark, file)
        s = fs.getFileStatus(p)
        seen.update(f"{file}|{s.getLen()}|{s.getModificationTime()}\n".encode())
    return seen.hexdigest()[:24]
