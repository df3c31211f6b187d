"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. A
``Ledger`` holds all versions (path and blob) and the findings of every (blob,
rule version) pair that was ever scanned, both as tables in the shared folder.
``scan_increment`` adds one increment of documents: only pairs that the ledger
lacks are scanned. ``scan_history`` takes documents in, increment after increment,
``findings_by_path`` joins findings back to all paths of all increments, and
``redact_spans`` replaces found secrets in texts. ``keep_increment`` and
``open_ledger`` keep a ledger in a folder, from session to session: each increment
is written as tables of its own and counts once its entry is there, which is
written last. A rule version is the hash of the rules themselves, so changed rules
never meet findings of others.

Defined results: a null text is the empty blob; repeated rows and equal texts
share one blob and are scanned once; a null id is a path like any other; a ledger
that repeats a pair gives its findings once; an empty table gives an empty table;
texts of any length are scanned whole, and offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folders
from .common import Scratch, pick, text_rows

#: Increments in which a table of documents is taken in.
INCREMENTS = 2
MASK = "[secret]"

#: Fixed patterns of the base rules, in the order in which ties are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

@dataclass(frozen=True)
class Rules:
    """The base rules and further ones, each a kind and a pattern whose matches are findings."""

    extra: tuple[tuple[str, str], ...] = ()

    @property
    def kinds(self) -> tuple[str, ...]:
        return (*KINDS, *(kind for kind, _ in self.extra))

    @property
    def version(self) -> str:
        """A hash of all patterns, flags and least lengths."""
        base = [(p.pattern, p.flags) for p in (ASSIGN, ACCESS, HEX)] + [(ASSIGN_LEAST, ACCESS_LEAST)]
        return hashlib.sha256(repr((base, self.extra)).encode()).hexdigest()[:16]


BASE = Rules()
RULE_VERSION = BASE.version

LEDGER_SCHEMA = "blob string, rule_version string, kinds array<string>, starts array<long>, ends array<long>"


def find_secrets(text: str, rules: Rules = BASE) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every finding, in order.

    A matching candidate that is too short still consumes its text, as leftmost
    non-overlapping matching demands; only a run of hex digits can be asked for
    its length at once, for its parts can't match without it.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (_, pattern) in enumerate(rules.extra, len(KINDS)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() > m.start()]
    return sorted(found)


def blob_id(column: Column) -> Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


@dataclass
class Ledger:
    """paths: doc_id, blob of every version so far; findings: LEDGER_SCHEMA; scanned: blobs that each increment scanned.

    ``once``: every (blob, rule version) is known to be there once, as in all that ``scan_increment`` makes from nothing.
    """

    paths: DataFrame
    findings: DataFrame
    scanned: list[int] = field(default_factory=list)
    once: bool = False
    #: paths and findings of the last increment alone
    last_paths: DataFrame | None = None
    last_findings: DataFrame | None = None


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION, rules: Rules = BASE) -> DataFrame:
    """Ledger rows of blobs (blob, text)."""
    kinds = rules.kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t.as_py() or "", rules) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([rule_version] * len(found), pa.string()),
                pa.array([[kinds[k] for _, k, _ in f] for f in found], pa.list_(pa.string())),
                pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.int64())),
                pa.array([[e for _, _, e in f] for f in found], pa.list_(pa.int64())),
            ], names=["blob", "rule_version", "kinds", "starts", "ends"])

    return blobs.select("blob", "text").mapInArrow(run, LEDGER_SCHEMA)


def unseen_blobs(versions: DataFrame, ledger: Ledger | None, rule_version: str) -> DataFrame:
    """blob and one path of each blob of ``versions`` that the ledger has not at this rule version.

    Copies are folded into one row a blob before the ledger is asked, so a text
    with very many copies is no hot key.
    """
    chosen = versions.groupBy("blob").agg(F.min(_path_key()).alias("path"))
    if ledger is None:
        return chosen
    known = ledger.findings.filter(F.col("rule_version") == rule_version).select("blob")
    return chosen.join(known, "blob", "left_anti")


#: Rows and spans of findings that are sent to all tasks, together (some 16 bytes a span, 80 a row).
SENT_FINDINGS = 500_000


def _path_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def scan_increment(docs: DataFrame, ledger: Ledger | None = None, rule_version: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", scratch: Scratch | None = None, rules: Rules = BASE) -> Ledger:
    """The ledger with the versions of ``docs`` and the findings of their unseen blobs added.

    One path stands for each unseen blob. Texts are moved by blob and path, and
    the chosen keys are hashed, so that copies of a text never meet in one task
    and texts are neither sorted nor held.
    """
    scratch, rule_version = scratch or Scratch(docs.sparkSession, "ledger"), rule_version or rules.version
    base = text_rows(pick(docs, doc_id=id_col, text=text_col)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("blob", blob_id(F.col("text")))
    versions = scratch.save(base.select("doc_id", "blob"))
    chosen = unseen_blobs(versions, ledger, rule_version)
    blobs = base.select("blob", _path_key().alias("path"), "text").join(chosen.hint("shuffle_hash"), ["blob", "path"]).select("blob", "text")
    fresh = scratch.save(scan_blobs(blobs, rule_version, rules))
    rows, distinct = fresh.groupBy("blob").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if rows > distinct:  # a chosen path repeats its text
        fresh = scratch.save(fresh.dropDuplicates(["blob"]))
    if ledger is None:
        return Ledger(versions, fresh, [distinct], True, versions, fresh)
    return Ledger(ledger.paths.unionByName(versions), ledger.findings.unionByName(fresh), [*ledger.scanned, distinct], ledger.once, versions, fresh)


def scan_history(docs: DataFrame, increments: int = INCREMENTS, ledger: Ledger | None = None, rule_version: str = RULE_VERSION,
                 id_col: str = "doc_id", text_col: str = "text") -> Ledger:
    """Take ``docs`` in as so many increments, dealt by a hash of the id, each onto the ledger that the one before left."""
    scratch = Scratch(docs.sparkSession, "ledger")
    for k in range(increments):
        part = docs.filter(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(increments)) == k)
        ledger = scan_increment(part, ledger, rule_version, id_col, text_col, scratch)
    return ledger


def open_ledger(spark: SparkSession, path: str) -> Ledger | None:
    """The ledger that is kept in a folder; None if there is none yet. Its paths have ``increment`` and ``at`` besides."""
    entries = [folders.read_json(spark, f"{path}/entries/{name}") for name in folders.names(spark, f"{path}/entries")]
    if not entries:
        return None
    entries.sort(key=lambda e: e["increment"])
    read = lambda kind, schema: spark.read.schema(schema).parquet(*[f"{path}/{kind}/{e['folder']}" for e in entries])
    paths = read("paths", f"doc_id {entries[0]['id']}, blob string, increment long, at string")
    return Ledger(paths, read("findings", LEDGER_SCHEMA), [e["scanned"] for e in entries], True)


def keep_increment(path: str, docs: DataFrame, at: str, rules: Rules = BASE, id_col: str = "doc_id", text_col: str = "text") -> Ledger:
    """Scan what the kept ledger has not seen of ``docs`` at these rules, and keep it; the ledger as it then is.

    ``at`` names the time of the versions. The ledger has one writer at a time.
    """
    spark = docs.sparkSession
    known = open_ledger(spark, path)
    plain = None if known is None else Ledger(known.paths.select("doc_id", "blob"), known.findings, known.scanned, known.once)
    grown = scan_increment(docs, plain, None, id_col, text_col, rules=rules)
    number, folder = len(grown.scanned) - 1, uuid.uuid4().hex
    grown.last_paths.select("doc_id", "blob", F.lit(number).cast("long").alias("increment"), F.lit(at).alias("at")).write.parquet(f"{path}/paths/{folder}")
    grown.last_findings.write.parquet(f"{path}/findings/{folder}")
    kind = grown.last_paths.schema["doc_id"].dataType.simpleString()
    folders.write_json(spark, f"{path}/entries/{number:08d}.json", {"increment": number, "folder": folder, "id": kind, "scanned": grown.scanned[-1], "rules": rules.version})
    return open_ledger(spark, path)


def latest_versions(ledger: Ledger) -> DataFrame:
    """doc_id, blob, increment, at: the versions of each path's last increment of a kept ledger."""
    last = ledger.paths.groupBy(F.col("doc_id").alias("id")).agg(F.max("increment").alias("last"))
    rows = ledger.paths.join(last, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("increment") == F.col("last")))
    return rows.select("doc_id", "blob", "increment", "at")


def findings_by_path(ledger: Ledger, rule_version: str = RULE_VERSION) -> DataFrame:
    """Every version of every path, of all increments, with the findings of its blob at the rule version."""
    current = ledger.findings.filter(F.col("rule_version") == rule_version).drop("rule_version")
    current = current if ledger.once else current.dropDuplicates(["blob"])
    return ledger.paths.join(current.hint("shuffle_hash"), "blob")


def span_digest(findings: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the SHA-256 of the base spans and all spans as text."""
    listed = F.array_join(F.transform(
        F.arrays_zip("kinds", "starts", "ends"),
        lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(kinds, k -> k = '{kind}')) as long) as n_{kind}") for kind in KINDS]
    return findings.select("doc_id", *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"))


def redact_spans(docs: DataFrame, findings: DataFrame, mask: str = MASK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with every found secret replaced, by the ledger's findings; rows without one are not moved through Python.

    ``findings`` has doc_id, blob, starts and ends. Findings are met by document
    and content, so of rows that share an id each is masked by its own text's. If
    they are counted as few they are sent to all tasks and texts stay where they
    are read; else texts meet them by content. Columns may have any names.
    """
    found = Scratch(docs.sparkSession, "findings").save(findings.filter(F.size("starts") > 0).groupBy("blob", F.col("doc_id").alias("found_id")).agg(
        F.first("starts").alias("starts"), F.first("ends").alias("ends")))
    held = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("starts")), F.lit(0)).alias("spans")).first()
    found = F.broadcast(found) if held["n"] + held["spans"] <= SENT_FINDINGS else found.hint("shuffle_hash")
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), blob_id(F.col(f"`{text_col}`")).alias("own"))
    joined = keyed.join(found, (F.col("own") == F.col("blob")) & F.col("id").eqNullSafe(F.col("found_id")), "left")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([mask_text(t, s, e, mask) for t, s, e in zip(texts, starts, ends)])

    text_rows(docs)
    kept = {c: F.col("row").getField(c) for c in docs.columns}
    clean = joined.filter(F.col("starts").isNull()).select(*[v.alias(c) for c, v in kept.items()])
    hit = joined.filter(F.col("starts").isNotNull()).select(*[(masked(v, "starts", "ends") if c == text_col else v).alias(c) for c, v in kept.items()])
    return clean.unionByName(hit)


def mask_text(text: str, starts, ends, mask: str = MASK) -> str:
    """The text with the union of the spans replaced, one mask a stretch."""
    out, at = [], 0
    for s, e in sorted(zip(starts, ends)):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, int(e))
    return "".join(out) + text[at:]
