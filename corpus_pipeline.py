"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1. language ID rejects texts without a recognisable language;
2. the n-gram Jaccard join keeps one document of each class of near copies;
3. secret scans mask every secret in the texts that are left;
4. mixing gives every source its target share, as whole copies of documents;
5. packing cuts the mixed documents into sequences.

Stages 1 to 4 return the columns of ``documents``; a document that the mix takes
more than once is that many rows. Every stage works on all rows it is given, and
columns beyond those of ``documents`` come through with whatever names they have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm.common import Scratch
from vellumspark.llm.jaccard import jaccard_classes
from vellumspark.llm.langid import keep_identified, train_prototypes
from vellumspark.llm.mixing import mix_documents
from vellumspark.llm.packing import pack_documents
from vellumspark.llm.registry import tokenizer_path
from vellumspark.llm.secrets import findings_by_path, redact_spans, scan_history

#: Cosine under which a text of 150 and more trigrams is like no language that the corpus labels. On the test tables such clean
#: texts have 0.15 at least (a text of one repeated word), random letters of any script 0.08 at the median and up to 0.16.
LEAST_COSINE = 0.12

def keyed_rows(docs: DataFrame) -> DataFrame:
    """row (all columns, whatever their names), doc_id, text, source, and two hashes of id and text.

    ``key`` brings rows without an id, or with another's, through the operators;
    rows are one document only if both hashes are equal, 128 bits in all.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    return docs.select(row.alias("row"), "doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key2"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``row``."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language. Prototypes are learned from all rows that name theirs."""
    return keep_identified(docs, train_prototypes(docs), LEAST_COSINE)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class; a null id comes last. Rows equal in id and text are one document."""
    rows = keyed_rows(docs)
    classes = jaccard_classes(rows, id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.select("key", "doc_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    kept = ids.join(classes, "key").groupBy("component_id").agg(F.min(place)["key"].alias("key")).select("key").distinct()
    whole = rows.select("row", "key", "key2")  # the text moves in the row alone
    return unpacked(whole.join(kept.hint("shuffle_hash"), "key").dropDuplicates(["key", "key2"]), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars is the masked text's."""
    masked = redact_spans(docs, findings_by_path(scan_history(docs)))
    counted = {"n_chars": F.length("text").cast("long")}
    return masked.select(*[counted.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, under one id."""
    rows = keyed_rows(docs)
    taken = mix_documents(rows, id_col="key").groupBy(F.col("doc_id").alias("key")).agg(F.max("copies").alias("n"))
    taken = taken.filter("n > 0").select("key", F.sequence(F.lit(1), "n").alias("copies"))
    return unpacked(rows.select("row", "key").join(taken.hint("shuffle_hash"), "key").withColumn("copy", F.explode("copies")), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the learned language profiles nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        following = scratch.save(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = following
    return docs
