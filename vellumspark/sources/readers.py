"""Readers with explicit schemas: files, JSON lines, eval cases, annotated contracts, collections, directory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contract_text as C

MESSAGES = "messages array<struct<role:string,content:string>>, metadata map<string,string>"
CUAD = ("data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,"
        "answers:array<struct<text:string,answer_start:int>>>>>>>>")
CASE = "case_id string, contract_type string, difficulty string, contract_text string, expected_clauses array<string>, expected_risks array<string>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with name, kind, size and time; kinds that are not accepted are left out."""
    from ..operators.chunking import file_kind

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.withColumn("kind", file_kind(F.col("path"))).filter(F.col("kind").isNotNull())


def listing(spark: SparkSession, path: str) -> DataFrame:
    """name, size, modified of the files under a path; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def json_lines(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    """JSON lines of a schema; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_in_order(spark: SparkSession, paths: list[str], schema: str = MESSAGES) -> DataFrame:
    """JSON lines of several files one after the other: ``source_no`` is a file's place in the list."""
    parts = [json_lines(spark, path, schema).withColumn("source_no", F.lit(k)) for k, path in enumerate(paths)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of every JSON file in a directory, each file a list or one object."""
    return spark.read.schema(CASE).option("multiLine", "true").json(path)


def annotated_contracts(spark: SparkSession, path: str) -> DataFrame:
    """title, context, question, answers, clause_type from nested question-answer annotations."""
    raw = spark.read.schema(CUAD).option("multiLine", "true").json(path)
    contracts = raw.select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    qas = contracts.select("title", "p.context", F.explode("p.qas").alias("q"))
    return qas.select("title", "context", "q.id", "q.question", "q.answers", C.question_type(F.col("q.question")).alias("clause_type"))


def spans(contracts: DataFrame) -> DataFrame:
    """Annotated spans inside their bounds, stripped. contracts: text, start, end (0-based, exclusive)."""
    inside = (F.col("start") >= 0) & (F.col("end") <= F.length("text")) & (F.col("start") < F.col("end"))
    return contracts.withColumn("span", F.when(inside, F.trim(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))))


def collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The points of one collection; the partition is pruned."""
    return spark.read.parquet(root).filter(F.col("collection_name") == name)


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.options(**options).load()


def metric_observations(metrics: DataFrame, name: str, since) -> DataFrame:
    return metrics.filter((F.col("name") == name) & (F.col("ts") >= since))
