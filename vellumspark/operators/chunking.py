"""Pages to chunks: recursive splitting, page overlap, table and image chunks, merging.

A page's chunks depend on the tail of the page before, so one document is one
sequential unit; documents are dealt over tasks by id and read in order, a page
at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import contract_text as C

SEPARATORS = ("\n\n", "\n", ".", " ")
CHUNK_SCHEMA = "doc_id string, chunk_index int, page_number int, text string"


def split_text(text: str, size: int = P.CHUNK_SIZE, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters where separators allow it.

    The first separator that occurs cuts the text; parts are joined again while
    they fit, and a part that is too long is cut with the separators after it. A
    text without any separator is cut at every ``size`` characters.
    """
    if len(text) <= size:
        return [text]
    found = next((i for i, s in enumerate(separators) if s in text), None)
    if found is None:
        return [text[i : i + size] for i in range(0, len(text), size)]
    sep = separators[found]
    pieces: list[str] = []
    open_piece: str | None = None
    for part in text.split(sep):
        joined = part if open_piece is None else open_piece + sep + part
        if len(joined) <= size:
            open_piece = joined
            continue
        if open_piece is not None:
            pieces.append(open_piece)
        if len(part) > size:
            pieces += split_text(part, size, separators[found + 1 :])
            open_piece = None
        else:
            open_piece = part
    if open_piece is not None:
        pieces.append(open_piece)
    return pieces


#: Characters of texts that a task splits before it sends their chunks on.
SPLIT_CHARS = 1 << 22


class PageChunker:
    """Chunks of one document's pages, given one after the other; between pages it holds the tail of the last one."""

    def __init__(self, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP):
        self.size, self.overlap, self.tail, self.before = size, overlap, "", None

    def page(self, number: int, text: str | None) -> Iterator[tuple[int, str]]:
        """(page number, text) of each chunk. A page starts with the tail of the one before; a chunk that is mostly tail counts there."""
        if not (text or "").strip():
            return
        tail, before = self.tail, self.before
        kept = [p.strip() for p in split_text(f"{tail} {text}" if tail else text, self.size) if p.strip()]
        for k, piece in enumerate(kept):
            mostly_tail = k == 0 and tail and before is not None and len(tail) > len(piece) / 2
            yield (before if mostly_tail else number), piece
        self.tail = kept[-1][-self.overlap:] if kept and self.overlap else ""
        self.before = number


def chunk_document(pages: list[tuple[int, str]], size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> Iterator[tuple[int, str]]:
    """(page number, text) of each chunk of a document."""
    chunker = PageChunker(size, overlap)
    for number, text in pages:
        yield from chunker.page(number, text)


#: Kinds of chunks in the order in which a document's index runs over them.
KINDS = ("text", "table", "image")
MERGED_SCHEMA = "doc_id string, chunk_index int, page_number int, chunk_type string, text string"


def chunk_in_order(pages: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """MERGED_SCHEMA: text chunks of pages, then a chunk a table, then one an image, under one running index a document.

    pages: doc_id, page_number, text; tables and images: doc_id, page_number, pos,
    text (an image's description). Rows are dealt by document and sorted within
    partitions, on disk where they don't fit. A task reads them in order and holds
    a page, the tail of the one before and a number, never a document. Blank pages,
    tables and descriptions give no chunk and don't break the tail's way; a null
    page number comes first, equal ones go by text; a null id is a document.
    """
    row = lambda frame, kind, pos: frame.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(kind).alias("kind"), F.col("page_number").cast("int").alias("page_number"), pos.alias("pos"), "text")
    rows = row(pages, 0, F.lit(0))
    for kind, frame in ((1, tables), (2, images)):
        rows = rows if frame is None else rows.unionByName(row(frame, kind, F.col("pos").cast("int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, chunker, index = None, None, 0
        for batch in batches:
            out = []
            for own, kind, number, _, text in zip(*[c.to_pylist() for c in batch.columns]):
                if chunker is None or own != doc:
                    doc, chunker, index = own, PageChunker(size, overlap), 0
                found = chunker.page(number, text) if kind == 0 else [(number, text)] if (text or "").strip() else []
                for page, piece in found:
                    out.append((doc, index, page, KINDS[kind], piece))
                    index += 1
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "chunk_index", "page_number", "chunk_type", "text"])

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "page_number", "pos", "text").mapInArrow(run, MERGED_SCHEMA)


def chunk_pages(pages: DataFrame, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """CHUNK_SCHEMA for pages (doc_id, page_number, text)."""
    return chunk_in_order(pages, size=size, overlap=overlap).drop("chunk_type")


def chunk_single_pages(pages: DataFrame) -> DataFrame:
    """CHUNK_SCHEMA for documents of one page each, as ``chunk_pages`` gives it, where the pages are read.

    A task holds the rows that Spark sends it at once, and of these the strings and
    chunks of ``SPLIT_CHARS`` characters and one text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, pieces, held = [], [], [], 0

            def sent() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(places, pa.int32()), batch.column(1).take(at), pa.array(pieces, pa.string())], names=["doc_id", "chunk_index", "page_number", "text"])

            for row, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                kept = [p.strip() for p in split_text(text) if p.strip()]
                rows += [row] * len(kept)
                places += range(len(kept))
                pieces += kept
                held += len(text)
                if held >= SPLIT_CHARS:
                    yield sent()
                    rows, places, pieces, held = [], [], [], 0
            yield sent()

    return pages.select(F.col("doc_id").cast("string"), F.col("page_number").cast("int"), "text").mapInArrow(run, CHUNK_SCHEMA)


def paragraph_pages(paragraphs: DataFrame, a_page: int = 40) -> DataFrame:
    """Non-blank paragraphs (doc_id, pos, text) as pages of so many."""
    kept = paragraphs.filter(F.trim("text") != "")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    numbered = kept.withColumn("page_number", F.floor(place / a_page).cast("int") + 1)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return numbered.groupBy("doc_id", "page_number").agg(ordered.alias("p")).select("doc_id", "page_number", F.array_join("p.text", "\n").alias("text"))


def table_page(place: Column, tables: Column, paragraphs: Column, a_page: int = 40) -> Column:
    """Page of the table at ``place`` (from 0): tables spread evenly over pages, leftovers on the last."""
    pages = F.floor(paragraphs / a_page) + 1
    each = F.greatest(F.floor(tables / pages), F.lit(1))
    return F.least(F.floor(place / each) + 1, pages).cast("int")


def row_sentence(header: Column, cells: Column) -> Column:
    """'H1: v1 | H2: v2' of a table row; blank headers are numbered, blank cells left out."""
    named = F.transform(header, lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(F.trim(h)))
    pairs = F.zip_with(named, cells, lambda h, v: F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(h, F.lit(": "), F.trim(v))))
    return F.array_join(F.array_compact(pairs), " | ")


def table_html(rows: Column) -> Column:
    """<table> markup of an array of rows, each an array of cells."""
    cells = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>"))), ""),
                                                 F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(cells, ""), F.lit("</table>"))


def table_markdown(rows: Column) -> Column:
    """Markdown of an array of rows, the first being the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.transform(F.element_at(rows, 1), lambda c: F.lit("---"))
    return F.array_join(F.concat(F.array(line(F.element_at(rows, 1)), line(rule)), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def table_chunks(pages: DataFrame) -> DataFrame:
    """One chunk a non-blank table. pages: doc_id, page_number, tables array<struct<html,text>>."""
    each = pages.select("doc_id", "page_number", F.posexplode("tables").alias("pos", "t")).filter(F.trim("t.text") != "")
    return each.select("doc_id", "page_number", "pos", F.col("t.text").alias("text"), F.array("t.html").alias("tables_html"), F.lit("table").alias("chunk_type"))


def usable_images(pages: DataFrame, side: int = 100, size: int = 5120) -> DataFrame:
    """Images of accepted kinds that are large enough; jpg is jpeg. pages: doc_id, page_number, images."""
    each = pages.select("doc_id", "page_number", F.explode("images").alias("i")).select("doc_id", "page_number", "i.*")
    kind = F.lower("image_ext")
    kept = each.filter(kind.isin("png", "jpeg", "jpg") & (F.col("width") >= side) & (F.col("height") >= side) & (F.length("image_bytes") >= size))
    return kept.withColumn("image_ext", F.when(kind == "jpg", "jpeg").otherwise(kind))


def merge_chunks(text: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Text, then table, then image chunks of each document under one running index."""
    parts = [f.withColumn("kind", F.lit(k)) for k, f in enumerate((text.withColumn("pos", F.col("chunk_index")).drop("chunk_index"), tables, images))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("kind", "page_number", "pos")
    return both.withColumn("chunk_index", F.row_number().over(order) - 1).drop("kind", "pos")


def classified(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("clause_type", C.clause_type(F.col("text"))).withColumn("section_reference", C.section_reference(F.col("text")))


def documents_of(chunks: DataFrame) -> DataFrame:
    """Embedding units: context header and text, with the chunk itself kept as a struct."""
    head = C.context_header(F.col("doc_id"), F.col("page_number"), F.col("clause_type"), F.col("section_reference"))
    return chunks.withColumn("page_content", F.concat(head, "text")).withColumn("original_content", F.struct(*chunks.columns))


def parse_stats(pages: DataFrame) -> DataFrame:
    """Pages, non-blank pages and characters of each document; images and tables too where pages have such arrays."""
    more = [F.sum(F.coalesce(F.size(c), F.lit(0))).alias(c) for c in ("images", "tables") if c in pages.columns]
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.trim("text") != "").alias("non_empty"), F.sum(F.length("text")).alias("chars"), *more)


def answer_sources(ranked: DataFrame) -> DataFrame:
    """What an answer cites of each ranked chunk. ranked: qid, rank, text, payload (JSON of the chunk), source_file, relevance_score."""
    chunk = F.from_json("payload", PAYLOAD)
    types = F.array_sort(content_types(F.coalesce(chunk["tables_html"], F.array().cast("array<string>")), F.coalesce(chunk["images_base64"], F.array().cast("array<string>"))))
    return ranked.select("qid", "rank", F.col("text").alias("content"), F.coalesce(chunk["raw_text"], F.col("text")).alias("raw_text"), chunk["page_numbers"].alias("page_numbers"),
                         F.coalesce("source_file", F.lit("")).alias("source_file"), types.alias("content_types"), "relevance_score")


PAYLOAD = "raw_text string, tables_html array<string>, images_base64 array<string>, page_numbers array<int>, clause_type string"


def promoted(points: DataFrame) -> DataFrame:
    """Points with the fields of their JSON payload as columns; a payload that doesn't parse gives nulls."""
    return points.withColumn("o", F.from_json("payload", PAYLOAD)).select(*points.columns, "o.*").drop("payload")


def content_types(tables: Column, images: Column) -> Column:
    return F.array_compact(F.array(F.lit("text"), F.when(F.size(tables) > 0, "table"), F.when(F.size(images) > 0, "image")))


def file_kind(path: Column) -> Column:
    """pdf or docx by extension; null is not accepted."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("docx", "doc"), "docx")
