"""Word-processor files to pages. A file is opened where it is read; pages are made of columns."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import table_html, table_markdown

# Fixed value: the namespace of word-processing markup.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = "paragraphs array<string>, tables array<array<array<string>>>, error string"


def _text(element: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join(e.text or "" if e.tag == f"{W}t" else marks.get(e.tag, "") for e in element.iter()).strip()


def _parts(content: bytes | None) -> tuple[list[str], list[list[list[str]]], str | None]:
    """Non-blank paragraphs and tables (rows of cells) of a file's body; an error message if it can't be opened."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml")).find(f"{W}body")
        found = [] if body is None else list(body)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return [], [], f"{type(e).__name__}: {e}"
    paragraphs = [t for t in (_text(e) for e in found if e.tag == f"{W}p") if t]
    tables = [[["\n".join(t for t in (_text(p) for p in cell.iter(f"{W}p")) if t) for cell in row.findall(f"{W}tc")] for row in e.findall(f"{W}tr")] for e in found if e.tag == f"{W}tbl"]
    return paragraphs, tables, None


@F.pandas_udf(PARTS)
def docx_parts(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parts(None if c is None else bytes(c)) for c in content], columns=["paragraphs", "tables", "error"])


def docx_pages(files: DataFrame, a_page: int = 40) -> DataFrame:
    """doc_id, page_number, text, tables (rows, html, text), error of each page. files: path, content.

    A page is ``a_page`` paragraphs. Tables are spread over pages in order, as
    many each as go evenly, at least one; what is left over is on the last page.
    A file without text, or one that can't be opened, is one blank page.
    """
    parts = files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), docx_parts("content").alias("x")).select("doc_id", "x.*")
    n, count = F.size("paragraphs"), F.size("tables")
    last = F.greatest(F.ceil(n / a_page), F.lit(1)).cast("int")
    each = F.greatest(F.floor(count / (F.floor(n / a_page) + 1)), F.lit(1))
    placed = F.transform("tables", lambda t, i: F.struct(F.least(F.floor(i / each) + 1, last).cast("int").alias("page"), t.alias("rows"), table_html(t).alias("html"), table_markdown(t).alias("text")))
    pages = parts.select("doc_id", "paragraphs", "error", placed.alias("placed"), last.alias("last"))
    pages = pages.select("doc_id", "paragraphs", "error", "placed", F.explode(F.sequence(F.lit(1), "last")).alias("page_number"))
    return pages.select("doc_id", "page_number", F.array_join(F.slice("paragraphs", (F.col("page_number") - 1) * a_page + 1, F.lit(a_page)), "\n").alias("text"),
                        F.transform(F.filter("placed", lambda t: t["page"] == F.col("page_number")), lambda t: F.struct(t["rows"].alias("rows"), t["html"].alias("html"), t["text"].alias("text"))).alias("tables"), "error")
