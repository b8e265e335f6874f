"""DOCX files, and the text of PDF pages, to nodes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalecrest.parsers.nodes import Node

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(p: ElementTree.Element) -> str:
    """A paragraph's text: tracked insertions are in it, deletions aren't."""
    out = []

    def visit(e: ElementTree.Element) -> None:
        if e.tag == f"{_W}del":
            return
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag in (f"{_W}tab", f"{_W}br"):
            out.append(" ")
        for c in e:
            visit(c)

    visit(p)
    return "".join(out).strip()


def docx(content: bytes) -> Iterator[Node]:
    """Paragraphs, headings by the styles Heading1 to Heading6, and tables, of which the first row is the header."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    at = 0
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            if not (text := _text(e)):
                continue
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{_W}val", "")) if style is not None else None
            n = len(text.encode()) + 1
            yield Node("heading" if m else "paragraph", text, level=int(m.group(1)) if m else None, start=at, end=at + n)
            at += n
        elif e.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(_text, c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            size = lambda cells: sum(len(c.encode()) + 1 for c in cells if c)
            yield Node("table", None, start=at, end=at + sum(map(size, rows)))
            for r, cells in enumerate(rows):
                yield Node("table-row", None, depth=1, start=at, end=at + size(cells), row=r, header=r == 0)
                for c, cell in enumerate(cells):
                    n = len(cell.encode()) + 1 if cell else 0
                    yield Node("table-cell", cell or None, depth=2, start=at, end=at + n, row=r, col=c, header=r == 0)
                    at += n


def page_blocks(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text", separator: str = "\n\n") -> DataFrame:
    """(id, seq, kind, text, level, page, start, end): blocks of extracted page texts, in the order of pages.

    A block is a heading if it is one line of up to 120 bytes that doesn't end like a sentence or a list: of level 1 if
    it has no lower-case letters or up to 30 bytes, else of level 2. Line breaks in other blocks become spaces. Offsets add
    up over all blocks of a document, each with its separator.
    """
    parts = pages.select(F.col(id_col).alias("id"), F.col(page_col).cast("int").alias("page"), F.posexplode(F.split(F.col(text_col), separator, -1)).alias("at", "part"))
    block = F.regexp_replace("part", r"^\s+|\s+$", "")
    kept = parts.withColumn("block", block).where("block <> ''")
    n = F.octet_length("block")
    heading = ~F.col("block").contains("\n") & (n <= 120) & ~F.col("block").rlike(r"[.,;:!?)]$")
    w = Window.partitionBy("id").orderBy("page", "at")
    end = F.sum(n + 2).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return kept.select(
        "id",
        (F.row_number().over(w) - 1).alias("seq"),
        F.when(heading, "heading").otherwise("paragraph").alias("kind"),
        F.when(heading, F.col("block")).otherwise(F.translate("block", "\n", " ")).alias("text"),
        _level(heading, n),
        "page",
        (end - n - 2).alias("start"),
        end.alias("end"),
    )


def _level(heading: Column, n: Column) -> Column:
    return F.when(heading, F.when((F.col("block") == F.upper("block")) | (n <= 30), 1).otherwise(2)).alias("level")
