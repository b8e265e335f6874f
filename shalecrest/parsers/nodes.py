"""What parsers give, which parser a path is for, and parsers as DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalecrest.functions.text import extension, glob_regex


@dataclass
class Node:
    """A node of a document: its kind, text and place. ``depth`` is how deep it lies in the tree; level is a heading's."""

    kind: str
    text: str | None = None
    level: int | None = None
    depth: int = 0
    start: int = 0
    end: int = 0
    line_start: int | None = None
    line_end: int | None = None
    page: int | None = None
    language: str | None = None
    ordered: bool | None = None
    list_depth: int | None = None
    row: int | None = None
    col: int | None = None
    header: bool | None = None


NODE = "kind string, text string, level int, depth int, start long, `end` long, line_start int, line_end int, page int, language string, ordered boolean, list_depth int, row int, col int, header boolean"
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

Parser = Callable[[bytes], Iterable[Node]]


@dataclass
class FileChunker:
    """A parser by name, and the globs of the paths that it is for."""

    name: str
    parse: Parser
    patterns: list[str] = field(default_factory=list)


#: Formats by extension; any other is raw text.
FORMATS = {"md": "md", "markdown": "md", "mdx": "md", "pdf": "pdf", "docx": "docx", "tex": "latex", "latex": "latex", "txt": "txt"} | {x: "code" for x in "py js jsx mjs ts tsx rs go java c h cpp hpp cc rb php cs kt swift".split()}


def source_format(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), extension(path)), F.lit("raw"))


def first_chunker(path: Column, chunkers: list[FileChunker]) -> Column:
    """The name of the first chunker of which a pattern matches; null if none does."""
    out = F.lit(None).cast("string")
    for c in reversed(chunkers):
        out = F.when(_matches(path, c), c.name).otherwise(out)
    return out


def all_chunkers(files: DataFrame, chunkers: list[FileChunker], path: str = "path") -> DataFrame:
    """Each file once for every chunker that matches it, with the chunker's name."""
    names = F.array(*[F.when(_matches(F.col(path), c), c.name) for c in chunkers])
    return files.withColumn("chunker", F.explode(F.array_compact(names)))


def _matches(path: Column, chunker: FileChunker) -> Column:
    hit = F.lit(False)
    for p in chunker.patterns:
        hit = hit | path.rlike(glob_regex(p, directory=False))
    return hit


def parse(files: DataFrame, parsers: dict[str, Parser], by: str = "chunker", id_col: str = "path", content_col: str = "content", options: dict | None = None) -> DataFrame:
    """(id, seq, node columns..., error): the nodes of each file by the parser that column ``by`` names, in the order of reading.

    One pass without a shuffle. A file whose parser fails has one row, with seq null and the error; it isn't handed
    to another parser. A file without a known parser, or whose content is null, has no rows.
    """
    kind = files.schema[id_col].dataType.simpleString()
    src = files.select(F.col(id_col).alias("id"), F.col(by).cast("string").alias("by"), F.col(content_col).cast("binary").alias("content"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _nodes(batch, parsers)

    return src.mapInArrow(run, f"id {kind}, seq int, {NODE}, error string")


def _nodes(batch: pa.RecordBatch, parsers: dict[str, Parser], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The nodes of a batch of files, read one at a time; what is held ends with the file that fills ``most`` bytes or 20,000 rows."""
    names = ["id", "seq", *[c.split()[0].strip("`") for c in NODE.split(", ")], "error"]
    ids, rows, held = [], [], 0
    for at in range(batch.num_rows):
        key, which, content = (batch.column(i)[at].as_py() for i in range(3))
        if content is None or which not in parsers:
            continue
        try:
            found = [(n, *astuple(x), None) for n, x in enumerate(parsers[which](content))]
        except Exception as e:  # noqa: BLE001 - whatever a parser raises is the file's error
            found = [(None, *[None] * len(_KINDS), f"{type(e).__name__}: {e}")]
        rows += found
        ids += [key] * len(found)
        held += len(content)
        if len(rows) > 20_000 or held > most:
            yield _batch(ids, rows, names, batch.schema.field(0).type)
            ids, rows, held = [], [], 0
    yield _batch(ids, rows, names, batch.schema.field(0).type)


def _batch(ids, rows, names, id_type) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(_KINDS) + 2)
    kinds = [pa.int32(), *_KINDS, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def text_of(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def raw(content: bytes) -> Iterator[Node]:
    """Paragraphs between blank lines, trimmed; offsets add up over the parts kept. Without any, one paragraph of the whole text."""
    at, found = 0, False
    whole = text_of(content)
    for part in whole.split("\n\n"):
        if part.strip():
            n = len(part.encode())
            yield Node("paragraph", part.strip(), start=at, end=at + n)
            at, found = at + n + 2, True
    if not found:
        yield Node("paragraph", whole, end=len(content))
