"""Splitting documents into paragraphs, and packing the nodes of documents into chunks with their section and neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalecrest.functions.text import chunk_id, token_estimate


_SPACE = " \t\n\f\r"


def paragraphs(docs: DataFrame, separator: str = "\n\n", id_col: str = "doc_id", text_col: str = "text", around: bool = False, nested: bool = False) -> DataFrame:
    """(doc_id, seq, text, start): the paragraphs that aren't blank, trimmed, with their byte offsets; ``around`` adds the texts before and after.

    Offsets add up over the paragraphs kept, each with its separator. A text without any is one paragraph as it is. A row of ``docs`` is a
    document, split by itself, so nothing is shuffled or sorted: its paragraphs follow each other in order, in the partition it was in.
    ``nested``: they are made as an array beside the document and then rows, rather than in a pass of their own over the table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()

    made = "seq int, text string, start long" + (", before string, after string" if around else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_bytes(batch, "text"):
                yield _split(some, separator, around)

    @F.arrow_udf(f"array<struct<{made}>>")
    def own(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            n = np.arange(len(part) + 1)
            of, *columns = _split(pa.RecordBatch.from_arrays([pa.array(n[:-1]), part], ["doc_id", "text"]), separator, around).columns
            items = pa.StructArray.from_arrays(columns, [f.split()[0] for f in made.split(", ")])
            yield pa.ListArray.from_arrays(pa.array(np.searchsorted(of.to_numpy(), n).astype(np.int32)), items)

    return rows.select("doc_id", F.inline(own("text"))) if nested else rows.mapInArrow(run, f"doc_id {kind}, {made}")


def _by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """A batch in parts of up to ``most`` bytes of a column, or of one row."""
    ends, at = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _split(docs: pa.RecordBatch, separator: str, around: bool) -> pa.RecordBatch:
    blank = lambda x: pc.equal(pc.binary_length(pc.ascii_trim(x, _SPACE)), 0).to_numpy(zero_copy_only=False)
    texts = docs.column("text")
    lists = pc.split_pattern(texts, separator)
    parts, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    kept = ~blank(parts)
    text, of = pc.ascii_trim(parts.filter(kept), _SPACE), of[kept]
    size = pc.binary_length(parts.filter(kept)).to_numpy().astype(np.int64) + len(separator.encode())
    whole = np.flatnonzero(blank(texts))
    if len(whole):
        order = np.argsort(np.concatenate([of, whole]), kind="stable")
        text = pa.concat_arrays([text, texts.take(pa.array(whole))]).take(pa.array(order))
        of, size = np.concatenate([of, whole])[order], np.concatenate([size, np.zeros(len(whole), np.int64)])[order]
    n = np.arange(len(of))
    first = np.searchsorted(of, of)  # where each one's document begins
    before = np.cumsum(size) - size
    columns = [docs.column("doc_id").take(pa.array(of)), pa.array((n - first).astype(np.int32)), text, pa.array(before - before[first])]
    if around:
        columns += [text.take(pa.array(n - 1, mask=n == first)), text.take(pa.array(n + 1, mask=n + 1 == np.searchsorted(of, of, "right")))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "seq", "text", "start", "before", "after"][: len(columns)])


@dataclass
class Segment:
    """A node's text as it is read, below the headings of ``crumb``."""

    text: str
    kind: str
    crumb: list[str]
    start: int = 0
    end: int = 0
    line_start: int | None = None
    line_end: int | None = None
    page: int | None = None
    language: str | None = None
    tokens: int = 0

    def __post_init__(self) -> None:
        self.tokens = (len(self.text.encode()) + 3) // 4


def cut_bytes(text: str, most: int) -> str:
    """The longest beginning of up to ``most`` bytes."""
    return text.encode()[:most].decode("utf-8", "ignore")


@dataclass
class Window_:
    """What becomes a chunk."""

    first: Segment
    texts: list[str] = field(default_factory=list)
    end: int = 0
    line_start: int | None = None
    line_end: int | None = None
    page_start: int | None = None
    page_end: int | None = None
    language: str | None = None
    truncated: bool = False

    def add(self, s: Segment, text: str | None = None) -> None:
        self.texts.append(s.text if text is None else text)
        self.end = s.end
        if text is not None:  # cut
            self.truncated = True
            return
        self.line_start = s.line_start if self.line_start is None else self.line_start
        self.line_end = s.line_end if s.line_end is not None else self.line_end
        self.page_start = s.page if self.page_start is None else self.page_start
        self.page_end = s.page if s.page is not None else self.page_end
        self.language = self.language or s.language

    @property
    def text(self) -> str:
        return "\n\n".join(self.texts)


@dataclass
class Walk:
    """How nodes become chunks.

    Segments follow each other in a chunk until the section changes or the next one would exceed ``max_tokens``, half of it (rounded
    up) before code and table cells if ``adaptive``. A segment that is too long alone is cut there and the chunk marked as truncated, unless
    ``recursive`` has divided it before. With ``overlap``, a chunk begins with segments of the one before that hold this share of its tokens. A last
    chunk of under ``min_tokens`` (a quarter of the most) joins the one before if that is of the same section.
    """

    max_tokens: int = 512
    min_tokens: int | None = None
    overlap: float = 0.0
    adaptive: bool = False
    recursive: bool = False

    def segments(self, nodes: Iterable[dict]) -> Iterator[Segment]:
        """The texts in the order of reading, each below its headings: one of level n replaces the crumbs from the n-th on."""
        crumb: list[str] = []
        for x in nodes:
            if x["kind"] == "heading" and x["text"] is not None:
                crumb = [*crumb[: max((x["level"] or 1) - 1, 0)], x["text"]]
            elif x["text"] and x["kind"] not in ("heading", "image", "link"):
                get = x.get
                s = Segment(x["text"], x["kind"], crumb, get("start") or 0, get("end") or 0, get("line_start"), get("line_end"), get("page"), get("language"))
                yield from self.divided(s) if self.recursive else [s]

    def divided(self, s: Segment) -> Iterator[Segment]:
        """Pieces of up to 4 x ``max_tokens`` bytes, between characters."""
        b, most, at = s.text.encode(), 4 * self.max_tokens, 0
        if len(b) <= most:
            yield s
            return
        while at < len(b):
            part = b[at : at + most].decode("utf-8", "ignore")
            n = len(part.encode())
            if not n:
                break
            yield Segment(part, s.kind, s.crumb, s.start + at, s.start + at + n, s.line_start, s.line_end, s.page, s.language)
            at += n

    def windows(self, segments: Iterable[Segment]) -> Iterator[Window_]:
        held: list[Window_] = []  # the last two, which may be joined
        for w in self._windows(segments):
            held.append(w)
            if len(held) > 2:
                yield held.pop(0)
        least = self.max_tokens // 4 if self.min_tokens is None else self.min_tokens
        if len(held) == 2 and (len(held[1].text.encode()) + 3) // 4 < least and held[0].first.crumb == held[1].first.crumb:
            last = held.pop()
            held[0].texts += last.texts
            held[0].end, held[0].line_end, held[0].page_end = last.end, last.line_end, last.page_end
        yield from held

    def _windows(self, segments: Iterable[Segment]) -> Iterator[Window_]:
        share = np.float32(min(max(self.overlap, 0.0), 0.9))
        source, ended = iter(segments), False
        buffer: list[Segment] = []
        while True:
            # a window begins with what is in the buffer, and reads on
            at = tokens = 0
            w = None
            while True:
                if at == len(buffer):
                    s = next(source, None)
                    if s is None:
                        ended = True
                        break
                    buffer.append(s)
                s = buffer[at]
                w = w or Window_(s)
                most = -(-self.max_tokens // 2) if self.adaptive and s.kind in ("code", "table-cell") else self.max_tokens
                if tokens and (s.crumb != w.first.crumb or tokens + s.tokens > most):
                    break
                at += 1
                if s.tokens > self.max_tokens:
                    w.add(s, cut_bytes(s.text, 4 * self.max_tokens))
                    break
                w.add(s)
                tokens += s.tokens
            if w is None:
                return
            yield w
            to = at
            if share > 0 and at > 1:
                target, held, back = int(np.float32(tokens) * share), 0, at - 1
                while back > 0 and held < target:
                    held += buffer[back].tokens
                    back -= 1
                to = max(1, back + 1)
            del buffer[:to]
            if ended and not buffer:
                return


CHUNK = "chunk int, text string, crumb array<string>, start long, `end` long, line_start int, line_end int, page_start int, page_end int, language string, truncated boolean"


def walk(nodes: DataFrame, how: Walk | None = None, id_col: str = "doc_id", in_order: bool = False) -> DataFrame:
    """(id, chunk, text, crumb, start, end, line_start, line_end, page_start, page_end, language, truncated) of the nodes of documents.

    nodes: id, seq, kind, text and what else ``Node`` has. They are sorted by document once and read as a stream, a
    document of any length too; only a chunk's nodes are held. Nodes that are ``in_order``, each document's one after the other in a
    partition as ``paragraphs`` gives them, are read as they lie.
    """
    how = how or Walk()
    return _streamed(nodes, id_col, CHUNK, lambda rows: ((n, w.text, w.first.crumb, w.first.start, w.end, w.line_start, w.line_end, w.page_start, w.page_end, w.language, w.truncated) for n, w in enumerate(how.windows(how.segments(rows)))), in_order)


def segments(nodes: DataFrame, how: Walk | None = None, id_col: str = "doc_id", in_order: bool = False) -> DataFrame:
    """(id, n, text, kind, crumb, start, end): the segments of documents in the order of reading."""
    how = how or Walk()
    return _streamed(nodes, id_col, "n int, text string, kind string, crumb array<string>, start long, `end` long", lambda rows: ((n, s.text, s.kind, s.crumb, s.start, s.end) for n, s in enumerate(how.segments(rows))), in_order)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _values(column: pa.Array) -> list:
    """As ``to_pylist``, in less time for strings and for what has no nulls."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or (not column.null_count and pa.types.is_integer(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _streamed(nodes: DataFrame, id_col: str, schema: str, make: Callable[[Iterable[dict]], Iterable[tuple]], in_order: bool = False) -> DataFrame:
    fields = [f.split() for f in schema.split(", ")]
    names = ["id", *(f[0].strip("`") for f in fields)]
    src = nodes.withColumnRenamed(id_col, "id")
    if not in_order:
        src = src.repartition("id").sortWithinPartitions("id", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = [None, *(_ARROW[f[1]] for f in fields)]
        out: list[tuple] = []

        def rows() -> Iterator[dict]:
            for batch in batches:
                kinds[0] = batch.schema.field("id").type
                for values in zip(*map(_values, batch.columns), strict=True):
                    yield dict(zip(batch.schema.names, values, strict=True))

        source = rows()
        row = next(source, None)
        while row is not None:
            key = row["id"]

            def one() -> Iterator[dict]:
                nonlocal row
                while row is not None and row["id"] == key:
                    yield row
                    row = next(source, None)

            mine = one()
            for made in make(mine):
                out.append((key, *made))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            for _ in mine:  # what wasn't asked for
                pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kind = nodes.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def outline(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, outline): the texts of the headings of level 1 at the top, and of the first heading inside each section at the top."""
    w = Window.partitionBy(id_col).orderBy("seq")
    top = F.sum((F.col("depth") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("top")
    n = nodes.where("kind in ('heading', 'section') or depth = 0").select(id_col, "seq", "kind", "text", "level", "depth", top)
    inside = n.withColumn("of", F.first(F.when(F.col("depth") == 0, F.col("kind"))).over(Window.partitionBy(id_col, "top").orderBy("seq")))
    first = F.row_number().over(Window.partitionBy(id_col, "top", "kind", "depth").orderBy("seq"))
    heads = inside.withColumn("nth", first).where("text is not null and kind = 'heading' and ((depth = 0 and level = 1) or (depth = 1 and of = 'section' and nth = 1))")
    return heads.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("h")).select(id_col, F.col("h.text").alias("outline"))


def dense_text(crumb: Column, text: Column) -> Column:
    """A chunk's text after its section's headings."""
    return F.when(F.size(crumb) > 0, F.concat(F.array_join(crumb, " › "), F.lit(". "), text)).otherwise(text)


def assembled(chunks: DataFrame, outlines: DataFrame | None = None, id_col: str = "doc_id", strategy: str = "walk") -> DataFrame:
    """Chunks with dense_text, its hash as id, links to their neighbours, their number and the document's, and what describes them in ``meta``."""
    w = Window.partitionBy(id_col).orderBy("chunk")
    c = chunks.join(outlines, id_col, "left") if outlines is not None else chunks.withColumn("outline", F.lit(None).cast("array<string>"))
    c = c.withColumn("dense_text", dense_text(F.col("crumb"), F.col("text")))
    c = c.withColumn("id", chunk_id(F.col("dense_text")))
    c = c.select("*", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"), F.count("*").over(Window.partitionBy(id_col)).alias("total"))
    some = F.size("crumb") > 0
    return c.withColumn("siblings", F.array_compact(F.array("prev", "next"))).withColumn(
        "meta",
        F.struct(
            F.when(some, F.element_at("crumb", -1)).alias("section_title"),
            F.when(some, F.size("crumb")).alias("heading_level"),
            F.col("crumb").alias("breadcrumb"),
            F.col("outline").alias("document_outline"),
            token_estimate(F.col("text")).alias("estimated_tokens"),
            F.lit(strategy).alias("strategy"),
            F.when(F.col("truncated"), F.lit(True)).alias("truncated"),
        ),
    ).drop("outline")


def transformed(chunks: DataFrame, f: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """A transformer's chunks; those whose key it has set to null are dropped."""
    return chunks.transform(f).where(F.col(key).isNotNull())


def pack(parts: DataFrame, max_tokens: int, in_order: bool = False) -> DataFrame:
    """(doc_id, chunk, first, last, n_tokens, text): paragraphs in order, a new chunk where the next one would exceed the limit.

    Paragraphs are sorted by document, unless they are ``in_order``, and read as a stream; only the open chunk is held.
    """

    def make(rows: Iterable[dict]) -> Iterator[tuple]:
        made, first, last, n, texts = 0, None, None, 0, []
        for r in rows:
            own = (len(r["text"].encode()) + 3) // 4
            if texts and n + own > max_tokens:
                yield made, first, last, n, "\n\n".join(texts)
                made, first, n, texts = made + 1, None, 0, []
            first = r["seq"] if first is None else first
            last, n = r["seq"], n + own
            texts.append(r["text"])
        if texts:
            yield made, first, last, n, "\n\n".join(texts)

    return _streamed(parts.select("doc_id", "seq", "text"), "doc_id", "chunk int, first int, last int, n_tokens long, text string", make, in_order)


def linked(chunks: DataFrame, seq: str = "chunk") -> DataFrame:
    """Chunks with their content id, their number, and the ids of the chunks before and after in the document."""
    w = Window.partitionBy("doc_id").orderBy(seq)
    named = chunks.withColumn("id", chunk_id(F.col("text")))
    return named.select("*", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"), F.count("*").over(Window.partitionBy("doc_id")).alias("total"))
