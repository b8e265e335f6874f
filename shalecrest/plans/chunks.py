"""Parsing and chunking of documents: the nodes of a tree in the order of reading, their sections, chunks and links."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from shalecrest.functions.text import slashed
from shalecrest.operators import chunking
from shalecrest.parsers import code, latex, markdown, nodes, office
from shalecrest.plans.corpus import _PARTS, lines
from shalecrest.plans.registry import query

# Every sixth line of a document stands for a heading, and of the others some for code.
_NODES = f"""{_PARTS},
n AS (SELECT doc_id, seq, start, start + strlen(text) AS "end", CASE WHEN seq % 6 = 0 THEN 'heading' WHEN strlen(text) % 5 = 0 THEN 'code' ELSE 'paragraph' END AS kind,
  CASE WHEN seq % 6 = 0 THEN 1 + strlen(text) % 3 END AS level, CASE WHEN seq % 6 = 0 THEN substr(text, 1, 24) ELSE text END AS text, CASE WHEN seq % 3 > 0 THEN seq // 10 + 1 END AS page FROM p)"""
_CRUMB = "CASE WHEN n.kind = 'heading' THEN list_append(f.bc[1:n.level - 1], n.text) ELSE f.bc END"


def doc_nodes(t, nested=False):
    x, head = F.col("text"), F.col("seq") % 6 == 0
    n = F.octet_length(x)
    return lines(t, nested).select(
        "doc_id",
        "seq",
        "start",
        (F.col("start") + n).alias("end"),
        F.when(head, "heading").when(n % 5 == 0, "code").otherwise("paragraph").alias("kind"),
        F.when(head, 1 + n % 3).cast("int").alias("level"),
        F.when(head, F.substring(x, 1, 24)).otherwise(x).alias("text"),
        F.when(F.col("seq") % 3 > 0, F.floor(F.col("seq") / 10) + 1).cast("int").alias("page"),
        (F.col("seq") + 1).cast("int").alias("line_start"),
        (F.col("seq") + 1).cast("int").alias("line_end"),
        F.lit(0).alias("depth"),
    )


@query("c1_segments", f"""WITH RECURSIVE {_NODES},
f AS (SELECT doc_id, seq, kind, text, CASE WHEN kind = 'heading' THEN [text] ELSE [] END AS bc FROM n WHERE seq = 0
  UNION ALL SELECT n.doc_id, n.seq, n.kind, n.text, {_CRUMB} FROM f JOIN n ON n.doc_id = f.doc_id AND n.seq = f.seq + 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS n, kind, array_to_string(bc, ' > ') AS crumb, length(text) AS size FROM f WHERE kind <> 'heading' AND text <> ''""")
def _(t):
    return chunking.segments(doc_nodes(t), in_order=True).select("doc_id", F.col("n").cast("long").alias("n"), "kind", F.array_join("crumb", " > ").alias("crumb"), F.length("text").cast("long").alias("size"))


@query("c2_outline", f"WITH {_NODES} SELECT doc_id, string_agg(text, '|' ORDER BY seq) AS outline FROM n WHERE kind = 'heading' AND level = 1 GROUP BY doc_id")
def _(t):
    return chunking.outline(doc_nodes(t)).select("doc_id", F.array_join("outline", "|").alias("outline"))


def _cut(most: int, text: str = "text") -> str:
    """The longest beginning of up to ``most`` bytes, whose characters have up to two bytes on average."""
    return f"substr({text}, 1, list_max(list_filter(generate_series({most // 2}, {most}), lambda k: strlen(substr({text}, 1, k)) <= {most})))"


@query("c4_divided", f"""WITH RECURSIVE {_PARTS}, f AS (SELECT doc_id, seq, 0 AS part, start AS off, CASE WHEN strlen(text) > 256 THEN {_cut(256)} ELSE text END AS piece, text AS rest FROM p WHERE text <> ''
  UNION ALL SELECT doc_id, seq, part + 1, off + strlen(piece), CASE WHEN strlen(r) > 256 THEN {_cut(256, 'r')} ELSE r END, r FROM (SELECT *, substr(rest, length(piece) + 1) AS r FROM f) WHERE r <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, part) - 1 AS n, CAST(off AS BIGINT) AS "start", CAST(off + strlen(piece) AS BIGINT) AS "end", substr(sha256(piece), 1, 16) AS id FROM f""")
def _(t):
    parts = lines(t).select("doc_id", "seq", "text", "start", (F.col("start") + F.octet_length("text")).alias("end"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"))
    return chunking.segments(parts, chunking.Walk(64, recursive=True), in_order=True).select("doc_id", F.col("n").cast("long").alias("n"), "start", "end", F.substring(F.sha2("text", 256), 1, 16).alias("id"))


_MOST = 128
_WINDOWS = f"""{_NODES},
g AS (SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tok, CASE WHEN kind = 'code' THEN {_MOST // 2} ELSE {_MOST} END AS lim FROM n),
f AS (SELECT doc_id, seq, CASE WHEN kind = 'heading' THEN [text] ELSE [] END AS bc, []::VARCHAR[] AS wbc, CAST(-1 AS BIGINT) AS win, CAST(0 AS BIGINT) AS held, true AS closed FROM g WHERE seq = 0
  UNION ALL SELECT doc_id, seq, bc, CASE WHEN kind = 'heading' OR NOT fresh THEN wbc ELSE bc END, CASE WHEN kind = 'heading' OR NOT fresh THEN win ELSE win + 1 END,
    CASE WHEN kind = 'heading' THEN held WHEN tok > {_MOST} THEN 0 WHEN fresh THEN tok ELSE held + tok END, CASE WHEN kind = 'heading' THEN closed ELSE tok > {_MOST} END
  FROM (SELECT n.doc_id, n.seq, n.kind, n.tok, f.win, f.wbc, f.held, f.closed, {_CRUMB} AS bc, f.closed OR (f.held > 0 AND ({_CRUMB} <> f.wbc OR f.held + n.tok > n.lim)) AS fresh
    FROM f JOIN g n ON n.doc_id = f.doc_id AND n.seq = f.seq + 1)),
s AS (SELECT f.doc_id, f.seq, f.win, f.wbc, g.start, g."end", g.page, g.tok > {_MOST} AS cut, CASE WHEN g.tok > {_MOST} THEN {_cut(4 * _MOST, 'g.text')} ELSE g.text END AS text FROM f JOIN g ON g.doc_id = f.doc_id AND g.seq = f.seq WHERE g.kind <> 'heading' AND g.text <> ''),
w AS (SELECT doc_id, win, any_value(wbc) AS bc, min(start) AS start, max("end") AS "end", min(seq) FILTER (NOT cut) + 1 AS line_start, max(seq) FILTER (NOT cut) + 1 AS line_end, min_by(page, seq) FILTER (NOT cut AND page IS NOT NULL) AS page_start,
    max_by(page, seq) FILTER (NOT cut AND page IS NOT NULL) AS page_end, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text, bool_or(cut) AS truncated FROM s GROUP BY doc_id, win),
j AS (SELECT *, max(win) OVER (PARTITION BY doc_id) AS last, lag(bc) OVER o AS before, lead(bc) OVER o AS after, lead(text) OVER o AS next_text, lead("end") OVER o AS next_end, lead(line_end) OVER o AS next_line, lead(page_end) OVER o AS next_page FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY win)),
k AS (SELECT *, win > 0 AND win = last AND ceil(strlen(text) / 4.0) < {_MOST // 4} AND before = bc AS gone, win = last - 1 AND ceil(strlen(next_text) / 4.0) < {_MOST // 4} AND after = bc AS joined FROM j),
c AS (SELECT doc_id, win AS chunk, bc, start, CASE WHEN joined THEN next_end ELSE "end" END AS "end", line_start, CASE WHEN joined THEN next_line ELSE line_end END AS line_end, page_start, CASE WHEN joined THEN next_page ELSE page_end END AS page_end,
    CASE WHEN joined THEN text || chr(10) || chr(10) || next_text ELSE text END AS text, truncated FROM k WHERE NOT coalesce(gone, false))"""


def doc_chunks(t, nested=False):
    return chunking.walk(doc_nodes(t, nested), chunking.Walk(_MOST, adaptive=True), in_order=True)


@query("c5_c6_c8_c13_windows", f"""WITH RECURSIVE {_WINDOWS} SELECT doc_id, chunk, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", CAST(coalesce(line_start, -1) AS BIGINT) AS line_start, CAST(coalesce(line_end, -1) AS BIGINT) AS line_end, CAST(coalesce(page_start, -1) AS BIGINT) AS page_start, CAST(coalesce(page_end, -1) AS BIGINT) AS page_end, truncated, substr(sha256(text), 1, 16) AS id FROM c""")
def _(t):
    return doc_chunks(t).select("doc_id", *[F.coalesce(F.col(x), F.lit(-1)).cast("long").alias(x) for x in ("chunk", "start", "end", "line_start", "line_end", "page_start", "page_end")], "truncated", F.substring(F.sha2("text", 256), 1, 16).alias("id"))


@query("c9_c11_c14_assembled", f"""WITH RECURSIVE {_WINDOWS}, d AS (SELECT doc_id, chunk, bc, text, truncated, substr(sha256(CASE WHEN len(bc) > 0 THEN array_to_string(bc, ' › ') || '. ' || text ELSE text END), 1, 16) AS id FROM c),
o AS (SELECT doc_id, string_agg(text, '|' ORDER BY seq) AS outline FROM n WHERE kind = 'heading' AND level = 1 GROUP BY doc_id)
SELECT d.doc_id, chunk, id, lag(id) OVER w AS prev, lead(id) OVER w AS next, count(*) OVER (PARTITION BY d.doc_id) AS total, bc[len(bc)] AS title, CAST(CASE WHEN len(bc) > 0 THEN len(bc) ELSE -1 END AS BIGINT) AS level, o.outline, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, truncated
FROM d LEFT JOIN o ON o.doc_id = d.doc_id WINDOW w AS (PARTITION BY d.doc_id ORDER BY chunk)""")
def _(t):
    a = chunking.assembled(doc_chunks(t), chunking.outline(doc_nodes(t)))
    m = "meta."
    return a.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "id", "prev", "next", "total", F.col(m + "section_title").alias("title"), F.coalesce(F.col(m + "heading_level"), F.lit(-1)).cast("long").alias("level"), F.array_join(m + "document_outline", "|").alias("outline"), F.col(m + "estimated_tokens").alias("tokens"), F.coalesce(F.col(m + "truncated"), F.lit(False)).alias("truncated"))


@query("c17_transformed", "SELECT doc_id, lang, lower(text[1:20]) AS text FROM documents WHERE n_chars >= 200")
def _(t):
    docs = t("documents").select("doc_id", "lang", "text", "n_chars")
    short = lambda d: d.withColumn("doc_id", F.when(F.col("n_chars") >= 200, F.col("doc_id"))).withColumn("text", F.lower(F.substring("text", 1, 20)))
    return chunking.transformed(docs, short, "doc_id").drop("n_chars")


# Documents as source files: their first words in the marks of each format.
_WORDS = "trim(regexp_replace(substr(text, {}, 60), '[^a-zA-Z]+', ' ', 'g'))"
_FILES = f"w AS (SELECT doc_id, trim('a ' || {_WORDS.format(1)}) AS a, trim('b ' || {_WORDS.format(61)}) AS b, trim('c ' || {_WORDS.format(121)}) AS c FROM documents)"


def _files(t):
    part = lambda at: F.trim(F.regexp_replace(F.substring("text", at, 60), "[^a-zA-Z]+", " "))
    return t("documents").select("doc_id", F.trim(F.concat(F.lit("a "), part(1))).alias("a"), F.trim(F.concat(F.lit("b "), part(61))).alias("b"), F.trim(F.concat(F.lit("c "), part(121))).alias("c"))


def _parsed(t, form: str, parser):
    """The nodes of files made by a format string of a, b and c."""
    content = F.format_string(form.replace("{a}", "%1$s").replace("{b}", "%2$s").replace("{c}", "%3$s"), "a", "b", "c")
    files = _files(t).select("doc_id", F.lit("x").alias("chunker"), content.alias("content"))
    return nodes.parse(files, {"x": parser}, id_col="doc_id").select(F.col("id").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "kind", "text", F.coalesce("level", F.lit(-1)).cast("long").alias("level"), F.col("depth").cast("long").alias("depth"), F.coalesce("line_start", F.lit(-1)).cast("long").alias("line"), "language")


def _expected(rows: list[tuple], ends: str = "") -> str:
    """SQL of the nodes that each file must give: kind, text, level, depth, line, language."""
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else v if v in ("a", "b", "c") or "||" in v else f"'{v}'"
    each = ", ".join(f"({n}, '{k}', {value(x)}, {value(lv)}, {d}, {value(ln)}, {value(lang)})" for n, (k, x, lv, d, ln, lang) in enumerate(rows))
    return f"WITH {_FILES} SELECT doc_id, CAST(v.seq AS BIGINT) AS seq, v.kind, CAST(v.text AS VARCHAR) AS text, CAST(coalesce(v.level, -1) AS BIGINT) AS level, CAST(v.depth AS BIGINT) AS depth, CAST(coalesce(v.line, -1) AS BIGINT) AS line, CAST(v.language AS VARCHAR) AS language FROM w, LATERAL (VALUES {each}) v(seq, kind, text, level, depth, line, language)"


_MD = "---\nkey: no\n---\n# {a}\n\n{b} **{c}**\n\n* {a}\n* {b}\n  1. {c}\n\n> {a}\n\n| {a} | {b} |\n|-----|-----|\n| {c} |  |\n\n```sql x\n{c}\n```\n\n<div>\n{a}\n</div>\n\n{b}\n---\n"


@query("p3_markdown", _expected([("heading", "a", 1, 0, 4, None), ("paragraph", "b || ' ' || c", None, 0, 6, None), ("list", None, None, 0, 8, None), ("list-item", "a", None, 1, 8, None), ("list-item", "b", None, 1, 9, None), ("list", None, None, 2, 10, None), ("list-item", "c", None, 3, 10, None), ("section", None, None, 0, 12, None), ("paragraph", "a", None, 1, 12, None), ("table", None, None, 0, 14, None), ("table-row", None, None, 1, 14, None), ("table-cell", "a", None, 2, 14, None), ("table-cell", "b", None, 2, 14, None), ("table-row", None, None, 1, 16, None), ("table-cell", "c", None, 2, 16, None), ("table-cell", None, None, 2, 16, None), ("code", "c", None, 0, 18, "sql"), ("heading", "b", 2, 0, 26, None)]))
def _(t):
    return _parsed(t, _MD, markdown.parse)


_PY = "import {x}\n# note\n@dec\ndef f(a,\n      b):\n    '''{a}'''\n    return a\n\nclass K:\n    def g(self):\n        return '''{b}'''\n".replace("{x}", "os")


@query("p7_source_code", _expected([("code", "import os", None, 0, 1, "python"), ("paragraph", "note", None, 0, 2, None), ("section", "def f(a, b)", 1, 0, 3, "python"), ("code", "chr(39) || chr(39) || chr(39) || a || chr(39) || chr(39) || chr(39)", None, 1, 6, "python"), ("code", "return a", None, 1, 7, "python"), ("section", "class K", 1, 0, 9, "python"), ("section", "def g(self)", 2, 1, 10, "python"), ("code", "'return ' || chr(39) || chr(39) || chr(39) || b || chr(39) || chr(39) || chr(39)", None, 2, 11, "python")]))
def _(t):
    return _parsed(t, _PY, code.python)


_TS = "import a from 'b';\nimport c from 'd';\n\n// {a}\nexport function f(x) {\n  return x;\n}\n\nclass B {\n  m() { return \"{b}\"; }\n}\nconst y = 2;\n"


@query("p8_top_level", _expected([("code", "'import a from ' || chr(39) || 'b' || chr(39) || ';' || chr(10) || 'import c from ' || chr(39) || 'd' || chr(39) || ';'", None, 0, 1, "typescript"), ("paragraph", "a", None, 0, 4, "typescript"), ("section", "export function f(x)", 1, 0, 5, "typescript"), ("code", "'export function f(x) {' || chr(10) || '  return x;' || chr(10) || '}'", None, 1, 5, "typescript"), ("section", "class B", 1, 0, 9, "typescript"), ("code", "'class B {' || chr(10) || '  m() { return \"' || b || '\"; }' || chr(10) || '}'", None, 1, 9, "typescript"), ("code", "const y = 2;", None, 0, 12, "typescript")]))
def _(t):
    return _parsed(t, _TS, code.top_level)


_TEX = "\\title{{a}}\\begin{document}\\section{{a}}{b} \\textbf{{c}} $x$ \\cite{k}.%% no\n\n{c}\\begin{itemize}\\item no\\end{itemize}\\begin{equation}{b}\\end{equation}\\begin{verbatim}\n{a}\n\\end{verbatim}\\begin{tabular}{ll}{a} & {b} \\\\ {c} & 2\\end{tabular}\\begin{figure}no \\caption{{b}}\\end{figure}\\end{document}"


@query("p6_latex", _expected([("metadata", "a", None, 0, None, "title"), ("heading", "a", 2, 0, None, None), ("paragraph", "b || ' ' || c || ' $x$ .'", None, 0, None, None), ("paragraph", "c", None, 0, None, None), ("formula", "b", None, 0, None, None), ("code", "a", None, 0, None, None), ("table", None, None, 0, None, None), ("table-row", None, None, 1, None, None), ("table-cell", "a", None, 2, None, None), ("table-cell", "b", None, 2, None, None), ("table-row", None, None, 1, None, None), ("table-cell", "c", None, 2, None, None), ("table-cell", "'2' || ''", None, 2, None, None), ("paragraph", "b", None, 0, None, None)]))
def _(t):
    return _parsed(t, _TEX, latex.parse)


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(a: str, b: str, c: str) -> bytes:
    """A small file: a heading, a paragraph with a tracked insertion and a deletion, and a table."""
    p = lambda x, style="": f"<w:p>{style}<w:r><w:t>{x}</w:t></w:r></w:p>"
    style = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
    body = p(a, style) + f"<w:p><w:r><w:t xml:space='preserve'>{b} </w:t></w:r><w:ins><w:r><w:t>{c}</w:t></w:r></w:ins><w:del><w:r><w:delText>no</w:delText></w:r></w:del></w:p>"
    body += f"<w:tbl><w:tr><w:tc>{p(a)}</w:tc><w:tc>{p(b)}</w:tc></w:tr><w:tr><w:tc>{p(c)}</w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("p5_docx", _expected([("heading", "a", 2, 0, None, None), ("paragraph", "b || ' ' || c", None, 0, None, None), ("table", None, None, 0, None, None), ("table-row", None, None, 1, None, None), ("table-cell", "a", None, 2, None, None), ("table-cell", "b", None, 2, None, None), ("table-row", None, None, 1, None, None), ("table-cell", "c", None, 2, None, None), ("table-cell", None, None, 2, None, None)]))
def _(t):
    def parser(content: bytes):
        return office.docx(docx(*content.decode().split("|")))

    return _parsed(t, "{a}|{b}|{c}", parser)


@query("p4_page_blocks", """WITH x AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS part FROM documents),
b AS (SELECT doc_id, pos, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS text FROM x), k AS (SELECT doc_id, pos, text, strlen(text) <= 120 AND NOT regexp_matches(text, '[.,;:!?)]$') AS head FROM b WHERE text <> '')
SELECT doc_id, row_number() OVER w - 1 AS seq, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS kind, CAST(CASE WHEN head THEN CASE WHEN text = upper(text) OR strlen(text) <= 30 THEN 1 ELSE 2 END ELSE -1 END AS BIGINT) AS level, CAST(sum(strlen(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS "end" FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def _(t):
    return office.page_blocks(t("documents").withColumn("page", F.lit(1)), separator="\n").select(F.col("id").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "kind", F.coalesce("level", F.lit(-1)).cast("long").alias("level"), "end")


@query("p9_by_bytes", """WITH RECURSIVE x AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS part FROM documents),
f AS (SELECT doc_id, pos, 0 AS piece, strlen(part) + 1 AS held FROM x WHERE pos = 1
  UNION ALL SELECT x.doc_id, x.pos, CASE WHEN f.held + strlen(x.part) + 1 <= 1500 THEN f.piece ELSE f.piece + 1 END, CASE WHEN f.held + strlen(x.part) + 1 <= 1500 THEN f.held + strlen(x.part) + 1 ELSE strlen(x.part) + 1 END FROM f JOIN x ON x.doc_id = f.doc_id AND x.pos = f.pos + 1),
g AS (SELECT f.doc_id, f.piece, min(f.pos) AS line, max(f.pos) AS last, string_agg(x.part, chr(10) ORDER BY f.pos) AS text FROM f JOIN x ON x.doc_id = f.doc_id AND x.pos = f.pos GROUP BY f.doc_id, f.piece)
SELECT doc_id, line, last, substr(sha256(text), 1, 16) AS id FROM g WHERE NOT regexp_matches(text, '\\A\\s*\\z')""")
def _(t):
    files = t("documents").select("doc_id", F.lit("x").alias("chunker"), F.col("text").alias("content"))
    return nodes.parse(files, {"x": code.by_bytes}, id_col="doc_id").select(F.col("id").alias("doc_id"), F.col("line_start").cast("long").alias("line"), F.col("line_end").cast("long").alias("last"), F.substring(F.sha2("text", 256), 1, 16).alias("id"))


_ENDS = "md py ts tex docx pdf txt rs MD".split()
_CHUNKERS = [nodes.FileChunker("notes", markdown.parse, ["src/src1*/**", "**/*.md"]), nodes.FileChunker("python", code.python, ["**/*.py"]), nodes.FileChunker("any-code", code.python, ["**/*.{py,ts,rs}"])]
_NAMED = f"p AS (SELECT doc_id, 'src/' || source || '/' || doc_id || '.' || [{', '.join(repr(e) for e in _ENDS)}][1 + doc_id % {len(_ENDS)}] AS path FROM documents)"


def named(t):
    """Documents as paths of several formats."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (1 + F.col("doc_id") % len(_ENDS)).cast("int"))
    return t("documents").select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), end).alias("path"))


_HITS = "regexp_matches(path, '^src/src1.*/.*$') OR path LIKE '%.md' AS notes, path LIKE '%.py' AS py, regexp_matches(path, '\\.(py|ts|rs)$') AS code"


@query("p10_p12_dispatch", f"""WITH {_NAMED}, h AS (SELECT *, {_HITS} FROM p) SELECT doc_id, CASE WHEN notes THEN 'notes' WHEN py THEN 'python' WHEN code THEN 'any-code' END AS chunker,
  CASE lower(regexp_extract(path, '\\.([^.]*)$', 1)) WHEN 'md' THEN 'md' WHEN 'tex' THEN 'latex' WHEN 'docx' THEN 'docx' WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'txt' ELSE 'code' END AS format FROM h""")
def _(t):
    return named(t).select("doc_id", nodes.first_chunker(F.col("path"), _CHUNKERS).alias("chunker"), nodes.source_format(F.col("path")).alias("format"))


@query("p11_all_chunkers", f"""WITH {_NAMED}, h AS (SELECT *, {_HITS} FROM p) SELECT doc_id, 'notes' AS chunker FROM h WHERE notes UNION ALL SELECT doc_id, 'python' FROM h WHERE py UNION ALL SELECT doc_id, 'any-code' FROM h WHERE code""")
def _(t):
    return nodes.all_chunkers(named(t), _CHUNKERS).select("doc_id", "chunker")


@query("p1_x3_parser_errors", f"""WITH {_NAMED} SELECT doc_id, CASE WHEN path LIKE '%.py' AND n_chars > 0 THEN 'error' ELSE 'paragraph' END AS kind FROM p JOIN documents USING (doc_id) WHERE path LIKE '%.py' OR path LIKE '%.txt'""")
def _(t):
    def broken(content: bytes):
        raise ValueError("not this one")

    chunkers = [nodes.FileChunker("broken", broken, ["**/*.py"]), nodes.FileChunker("raw", nodes.raw, ["**/*.txt", "**/*.py"])]
    files = named(t).join(t("documents").select("doc_id", F.col("text").alias("content")), "doc_id").withColumn("chunker", nodes.first_chunker(F.col("path"), chunkers))
    return nodes.parse(files, {c.name: c.parse for c in chunkers}, id_col="doc_id").select(F.col("id").alias("doc_id"), F.when(F.col("error").isNotNull(), "error").otherwise(F.col("kind")).alias("kind"))


@query("fn_path", f"WITH {_NAMED} SELECT doc_id, replace(regexp_extract(path, '^(.*)/[^/]*$', 1), chr(92), '/') AS dir FROM p")
def _(t):
    from shalecrest.functions.text import dirname

    return named(t).select("doc_id", dirname(F.translate("path", "/", "\\")).alias("dir")).withColumn("dir", slashed(F.col("dir")))
