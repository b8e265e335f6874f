"""LaTeX to nodes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from shalecrest.parsers.nodes import Node, text_of

LEVELS = {name: n for n, name in enumerate("chapter section subsection subsubsection paragraph subparagraph".split(), 1)}
_CODE = {"verbatim", "lstlisting", "minted"}
_MATH = {"equation", "align", "gather", "multline", "displaymath", "math", "eqnarray"}
_FLOATS = {"figure", "table", "wrapfigure", "subfigure"}
_OPEN = {"document", "center", "quote", "quotation", "flushleft", "flushright"}
_TOKEN = re.compile(
    r"(?P<comment>(?<!\\)%[^\n]*(?:\n(?![ \t]*\n))?)|(?P<env>\\begin\s*\{(?P<name>[a-zA-Z]+)\*?\})|\\end\s*\{[a-zA-Z]+\*?\}|(?P<blank>\n[ \t]*\n\s*)|(?P<display>\$\$.*?\$\$|\\\[.*?\\\])"
    r"|(?P<head>\\(?P<what>chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]]*\])?(?=\s*\{))|(?P<meta>\\(?:title|author|date)(?=\s*\{))|(?P<note>\\footnote(?=\s*\{))|(?P<caption>\\caption(?:\[[^\]]*\])?(?=\s*\{))",
    re.S,
)


def _group(s: str, at: int) -> tuple[str, int]:
    """(content, end) of the braces that begin at or after ``at``."""
    a = s.index("{", at)
    level = 0
    for i in range(a, len(s)):
        if s[i] == "\\":
            continue
        if s[i] in "{}" and (i == 0 or s[i - 1] != "\\"):
            level += 1 if s[i] == "{" else -1
            if not level:
                return s[a + 1 : i], i + 1
    return s[a + 1 :], len(s)


def plain(s: str) -> str:
    """Text without commands: citations, references and labels go, of others the last argument stays; math stays as it is."""
    s = re.sub(r"(?<!\\)%[^\n]*\n?", "", s)
    s = re.sub(r"~?\\(?:cite\w*|ref|eqref|autoref|cref|pageref|label|index|vspace|hspace|includegraphics|bibliography\w*|input|include|usepackage|documentclass)\*?(?:\[[^\]]*\])*\s*\{[^{}]*\}", "", s)
    for _ in range(8):
        t = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\s*\{([^{}]*)\}", r"\1", s)
        if t == s:
            break
        s = t
    s = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", s)
    s = re.sub(r"\\([%&_#$ {}])", r"\1", s)
    math: list[str] = []
    s = re.sub(r"\$[^$]*\$", lambda m: math.append(m.group()) or f"\x00{len(math) - 1}\x00", s)
    s = re.sub(r"\\[a-zA-Z]+\*?\s?", "", s)
    s = s.replace("~", " ").replace("``", '"').replace("''", '"').replace("---", "—").replace("--", "–")
    s = re.sub(r"[{}]", "", s)
    s = re.sub(r"\x00([0-9]+)\x00", lambda m: math[int(m.group(1))], s)
    return re.sub(r"\s+", " ", s).strip()


def parse(content: bytes) -> Iterator[Node]:
    """Headings by sectioning commands, paragraphs between blank lines, code, formulas, tables, captions, footnotes and the abstract.

    Inline math of up to 60 bytes stays in its text, longer is a formula of its own. Of floats only the caption is kept, and
    environments that aren't known are left out.
    """
    s = text_of(content)
    # bytes before each character are only needed where a node begins or ends
    offset = lambda i: len(s[:i].encode())
    begin = s.find(r"\begin{document}")
    if begin >= 0:
        for m in re.finditer(r"\\(title|author|date)(?=\s*\{)", s[:begin]):
            text, end = _group(s, m.end())
            if plain(text):
                yield Node("metadata", plain(text), start=offset(m.start()), end=offset(end), language=m.group(1))
    yield from _walk(s, max(begin, 0), len(s), offset)


def _walk(s: str, at: int, end: int, offset) -> Iterator[Node]:
    held: list[str] = []
    since = at

    def flush(to: int) -> Iterator[Node]:
        raw = "".join(held)
        held.clear()
        rest = raw
        long: list[str] = []
        rest = re.sub(r"\$[^$]*\$", lambda m: m.group() if len(m.group().encode()) <= 60 else long.append(m.group().strip("$").strip()) or " ", rest)
        if text := plain(rest):
            yield Node("paragraph", text, start=offset(since), end=offset(to))
        for f in long:
            yield Node("formula", f, start=offset(since), end=offset(to))

    while at < end:
        m = _TOKEN.search(s, at, end)
        if not m:
            held.append(s[at:end])
            break
        held.append(s[at : m.start()])
        at = m.end()
        if m.group("comment"):
            continue
        if m.group("note"):
            text, at = _group(s, at)
            note = Node("paragraph", plain(text), start=offset(m.start()), end=offset(at))
            if note.text:
                yield note
            continue
        if m.group("blank"):
            yield from flush(m.start())
        elif m.group("display"):
            yield from flush(m.start())
            if f := m.group().strip("$").removeprefix("\\[").removesuffix("\\]").strip():
                yield Node("formula", f, start=offset(m.start()), end=offset(at))
        elif m.group("head") or m.group("meta") or m.group("caption"):
            yield from flush(m.start())
            text, at = _group(s, at)
            if plain(text):
                kind = "heading" if m.group("head") else "metadata" if m.group("meta") else "paragraph"
                yield Node(kind, plain(text), level=LEVELS.get(m.group("what") or ""), start=offset(m.start()), end=offset(at))
        elif m.group("env"):
            yield from flush(m.start())
            name = m.group("name")
            close = _closing(s, at, end, name)
            inner = s[at : close[0]]
            place = {"start": offset(m.start()), "end": offset(close[1])}
            if name in _CODE:
                code = re.sub(r"^(?:\[[^\]]*\])?(?:\{([a-zA-Z]+)\})?[ \t]*\n?", "", inner) if name != "verbatim" else inner
                language = re.match(r"(?:\[[^\]]*\])?\{([a-zA-Z]+)\}", inner) if name == "minted" else re.search(r"\A\[[^\]]*language=(\w+)", inner)
                if code.strip():
                    yield Node("code", code.strip("\n").rstrip(), language=language.group(1).lower() if language else None, **place)
            elif name in _MATH:
                if inner.strip():
                    yield Node("formula", re.sub(r"\\label\{[^}]*\}", "", inner).strip(), **place)
            elif name in ("tabular", "tabularx", "longtable"):
                yield from _table(inner, place)
            elif name in _FLOATS:
                for c in re.finditer(r"\\caption(?:\[[^\]]*\])?(?=\s*\{)", inner):
                    if text := plain(_group(inner, c.end())[0]):
                        yield Node("paragraph", text, **place)
                if name == "table" and (t := re.search(r"\\begin\{(tabularx?|longtable)\}(.*?)\\end\{\1\}", inner, re.S)):
                    yield from _table(t.group(2), place)
            elif name == "abstract":
                yield Node("section", None, **place)
                for x in _walk(s, at, close[0], offset):
                    x.depth += 1
                    yield x
            elif name in _OPEN:
                yield from _walk(s, at, close[0], offset)
            at = close[1]
        since = at
    yield from flush(end)


def _closing(s: str, at: int, end: int, name: str) -> tuple[int, int]:
    """Where the environment that is open at ``at`` ends: before and after its end command."""
    level = 1
    for m in re.finditer(rf"\\(begin|end)\s*\{{{name}\*?\}}", s[at:end]):
        level += 1 if m.group(1) == "begin" else -1
        if not level:
            return at + m.start(), at + m.end()
    return end, end


def _table(inner: str, place: dict) -> Iterator[Node]:
    body = re.sub(r"^\s*(?:\[[^\]]*\])?(?:\{[^{}]*\}){1,2}", "", inner)
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", body)
    rows = [[plain(c) for c in re.split(r"(?<!\\)&", r)] for r in re.split(r"\\\\", body) if r.strip()]
    if rows:
        yield Node("table", None, **place)
        for r, cells in enumerate(rows):
            yield Node("table-row", None, depth=1, row=r, header=r == 0, **place)
            for c, cell in enumerate(cells):
                yield Node("table-cell", cell or None, depth=2, row=r, col=c, header=r == 0, **place)
