"""Markdown to nodes: the blocks of CommonMark with tables and front matter, and the plain text of their inlines."""

from __future__ import annotations

import re
from collections.abc import Iterator

from shalecrest.parsers.nodes import Node, text_of

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])(?:([ \t]+)(.*)|)$")
_HTML = re.compile(r" {0,3}<(?:[a-zA-Z/!?])")
_NOTE = re.compile(r" {0,3}\[\^[^\]]+\]:")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DIVIDER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def inline(s: str) -> str:
    """The plain text of inline Markdown: no marks, links as their text, images left out, code as it is."""
    kept: list[str] = []

    def keep(x: str) -> str:
        kept.append(x)
        return f"\x00{len(kept) - 1}\x00"

    s = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(m.group(2).strip()), s, flags=re.S)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m.group(1)), s)
    s = re.sub(r"!\[([^\]]*)\]\([^)]*\)", "", s)
    s = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", s)
    s = re.sub(r"\[([^\]]*)\]\[[^\]]*\]", r"\1", s)
    s = re.sub(r"<((?:https?|mailto):[^ >]+)>", r"\1", s)
    s = re.sub(r"</?[a-zA-Z][^<>]*>", "", s)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
        s = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", s, flags=re.S)
    s = re.sub(r"(?<!\w)(__?)(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", s, flags=re.S)
    s = re.sub(r"\x00([0-9]+)\x00", lambda m: kept[int(m.group(1))], s)
    return s


def _cells(line: str) -> list[str]:
    line = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [inline(c.replace("\\|", "|").strip()) for c in re.split(r"(?<!\\)\|", line)]


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip(" "))


class _Lines:
    """Lines with the byte offset at which each begins in the source, and its number."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = rows

    def cut(self, a: int, b: int, width: int) -> _Lines:
        """Lines a to b without up to ``width`` columns of indentation."""
        out = []
        for s, at, n in self.rows[a:b]:
            k = min(width, len(s) - len(s.lstrip(" \t")))
            out.append((s[k:], at + k, n))
        return _Lines(out)


def parse(content: bytes) -> Iterator[Node]:
    """Headings, paragraphs, code, quotes as sections, nested lists, tables; HTML, rules, footnotes and front matter are left out."""
    rows, at = [], 0
    for n, line in enumerate(text_of(content).split("\n"), 1):
        rows.append((line.rstrip("\r"), at, n))
        at += len(line.encode()) + 1
    if rows and rows[0][0].rstrip() == "---":
        end = next((i for i, (s, *_) in enumerate(rows[1:], 1) if s.rstrip() == "---"), None)
        if end is not None:
            rows = rows[end + 1 :]
    yield from _blocks(_Lines(rows), 0, 0)


def _node(lines: _Lines, a: int, b: int, kind: str, text: str | None, depth: int, **more) -> Node:
    first, last = lines.rows[a], lines.rows[b - 1]
    lead = len(first[0]) - len(first[0].lstrip(" \t"))
    return Node(kind, text, depth=depth, start=first[1] + lead, end=last[1] + len(last[0].encode()), line_start=first[2], line_end=last[2], **more)


def _blocks(lines: _Lines, depth: int, list_depth: int) -> Iterator[Node]:
    rows = lines.rows
    i, n = 0, len(rows)
    while i < n:
        s = rows[i][0]
        if not s.strip():
            i += 1
            continue
        if m := _FENCE.match(s):
            mark, info = m.groups()
            if mark[0] == "~" or "`" not in info:
                j = i + 1
                close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
                while j < n and not close.match(rows[j][0]):
                    j += 1
                text = "\n".join(r[0] for r in rows[i + 1 : j]).rstrip()
                yield _node(lines, i, min(j + 1, n), "code", text or None, depth, language=(info.split() or [None])[0])
                i = j + 1
                continue
        if _indent(s) >= 4:
            j = i
            while j < n and (_indent(rows[j][0]) >= 4 or not rows[j][0].strip()):
                j += 1
            while not rows[j - 1][0].strip():
                j -= 1
            text = "\n".join(re.sub(r"^(?: {4}| {0,3}\t)", "", r[0]) for r in rows[i:j]).rstrip()
            yield _node(lines, i, j, "code", text or None, depth)
            i = j
            continue
        if m := _ATX.match(s):
            if text := inline((m.group(2) or "").strip()):
                yield _node(lines, i, i + 1, "heading", text, depth, level=len(m.group(1)))
            i += 1
            continue
        if _RULE.match(s):
            i += 1
            continue
        if s.lstrip().startswith(">") and _indent(s) < 4:
            j, inner = i, []
            while j < n and rows[j][0].strip() and (rows[j][0].lstrip().startswith(">") or not _starts(rows[j][0])):
                t, at, k = rows[j]
                cut = re.match(r"[ \t]*>? ?", t).end() if t.lstrip().startswith(">") else 0
                inner.append((t[cut:], at + cut, k))
                j += 1
            yield _node(lines, i, j, "section", None, depth)
            yield from _blocks(_Lines(inner), depth + 1, list_depth)
            i = j
            continue
        if m := _ITEM.match(s):
            i = yield from _list(lines, i, m, depth, list_depth)
            continue
        if _HTML.match(s) and not re.match(r" {0,3}<(?:https?|mailto):", s):
            while i < n and rows[i][0].strip():
                i += 1
            continue
        if _NOTE.match(s):
            i += 1
            while i < n and (_indent(rows[i][0]) >= 4 or (rows[i][0].strip() and not _starts(rows[i][0]))):
                i += 1
            continue
        if "|" in s and i + 1 < n and "-" in rows[i + 1][0] and _DIVIDER.match(rows[i + 1][0]) and len(_cells(s)) == len(_cells(rows[i + 1][0])):
            j = i + 2
            while j < n and rows[j][0].strip() and not _starts(rows[j][0]):
                j += 1
            yield _node(lines, i, j, "table", None, depth)
            width = len(_cells(s))
            for r, k in enumerate([i, *range(i + 2, j)]):
                yield _node(lines, k, k + 1, "table-row", None, depth + 1, row=r, header=r == 0)
                for c, cell in enumerate((_cells(rows[k][0]) + [""] * width)[:width]):
                    yield _node(lines, k, k + 1, "table-cell", cell or None, depth + 2, row=r, col=c, header=r == 0)
            i = j
            continue
        j = i + 1
        level = None
        while j < n and rows[j][0].strip():
            if u := _SETEXT.match(rows[j][0]):
                level = 1 if u.group(1)[0] == "=" else 2
                break
            if _starts(rows[j][0]):
                break
            j += 1
        text = inline(" ".join(r[0].strip() for r in rows[i:j]).strip())
        end = j + 1 if level else j
        if text:
            yield _node(lines, i, end, "heading" if level else "paragraph", text, depth, level=level)
        i = end


def _starts(s: str) -> bool:
    """Whether a line ends a paragraph by beginning another block."""
    m = _ITEM.match(s)
    return bool(_FENCE.match(s) or _ATX.match(s) or _RULE.match(s) or s.lstrip().startswith(">") and _indent(s) < 4 or (m and m.group(4) and (not m.group(2)[0].isdigit() or m.group(2)[:-1] == "1")))


def _list(lines: _Lines, i: int, m: re.Match, depth: int, list_depth: int):
    rows, n = lines.rows, len(lines.rows)
    kind, begin = m.group(2)[-1], i
    items: list[tuple[int, int, int]] = []
    while i < n and (m := _ITEM.match(rows[i][0])) and m.group(2)[-1] == kind and not _RULE.match(rows[i][0]):
        width = len(m.group(1)) + len(m.group(2)) + (min(len(m.group(3)), 4) if m.group(3) and m.group(4) else 1)
        j, blank = i + 1, False
        while j < n:
            t = rows[j][0]
            if not t.strip():
                blank = True
            elif _indent(t) >= width:
                blank = False
            elif blank or _starts(t) or _ITEM.match(t):
                break
            j += 1
        end = j
        while end > i + 1 and not rows[end - 1][0].strip():
            end -= 1
        items.append((i, end, width))
        i = j
    yield _node(lines, begin, items[-1][1], "list", None, depth, ordered=kind in ".)" and rows[begin][0].lstrip()[0].isdigit(), list_depth=list_depth)
    for a, b, width in items:
        inner = lines.cut(a + 1, b, width)
        first, at, k = rows[a]
        inner.rows.insert(0, (first[width:], at + width, k))
        if inner.rows[0][0][:4] in ("[ ] ", "[x] ", "[X] "):
            inner.rows[0] = (inner.rows[0][0][4:], at + width + 4, k)
        below = list(_blocks(inner, depth + 2, list_depth + 1))
        # the item's text is that of its own blocks; lists in it are nodes below it
        own, nested, deep = [], [], False
        for x in below:
            if x.depth == depth + 2:
                deep = x.kind == "list"
            if deep:
                nested.append(x)
            elif x.text:
                own.append(x.text)
        yield _node(lines, a, b, "list-item", " ".join(own) or None, depth + 1, list_depth=list_depth + 1)
        yield from nested
    return i
