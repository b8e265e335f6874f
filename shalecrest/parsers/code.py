"""Source code to nodes: a definition is a section with its signature, a comment a paragraph, the rest code."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from functools import partial

from shalecrest.parsers.nodes import Node, text_of

LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "rb": "ruby", "cs": "csharp", "kt": "kotlin", "swift": "swift", "php": "php"}
MOST = 400  # bytes of a signature

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|declare|pub(?:\([^)]*\))?|unsafe|virtual|override|sealed|partial|readonly|inline|extern|const(?=\s+fn))\s+)*"
_DEFS = {
    "javascript": rf"{_MODS}(?:function\b|class\s|interface\s|enum\s|type\s+\w+\s*[=<]|namespace\s|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)",
    "rust": rf"{_MODS}(?:fn|impl|struct|enum|trait|mod|type|const|static|union)\b",
    "go": r"(?:func|type)\b",
    "ruby": r"(?:def|class|module)\b",
    "php": rf"{_MODS}(?:function|class|interface|trait|enum)\b",
    "swift": rf"{_MODS}(?:func|class|struct|enum|protocol|extension)\b",
    "kotlin": rf"{_MODS}(?:fun|class|interface|object|enum\s+class|data\s+class)\b",
    "java": rf"(?:@\w+\s+)*{_MODS}(?:(?:class|interface|enum|record|struct|namespace)\s|[\w<>\[\],.?]+\s+\w+\s*\([^;]*$|[\w<>\[\],.?]+\s+\w+\s*\([^;{{]*\)[^;]*\{{)",
    "c": rf"{_MODS}(?:(?:struct|class|enum|union|namespace|typedef\s+struct)\s+\w*[^;()]*\{{|(?!(?:return|else|if|for|while|switch|case)\b)[\w:<>*&~\s]+?\([^;{{]*\)[^;{{]*(?:\{{|$))",
}
_DEFS["typescript"] = _DEFS["javascript"]
_DEFS["csharp"] = _DEFS["java"]
_DEFS["cpp"] = _DEFS["c"]
_METHOD = {"javascript": re.compile(rf"{_MODS}(?:get\s+|set\s+|\*\s*)?(?!(?:if|for|while|switch|return|catch)\b)#?\w+\s*(?:<[^>]*>)?\([^;]*\)[^;{{]*\{{")}
_METHOD["typescript"] = _METHOD["javascript"]


def signature(text: str) -> str:
    """A definition's text up to its body in one line, of 400 bytes at most, without the brace or colon at its end."""
    head = text.encode()[:MOST].decode("utf-8", "ignore")
    return " ".join(filter(None, map(str.strip, head.splitlines()))).rstrip("{: \t\n")


def _bare(comment: str) -> str:
    return comment.lstrip("/*#- \t!").removesuffix("*/").strip()


def python(content: bytes) -> Iterator[Node]:
    """Functions and classes, nested ones below their own, by Python's grammar; a source that isn't Python raises SyntaxError."""
    source = text_of(content)
    tree = ast.parse(source)
    lines = source.splitlines(keepends=True)
    first = [0]
    for s in lines:
        first.append(first[-1] + len(s.encode()))
    comments: dict[int, tuple[int, str]] = {}
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type == tokenize.COMMENT and not lines[t.start[0] - 1][: t.start[1]].strip():
            comments[t.start[0]] = (t.start[1], t.string)
    below = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

    def note(n: int, depth: int) -> Iterator[Node]:
        col, s = comments.pop(n)
        if _bare(s):
            at = first[n - 1] + len(lines[n - 1][:col].encode())
            yield Node("paragraph", _bare(s), depth=depth, start=at, end=at + len(s.encode()), line_start=n, line_end=n)

    def walk(body: list, depth: int, last: int) -> Iterator[Node]:
        for x in body:
            begin = min([x.lineno, *(d.lineno for d in getattr(x, "decorator_list", []))])
            for n in sorted(k for k in comments if k < begin):
                yield from note(n, depth)
            place = {"depth": depth, "start": first[begin - 1] + (x.col_offset if begin == x.lineno else 0), "end": first[x.end_lineno - 1] + x.end_col_offset, "line_start": begin, "line_end": x.end_lineno, "language": "python"}
            if isinstance(x, below):
                inner = x.body[0]
                to = min([inner.lineno, *(d.lineno for d in getattr(inner, "decorator_list", []))])
                head = "".join(lines[x.lineno - 1 : to - 1]) if to > x.lineno else ast.unparse(x).splitlines()[0]
                yield Node("section", signature(re.sub(r"(?m)^\s*#.*$", "", head)), level=depth + 1, **place)
                yield from walk(x.body, depth + 1, x.end_lineno)
            else:
                text = content[place["start"] : place["end"]].decode("utf-8", "replace")
                yield Node("code", text, **place)
                for n in [k for k in comments if begin <= k <= x.end_lineno]:
                    del comments[n]  # part of the statement
        for n in sorted(k for k in comments if k <= last):
            yield from note(n, depth)

    yield from walk(tree.body, 0, len(lines))


def braces(content: bytes, language: str) -> Iterator[Node]:
    """Definitions of a language whose bodies stand in braces, or end with ``end``, by the patterns of their first lines."""
    source = text_of(content)
    define = re.compile(r"\s*(?:" + _DEFS[language] + ")")
    method = _METHOD.get(language)
    blank = _blanked(source, language)
    lines = source.split("\n")
    bare = blank.split("\n")
    first = [0]
    for s in lines:
        first.append(first[-1] + len(s.encode()) + 1)

    def end_of(i: int, last: int) -> tuple[int, int | None]:
        """(last line, line of the body's begin) of the definition that begins at line i."""
        if language == "ruby":
            width = len(lines[i]) - len(lines[i].lstrip())
            j = next((j for j in range(i + 1, last) if re.match(rf"\s{{{width}}}end\b", lines[j])), i)
            return j, i
        level, opened = 0, None
        for j in range(i, last):
            for c in bare[j]:
                if c == "{":
                    opened = j if opened is None else opened
                    level += 1
                elif c == "}":
                    level -= 1
                elif c == ";" and opened is None:
                    return j, None
                if opened is not None and level <= 0:
                    return j, opened
            if opened is None and j > i + 20:
                break
        return i, opened

    def node(kind: str, text: str, a: int, b: int, depth: int, **more) -> Node:
        return Node(kind, text, depth=depth, start=first[a] + len(lines[a]) - len(lines[a].lstrip()), end=first[b] + len(lines[b].encode()), line_start=a + 1, line_end=b + 1, language=language, **more)

    def walk(a: int, b: int, depth: int) -> Iterator[Node]:
        held: list[int] = []

        def flush() -> Iterator[Node]:
            if held:
                text = "\n".join(lines[held[0] : held[-1] + 1])
                if text.strip(" \t\n{}"):
                    yield node("code", text, held[0], held[-1], depth)
                held.clear()

        i = a
        while i < b:
            s = lines[i]
            if not s.strip():
                yield from flush()
                i += 1
            elif not bare[i].strip():  # all of the line is comment
                yield from flush()
                j = i
                while j < b and lines[j].strip() and not bare[j].strip():
                    j += 1
                text = "\n".join(filter(None, (_bare(x.strip()) for x in lines[i:j])))
                if text:
                    yield node("paragraph", text, i, j - 1, depth)
                i = j
            elif define.match(bare[i]) or (depth and method and method.match(bare[i].lstrip())):
                yield from flush()
                to, body = end_of(i, b)
                head = "\n".join(lines[i : (to if body is None else body) + 1])
                head = head.split("{", 1)[0] if body is not None and language != "ruby" else head.split("\n", 1)[0] if language == "ruby" else head
                yield node("section", signature(head), i, to, depth, level=depth + 1)
                if body is not None and to > body + 1:
                    yield from walk(body + 1, to, depth + 1)
                i = to + 1
            else:
                held.append(i)
                i += 1
        yield from flush()

    yield from walk(0, len(lines), 0)


def _blanked(source: str, language: str) -> str:
    """The source with comments and strings replaced by spaces, lines kept."""
    text = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'" + (r"|`(?:\\.|[^`\\])*`" if language in ("javascript", "typescript", "go") else "")
    if language == "rust":
        text = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"
    comment = r"#[^\n]*" if language == "ruby" else r"//[^\n]*|/\*[\s\S]*?\*/"
    return re.sub(f"({comment})|{text}", lambda m: re.sub(r"[^\n]", " " if m.group(1) else "_", m.group()), source)


def top_level(content: bytes, language: str = "typescript") -> Iterator[Node]:
    """Leading imports as one code node, then a section for each top-level declaration with its whole text as code below it."""
    source = text_of(content)
    found = [x for x in braces(content, language) if x.depth == 0]
    lines = source.split("\n")
    imports = []
    for x in found:
        if x.kind == "code" and re.match(r"\s*(?:import\b|export\s+.*\bfrom\b|(?:const|let|var)\s.*\brequire\()", x.text):
            imports.append(x)
        elif x.kind != "paragraph":
            break
    if imports:
        yield Node("code", "\n".join(x.text for x in imports), start=imports[0].start, end=imports[-1].end, line_start=imports[0].line_start, line_end=imports[-1].line_end, language=language)
    for x in found:
        if x.kind == "section":
            yield x
            yield Node("code", "\n".join(lines[x.line_start - 1 : x.line_end]), depth=1, start=x.start, end=x.end, line_start=x.line_start, line_end=x.line_end, language=language)
        elif x not in imports:
            yield x


def by_bytes(content: bytes, most: int = 1500, overlap_lines: int = 0) -> Iterator[Node]:
    """Whole lines in pieces of up to ``most`` bytes, each beginning with the last lines of the one before; a longer line is a piece."""
    lines = text_of(content).split("\n")
    sizes = [len(s.encode()) + 1 for s in lines]
    first = [0]
    for n in sizes:
        first.append(first[-1] + n)
    i = 0
    while i < len(lines):
        j, held = i, 0
        while j < len(lines) and (j == i or held + sizes[j] <= most):
            held += sizes[j]
            j += 1
        text = "\n".join(lines[i:j])
        if text.strip():
            yield Node("code", text, start=first[i], end=first[j] - 1, line_start=i + 1, line_end=j)
        i = j if j == len(lines) else max(j - overlap_lines, i + 1)


PARSERS: dict[str, Callable[[bytes], Iterator[Node]]] = {"python": python} | {lang: partial(braces, language=lang) for lang in _DEFS}
