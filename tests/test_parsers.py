"""Parsers and the chunk walk on small inputs, against plain Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shalecrest.operators import chunking
from shalecrest.parsers import code, latex, markdown, nodes, office
from shalecrest.plans.chunks import docx


def seen(found):
    return [(n.kind, n.text) for n in found]


def test_markdown_table_and_front_matter():
    found = list(markdown.parse(b"---\ntitle: x\n---\n# Head\n\n| a | b |\n|---|:-:|\n| 1 | `x|y` |\n"))
    assert seen(found)[0] == ("heading", "Head") and "title" not in str(found)
    assert [n.text for n in found if n.kind == "table-cell"][:3] == ["a", "b", "1"]
    assert [n.header for n in found if n.kind == "table-row"] == [True, False]


def test_markdown_bytes_and_lines():
    source = "# Ünï\n\npara one\ngoes on\n\n```py\nx = 1\n```\n".encode()
    found = list(markdown.parse(source))
    assert [source[n.start : n.end].decode() for n in found] == ["# Ünï", "para one\ngoes on", "```py\nx = 1\n```"]
    assert [(n.line_start, n.line_end) for n in found] == [(1, 1), (3, 4), (6, 8)] and found[2].language == "py"


def test_markdown_nested_lists_quotes_and_what_is_left_out():
    found = list(markdown.parse(b"- a\n  - b\n    - c\n- d\n\n> q\n> - r\n\n<div>\nno\n</div>\n\n[^1]: no\n\n***\n\nend"))
    assert [(n.text, n.list_depth) for n in found if n.kind == "list-item"] == [("a", 1), ("b", 2), ("c", 3), ("d", 1), ("r", 1)]
    assert found[-1].text == "end" and "no" not in [n.text for n in found]


def test_inline():
    assert markdown.inline("a **b** _c_ `d*e*` [f](g) ![h](i) ~~j~~ \\*k\\* snake_case_name") == "a b c d*e* f  j *k* snake_case_name"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #-*>|`\n\t1.[]_:\\", max_size=80))
def test_markdown_never_fails(text):
    for n in markdown.parse(text.encode()):
        assert n.start <= n.end <= len(text.encode()) + 1


def test_python_by_its_grammar():
    found = list(code.python(b"import os\n\n# about f\ndef f(a,\n      b=1):\n    return a\n\nclass K(object):\n    async def g(self):\n        pass\n"))
    assert ("section", "def f(a, b=1)") in seen(found) and ("section", "async def g(self)") in seen(found) and ("paragraph", "about f") in seen(found)
    assert [n.depth for n in found if n.kind == "section"] == [0, 0, 1]
    with pytest.raises(SyntaxError):
        list(code.python(b"def ("))


@pytest.mark.parametrize(
    "language, source, sections",
    [
        ("rust", "use a;\npub fn f(x: u8) -> u8 {\n  x\n}\nimpl K {\n  fn g(&self) {}\n}\n", ["pub fn f(x: u8) -> u8", "impl K", "fn g(&self)"]),
        ("go", "package p\n\nfunc F(a int) int {\n\treturn a\n}\ntype T struct {\n\tx int\n}\n", ["func F(a int) int", "type T struct"]),
        ("java", "class A {\n  int f(int x) {\n    return x; // }\n  }\n}\n", ["class A", "int f(int x)"]),
        ("typescript", "export class A {\n  m(x: string) {\n    return '}';\n  }\n}\nconst f = (a) => {\n  return a;\n};\n", ["export class A", "m(x: string)", "const f = (a) =>"]),
        ("c", "#include <x.h>\nint f(int a)\n{\n  return a;\n}\n", ["int f(int a)"]),
        ("ruby", "class A\n  def f(x)\n    x\n  end\nend\n", ["class A", "def f(x)"]),
    ],
)
def test_braces(language, source, sections):
    assert [n.text for n in code.PARSERS[language](source.encode()) if n.kind == "section"] == sections


def test_signature_is_short():
    assert len(code.signature("def f(" + "a, " * 1000 + "):").encode()) <= code.MOST


def test_pieces_by_bytes_cover_all_lines():
    text = "\n".join("x" * (i % 90) for i in range(300))
    found = list(code.by_bytes(text.encode(), 500, overlap_lines=2))
    covered = {n for x in found for n in range(x.line_start, x.line_end + 1)}
    assert covered >= {n + 1 for n, s in enumerate(text.split("\n")) if s} and all(len(x.text.encode()) <= 500 for x in found)


def test_latex():
    source = rb"\documentclass{x}\title{T}\begin{document}\chapter{A}\subsection*{B} one \emph{two} \cite{z}\footnote{note}" + b"\n\n" + rb"$$E=m$$ \begin{abstract}sum\end{abstract}\begin{itemize}\item gone\end{itemize}\begin{minted}{python}" + b"\nx=1\n" + rb"\end{minted} long $" + b"a" * 80 + rb"$ end\end{document}"
    found = list(latex.parse(source))
    assert [(n.text, n.level) for n in found if n.kind == "heading"] == [("A", 1), ("B", 3)]
    assert ("formula", "E=m") in seen(found) and ("paragraph", "note") in seen(found) and ("paragraph", "one two") in seen(found)
    assert ("formula", "a" * 80) in seen(found) and "gone" not in str(found) and [n.language for n in found if n.kind == "code"] == ["python"]


def test_docx():
    found = list(office.docx(docx("Head", "kept", "added")))
    assert seen(found)[:2] == [("heading", "Head"), ("paragraph", "kept added")] and found[0].level == 2
    assert [n.text for n in found if n.kind == "table-cell"] == ["Head", "kept", "added", None]


def test_raw_text():
    assert seen(nodes.raw(b"First paragraph.\n\nSecond paragraph.\n\nThird.")) == [("paragraph", x) for x in ("First paragraph.", "Second paragraph.", "Third.")]
    assert seen(nodes.raw(b"")) == [("paragraph", "")] and seen(nodes.raw(b"  ")) == [("paragraph", "  ")]
    assert [(n.start, n.end) for n in nodes.raw("é\n\n\n\nb".encode())] == [(0, 2), (4, 5)]


def test_headings_set_the_section_and_divide_chunks():
    rows = [("heading", "One", 1), ("paragraph", "a" * 8, None), ("heading", "Three", 3), ("paragraph", "b" * 8, None), ("heading", "Two", 2), ("paragraph", "c" * 8, None)]
    walk = chunking.Walk(100)
    found = list(walk.windows(walk.segments({"kind": k, "text": x, "level": n} for k, x, n in rows)))
    assert [w.first.crumb for w in found] == [["One"], ["One", "Three"], ["One", "Two"]]


def test_short_last_chunk_joins_the_one_before():
    walk = chunking.Walk(10)
    found = list(walk.windows(walk.segments({"kind": "paragraph", "text": x, "level": None} for x in ("a" * 40, "b"))))
    assert [w.texts for w in found] == [["a" * 40, "b"]]


def test_recursive_and_cut():
    long = {"kind": "paragraph", "text": "é" * 100, "level": None, "start": 5}
    one = chunking.Walk(10, recursive=True, min_tokens=0)
    parts = list(one.windows(one.segments([long])))
    assert "".join(w.text for w in parts) == "é" * 100 and all(len(w.text.encode()) <= 40 for w in parts) and parts[1].first.start == 45
    cut = list(chunking.Walk(10).windows(chunking.Walk(10).segments([long])))
    assert [len(w.text) for w in cut] == [20] and cut[0].truncated


def by_index(segments, most, share, least):
    """The windows by places in the list of segments, as the definition says."""
    import numpy as np

    out, start = [], 0
    while start < len(segments):
        i = start
        tokens = 0
        texts = []
        while i < len(segments):
            s = segments[i]
            if tokens and (s.crumb != segments[start].crumb or tokens + s.tokens > most):
                break
            i += 1
            texts.append(chunking.cut_bytes(s.text, 4 * most) if s.tokens > most else s.text)
            if s.tokens > most:
                break
            tokens += s.tokens
        out.append((segments[start].crumb, texts))
        if share > 0 and i > start + 1:
            target, held, back = int(np.float32(tokens) * np.float32(share)), 0, i - 1
            while back > start and held < target:
                held += segments[back].tokens
                back -= 1
            start = max(start + 1, back + 1)
        else:
            start = i
    if len(out) > 1 and -(-len("\n\n".join(out[-1][1]).encode()) // 4) < least and out[-1][0] == out[-2][0]:
        crumb, texts = out.pop()
        out[-1] = (crumb, out[-1][1] + texts)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 5)), max_size=30), st.sampled_from([0.0, 0.2, 0.5, 0.9]))
def test_windows_against_the_definition(sizes, share):
    segments = [chunking.Segment("x" * n, "paragraph", [str(c // 3)]) for n, c in sizes]
    walk = chunking.Walk(8, overlap=share)
    assert [(w.first.crumb, w.texts) for w in walk.windows(iter(segments))] == by_index(segments, 8, share, 2)


def test_walk_streams_documents(spark):
    rng = random.Random(1)
    rows = [(d, n, "paragraph", "w" * rng.randint(1, 90), None) for d in (1, 2, None) for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, kind string, text string, level int").repartition(5)
    got = chunking.walk(df, chunking.Walk(32)).collect()
    for d in (1, 2, None):
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.chunk)
        walk = chunking.Walk(32)
        assert [r.text for r in own] == [w.text for w in walk.windows(walk.segments({"kind": k, "text": x, "level": v} for i, _, k, x, v in rows if i == d))]


def test_outline(spark):
    rows = [(1, 0, "heading", "One", 1, 0), (1, 1, "heading", "not", 2, 0), (1, 2, "section", None, None, 0), (1, 3, "paragraph", "x", None, 1), (1, 4, "heading", "In", 3, 1), (1, 5, "heading", "second", 1, 1), (1, 6, "heading", "Two", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, kind string, text string, level int, depth int")
    assert chunking.outline(df).first().outline == ["One", "In", "Two"]


def test_nodes_are_given_before_they_are_many_bytes():
    import pyarrow as pa

    files = pa.RecordBatch.from_pydict({"id": list(range(40)), "by": ["x"] * 40, "content": [b"a" * 1000] * 40})
    got = list(nodes._nodes(files, {"x": nodes.raw}, most=4500))
    assert max(b.num_rows for b in got) == 5 and [i for b in got for i in b.column(0).to_pylist()] == list(range(40))
