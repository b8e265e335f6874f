"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. To find which part of the result belongs to
which turn, without looking into the template, the prefixes of a conversation are rendered one turn longer each
time. Where a result only continues the one before, the new turn's span is what was added. Where it
doesn't, the template has rewritten history: the span is what differs, and the conversation is marked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.common import col, table

Template = Callable[[list[tuple[str, str]]], str]


def tagged(turns: list[tuple[str, str]]) -> str:
    """Each turn between marks with its role."""
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)


def instruct(turns: list[tuple[str, str]]) -> str:
    """Turns of the user in brackets, with a leading system text inside the first; answers end with a mark."""
    out, system = "", ""
    for role, text in turns:
        if role == "system":
            system += f"<<SYS>>\n{text}\n<</SYS>>\n\n"
        elif role == "user":
            out += f"[INST] {system}{text} [/INST]"
            system = ""
        else:
            out += f" {text} </s>"
    return out + (f"[INST] {system}" if system else "")


def latest(turns: list[tuple[str, str]]) -> str:
    """As ``tagged``, but a turn of the assistant keeps its text only while it is the last of them."""
    last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
    return "".join(f"<|{role}|>\n{'...' if role == 'assistant' and i != last else text}<|end|>\n" for i, (role, text) in enumerate(turns))


TEMPLATES: dict[str, Template] = {"tagged": tagged, "instruct": instruct, "latest": latest}


def common(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the prefixes up to lo are equal, those beyond hi aren't
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def spans(turns: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int, bool]]]:
    """(rendered, spans): for each turn start, end, and whether it rewrote what was there.

    A span holds for the rendering of the prefix that ends with its turn. It also holds in ``rendered`` unless a
    later turn rewrote from before its end; then it is cut where that begins.
    """
    before, out = "", []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        at = common(before, now)
        rewrote = at < len(before)
        if rewrote:
            out = [(min(a, at), min(b, at), r) for a, b, r in out]
        out.append((at, len(now), rewrote))
        before = now
    return before, out


def render(conversations: DataFrame, templates: dict[str, Template] | None = None) -> DataFrame:
    """(conv_id, template, n_turns, text, spans, rewrites): each conversation by each template.

    spans: "turn:role:start:end" for each turn, joined by spaces, in characters of ``text``; rewrites: the number
    of turns that changed what earlier turns had rendered. Turns are ordered by turn, role and text, nulls first, so
    ties are defined; repeated rows are turns of their own. A null role or text is rendered as an empty
    string. Rows with a null conv_id belong to no conversation and are left out. An empty table gives an
    empty result. Texts of any length are rendered whole; a conversation of n turns is rendered n times by each template. One shuffle brings a
    conversation together. Other columns are neither read nor returned.
    """
    templates = templates or TEMPLATES
    turns = conversations.where(col("conv_id").isNotNull()).groupBy(col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(col("turn").cast("long").alias("turn"), col("role").cast("string").alias("role"), col("text").cast("string").alias("text")))).alias("turns"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    said = [(r["role"] or "", r["text"] or "") for r in rows]
                    for name, template in templates.items():
                        text, found = spans(said, template)
                        marks = " ".join(f"{'' if r['turn'] is None else r['turn']}:{r['role'] or ''}:{a}:{b}" for r, (a, b, _) in zip(rows, found, strict=True))
                        out.append((conv, name, len(rows), text, marks, sum(w for _, _, w in found)))
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "template", "n_turns", "text", "spans", "rewrites"])

    return turns.mapInArrow(run, "conv_id long, template string, n_turns int, text string, spans string, rewrites int")


def query(spark, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


# By construction rather than by rendering prefixes: what each turn adds, in order. Only the template "latest" rewrites, at an
# answer after an earlier one, from that one's text on.
SQL = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER w AS k,
    count(*) FILTER (role = 'assistant') OVER w AS answers,
    count(*) OVER (PARTITION BY conv_id) AS n,
    count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS all_answers
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS tagged,
    '<|' || role || '|>' || chr(10) || CASE WHEN role = 'assistant' AND answers < all_answers THEN '...' ELSE text END || '<|end|>' || chr(10) AS latest,
    CASE role WHEN 'system' THEN '' WHEN 'user' THEN '[INST] ' || CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY k) = 'system' THEN '<<SYS>>' || chr(10) || lag(text) OVER (PARTITION BY conv_id ORDER BY k) || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text || ' [/INST]'
      ELSE ' ' || text || ' </s>' END AS part,
    length('[INST] <<SYS>>' || chr(10) || text || chr(10) || '<</SYS>>' || chr(10) || chr(10)) AS opened
  FROM t),
one AS (SELECT conv_id, turn, role, k, n, tagged AS part, sum(length(tagged)) OVER (PARTITION BY conv_id ORDER BY k) AS e FROM p),
two AS (SELECT conv_id, turn, role, k, n, part, sum(length(part)) OVER (PARTITION BY conv_id ORDER BY k) AS e, opened, lag(CASE WHEN role = 'system' THEN opened ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS open_before FROM p),
lens AS (SELECT conv_id, turn, role, k, n, latest, CASE WHEN role = 'assistant' THEN length(tagged) - length(text) + 3 ELSE length(tagged) END AS short, length(tagged) AS long,
    length('<|assistant|>') + 1 AS head, max(CASE WHEN role = 'assistant' THEN k END) OVER (PARTITION BY conv_id ORDER BY k) AS answer FROM p),
ends AS (SELECT *, sum(short) OVER (PARTITION BY conv_id ORDER BY k) AS c, lag(answer) OVER (PARTITION BY conv_id ORDER BY k) AS earlier FROM lens),
drawn AS (SELECT a.*, a.c + coalesce(b.long - b.short, 0) AS e, CASE WHEN a.role = 'assistant' AND a.earlier IS NOT NULL THEN o.c - o.short + a.head END AS again
  FROM ends a LEFT JOIN ends b ON a.conv_id = b.conv_id AND a.answer = b.k LEFT JOIN ends o ON a.conv_id = o.conv_id AND a.earlier = o.k),
three AS (SELECT *, coalesce(again, lag(e, 1, 0) OVER (PARTITION BY conv_id ORDER BY k)) AS b,
    coalesce(min(again) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1000000000000) AS bound FROM drawn)
SELECT conv_id, 'tagged' AS template, CAST(max(n) AS INTEGER) AS n_turns, string_agg(part, '' ORDER BY k) AS text,
  string_agg(turn || ':' || role || ':' || CAST(e - length(part) AS BIGINT) || ':' || CAST(e AS BIGINT), ' ' ORDER BY k) AS spans, CAST(0 AS INTEGER) AS rewrites FROM one GROUP BY conv_id
UNION ALL
SELECT conv_id, 'instruct', CAST(max(n) AS INTEGER), string_agg(part, '' ORDER BY k) || max(CASE WHEN k = n AND role = 'system' THEN '[INST] <<SYS>>' ELSE '' END),
  string_agg(turn || ':' || role || ':' || CAST(e - length(part) + coalesce(open_before, 0) AS BIGINT) || ':' || CAST(e + CASE WHEN role = 'system' THEN opened ELSE 0 END AS BIGINT), ' ' ORDER BY k), CAST(0 AS INTEGER) FROM two GROUP BY conv_id
UNION ALL
SELECT conv_id, 'latest', CAST(max(n) AS INTEGER), string_agg(latest, '' ORDER BY k),
  string_agg(turn || ':' || role || ':' || CAST(least(b, bound) AS BIGINT) || ':' || CAST(least(e, bound) AS BIGINT), ' ' ORDER BY k), CAST(count(again) AS INTEGER) FROM three GROUP BY conv_id
"""
