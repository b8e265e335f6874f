"""URL filters by a sort-merge range join.

A URL's key is its host's labels in reverse, each with a comma, then the path: http://m.a.com/x is com,a,m,/x.
All URLs that a rule covers then start with the rule's own key, so a rule is an interval of keys, and two
rules are disjoint or nested. URLs and rules are sorted together by key, and a sweep keeps the stack of
rules whose interval it is in; the innermost decides.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.common import col, table

#: (id, host with an optional port and path, action). A host covers its subdomains, a path what begins with it.
RULES = [
    (n, *rule)
    for n, rule in enumerate(
        [(f"{name}.example.{top}", "block") for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org")]
        + [("example.net", "allow"), ("ththth.example.net", "allow"), ("m.ththth.example.net/es", "block"), ("blog.tionsh.example.com/en/7", "block"), ("blog.tionsh.example.com/en/72", "allow"), ("blog.tionsh.example.com/en/720", "block")]
    )
]


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """(labels of the host in reverse, port, what follows): no scheme, user, port 80 or 443, or fragment; null labels without a host.

    The host is in lower case without a final dot. An IPv4 address or a bracketed IPv6 address is one label.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"(?s)#.*$", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    port = F.regexp_extract(host, r":([0-9]+)$", 1)
    name = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.$", "")
    one = name.startswith("[") | name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    labels = F.when(name == "", F.lit(None)).when(one, F.concat(name, F.lit(","))).otherwise(F.concat(F.concat_ws(",", F.reverse(F.split(name, r"\."))), F.lit(",")))
    odd = F.when((port == "") | port.isin("80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    return labels, odd, F.substring(rest, F.length(authority) + 1, 1 << 30)


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def url_key(url: Column) -> Column:
    """The canonical key of a URL; a missing path is "/". Null, or without a host: null."""
    labels, port, path = _parts(url)
    return F.concat(labels, port, _rooted(path))


def rule_key(rule: Column) -> Column:
    """What the keys of all URLs that the rule covers start with; null for a null rule or one without a host.

    A rule is made canonical as URLs are. A bare host covers its subdomains and all ports; with a port or a path it covers that host alone.
    """
    labels, port, path = _parts(rule)
    return F.when((port == "") & (path == ""), labels).otherwise(F.concat(labels, port, _rooted(path)))


class Sweep:
    """The stack of rules that cover a key, as keys come in order."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, str]] = []

    def to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def push(self, prefix: str, number: int, action: str) -> None:
        self.to(prefix)
        self.stack.append((prefix, number, action))


_OUT = "page_id long, url string, url_key string, n_rules int, rule_id long, action string, blocked boolean"


def _row(page, url, key, stack):
    return (page, url, key, len(stack), stack[-1][1] if stack else -1, stack[-1][2] if stack else "none", bool(stack) and stack[-1][2] == "block")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)


def match(pages: DataFrame, rules: DataFrame, small: int = 8 << 20, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, url_key, n_rules, rule_id, action, blocked): each page with the innermost rule that covers it.

    rules: rule_id, rule, action. While the keys of all rules take up to ``small`` bytes, every partition sorts
    its own URLs and sweeps them with all rules, without a shuffle. Beyond that both sides are range-partitioned
    by key at split points taken from the rules, with a rule in each range that it reaches into, and swept
    there. Both give the same rows.

    A null url, or one without a host, has a null key and no rules: n_rules 0, rule_id -1, action "none". Rules that are null, have no host,
    or a null id or action are left out; of rules for the same prefix the one of greatest id is the innermost, of those of one id the one of
    greatest action, and repeated rules count each. Repeated pages give repeated rows,
    an empty table an empty result; without rules nothing is blocked. URLs are read whole. Other columns are not read or returned.
    """
    src = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url")).withColumn("url_key", url_key(F.col("url")))
    known = rules.select(F.col("rule_id").cast("long").alias("rule_id"), rule_key(F.col("rule")).alias("prefix"), F.col("action").cast("string").alias("action")).where("prefix is not null and action is not null and rule_id is not null")
    if (known.agg(F.sum(F.octet_length("prefix") + 24)).first()[0] or 0) <= small:
        return _swept_whole(src, sorted((r.prefix, r.rule_id, r.action) for r in known.collect()))
    return _swept_in_ranges(src, known)


def _swept_whole(src: DataFrame, ordered: list[tuple[str, int, str]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(batch.column(2).to_pylist(), *(batch.column(i).to_pylist() for i in (0, 1)), strict=True), key=lambda r: (r[0] is not None, r[0] or ""))
            sweep, at, out = Sweep(), 0, []
            for key, page, url in rows:
                if key is None:
                    out.append(_row(page, url, key, []))
                    continue
                while at < len(ordered) and ordered[at][0] <= key:
                    sweep.push(*ordered[at])
                    at += 1
                sweep.to(key)
                out.append(_row(page, url, key, sweep.stack))
            yield _batch(out)

    return src.mapInArrow(run, _OUT)


def _swept_in_ranges(src: DataFrame, known: DataFrame, ranges: int | None = None) -> DataFrame:
    spark = src.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [min(b.column(0).to_pylist()) for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([min(least)] if least else [], pa.string())], ["k"])

    # split points only balance the work: any give the same rows
    keys = src.where("url_key is not null").select(F.col("url_key").alias("k"))
    splits = sorted({r.k for r in keys.repartitionByRange(ranges, "k").mapInArrow(first, "k string").collect()})[1:]

    @F.pandas_udf("int")
    def place(k):
        return k.map(lambda x: 0 if x is None else bisect.bisect_right(splits, x))

    def reached(x: str) -> list[int]:
        # from the range of the prefix to the last that begins with a key of it
        at = to = bisect.bisect_right(splits, x)
        while to < len(splits) and splits[to].startswith(x):
            to += 1
        return list(range(at, to + 1))

    @F.pandas_udf("array<int>")
    def places(p):
        return p.map(reached)

    left = known.select(F.explode(places("prefix")).alias("place"), F.col("prefix").alias("k"), F.lit(0).alias("kind"), F.col("rule_id").alias("n"), F.col("action").alias("what"))
    right = src.select(place("url_key").alias("place"), F.col("url_key").alias("k"), F.lit(1).alias("kind"), F.col("page_id").alias("n"), F.col("url").alias("what"))
    both = left.unionByName(right).repartition(len(splits) + 1, "place").sortWithinPartitions("place", F.col("k").asc_nulls_first(), "kind", "n", "what")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, current = Sweep(), None
        for batch in batches:
            out = []
            for at, k, kind, n, what in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if at != current:
                    sweep, current = Sweep(), at
                if kind == 0:
                    sweep.push(k, n, what)
                elif k is None:
                    out.append(_row(n, what, k, []))
                else:
                    sweep.to(k)
                    out.append(_row(n, what, k, sweep.stack))
            yield _batch(out)

    return both.mapInArrow(run, _OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return match(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule_id long, rule string, action string"))


def _values() -> str:
    return ", ".join(f"({n}, '{r}', '{a}')" for n, r, a in RULES)


SQL = f"""
WITH rules AS (SELECT CAST(n AS BIGINT) AS rule_id, action,
    array_to_string(list_reverse(string_split(lower(regexp_extract(r, '^([^/]*)', 1)), '.')), ',') || ',' || regexp_extract(r, '^[^/]*(/.*)?$', 1) AS prefix
  FROM (VALUES {_values()}) t(n, r, action)),
parts AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '#.*$', '') AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS authority FROM parts),
named AS (SELECT *, lower(regexp_replace(authority, '^.*@', '')) AS host, substr(rest, length(authority) + 1) AS path FROM hosts),
keyed AS (SELECT page_id, url, CASE WHEN host = '' THEN NULL ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ',' ||
    CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END END AS url_key FROM named),
hit AS (SELECT k.page_id, k.url, k.url_key, r.rule_id, r.action,
    row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY length(r.prefix) DESC, r.rule_id DESC) AS rn,
    count(r.rule_id) OVER (PARTITION BY k.page_id, k.url) AS n
  FROM keyed k LEFT JOIN rules r ON starts_with(k.url_key, r.prefix))
SELECT page_id, url, url_key, CAST(n AS INTEGER) AS n_rules, coalesce(rule_id, -1) AS rule_id, coalesce(action, 'none') AS action, coalesce(action = 'block', false) AS blocked FROM hit WHERE rn = 1
"""
