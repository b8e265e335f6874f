"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tokens: structural tags, and texts. Tandem repeats become repeated groups. The streams of a
host are aligned one after the other with the wrapper so far; where they don't match, what only some pages
have becomes optional, and a text that isn't the same on all pages becomes a slot. The wrapper is then a regular expression
without alternatives. Matching it against a page assigns the page's texts to slots; what is the same on all pages
of the host is template, and what lies in navigation, advertisements and the like isn't content.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.common import col, cut, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^<>]*)>|<[!?][^>]*>", re.S | re.I)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Tags within a text; they don't divide it.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_BREAK = frozenset("br hr img input meta link source area base col embed track".split())
#: Ends of these may be left out, so they aren't tokens.
_OPEN_ENDED = frozenset("p li dt dd tr td th option thead tbody tfoot html body head".split())
_ASIDE = frozenset("nav footer header aside form button select menu dialog".split())
_ASIDE_CLASS = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sidebar|menu|nav\w*|breadcrumbs?|cookies?|share|social|comments?|footer|related)(?:$|[\s_-])")
_MAIN = frozenset(["article", "main"])


def tokens(page: str) -> tuple[list[str], list[str]]:
    """(labels, texts): the token stream of a page. A text's label is T, or M within an article, B beside the content, H in the head."""
    labels: list[str] = []
    texts: list[str] = []
    words: list[str] = []
    aside: list[str] = []  # open elements beside the content
    depth = main = 0
    head = False

    def flush() -> None:
        if words:
            s = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
            words.clear()
            if s:
                labels.append("H" if head else "B" if aside else "M" if main else "T")
                texts.append(s)

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if name in _BREAK:
            words.append(" ")
            continue
        flush()
        if m.group(2):
            if aside and name == aside[-1]:
                if depth:
                    depth -= 1
                else:
                    aside.pop()
            if name in _MAIN and main:
                main -= 1
            if name in ("title", "head"):
                head = False
            if name not in _OPEN_ENDED:
                labels.append(f"</{name}>")
        else:
            names = " ".join(a or b or c for a, b, c in _CLASS.findall(m.group(4))) if "=" in m.group(4) else ""
            if aside and name == aside[-1]:
                depth += 1
            elif not aside and (name in _ASIDE or (names and _ASIDE_CLASS.search(names))):
                aside.append(name)
            if name in _MAIN:
                main += 1
            if name == "title":
                head = True
            labels.append(f"<{name}{'.' + _SPACE.sub('.', names.strip()) if names else ''}>")
    if at < len(page):
        words.append(page[at:])
    flush()
    return labels, texts


_REPEAT = re.compile(r"(.{1,40}?)\1+", re.S)
TEXTS = frozenset("TMBH")


def _long_repeat(number: np.ndarray) -> tuple[int, int, int] | None:
    """(start, period, end) of the tandem repeat of the least period over 40; the first of these."""
    n = len(number)
    for period in range(41, n // 2 + 1):
        same = np.concatenate([[False], number[period:] == number[:-period], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        runs = turns[1::2] - turns[0::2]
        hit = np.flatnonzero(runs >= period)
        if len(hit):
            at = int(turns[2 * hit[0]])
            return at, period, at + period * (1 + int(runs[hit[0]]) // period)
    return None


def collapse(labels: list[str]) -> list[str]:
    """Tandem repeats as one label, "(inner )+", from the inside out; of any period and to any depth."""
    while True:
        number: dict[str, int] = {}
        s = "".join(chr(0x100 + number.setdefault(x, len(number))) for x in labels)
        name = list(number)
        if not _REPEAT.search(s):
            # short periods go first; what is left is seldom long enough for others
            long = _long_repeat(np.array([number[x] for x in labels])) if len(labels) > 81 else None
            if long is None:
                return labels
            at, period, end = long
            labels = [*labels[:at], "(" + "\x1f".join(labels[at : at + period]) + ")+", *labels[end:]]
            continue
        out, at = [], 0
        for m in _REPEAT.finditer(s):
            out += labels[at : m.start()]
            inner = [name[ord(c) - 0x100] for c in m.group(1)]
            out.append(inner[0] if len(inner) == 1 and inner[0].endswith(")+") else "(" + "\x1f".join(inner) + ")+")
            at = m.end()
        labels = out + labels[at:]


def inner(label: str) -> list[str]:
    """The labels of a repeated group."""
    out, level, begin = [], 0, 1
    for i, c in enumerate(label[1:-2], 1):
        level += (c == "(") - (c == ")")
        if c == "\x1f" and not level:
            out.append(label[begin:i])
            begin = i + 1
    return [*out, label[begin:-2]]


def regroup(seq: list[str], groups: list[list[str]]) -> list[str]:
    """A sequence in which single occurrences of what is repeated elsewhere are that group too."""
    for g in groups:
        label, n, out, i = "(" + "\x1f".join(g) + ")+", len(g), [], 0
        while i < len(seq):
            if seq[i : i + n] == g:
                if not out or out[-1] != label:
                    out.append(label)
                i += n
            elif seq[i] == label and out and out[-1] == label:
                i += 1
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of all of x and each prefix of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x.tolist():
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def _common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence, by halving x: memory grows with the sum of the lengths, time with their product."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        at = np.flatnonzero(y == x[0])
        return [(0, int(at[0]))] if len(at) else []
    half = len(x) // 2
    cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
    return _common(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in _common(x[half:], y[cut:])]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    pre = 0
    while pre < min(len(a), len(b)) and a[pre] == b[pre]:
        pre += 1
    suf = 0
    while suf < min(len(a), len(b)) - pre and a[-1 - suf] == b[-1 - suf]:
        suf += 1
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(v, len(number)) for v in s[pre : len(s) - suf]], np.int64) for s in (a, b))
    out = [(i, i) for i in range(pre)] + [(pre + i, pre + j) for i, j in _common(x, y)]
    return out + [(len(a) - k, len(b) - k) for k in range(suf, 0, -1)]


def start(skeleton: str, pages: int, hashes: list[tuple[int, int]], groups: list[list[str]]) -> dict:
    """The part of a wrapper that one collapsed stream makes: symbols, and for each the pages that have it and the least and greatest hash of its text.

    hashes: of the texts outside groups; groups: all of the host, the longest first.
    """
    seq = skeleton.split("\x1e") if skeleton else []
    values = iter(hashes)
    own = [(x, next(values) if x in TEXTS else None) for x in seq]
    # texts that went into a group are slots
    at, texts, symbols = 0, [], regroup(seq, groups)
    for x in symbols:
        if x.endswith(")+"):
            while at < len(own) and not (own[at][0] == x) and own[at][0] in _members(x):
                at += 1
            if at < len(own) and own[at][0] == x:
                at += 1
            texts.append(None)
        else:
            texts.append(list(own[at][1]) if at < len(own) and own[at][0] == x and own[at][1] else None)
            at += 1
    return {"symbols": symbols, "seen": [pages] * len(symbols), "texts": texts, "pages": pages}


def merge(a: dict, b: dict) -> dict:
    """Two parts as one: aligned, with what either has alone between what both have."""
    symbols, seen, texts = [], [], []
    i = j = 0
    for p, q in [*align(a["symbols"], b["symbols"]), (len(a["symbols"]), len(b["symbols"]))]:
        for x, m, n in ((a, i, p), (b, j, q)):
            symbols += x["symbols"][m:n]
            seen += x["seen"][m:n]
            texts += x["texts"][m:n]
        if p < len(a["symbols"]):
            symbols.append(a["symbols"][p])
            seen.append(a["seen"][p] + b["seen"][q])
            h, old = b["texts"][q], a["texts"][p]
            texts.append([min(old[0], h[0]), max(old[1], h[1])] if h and old else None)
        i, j = p + 1, q + 1
    return {"symbols": symbols, "seen": seen, "texts": texts, "pages": a["pages"] + b["pages"]}


def finish(part: dict) -> dict:
    """{"symbols": labels in order, "optional": on which of them, "constant": texts that are the same on all pages, of which there are two or more}."""
    pages = part["pages"]
    return {
        "symbols": part["symbols"],
        "optional": [c < pages for c in part["seen"]],
        "constant": [bool(t) and t[0] == t[1] and c == pages > 1 for t, c in zip(part["texts"], part["seen"], strict=True)],
    }


def _members(group: str) -> set[str]:
    out: set[str] = set()
    for x in inner(group):
        out |= _members(x) | {x} if x.endswith(")+") else {x}
    return out


class Wrapper:
    """A wrapper ready to match pages: states that read a token each, and forks with a preferred way.

    The match is the one that plain backtracking finds first: an optional symbol is rather there than not, a group is
    rather repeated. A fork is tried at a place of the page only once, as it would fail there again, so the time is
    bounded by tokens times symbols.
    """

    def __init__(self, spec: dict):
        self.reads: list[str | None] = []  # the label that a state reads before it goes on to the next one; none at forks and the end
        self.forks: list[tuple[int, int] | None] = []
        self.constant: list[bool] = []
        for x, optional, constant in zip(spec["symbols"], spec["optional"], spec["constant"], strict=True):
            at = self._state(None, False) if optional else None
            self._add(x, constant)
            if at is not None:
                self.forks[at] = at + 1, len(self.reads)
        self._state(None, False)

    def _state(self, label: str | None, constant: bool) -> int:
        self.reads.append(label)
        self.forks.append(None)
        self.constant.append(constant)
        return len(self.reads) - 1

    def _add(self, label: str, constant: bool) -> None:
        if label.endswith(")+"):
            begin = len(self.reads)
            for x in inner(label):
                self._add(x, False)
            at = self._state(None, False)
            self.forks[at] = begin, at + 1
        else:
            self._state(label, constant)

    def slots(self, labels: list[str]) -> list[tuple[int, str, bool]] | None:
        """For each text of a page: place in the stream, zone, and whether it is template; none if the page doesn't match."""
        reads, forks, n, end = self.reads, self.forks, len(labels), len(self.reads) - 1
        found: list[tuple[int, str, bool]] = []
        later: list[tuple[int, int, int]] = []  # states to go on from if this way fails, with the place and the texts found till there
        tried: set[int] = set()
        state = at = 0
        while True:
            label = reads[state]
            if label is not None:
                if at < n and labels[at] == label:
                    if label in TEXTS:
                        found.append((at, label, self.constant[state]))
                    state, at = state + 1, at + 1
                    continue
            elif state == end:
                if at == n:
                    return found
            else:
                way, other = forks[state]
                key = state * (n + 1) + at
                if key not in tried:
                    tried.add(key)
                    later.append((other, at, len(found)))
                    state = way
                    continue
            if not later:
                return None
            state, at, k = later.pop()
            del found[k:]


def content(labels: list[str], texts: list[str], slots: list[tuple[int, str, bool]] | None) -> tuple[str, str, int, int]:
    """(title, text, fields, template texts) of a page. Without a match all its texts count as slots."""
    places = [i for i, x in enumerate(labels) if x in TEXTS]
    found = slots if slots is not None else [(i, labels[i], False) for i in places]
    at = dict(zip(places, texts, strict=True))
    zone = "M" if any(z == "M" for _, z, _ in found) else "T"
    title = next((at[i] for i, z, _ in found if z == "H"), "")
    body = [at[i] for i, z, constant in found if z == zone and not constant]
    return title, "\n".join(body), sum(not k for *_, k in found), sum(k for *_, k in found)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def streams(pages: DataFrame) -> DataFrame:
    """(host, skeleton, at, lo, hi, n): the collapsed streams of each host, with the least and greatest hash of each text outside groups.

    Summed up within batches first, then by key; a row with at = -1 counts the distinct pages of a stream: copies of
    a page and repeated rows have the same hash and are one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[tuple, list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page is None:
                    continue
                labels, texts = tokens(page)
                short = collapse(labels)
                value = iter(_outside(labels, short, texts))
                skeleton, whole = "\x1e".join(short), _hash(page)
                got[host, skeleton, -1, whole] = [whole, whole]
                for at, h in [(i, next(value)) for i, x in enumerate(short) if x in TEXTS]:
                    old = got.setdefault((host, skeleton, at, None), [h, h])
                    old[0], old[1] = min(old[0], h), max(old[1], h)
            keys, values = list(got), list(got.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int64()), *(pa.array([v[i] for v in values], pa.int64()) for i in range(2))],
                ["host", "skeleton", "at", "page", "lo", "hi"],
            )

    part = pages.mapInArrow(run, "host string, skeleton string, at int, page long, lo long, hi long")
    once = part.groupBy("host", "skeleton", "at", "page").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return once.groupBy("host", "skeleton", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("page").alias("n"))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _outside(labels: list[str], short: list[str], texts: list[str]) -> list[int]:
    """Hashes of the texts that no group of the collapsed stream holds."""
    places, k, out = [], 0, []
    for i, x in enumerate(labels):
        if x in TEXTS:
            places.append((i, k))
            k += 1
    which = dict(places)
    i = 0
    for x in short:
        if x.endswith(")+"):
            i = _skip(labels, i, x)
        else:
            if x in TEXTS:
                out.append(_hash(texts[which[i]]))
            i += 1
    return out


def _skip(labels: list[str], i: int, group: str) -> int:
    """The place after all repeats of a group that begins at i."""
    parts = inner(group)
    while True:
        j = i
        for x in parts:
            if x.endswith(")+"):
                k = _skip(labels, j, x)
                if k == j:
                    return i
                j = k
            elif j < len(labels) and labels[j] == x:
                j += 1
            else:
                return i
        i = j


def wrappers(pages: DataFrame, streams_a_task: int = 2000, fan: int = 16) -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON, from all its pages.

    A host's distinct streams are merged about ``streams_a_task`` in a task, the commonest first, and the parts that come out ``fan`` in
    a task, until one is left; so no task gets all streams of a large host. All parts know all groups of their host.
    """
    known = cut(streams(pages))
    one = known.where("at = -1")
    labels = F.filter(F.split("skeleton", "\x1e"), lambda x: x.endswith(")+"))
    groups = one.select("host", F.explode(labels).alias("g")).distinct().groupBy("host").agg(F.collect_list("g").alias("groups"), F.lit(-1).alias("at"))
    parts = one.groupBy("host").agg(F.ceil(F.count("*") / streams_a_task).alias("parts"))
    most = parts.agg(F.max("parts")).first()[0] or 0
    placed = known.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("skeleton"), F.col("parts"))).join(groups, ["host", "at"], "left")

    def build(pdf):
        import pandas as pd

        rows: dict[str, list] = {}
        labels_: set[str] = set()
        for s, at, lo, hi, n, g in zip(pdf["skeleton"], pdf["at"], pdf["lo"], pdf["hi"], pdf["n"], pdf["groups"], strict=True):
            row = rows.setdefault(s, [0, []])
            if at < 0:
                row[0] = int(n)
                labels_.update(g if g is not None else ())
            else:
                row[1].append((int(at), int(lo), int(hi)))
        own = [list(g) for g in sorted({tuple(inner(x)) for x in labels_}, key=lambda g: (-len(g), g))]
        ordered = sorted(rows.items(), key=lambda x: (-x[1][0], x[0]))
        part = reduce(merge, (start(s, n, [(lo, hi) for _, lo, hi in sorted(h)], own) for s, (n, h) in ordered))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [int(pdf["part"].iloc[0])], "wrapper": [json.dumps(part)]})

    def join(pdf):
        import pandas as pd

        rows = sorted(zip(pdf["part"], pdf["wrapper"], strict=True))
        part = reduce(merge, (json.loads(w) for _, w in rows))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [int(rows[0][0]) // fan], "wrapper": [json.dumps(part)]})

    def end(pdf):
        return pdf.assign(wrapper=[json.dumps(finish(json.loads(w))) for w in pdf["wrapper"]])[["host", "wrapper"]]

    made = placed.groupBy("host", "part").applyInPandas(build, "host string, part long, wrapper string")
    while most > 1:
        made = cut(made.groupBy("host", F.floor(F.col("part") / fan).alias("_of")).applyInPandas(join, "host string, part long, wrapper string"))
        most = -(-most // fan)
    return made.mapInPandas(lambda parts_: map(end, parts_), "host string, wrapper string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, title, text, n_fields, n_template, matched): the content of every page.

    text: the slots within article or main, or else in the body outside navigation and the like, a line each, without what all of the
    host's pages share. n_fields and n_template count the page's slots and template texts; matched tells whether its
    host's wrapper matched, without which all texts count as slots.

    All pages of a host make its wrapper, copies of one page as one; on a single page no text is template. Only streams and counts are shuffled for it, and pages
    are joined with wrappers by host. A null html has null title and text and isn't matched; an empty one has empty ones. Pages
    without a host, also with a null url, are the host "". Repeated pages give repeated rows, an empty table an empty
    result. Streams of equally many pages are aligned in the order of their text, so ties are defined. Pages are read whole, of any length. Other columns are neither read nor returned.
    """
    src = pages.select(col(id_col).cast("long").alias("page_id"), host_of(col(url_col)).alias("host"), col(html_col).cast("string").alias("html"))
    known = cut(wrappers(src.select("host", "html")))
    joined = src.join(known, "host", "left").select("page_id", "host", "html", "wrapper")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Wrapper] = {}
        for batch in batches:
            out = []
            for page, host, source, spec in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if source is None:
                    out.append((page, host, None, None, 0, 0, False))
                    continue
                if spec is not None and host not in ready:
                    if len(ready) > 256:
                        ready.clear()
                    ready[host] = Wrapper(json.loads(spec))
                labels, texts = tokens(source)
                slots = ready[host].slots(labels) if spec is not None else None
                out.append((page, host, *content(labels, texts, slots), slots is not None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["page_id", "host", "title", "text", "n_fields", "n_template", "matched"])

    return joined.mapInArrow(run, "page_id long, host string, title string, text string, n_fields int, n_template int, matched boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
