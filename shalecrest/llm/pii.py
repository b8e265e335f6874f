"""Personal data and secrets by a skip-chain conditional random field.

The nodes of a document are its tokens that hold a digit or an at sign; a token without either can't be of any
label but O here, so it only serves as context. Neighbouring nodes share a chain potential, and all nodes of a document
with the same letters, or the same last seven digits, share a skip potential with one hub, whatever lies between them and
however many they are. Loopy sum-product message passing over both kinds of edges, until messages rest, gives each node's
marginal, so that what is clear in one place of a document decides the same thing elsewhere. The weights are fitted by pseudo-likelihood to
documents made by ``examples`` and ``mentions``.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.common import col, table
from shalecrest.llm.words import raw, slices

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "ID", "SECRET")
_HOT = np.zeros(256, dtype=bool)
_HOT[48:58] = _HOT[64] = True

#: What stands between spaces with a digit or @; the look-behind keeps it linear in the text.
_CHUNK = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
#: The tokens in it.
_TOKEN = re.compile(
    # an address of any length; it begins where such a run begins, so that the search stays linear
    r"""(?<![^\s@"'<>()\[\]{},;:|=])[^\s@"'<>()\[\]{},;:|=]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"""
    r"|[A-Za-z0-9_+/-]*[A-Za-z_/][A-Za-z0-9_+/-]*"  # letters, with digits or not
    r"|\+?\(?[0-9](?:[0-9().\-]*[0-9])?\)?"  # digits with the marks inside numbers
)
_IP = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")
_KEYS = {
    "secret": re.compile(r"(?i)(?:token|secret|passw|api|key|auth|bearer|credential)"),
    "phone": re.compile(r"(?i)(?:phone|tel|call|mobile|fax|cell)"),
    "card": re.compile(r"(?i)(?:card|visa|account|iban|payment|credit)"),
    "id": re.compile(r"(?i)(?:ssn|social|passport|licen[cs]e no|insurance)"),
    "plain": re.compile(r"(?i)(?:version|page|section|chapter|table|figure|year|volume|commit|isbn|v$)"),
}


def luhn(digits: str) -> bool:
    s = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


_FEATURES: dict[str, int] = {}
for _f in ("bias at ip bad_ip mixed20 mixed16 mixed hex32 quoted plus parens phone7 phone10 phone_long ssn iban d1 d2 d3 d4 d5_6 d7_9 d10_12 d13_19 d20 decimal date luhn group4 equals run4 phone_parts").split() + [f"key_{k}" for k in _KEYS]:
    _FEATURES[_f] = len(_FEATURES)

#: Shapes that are parts of one number when they follow each other, and the feature that both then have.
_PARTS = [(_FEATURES[a], _FEATURES[b], _FEATURES[c]) for a, b, c in (("d4", "d4", "run4"), ("parens", "phone7", "phone_parts"), ("plus", "parens", "phone_parts"))]


def features(s: str, before: str, quoted: bool) -> list[int]:
    """Numbers of the features of token ``s`` after the text ``before``."""
    on = ["bias"]
    digits = re.sub(r"[^0-9]", "", s)
    n = len(digits)
    if "@" in s:
        on.append("at")
    elif _IP.fullmatch(s):
        on.append("ip" if all(int(x) < 256 for x in s.split(".")) else "bad_ip")
    elif re.search(r"[A-Za-z]", s):
        if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
            on.append("iban")
        on.append("mixed20" if len(s) >= 20 else "mixed16" if len(s) >= 16 else "mixed")
        if len(s) >= 32 and re.fullmatch(r"[0-9a-fA-F]+", s):
            on.append("hex32")
    elif re.fullmatch(r"\+[0-9]{1,3}", s):
        on.append("plus")
    elif re.fullmatch(r"\([0-9]{2,4}\)", s):
        on.append("parens")
    elif re.fullmatch(r"[0-9]{3}[-.][0-9]{4}", s):
        on.append("phone7")
    elif re.fullmatch(r"\(?[0-9]{3}\)?[-.][0-9]{3}[-.][0-9]{4}", s):
        on.append("phone10")
    elif re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s):
        on.append("ssn")
    elif s[0] == "+" and 8 <= n <= 15:
        on.append("phone_long")
    elif re.fullmatch(r"[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}", s):
        on.append("date")
    elif re.fullmatch(r"[0-9]{4}(?:-[0-9]{4}){3}", s):
        on += ["d13_19", "group4"]
    elif re.fullmatch(r"[0-9]+(?:\.[0-9]+)+", s):
        on.append("decimal")
    else:
        on.append(f"d{n}" if n < 5 else "d5_6" if n < 7 else "d7_9" if n < 10 else "d10_12" if n < 13 else "d13_19" if n < 20 else "d20")
    if 13 <= n <= 19 and len(s) - n <= 3 and luhn(digits):
        on.append("luhn")
    if quoted:
        on.append("quoted")
    if re.search(r"[=:]\s*[\"']?$", before):
        on.append("equals")
    on += [f"key_{k}" for k, rx in _KEYS.items() if rx.search(before)]
    return [_FEATURES[f] for f in on]


class Graph:
    """The nodes of some documents, their features, and chain and skip edges between them."""

    def __init__(self) -> None:
        self.feats: list[list[int]] = []
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.chain: list[tuple[int, int]] = []
        self.key: list[tuple[int, str] | None] = []  # document and what tells repeats of one thing

    def add(self, doc: int, text: str) -> None:
        last_end, begin = -9, 0
        for chunk in _CHUNK.finditer(text):
            for m in _TOKEN.finditer(text, chunk.start(), chunk.end()):
                s = m.group()
                if not any(c in "0123456789@" for c in s):
                    continue
                a, b = m.span()
                node = len(self.feats)
                # two words and their marks before, no further than the token before
                before = text[max(begin, a - 24) : a]
                self.feats.append(features(s, before, a > 0 and text[a - 1] in "\"'`"))
                self.spans.append((doc, a, b))
                if a - last_end <= 3 and "\n" not in text[last_end:a]:
                    self.chain.append((node - 1, node))
                    for one, other, both in _PARTS:
                        if one in self.feats[node - 1] and other in self.feats[node]:
                            self.feats[node - 1] = [*self.feats[node - 1], both]
                            self.feats[node] = [*self.feats[node], both]
                digits = re.sub(r"[^0-9]", "", s)
                key = digits[-7:] if len(digits) >= 7 and "@" not in s else s.lower()  # same letters have the same last digits
                self.key.append((doc, key) if len(key) >= 5 else None)
                last_end = begin = b

    def skip(self) -> tuple[np.ndarray, np.ndarray]:
        """(node and hub of each skip edge, how much the node's evidence weighs at the hub): a hub for each key that several nodes have.

        Nodes of a hub with the same features say the same thing, so together they weigh as much as one of them:
        it isn't truer for being repeated, and bare repeats don't outvote a clear mention however many they are.
        """
        times = Counter(k for k in self.key if k is not None)
        hubs: dict[tuple[int, str], int] = {}
        edges = [(i, hubs.setdefault(k, len(hubs))) for i, k in enumerate(self.key) if k is not None and times[k] > 1]
        kinds = [(h, *sorted(self.feats[i])) for i, h in edges]
        alike = Counter(kinds)
        return np.array(edges, dtype=np.int64).reshape(-1, 2), np.array([1 / alike[k] for k in kinds])

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.feats), len(_FEATURES)))
        for i, f in enumerate(self.feats):
            x[i] = np.bincount(f, minlength=len(_FEATURES))  # run4 counts both sides
        return x


def examples(seed: int = 5, documents: int = 1500) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Documents of invented words with personal data, secrets and harmless numbers, and where each entity is."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ren", "to", "mi", "sul", "ka", "ent", "or", "ish", "le"]) for _ in range(rng.randint(1, 4)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def entity() -> tuple[str, str, str]:
        kind = rng.randrange(13)
        if kind == 0:
            return "", f"{word()}.{number(2)}@{word()}{number(1)}.{word()}.{rng.choice(['com', 'org', 'net'])}", "EMAIL"
        if kind == 1:
            return "", f"{word()}@{word()}.{rng.choice(['com', 'de'])}", "EMAIL"
        if kind == 2:
            return rng.choice(["", "", "call ", "tel: "]), f"+{rng.choice(['1', '44', '49'])} ({number(3)}) {number(3)}-{number(4)}", "PHONE"
        if kind == 3:
            return rng.choice(["", "phone "]), rng.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+{number(11)}", f"{number(3)}-{number(4)}"]), "PHONE"
        if kind in (4, 5):
            return "", ".".join(str(rng.randrange(256)) for _ in range(4)), "IP"
        if kind in (6, 7):
            return rng.choice(["", "", "", "card "]), number(rng.choice([16, 16, 16, 15, 13])), "CARD"
        if kind == 8:
            return rng.choice(["", "card "]), rng.choice([" ", "-"]).join(number(4) for _ in range(4)), "CARD"
        if kind == 9:
            return rng.choice(["", "ssn "]), f"{number(3)}-{number(2)}-{number(4)}", "ID"
        if kind == 10:
            return "", f"{rng.choice(['DE', 'FR', 'GB'])}{number(18)}", "ID"
        key = rng.choice(["token = ", "secret: ", "api_key=", "password = ", "auth token "])
        return key, rng.choice(['"%s"', "'%s'", "%s"]) % ("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))) if rng.random() < 0.7 else "".join(rng.choice("abcDEFghiJKLmno0123456789_-") for _ in range(28))), "SECRET"

    def harmless() -> str:
        return rng.choice([number(1), number(2), number(3), f"{rng.randrange(1900, 2030)}", f"version {number(1)}.{number(1)}.", f"{number(1)}.{number(2)}", f"page {number(3)}", f"{number(5)}", f"{number(7)}", f"{rng.randrange(1990, 2030)}-{number(2)}-{number(2)}", f"version {number(1)}.{number(1)}.{number(1)}.{number(2)}", f"{word()}{number(2)}", f"commit {''.join(rng.choice('0123456789abcdef') for _ in range(40))}", f"({number(1)})", f"({rng.randrange(1990, 2030)})", f"{number(10)}"])

    out = []
    for _ in range(documents):
        text, found, kept = "", [], []
        for _ in range(rng.randint(3, 12)):
            text += " ".join(word() for _ in range(rng.randint(1, 6))) + " "
            r = rng.random()
            if r < 0.25 and kept:
                key, what, label = *("", rng.choice(kept))[:1], *rng.choice(kept)
            elif r < 0.6:
                key, what, label = entity()
                kept.append((what, label))
            else:
                key, what, label = "", harmless(), "O"
            text += key
            if label != "O":
                inner = what.strip("\"'")
                at = len(text) + what.index(inner)
                found.append((at, at + len(inner), label))
            text += what + rng.choice([" ", " ", ". ", "### ", "!! ", ", ", "\n"])
        out.append((text, found))
    return out


def mentions(seed: int = 6, documents: int = 750) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Documents in which one number of an unclear shape is named once and bare elsewhere: as what it was named, or as nothing."""
    rng = random.Random(seed)
    words = lambda: " ".join("".join(rng.choice(["ba", "ren", "to", "mi", "sul", "ka", "ent", "or", "ish", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(documents):
        label, keys = rng.choice([*[("PHONE", ["phone ", "call ", "tel: ", "mobile "])] * 2, ("O", ["page ", "version ", "commit ", ""])])
        what = "".join(rng.choice("0123456789") for _ in range(rng.choice([7, 7, 8, 9, 10, 10, 11])))
        named, found, text = rng.choice([0, 0, 0, 1, 2]), [], ""
        for k in range(rng.choice([named + 1, 4])):
            text += words() + " " + (rng.choice(keys) if k == named else "")
            if label != "O":
                found.append((len(text), len(text) + len(what), label))
            text += what + rng.choice([" ", ". ", ", ", "\n"])
        out.append((text + words(), found))
    return out


@lru_cache(maxsize=4)
def weights(seed: int = 5, documents: int = 1500, rounds: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features x labels, chain, skip): fitted by gradient steps on the pseudo-likelihood of ``examples`` and ``mentions``."""
    g, gold = Graph(), []
    for d, (text, found) in enumerate(examples(seed, documents) + mentions(seed + 1, documents // 2)):
        at = len(g.spans)
        g.add(d, text)
        for _, a, b in g.spans[at:]:
            gold.append(next((LABELS.index(k) for s, e, k in found if s <= a and b <= e or a <= s and e <= b), 0))
    x, y, n = g.matrix(), np.array(gold), len(LABELS)
    one = np.eye(n)[y]
    chain, (skip, _) = np.array(g.chain).reshape(-1, 2), g.skip()
    near, far, hub = np.zeros((len(y), n)), np.zeros((len(y), n)), np.zeros((len(y), n))
    np.add.at(near, chain[:, 0], one[chain[:, 1]])
    np.add.at(near, chain[:, 1], one[chain[:, 0]])
    # a hub's label is that of most of its nodes
    np.add.at(hub, skip[:, 1], one[skip[:, 0]])
    far[skip[:, 0]] = np.eye(n)[hub[skip[:, 1]].argmax(axis=1)]
    z = np.concatenate([x, near, far], axis=1)
    w, m, v = np.zeros((z.shape[1], n)), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = z @ w
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = z.T @ (p - one) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    k = x.shape[1]
    # an edge has one potential whichever end it is seen from
    return w[:k], (w[k : k + n] + w[k : k + n].T) / 2, (w[k + n :] + w[k + n :].T) / 2


def marginals(unary: np.ndarray, edges: np.ndarray, potential: np.ndarray, rounds: int | None = None, weight: np.ndarray | None = None, part: np.ndarray | None = None) -> np.ndarray:
    """Beliefs of all nodes by damped loopy sum-product; exact where edges form no cycle.

    unary: log potentials, a row a node; edges: pairs of nodes; potential: a symmetric log matrix for each; weight:
    how much the message to an edge's second node counts there, 1 if not given; part: of each node, such that
    edges lie within parts. Each part runs until its messages rest, or for so many rounds; after 100 rounds the
    messages move ever less, so that those that would swing for ever come to rest too.
    """
    n, k = unary.shape
    total = unary.copy()
    if len(edges):
        m = len(edges)
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        both = np.concatenate([potential, potential])
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        counts = np.concatenate([np.ones(m) if weight is None else weight, np.ones(m)])[:, None]
        of = np.zeros(2 * m, dtype=np.int64) if part is None else part[src]
        msg = np.zeros((2 * m, k))
        live, t = np.arange(2 * m), 0
        while len(live) and (rounds is None or t < rounds):
            t += 1
            total[dst[live]] = unary[dst[live]]
            np.add.at(total, dst[live], counts[live] * msg[live])
            out = (total[src[live]] - counts[back[live]] * msg[back[live]])[:, :, None] + both[live]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.zeros(of.max() + 1)
            step = (0.5 if t <= 100 else 50 / t) * (new - msg[live])
            np.maximum.at(moved, of[live], np.abs(step).max(axis=1))
            msg[live] += step
            live = live[moved[of[live]] >= 5e-5]
        total = unary.copy()
        np.add.at(total, dst, counts * msg)
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def label(texts: list[str], w: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[tuple[str, int, int]]]:
    """(label, start, end) of the entities of each text, in characters; parts of one number are one entity."""
    g = Graph()
    for d, s in enumerate(texts):
        g.add(d, s)
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not g.feats:
        return found
    unary = np.stack([w[0][f].sum(axis=0) for f in g.feats])
    skip, weight = g.skip()
    nodes, hubs = len(unary), int(skip[:, 1].max(initial=-1)) + 1
    edges = np.concatenate([np.array(g.chain, dtype=np.int64).reshape(-1, 2), skip + [0, nodes]])
    potential = np.concatenate([np.repeat(w[1][None], len(g.chain), axis=0), np.repeat(w[2][None], len(skip), axis=0)])
    part = np.array([d for d, _, _ in g.spans] + [0] * hubs)
    part[nodes + skip[:, 1]] = part[skip[:, 0]]
    best = marginals(np.concatenate([unary, np.zeros((hubs, len(LABELS)))]), edges, potential, weight=np.concatenate([np.ones(len(g.chain)), weight]), part=part)[:nodes].argmax(axis=1)
    chained = {b for _, b in g.chain}
    for i, (d, a, b) in enumerate(g.spans):
        if best[i]:
            name = LABELS[best[i]]
            if i in chained and best[i - 1] == best[i] and name in ("PHONE", "CARD"):
                found[d][-1] = (name, found[d][-1][1], b)
            else:
                found[d].append((name, a, b))
    return found


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for name, a, b in found:
        out += [text[at:a], f"[{name}]"]
        at = b
    return "".join(out) + text[at:]


def _redacted(texts: pa.Array, w) -> tuple[pa.Array, list[int], list[list[tuple[str, int, int]]]]:
    """(texts without entities, numbers of the texts that have a digit or @, their entities)."""
    b, starts = raw(texts)
    hot = np.unique(np.searchsorted(starts, np.flatnonzero(_HOT[b]), "right") - 1)
    if not len(hot):
        return texts, [], []
    some = texts.take(pa.array(hot)).to_pylist()
    found = label(some, w)
    mask = np.zeros(len(texts), dtype=bool)
    mask[hot] = True
    clean = pc.replace_with_mask(texts, pa.array(mask), pa.array([redact(s, f) for s, f in zip(some, found, strict=True)], texts.type))
    return clean, hot.tolist(), found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, entities): every row with its text redacted and where its entities were.

    entities: label, start and end in characters of the original text; what they said isn't returned. One
    pass without a shuffle over whole texts. A null text stays null and, like an empty one, has no entities.
    Null ids stay null, repeated rows give repeated results, an empty table an empty one. Of equally likely labels the
    first in LABELS is taken, so ties are defined. Addresses of any length are found whole. Other columns are
    neither read nor returned.
    """
    w = weights()
    src = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    one = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                text, hot, found = _redacted(batch.column(1), w)
                rows: list[list] = [[] for _ in range(batch.num_rows)]
                for i, f in zip(hot, found, strict=True):
                    rows[i] = [{"label": k, "start": a, "end": b} for k, a, b in f]
                yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array([len(r) for r in rows], pa.int32()), pa.array(rows, one)], ["doc_id", "text", "n_entities", "entities"])

    return src.mapInArrow(run, "doc_id long, text string, n_entities int, entities array<struct<label: string, start: int, end: int>>")


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with entities in its texts replaced by their labels, and the column of lengths set anew where there is one."""
    w = weights()
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                columns = list(batch.columns)
                columns[at] = _redacted(columns[at], w)[0]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, schema)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(col(text_col).isNull(), col(chars_col)).otherwise(F.length(col(text_col))).cast(schema[chars_col].dataType))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
