"""Quality by weak supervision: rules vote or abstain, and a label model weighs the votes.

Each rule looks at one property of a text and votes 1 (good), 0 (bad) or -1 (abstains). The label model has
a hidden class for each document, good or one of the kinds of bad, and for each rule its accuracy in every
class: the probabilities of its votes given the class and that it doesn't abstain.
Expectation-maximisation fits them to the counts of all vote patterns of all documents, without labels.
A document's quality is the posterior probability of the good class, instead of passing all rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.common import col, cut, table
from shalecrest.llm.words import _WORD, Words, raw, slices

RULES = ("symbols", "capitals", "exclamations", "bars", "repeats", "dominance", "word_length", "sentence_ends", "line_copies", "digits", "mark_runs", "bare_marks")

#: Classes of bytes that are counted: capitals, digits, symbols, exclamation marks, bars.
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in b"#$%&*@^~=_<>{}[]\\":
    _CLASS[_c] = 3
_CLASS[ord("!")] = 4
_CLASS[ord("|")] = 5
_END = np.zeros(256, dtype=bool)
for _c in b".!?:;\"')":
    _END[_c] = True
_MARK = ~_WORD
_MARK[:33] = False


def _owner(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The number of the text that each of the places is in."""
    return np.searchsorted(starts, places, "right") - 1


def properties(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(properties, words): a row of the values that RULES judge for each text, and its number of words.

    In the order of RULES: symbols, capitals among letters, exclamation marks and bars per word; the share of
    words equal to the one before, and of the commonest word; mean letters of a word; the share of lines
    that end like a sentence, and of lines that repeat one before; the share of digits; runs of three or
    more of one mark per word; and what stands between spaces without letter or digit, per word.
    """
    b, starts = raw(texts)
    n = len(texts)
    w = Words(b, starts)
    size = np.diff(starts)
    words = np.bincount(w.text, minlength=n)
    per_word = np.maximum(words, 1)
    kind = _CLASS[b]
    marked = np.flatnonzero(kind)
    kinds = np.bincount(_owner(starts, marked) * 6 + kind[marked], minlength=n * 6).reshape(n, 6)
    same = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    repeats = np.bincount(w.text[1:][same], minlength=n)
    key = np.sort((w.text << 44) | (w.hash >> np.uint64(20)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, key[first] >> 44, np.diff(np.append(first, len(key))))
    letters = np.bincount(w.text, w.end - w.start, n)
    # what stands between spaces, and lines that have any of it
    full = np.concatenate([[False], b > 32, [False]])
    turns = np.flatnonzero(full[1:] != full[:-1])
    p_start, p_end = turns[0::2], turns[1::2]
    inner = np.unique(starts[1:-1])
    inner = inner[(inner > 0) & (inner < len(b))]
    inner = inner[full[inner] & full[inner + 1]]  # a text's end also ends a piece
    p_start, p_end = np.sort(np.append(p_start, inner)), np.sort(np.append(p_end, inner))
    p_owner = _owner(starts, p_start)
    cuts = np.unique(np.concatenate([starts, np.flatnonzero(b == 10)]))
    at = np.searchsorted(p_start, cuts[:-1])
    to = np.searchsorted(p_start, cuts[1:])
    at, to = at[to > at], to[to > at]
    lo, hi = p_start[at], p_end[to - 1] - 1
    of = p_owner[at]
    lines = np.bincount(of, minlength=n)
    ends = np.bincount(of, _END[b[hi]], n)
    # a line is known by the words in it and their number
    at = np.searchsorted(w.start, lo)
    to = np.searchsorted(w.start, hi, "right")
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w.hash, dtype=np.uint64)]) if len(w.hash) else np.zeros(1, np.uint64)
    name = ((sums[to] - sums[at]) >> np.uint64(20)).astype(np.int64)
    named = np.sort((of << 44) | name)
    copy = np.flatnonzero(named[1:] == named[:-1])
    copies = np.bincount(named[copy] >> 44, minlength=n)
    third = np.flatnonzero((b[2:] == b[1:-1]) & (b[2:] == b[:-2])) if len(b) > 2 else np.zeros(0, int)
    third = third[_MARK[b[third]] & (_owner(starts, third) == _owner(starts, third + 2))]
    runs = third[np.concatenate([[True], third[1:] != third[:-1] + 1])] if len(third) else third
    inked = np.concatenate([[0], np.cumsum(_WORD[b])])
    alone = p_owner[inked[p_start] == inked[p_end]]
    out = np.stack(
        [
            kinds[:, 3] / per_word,
            kinds[:, 1] / np.maximum(letters - kinds[:, 2], 1),
            kinds[:, 4] / per_word,
            kinds[:, 5] / per_word,
            repeats / per_word,
            top / per_word,
            letters / per_word,
            ends / np.maximum(lines, 1),
            copies / np.maximum(lines, 1),
            kinds[:, 2] / np.maximum(size, 1),
            np.bincount(_owner(starts, runs), minlength=n) / per_word,
            np.bincount(alone, minlength=n) / per_word,
        ],
        axis=1,
    )
    return out, words


#: A rule votes bad from the first value on and good up to the second; in between, and below the least number of words, it abstains.
LIMITS = {
    "symbols": (0.5, 0.1, 2),
    "capitals": (0.5, 0.2, 5),
    "exclamations": (0.3, 0.1, 5),
    "bars": (0.2, 0.05, 2),
    "repeats": (0.2, 0.05, 10),
    "dominance": (0.3, 0.15, 20),
    "word_length": (20.0, 12.0, 5),
    "sentence_ends": (-0.1, -0.5, 10),
    "line_copies": (0.5, 0.1, 20),
    "digits": (0.3, 0.1, 5),
    "mark_runs": (0.3, 0.05, 2),
    "bare_marks": (0.2, 0.05, 2),
}


def votes(texts: pa.Array) -> np.ndarray:
    """-1, 0 or 1 of each rule for each text. On a text with fewer words than it needs, a rule abstains."""
    values, words = properties(texts)
    out = np.full(values.shape, -1, dtype=np.int8)
    for k, rule in enumerate(RULES):
        bad, good, least = LIMITS[rule]
        v = -values[:, k] if rule == "sentence_ends" else values[:, k]
        out[v <= good, k] = 1
        out[v >= bad, k] = 0
        out[words < least, k] = -1
    return out


def _number(texts: pa.Array) -> np.ndarray:
    """The votes of each text as a number in base 3."""
    return (votes(texts) + 1).astype(np.int64) @ 3 ** np.arange(len(RULES), dtype=np.int64)


def patterns(src: DataFrame, text_at: int) -> DataFrame:
    """The columns of ``src`` but the text's, and the votes on it as a number, ``pattern``."""
    keep = [i for i in range(len(src.columns)) if i != text_at]
    names = [src.columns[i] for i in keep] + ["pattern"]
    schema = src.select(*(col(src.columns[i]) for i in keep)).schema.add("pattern", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at):
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(_number(batch.column(text_at)))], names)

    return src.mapInArrow(run, schema)


#: Kinds of bad documents, each with the rules that witness it. Defects mostly exclude one another, so that
#: a single bad class, in which votes are independent, would hold but the commonest of them.
KINDS = (("symbols", "mark_runs"), ("capitals", "exclamations"), ("bars", "bare_marks"), ("repeats", "dominance", "line_copies"))


def fit(seen: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """(posterior probability of the good class for each pattern, rates of votes by class, rule and vote), by EM over their counts.

    It starts where a kind's bad vote means that kind; rates are smoothed by one document a vote. All rules
    count for all classes, also those that witness no kind.
    """
    if not len(seen):
        return {}, np.full((1 + len(KINDS), len(RULES), 2), 0.5)
    v = seen[:, None] // 3 ** np.arange(len(RULES)) % 3  # 0 abstains, 1 bad, 2 good
    n = counts.astype(float)
    cast = (v[:, :, None] == np.arange(1, 3)).astype(float)
    bad = np.stack([(v[:, [RULES.index(r) for r in kind]] == 1).any(axis=1) for kind in KINDS]).astype(float) + 1e-3
    good = np.where((bad > 1).any(axis=0), 0.1, 0.95)
    of = np.concatenate([good[None], bad / bad.sum(axis=0) * (1 - good)])
    for _ in range(rounds):
        by_class = of * n
        prior = (by_class.sum(axis=1) + 1) / (n.sum() + len(of))
        rates = np.einsum("cp,prv->crv", by_class, cast) + 1.0  # an abstention says nothing of the class
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("crv,prv->cp", np.log(rates), cast)
        new = np.exp(log - log.max(axis=0))
        new /= new.sum(axis=0)
        moved = np.abs(new - of).max()
        of = new
        if moved < 1e-10:
            break
    return dict(zip(seen.tolist(), of[0].tolist(), strict=True)), rates


def model(seen: DataFrame) -> tuple[dict[int, float], np.ndarray]:
    """The label model of a table with a column pattern: the counts of the patterns go to the driver, 3^12 at most."""
    rows = seen.groupBy("pattern").count().orderBy("pattern").collect()
    return fit(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows]))


def posterior(known: dict[int, float]):
    """A column of the posterior of the column pattern."""

    @F.pandas_udf("double")
    def of(s):
        return s.map(known)

    return of("pattern")


def score(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, votes, quality, kept): all rows with their votes, posterior and whether it is at least ``threshold``.

    Two passes over small data after one over the texts, without a shuffle of texts. A null or empty text
    has no words, so all rules abstain and its quality is that of all documents with no votes, mostly the
    prior. Repeated rows count each; equal texts have equal votes and quality. A null id stays null. An empty table
    gives an empty result. Texts are read whole. Of other columns none is read or returned.
    """
    src = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    seen = cut(patterns(src, 1))
    known, _ = model(seen)
    digits = [((F.col("pattern") / F.lit(float(3**k))).cast("long") % 3 - 1).cast("int") for k in range(len(RULES))]
    return seen.withColumn("quality", posterior(known)).select("doc_id", F.array(*digits).alias("votes"), "quality", (F.col("quality") >= threshold).alias("kept"))


def accuracies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(class, rule, good): how often each rule votes good on documents of a class when it votes; class 0 is the good one, then the kinds of bad.

    Of the good class this is the rule's accuracy, of the others its error. Cases as in ``score``; an empty table gives a half for all.
    """
    _, rates = model(patterns(docs.select(col(text_col).cast("string").alias("text")), 0).select("pattern"))
    rows = [(k, rule, float(rates[k, i, 1])) for k in range(len(rates)) for i, rule in enumerate(RULES)]
    return docs.sparkSession.createDataFrame(rows, "class int, rule string, good double")


def keep_good(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose posterior quality is at least ``threshold``, with their columns unchanged.

    The texts are read twice, once to fit and once to filter, and never shuffled. Cases as in ``score``.
    """
    known, _ = model(patterns(docs.select(col(text_col).cast("string").alias("text")), 0).select("pattern"))
    good = np.array([p for p, q in known.items() if q >= threshold], dtype=np.int64)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(np.isin(_number(batch.column(at)), good)))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
