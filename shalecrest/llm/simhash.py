"""Near duplicates by SimHash, found with the nearest-neighbour recursion of May and Ozerov.

A fingerprint has 256 bits: the signs of the hashed word vector on random directions. Two documents are
near duplicates if their fingerprints differ in ``distance`` bits at most (45: an angle of 32 degrees,
where about nine of ten words agree). To find such pairs, the coordinates are shuffled and cut into strips. A filter is a
random half of a strip with a random pattern; it lets a fingerprint pass whose bits there differ from the pattern in
few places. Close fingerprints pass the same filters much more often than others. What passes a filter of the first
strip is a list; a list that isn't small is filtered again by the next strip, and so on; small lists are compared by brute
force. The whole is repeated in rounds with fresh strips and filters. There are so many filters and rounds that a pair at just
``distance`` is met with the wanted chance by lists of the greatest depth, hence by any, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.common import col, components, cut, table
from shalecrest.llm.words import directions, sketch, slices

BITS = 256
STRIPS = 4
_FP = [f"f{i}" for i in range(BITS // 64)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(doc_id, f0..f3); no fingerprint (null) for a text that is null or without words."""
    src = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = directions(BITS, seed)
        for whole in batches:
            for batch in slices(whole, 1):
                v = sketch(batch.column(1))
                words = np.packbits(v @ planes > 0, axis=1).view("<i8")
                none = ~v.any(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, i], mask=none) for i in range(len(_FP)))], ["doc_id", *_FP])

    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in _FP))


_WIDTH = BITS // STRIPS
_HALF = _WIDTH // 2
_TAIL = np.cumsum([math.comb(_HALF, k) for k in range(_HALF + 1)]) / 2**_HALF
#: The differences from a pattern with which a fingerprint still passes, and the share of fingerprints that do.
MOST = int(np.searchsorted(_TAIL, 0.011, "right")) - 1
SHARE = float(_TAIL[MOST])


#: The depth that recall is planned for. Lists of this depth are a millionth of the rows.
LEVELS = 3


@lru_cache(maxsize=1)
def _pass_together() -> np.ndarray:
    """The chance that two fingerprints both pass a random filter, by the number of differences in its strip."""
    half = [sum(math.comb(h, a) * math.comb(_HALF - h, c) for a in range(h + 1) for c in range(_HALF - h + 1) if max(a, h - a) + c <= MOST) / 2**_HALF for h in range(_HALF + 1)]
    return np.array([sum(math.comb(d, h) * math.comb(_WIDTH - d, _HALF - h) * half[h] for h in range(max(0, d - _HALF), min(d, _HALF) + 1)) / math.comb(_WIDTH, _HALF) for d in range(_WIDTH + 1)])


def expected_recall(distance: int, count: int, levels: int, rounds: int) -> float:
    """The chance that a pair with so many differences, anywhere, passes a common filter at each level in one round at least.

    Exact: over how the differences are spread over the strips, which are drawn anew in each round.
    """
    d = np.arange(distance + 1)
    meet = 1 - (1 - np.pad(_pass_together(), (0, distance))[: distance + 1]) ** count
    ways = np.array([math.comb(_WIDTH, k) for k in d], dtype=float) * meet
    rest = np.array([math.comb(BITS - levels * _WIDTH, distance - k) for k in d], dtype=float)
    spread = np.ones(1)
    for _ in range(levels):
        spread = np.convolve(spread, ways)[: distance + 1]
    return 1 - (1 - float(spread @ rest) / math.comb(BITS, distance)) ** rounds


@lru_cache(maxsize=16)
def plan(distance: int, recall: float, levels: int = LEVELS) -> tuple[int, int]:
    """(filters of a strip, rounds) with which a pair at ``distance`` meets at all levels with the chance ``recall``.

    More rounds need fewer filters each, but more in all; the least sum of the lists that a fingerprint comes into at the first level,
    each of which is shuffled, and a tenth of those at the second.
    """
    best = None
    for rounds in range(1, 17):
        low, high = 1, 1
        while expected_recall(distance, high, levels, rounds) < recall:
            low, high = high + 1, high * 2
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if expected_recall(distance, mid, levels, rounds) >= recall else (mid + 1, high)
        cost = rounds * (low * SHARE + (low * SHARE) ** 2 / 10)
        if best is None or cost < best[0]:
            best = cost, low, rounds
    return best[1:]


class Filters:
    """The strips of each round, and the filters of each strip: bits and patterns."""

    def __init__(self, distance: int, recall: float, seed: int):
        self.count, self.rounds = plan(distance, recall)
        rng = np.random.default_rng(seed)
        self.order = [rng.permutation(BITS) for _ in range(self.rounds)]
        self.masks, self.patterns = [], []
        for _ in range(self.rounds * LEVELS):
            bits = np.zeros((self.count, _WIDTH), dtype=bool)
            for row in bits:
                row[rng.choice(_WIDTH, _HALF, replace=False)] = True
            mask = np.packbits(bits, axis=1).view("<u8").ravel()
            self.masks.append(mask)
            self.patterns.append(rng.integers(0, 2**64, self.count, dtype=np.uint64) & mask)

    def turned(self, fp: np.ndarray, turn: int) -> np.ndarray:
        """Fingerprints with their bits in the order of the round, a word a strip; distances stay."""
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)
        return np.ascontiguousarray(np.packbits(bits[:, self.order[turn]], axis=1)).view("<u8")

    def passed(self, strip: np.ndarray, turn: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of the strips that pass a filter of the round and level."""
        mask, pattern = self.masks[turn * LEVELS + level], self.patterns[turn * LEVELS + level]
        rows, which = [], []
        step = max(1, (1 << 18) // self.count)
        for at in range(0, len(strip), step):
            r, f = np.nonzero(np.bitwise_count((strip[at : at + step, None] & mask) ^ pattern) <= MOST)
            rows.append(r + at)
            which.append(f)
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(which or [np.zeros(0, int)])

    def lists(self, fp: np.ndarray, levels: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(round, turned fingerprints, row, list) for each list of the depth that a fingerprint comes into; a part for each round."""
        for turn in range(self.rounds):
            own = self.turned(fp, turn)
            row = np.arange(len(fp))
            path = np.full(len(fp), turn, np.int64)
            for level in range(levels):  # every list so far with every filter passed at this level
                r, f = self.passed(own[:, level], turn, level)
                first, last = np.searchsorted(r, row), np.searchsorted(r, row, "right")
                times = last - first
                pick = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
                path = np.repeat(path, times) * self.count + f[pick]
                row = np.repeat(row, times)
            yield turn, own, row, path

    def near(self, fp: np.ndarray, turn: int, level: int, distance: int, list_size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of a list that has been filtered by ``level`` strips: it is filtered on while it is large, then compared."""
        if len(fp) <= list_size or level == LEVELS:
            return singles(fp, distance)
        r, f = self.passed(fp[:, level], turn, level)
        r = r[np.argsort(f, kind="stable")]
        ends = np.cumsum(np.bincount(f, minlength=self.count))
        found = [np.zeros(0, np.int64)]
        for a, b in zip(ends - np.diff(ends, prepend=0), ends, strict=True):
            if b - a > 1:
                i, j = self.near(fp[r[a:b]], turn, level + 1, distance, list_size)
                found.append(r[a + i] * len(fp) + r[a + j])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(fp), pairs % len(fp)


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the distance that connect all that such pairs connect, by comparing what isn't reached yet.

    Exact: breadth first from each row in turn; every reached row is compared with every row not yet reached.
    """
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            part, front = front[:64], front[64:]
            step = max(1, (1 << 20) // len(part))
            found, source = [], []
            for at in range(0, len(left), step):
                d = sum(np.bitwise_count(fp[part, None, i] ^ fp[None, left[at : at + step], i]).astype(np.int16) for i in range(fp.shape[1]))
                near = d <= distance
                hit = np.flatnonzero(near.any(axis=0))
                found.append(hit + at)
                source.append(part[near[:, hit].argmax(axis=0)])
            hit = np.concatenate(found)
            if len(hit):
                new = left[hit]
                a.append(np.concatenate(source))
                b.append(new)
                front = np.concatenate([front, new])
                left = np.delete(left, hit)
    none = np.zeros(0, int)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def singles(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, for a list in which few are near: rows are compared in blocks with all later rows.

    Falls back to ``forest`` as soon as many are near, so that large groups cost no square.
    """
    n = len(fp)
    words = np.ascontiguousarray(fp.T)
    # strips that have been filtered come first and tell rows of a list apart the least
    x, y = words[-1], words[-2]
    a, b, pairs = [], [], 0
    step = max(16, min(512, (1 << 17) // max(n, 1)))
    for at in range(0, n, step):
        d = np.bitwise_count(x[at : at + step, None] ^ x[None, at:])
        d += np.bitwise_count(y[at : at + step, None] ^ y[None, at:])
        i, j = np.nonzero(d <= distance)
        keep = j > i
        i, j = i[keep], j[keep]
        total = d[i, j].astype(np.int16)
        for w in words[:-2]:
            total = total + np.bitwise_count(w[i + at] ^ w[j + at])
        ok = total <= distance
        i, j = i[ok], j[ok]
        pairs += len(i)
        if pairs > 8 * n:
            return forest(fp, distance)
        a.append(i + at)
        b.append(j + at)
    none = np.zeros(0, int)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key, ids, fingerprints) of each run of rows with one key; the last columns are the id and the fingerprint."""
    held: list[np.ndarray] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_columns - len(_FP) - 1
        rows = np.stack([c.fill_null(-1).to_numpy() for c in batch.columns], axis=1)
        cuts = np.flatnonzero((rows[1:, :n] != rows[:-1, :n]).any(axis=1)) + 1
        for part in np.split(rows, cuts):
            key = tuple(part[0, :n].tolist())
            if key != current and held:
                yield current, *_whole(held)
                held = []
            current = key
            held.append(part)
    if held:
        yield current, *_whole(held)


def _whole(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.concatenate(held)
    return rows[:, -len(_FP) - 1].copy(), np.ascontiguousarray(rows[:, -len(_FP) :]).view(np.uint64)


def near_pairs(prints: DataFrame, distance: int, recall: float, list_size: int, task_rows: int, seed: int) -> DataFrame:
    """(a, b): pairs of ids of distinct fingerprints that connect near duplicates.

    As many levels are shuffled as it takes for lists of ``task_rows`` rows at most if fingerprints were
    independent; deeper ones are made within a list's task. Where a list is longer all the same, as
    near copies stay together at any depth, its rows are hashed into blocks, and each pair of blocks is a task.
    """
    filters = Filters(distance, recall, seed)
    n, levels = prints.count(), 1
    while levels < LEVELS and n * SHARE**levels > task_rows:
        levels += 1
    step = max(1, min(2048, int((1 << 18) / (filters.count * SHARE) ** levels)))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids = batch.column(0).to_numpy()
                fp = np.stack([batch.column(1 + i).to_numpy() for i in range(len(_FP))], axis=1).view(np.uint64)
                for _, own, row, path in filters.lists(fp, levels):
                    yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(ids[row]), *(pa.array(own[row, i].view(np.int64)) for i in range(len(_FP)))], ["list", "id", *_FP])

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spread(batches):
            path, times = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(times)], ["list", "n"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, fp in _lists(batches):
            order = np.argsort(ids, kind="stable")  # the same pairs whatever order rows come in
            ids = ids[order]
            a, b = filters.near(fp[order], key[0] // filters.count**levels, levels, distance, list_size)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    lists = prints.mapInArrow(spread, "list long, id long, " + ", ".join(f"{f} long" for f in _FP))
    sizes = prints.mapInArrow(tally, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * task_rows)
    heavy = cut(sizes.select("list", F.ceil(F.col("n") / task_rows).cast("int").alias("k")))
    keys = ["list"]
    if not heavy.isEmpty():
        own = F.pmod(F.xxhash64("id"), "k").cast("int")
        other = F.explode(F.when(F.col("k").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("k") - 1)))
        lists = lists.join(heavy, "list", "left").select("list", "id", *_FP, own.alias("o"), other.alias("p")).select("list", "id", *_FP, F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"))
        keys += ["i", "j"]
    # lists are made of sorted rows: most are far smaller than an Arrow batch
    return lists.select(*keys, "id", *_FP).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 45, recall: float = 0.98, list_size: int = 4000, task_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(doc_id, group_id, n_links, kept): the group of near duplicates of every row, named by its least id, whose row is kept.

    Groups are the connected components of near pairs. ``recall`` is the expected share of pairs at just
    ``distance`` that are found; closer pairs are found more often. n_links is the number of other fingerprints
    that the row's own is linked with; in a list full of near duplicates only the links that connect them are made.
    Lists of over ``list_size`` rows are filtered on, and no task gets more than about twice ``task_rows``. Texts are read whole.

    A text that is null, empty or without words has no fingerprint and is a group of its own, so it is kept.
    A row with a null id gets a null group and is kept. Repeated rows of one id are in one group; as they
    have the same id, all of them say ``kept``. Equal fingerprints always are one group; ties don't arise. An empty
    table gives an empty result. Other columns are neither read nor returned.
    """
    rows = cut(fingerprints(docs, id_col, text_col, seed))
    known = rows.where("doc_id is not null and f0 is not null")
    prints = cut(known.groupBy(*_FP).agg(F.min("doc_id").alias("id")).select("id", *_FP))
    # an id with several texts has several fingerprints; it then connects them
    same = known.join(prints, _FP).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    pairs = cut(near_pairs(prints, distance, recall, list_size, task_rows, seed))
    roots = components(pairs.unionByName(same.where("a <> b")))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    links = same.join(degree, "a").groupBy(F.col("b").alias("of")).agg(F.max("n").alias("n_links"))
    out = rows.join(roots, rows.doc_id == roots.node, "left").join(links, rows.doc_id == links.of, "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
