"""Packing documents into sequences of one capacity along a space-filling curve.

Each document's hashed word vector is projected on a few random directions. The coordinates, spread evenly
over a cube, give a Hilbert key: documents near on the curve have similar words. Documents are sorted by key
in ranges and their token ids are packed in this order, so that a sequence holds neighbours.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.bpe import encoder, vocabulary
from shalecrest.llm.codec import encoder_size, width
from shalecrest.llm.common import col, cut, table
from shalecrest.llm.words import directions, sketch, slices

DIMENSIONS = 4
ORDER = 12  # bits of a coordinate
_CELL = DIMENSIONS * ORDER - 16  # a cell is all keys with the same first 16 bits


def hilbert(x: np.ndarray, order: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of coordinates below 2^order."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (order - 1)
    while q > 1:  # undo the rotations and reflections, from the coarsest bit on
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def keys(texts: pa.Array, planes: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text; 0 for a text without words."""
    v = sketch(texts)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    z = np.round((v @ planes) / np.maximum(norm, 1e-9), 4)  # of variance 1 over random texts
    even = 1 / (1 + np.exp(-1.702 * z.astype(np.float64)))  # close to the normal distribution function
    key = hilbert(np.minimum((even * (1 << ORDER)).astype(np.int64), (1 << ORDER) - 1), ORDER)
    return np.where(norm[:, 0] > 0, key, 0)


class Filler:
    """Puts documents into packs in the order in which they come.

    A document goes into the first of the packs still open in which it fits, else into a new one, and then
    the oldest of ``open_packs`` closes. What exceeds the capacity is cut off in full packs first.
    """

    def __init__(self, capacity: int, open_packs: int):
        self.capacity, self.open_packs, self.made = capacity, open_packs, 0
        self.packs: deque[list] = deque()  # number, tokens so far, pieces

    def place(self, doc: int | None, ids: np.ndarray) -> Iterator[list]:
        """Takes a document in, and gives the packs that close: number, tokens, pieces of (document, start, ids)."""
        start = 0
        while len(ids) - start > self.capacity:
            yield [self.made, self.capacity, [(doc, start, ids[start : start + self.capacity])]]
            self.made, start = self.made + 1, start + self.capacity
        rest = len(ids) - start
        pack = next((p for p in self.packs if p[1] + rest <= self.capacity), None)
        if pack is None:
            pack = [self.made, 0, []]
            self.made += 1
            self.packs.append(pack)
            if len(self.packs) > self.open_packs:
                yield self.packs.popleft()
        pack[1] += rest
        pack[2].append((doc, start, ids[start:]))

    def close(self) -> Iterator[list]:
        yield from self.packs
        self.packs.clear()


class Ranges:
    """Which range each cell of the curve lies in, from the cells' tokens; a cell beyond a range is divided into several.

    ``first``: a cell's range, or the first of its ranges; ``parts``: how many it has.
    """

    def __init__(self, cells: np.ndarray, tokens: np.ndarray, size: int):
        self.first, self.parts = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
        n = np.zeros(1 << 16, np.int64)
        n[cells] = tokens
        large = n >= 2 * size
        self.parts[large] = -(-n[large] // size)
        total, at = 0, 0
        for cell in np.flatnonzero(n).tolist():
            if large[cell]:
                at += total > 0
                self.first[cell] = at
                at, total = at + int(self.parts[cell]), 0
            else:
                if total >= size:
                    at, total = at + 1, 0
                self.first[cell] = at
                total += int(n[cell])
        # a cell without tokens goes with the cell before it
        self.first = self.first[np.maximum.accumulate(np.where(n > 0, np.arange(1 << 16), 0))]


OUT = "pack_id long, n_tokens int, token_ids array<int>, doc_ids array<long>, starts array<long>, lengths array<int>"


def pack(docs: DataFrame, capacity: int = 2048, open_packs: int = 16, range_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, path: str | None = None) -> DataFrame:
    """(pack_id, n_tokens, token_ids, doc_ids, starts, lengths): the packs, up to ``capacity`` tokens each.

    Tokens are those of the byte-level BPE of the vocabulary at ``path``. A pack's pieces lie one after the other: the
    k-th is lengths[k] tokens of document doc_ids[k], from its token starts[k] on. Every row of the input is in some
    pack: a document up to the capacity whole, a longer one in full packs and a rest.

    The texts are read once; keys and token ids lie in the shared folder and are shuffled once, by range. Ranges of about
    ``range_tokens`` tokens are whole cells of the curve, so they and the result depend on the rows alone; a cell that
    holds more, as that of many copies, is divided by a hash of the documents. Each range has its own
    packs, which costs it one or a few that aren't full. The sizes of the 65,536 cells go to the driver.

    Null, empty and wordless texts have key 0; the first two have no tokens, and are pieces of length 0. Ties go by id, then
    ids of tokens; rows that are equal in all of it are interchangeable. Null ids come first and stay null. An empty table
    gives an empty result. Other columns are neither read nor returned.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = width(encoder_size(path))
    src = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, enc = directions(DIMENSIONS, seed), encoder(data.value)
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20, 2048):
                flat, ends = enc.encode(batch.column(1))
                at = np.concatenate([[0], ends])
                ids = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * np.dtype(kind).itemsize), pa.py_buffer(flat.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys(batch.column(1), planes)), pa.array(np.diff(at)), ids], ["doc_id", "key", "n", "ids"])

    keyed = cut(src.mapInArrow(run, "doc_id long, key long, n long, ids binary"))
    cells = keyed.groupBy(F.shiftright("key", _CELL).alias("cell")).agg(F.sum("n").alias("n")).orderBy("cell").collect()
    ranges = Ranges(np.array([c for c, _ in cells], np.int64), np.array([n for _, n in cells], np.int64), range_tokens)
    first, parts = ranges.first, ranges.parts

    @F.pandas_udf("long")
    def which(cell, salt):
        c = cell.to_numpy()
        return pd.Series(first[c] + salt.to_numpy() % parts[c])

    salt = F.shiftrightunsigned(F.xxhash64("doc_id", "n", "key"), 1)
    ranged = keyed.withColumn("range", which(F.shiftright("key", _CELL), salt)).repartition("range").sortWithinPartitions("range", "key", F.col("doc_id").asc_nulls_first(), "ids").select("range", "doc_id", "ids")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, filler = None, None

        def packed(closed: Iterable[list]) -> Iterator[pa.RecordBatch]:
            closed = list(closed)
            if closed:
                pieces = [p for c in closed for p in c[2]]
                ends = np.cumsum([0] + [len(c[2]) for c in closed]).astype(np.int32)
                tokens = np.concatenate([ids for *_, ids in pieces]).astype(np.int32)
                n = np.array([c[1] for c in closed], np.int32)
                arrays = [pa.array([(current << 32) | c[0] for c in closed], pa.int64()), pa.array(n), pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, n)).astype(np.int32)), pa.array(tokens))]
                arrays += [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, k)) for v, k in (([d for d, *_ in pieces], pa.int64()), ([s for _, s, _ in pieces], pa.int64()), ([len(i) for *_, i in pieces], pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in OUT.split(", ")])

        for batch in batches:
            closed: list = []
            for rng, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if rng != current:
                    if filler:
                        yield from packed([*closed, *filler.close()])
                    current, filler, closed = rng, Filler(capacity, open_packs), []
                closed += filler.place(doc, np.frombuffer(raw.as_buffer(), kind))
                if len(closed) >= 256:
                    yield from packed(closed)
                    closed = []
            yield from packed(closed)
        if filler:
            yield from packed(filler.close())

    return ranged.mapInArrow(place, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
