"""Texts to vectors: the interface of embedders, one that needs no model, and what is kept of earlier calls."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")  # the same in a text of ASCII, in less time


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of ``dimensions`` numbers for each text."""


class HashingEmbedder:
    """Counts of words in buckets, with signs, of unit length; a text without words is zero.

    A word's bucket is what the first four digits of its MD5 leave modulo the dimensions; its sign is minus from the fifth digit 8 on.
    """

    def __init__(self, dimensions: int = 64, kept: int = 200_000):
        self.dimensions, self.kept = dimensions, kept
        self.known = _Places(dimensions, kept)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        place, bins = self.known.__getitem__, 2 * self.dimensions
        first, counts, places = 0, [], []  # what isn't added up yet: of which texts, how many words each, and the words' buckets

        def add() -> None:
            n = np.fromiter(places, np.int64, len(places)) + np.repeat(np.arange(len(counts)) * bins, counts)
            n = np.bincount(n, minlength=len(counts) * bins).reshape(-1, bins)
            out[first : first + len(counts)] += n[:, : self.dimensions] - n[:, self.dimensions :]

        for k, s in enumerate(texts):
            s = s.lower()
            found = (_ASCII_WORD if s.isascii() else _WORD).findall(s)
            for at in range(0, len(found) or 1, 65_536):
                some = found[at : at + 65_536]
                if first + len(counts) > k:  # a text goes on
                    counts[-1] += len(some)
                else:
                    counts.append(len(some))
                places.extend(map(place, some))
                if len(places) >= 65_536 or len(counts) >= 1024:
                    add()
                    first, counts, places = k + (at + 65_536 >= len(found)), [], []
        if counts:
            add()
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class _Places(dict):
    """Words to buckets, those of sign minus beyond all others; up to ``kept`` words are known at a time."""

    def __init__(self, dimensions: int, kept: int):
        self.dimensions, self.kept = dimensions, kept

    def __missing__(self, word: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        h = hashlib.md5(word.encode()).hexdigest()
        got = self[word] = int(h[:4], 16) % self.dimensions + (0 if int(h[4], 16) < 8 else self.dimensions)
        return got

    def __reduce__(self):
        return _Places, (self.dimensions, self.kept)


def embedded(rows: DataFrame, text_col: str, out_col: str = "vector", embedder: Embedder | None = None, batch: int = 64) -> DataFrame:
    """``rows`` with the vectors of a text column, in calls of up to ``batch`` texts; a null text has none."""
    e = embedder or HashingEmbedder()

    @F.arrow_udf("array<double>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            there = part.is_valid().to_numpy(zero_copy_only=False)
            texts = part.drop_null()
            got = [np.asarray(e.embed(texts.slice(at, batch).to_pylist()), np.float64) for at in range(0, len(texts), batch)]
            sizes = np.zeros(len(part), np.int64)
            sizes[there] = [m.shape[1] for m in got for _ in range(len(m))]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m.ravel() for m in got]) if got else np.zeros(0)), mask=pa.array(~there))

    return rows.withColumn(out_col, of(F.col(text_col)))


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The means of the vectors of tokens that count, of unit length unless under 1e-12. hidden: texts x tokens x dimensions."""
    m = mask[:, :, None].astype(float)
    return unit((hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9))


def first_pooled(hidden: np.ndarray) -> np.ndarray:
    """The vectors of first tokens, of unit length unless under 1e-12."""
    return unit(hidden[:, 0])


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1e-12, x, x / np.maximum(n, 1e-12))
