"""Words of many texts at once, as arrays over the UTF-8 bytes of an Arrow column.

A word is a run of ASCII letters and digits and of bytes above 127, folded to lower case (ASCII, and the
Latin-1 letters in their two-byte form). All else separates words. Every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_PRIME = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        inverse = pow(_PRIME, -1, 1 << 64)
        for base in (_PRIME, inverse):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers.append(p)
        del _powers[:-2]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of a string column; a null is an empty text. len(starts) is one more than the texts."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.null_count:  # what lies under a null doesn't count
        return raw(pa.array(["" if x is None else x for x in texts.to_pylist()], pa.string()))
    data = texts.buffers()[2]
    b = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, starts - starts[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``rows`` rows and about ``most`` bytes of text; a longer text is a run of its own."""
    at = 0
    if batch.num_rows:
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + most, "right"))))
            yield batch.slice(at, to - at)
            at = to


def fold(b: np.ndarray) -> np.ndarray:
    """Lower case."""
    out = _LOWER[b]
    if len(b) > 1:
        latin = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        out[1:][latin] += 0x20
    return out


class Words:
    """start, end: the place of each word in the bytes; text: the number of its text; hash: of its letters."""

    def __init__(self, b: np.ndarray, starts: np.ndarray):
        is_word = np.concatenate([[False], _WORD[b], [False]])
        turns = is_word[1:] != is_word[:-1]
        # a text's end also ends a word
        inner = starts[1:-1]
        inner = inner[(inner > 0) & (inner < len(b))]
        joined = np.unique(inner[is_word[inner] & is_word[inner + 1]]) if len(inner) else inner
        place = np.flatnonzero(turns)
        self.start, self.end = place[0::2], place[1::2]
        if len(joined):
            self.start = np.sort(np.concatenate([self.start, joined]))
            self.end = np.sort(np.concatenate([self.end, joined]))
        self.text = np.searchsorted(starts, self.start, "right") - 1
        p, q = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((fold(b).astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * q[self.start])


#: Buckets of the hashed document vector.
BUCKETS = 1024


def sketch(texts: pa.Array) -> np.ndarray:
    """A hashed vector for each text: distinct words weigh (1 + ln count) x letters (10 at most), with random signs.

    Long words tell texts apart, short ones are mostly grammar. A text without words is the zero vector.
    """
    w = Words(*raw(texts))
    size = np.minimum(w.end - w.start, 10)
    key = np.sort((w.text << 44) | ((w.hash >> np.uint64(24)).astype(np.int64) << 4) | size)
    if not len(key):
        return np.zeros((len(texts), BUCKETS), np.float32)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    weight = (1 + np.log(times)) * (key & 15)
    bucket = (key >> 44) * BUCKETS + ((key >> 5) & (BUCKETS - 1))
    return np.bincount(bucket, np.where(key & 16, weight, -weight), len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float32)


def directions(n: int, seed: int) -> np.ndarray:
    """n random directions to project sketches on."""
    return np.random.default_rng(seed).standard_normal((BUCKETS, n), dtype=np.float32)
