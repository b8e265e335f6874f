"""Token ids as binary blocks by a static range asymmetric numeral system (rANS).

One table of frequencies, counted over all documents, is shared by all blocks and stored with them in a header row. A block is an independent
stream: its tokens go round over ``LANES`` states, which one array operation advances together, and share one
stream of 32-bit words. Every ``STRIDE`` steps the block keeps a checkpoint, the states and the place in the
stream, so that the segments of a block can be decoded in parallel and from the middle. Checksums cover the
stream with its checkpoints, and the tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.bpe import encoder, ranks_of, vocabulary
from shalecrest.llm.common import col, cut, table
from shalecrest.llm.words import slices

LANES = 512
STRIDE = 256
BITS = 20  # frequencies add up to 2^20
BLOCK = 4 * LANES * STRIDE  # tokens
_LOW = np.uint64(1 << 31)
_32, _BITS, _SLOT = np.uint64(32), np.uint64(BITS), np.uint64((1 << BITS) - 1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^20, at least 1 for each token that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > 1 << BITS:
        raise ValueError("more tokens than slots")
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * ((1 << BITS) / total)).astype(np.int64)), 0)
    over = int(f.sum()) - (1 << BITS)
    if over < 0:
        f[np.argmax(f)] -= over
    order = np.argsort(-f, kind="stable")
    while over > 0:  # from the commonest tokens, to which it matters least
        for i in order:
            take = min(over, int(f[i]) // 2)
            f[i] -= take
            over -= take
            if not over:
                break
    return f


class Table:
    """The shared table: each token's frequency and start, and the token of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.token = np.repeat(np.arange(len(freq)), freq)


def encode(tokens: np.ndarray, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, states) of one block: the stream, and for each checkpoint its place and the lanes' states."""
    n = len(tokens)
    steps = -(-n // LANES)
    x = np.full(LANES, _LOW, np.uint64)
    chunks: list[np.ndarray] = []
    states = np.zeros((-(-steps // STRIDE), LANES), np.uint64)
    freq, start = t.freq[tokens], t.start[tokens]
    most = freq << np.uint64(31 - BITS + 32)
    for step in range(steps - 1, -1, -1):  # a decoder pops what was pushed last
        a, b = step * LANES, min(n, (step + 1) * LANES)
        f = freq[a:b]
        y = x[: b - a]
        full = y >= most[a:b]
        chunks.append(y[full].astype(np.uint32))
        y = np.where(full, y >> _32, y)
        q = y // f
        x[: b - a] = (q << _BITS) + (y - q * f) + start[a:b]
        if step % STRIDE == 0:
            states[step // STRIDE] = x
    chunks.reverse()
    ends = np.cumsum([0] + [len(c) for c in chunks])
    return np.concatenate(chunks or [np.zeros(0, np.uint32)]), ends[:-1:STRIDE].astype(np.int64), states


def decode_segment(words: np.ndarray, at: int, states: np.ndarray, n: int, t: Table) -> np.ndarray:
    """n tokens from a checkpoint on."""
    x = states.copy()
    out = np.zeros(n, np.int64)
    words = words.astype(np.uint64)
    for a in range(0, n, LANES):
        b = min(n, a + LANES)
        y = x[: b - a]
        slot = y & _SLOT
        token = t.token[slot.astype(np.int64)]
        out[a:b] = token
        y = t.freq[token] * (y >> _BITS) + slot - t.start[token]
        low = y < _LOW
        k = int(low.sum())
        y[low] = (y[low] << _32) | words[at : at + k]
        at += k
        x[: b - a] = y
    return out


def decode(words: np.ndarray, offsets: np.ndarray, states: np.ndarray, n: int, t: Table) -> np.ndarray:
    """All n tokens of a block, segment by segment; each could be decoded elsewhere."""
    size = LANES * STRIDE
    return np.concatenate([decode_segment(words, int(at), s, min(size, n - k * size), t) for k, (at, s) in enumerate(zip(offsets, states, strict=True))] or [np.zeros(0, np.int64)])


def tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text as little-endian numbers of two bytes, or four for a larger vocabulary."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    src = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        kind = width(enc.fst.size)
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20, 4096):
                flat, ends = enc.encode(batch.column(1))
                at = np.concatenate([[0], ends]) * np.dtype(kind).itemsize
                ids = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(flat.astype(kind))])
                ids = pc.if_else(batch.column(1).is_valid(), ids, None).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return src.mapInArrow(run, "doc_id long, ids binary")


def width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def count(ids: DataFrame, size: int) -> np.ndarray:
    """How often each token occurs in all documents: a row for each token goes to the driver."""
    kind = width(size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pc.fill_null(batch.column(0), b"")), b"")[0]
            total += np.bincount(np.frombuffer(joined.as_buffer(), kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for token, n in ids.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


BLOCKS = "block_id long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, first_at long, words binary, offsets array<long>, states binary, crc long, tokens_crc long"


def blocks(ids: DataFrame, freq: np.ndarray, block: int = BLOCK) -> DataFrame:
    """The blocks of a table of token ids; a partition's documents follow each other in its blocks."""
    shared_table = ids.sparkSession.sparkContext.broadcast(freq)  # a number for each token of the vocabulary, whatever the data
    kind = width(len(freq))
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(shared_table.value)
        part = TaskContext.get().partitionId() << 32
        made, docs, sizes, first_at, parts, n = 0, [], [], 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, docs, sizes, parts, n
            flat = np.concatenate(parts or [np.zeros(0, kind)])
            words, offsets, states = encode(flat, t)
            w, s = words.astype("<u4").tobytes(), states.astype("<u8").tobytes()
            row = (part | made, n, docs, sizes, first_at, w, offsets.tolist(), s, zlib.crc32(s, zlib.crc32(w)), zlib.crc32(flat.astype("<u4").tobytes()))
            made, docs, sizes, parts, n = made + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw or b"", kind)
                at = 0
                while True:
                    if not docs:
                        first_at = at
                    take = min(len(own) - at, block - n)
                    docs.append(doc)
                    sizes.append(-1 if raw is None else take)
                    parts.append(own[at : at + take])
                    n, at = n + take, at + take
                    if n == block:
                        yield close()
                    if at == len(own):
                        break
        if docs:
            yield close()

    return ids.mapInArrow(run, BLOCKS)


def unpack(stored: DataFrame, freq: np.ndarray) -> DataFrame:
    """(doc_id, at, token_ids): the pieces of documents in the blocks; raises where a checksum doesn't hold.

    at is the piece's place in its document. A null text has null token_ids.
    """
    shared_table = stored.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(shared_table.value)
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["states"], zlib.crc32(r["words"])) != r["crc"]:
                    raise ValueError(f"block {r['block_id']} is damaged")
                flat = decode(np.frombuffer(r["words"], "<u4"), np.array(r["offsets"], np.int64), np.frombuffer(r["states"], "<u8").reshape(-1, LANES), r["n_tokens"], t)
                if zlib.crc32(flat.astype("<u4").tobytes()) != r["tokens_crc"]:
                    raise ValueError(f"block {r['block_id']} decodes to other tokens")
                ends = np.cumsum(np.maximum(r["doc_tokens"], 0))
                rows = [None if n < 0 else flat[e - n : e] for n, e in zip(r["doc_tokens"], ends, strict=True)]
                at = [r["first_at"]] + [0] * (len(rows) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(at, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "at", "token_ids"])

    return stored.mapInArrow(run, "doc_id long, at long, token_ids array<int>")


def write(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(blocks, frequencies) of the token ids of all texts.

    The texts are tokenised once; the ids lie in the shared folder while they are counted and encoded. Nothing
    but counts is shuffled. Every row is in some block, a long document in several: doc_ids and doc_tokens name
    what a block holds, and first_at where in its first document it begins. A null text has -1 tokens, an empty one
    0. Null ids stay null, repeated rows are kept and ties don't arise; an empty table gives no blocks. Other columns are not read.
    """
    ids = cut(tokens(docs, path, id_col, text_col))
    size = encoder_size(path)
    freq = frequencies(count(ids, size))
    return blocks(ids, freq), freq


def header(spark, freq: np.ndarray) -> DataFrame:
    """A row like those of blocks that holds the shared table: block_id -1, no tokens, the frequencies in words, with their checksum."""
    packed = zlib.compress(freq.astype("<u4").tobytes())
    return spark.createDataFrame([(-1, 0, [], [], 0, packed, [], b"", zlib.crc32(packed), 0)], BLOCKS)


def store(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of ``write`` and the header row that decodes them; of an empty table the header alone."""
    made, freq = write(docs, path, id_col, text_col)
    return made.unionByName(header(docs.sparkSession, freq))


def restore(stored: DataFrame) -> DataFrame:
    """As ``unpack``, from what ``store`` gives alone; raises where it has no header, several, or a damaged one."""
    heads = stored.where("block_id = -1").select("words", "crc").limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"{len(heads) or 'no'} headers")
    if zlib.crc32(heads[0].words) != heads[0].crc:
        raise ValueError("the header is damaged")
    return unpack(stored.where("block_id >= 0"), np.frombuffer(zlib.decompress(heads[0].words), "<u4").astype(np.int64))


def encoder_size(path: str | None) -> int:
    """One more than the greatest token."""
    return max(ranks_of(vocabulary(path)).values()) + 1


def query(spark, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"))
