"""Near duplicates of embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes of all vectors, largest first, which leaves cosines as they are.
They are cut into tiles along the first axis. Two tiles are compared unless their boxes are further apart than
vectors at the threshold can be. Within a pair of tiles, products are added up from the leading dimensions on; what the
rest can add is at most the product of the norms of the two remainders, and a pair of vectors is given up as
soon as it can't reach the threshold any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.llm.common import col, components, cut, table

BOX = 8  # leading dimensions of a tile's box
_EPS = 1e-5  # for sums in single precision


def units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, unit): unit vectors in double precision as bytes; null where a vector has no direction."""
    src = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = [], []
            for v in batch.column(1):
                x = None
                if v.is_valid and v.values.null_count == 0 and len(v.values):
                    x = v.values.to_numpy()
                    top = np.abs(x).max()
                    x = x / top / np.linalg.norm(x / top) if 0 < top < np.inf else None
                dims.append(0 if x is None else len(x))
                out.append(None if x is None else x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "unit"])

    return src.mapInArrow(run, "vec_id long, dim int, unit binary")


def axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes of the vectors of each dimension, as columns, largest first. All vectors count.

    dim^2 sums go to the driver for each dimension that occurs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = np.frombuffer(b"".join(batch.column(1).filter(pa.array(dims == d)).to_pylist()), "<f8").reshape(-1, d)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(s.ravel())], ["dim", "at", "s"])

    got: dict[int, np.ndarray] = {}
    for d, at, s in rows.select("dim", "unit").mapInArrow(run, "dim int, at int, s double").groupBy("dim", "at").agg(F.sum("s")).collect():
        got.setdefault(d, np.zeros(d * d))[at] = s
    return {d: np.linalg.eigh(s.reshape(d, d))[1][:, ::-1] for d, s in got.items()}


def reach(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b with a product of at least the threshold; of one tile with itself each pair once."""
    d = a.shape[1]
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    # the norm of what is left from each dimension on
    left = lambda x: np.sqrt(np.maximum(np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1], 0)).astype(np.float32)
    ra, rb = left(a), left(b)
    out_i, out_j = [], []
    for at in range(0, len(a), 1024):  # bounds the products held at once
        part = slice(at, at + 1024)
        total, done = np.zeros((len(a32[part]), len(b)), np.float32), 0
        while True:
            step = min(d, done + max(8, d // 4))
            total += a32[part, done:step] @ b32[:, done:step].T
            done = step
            alive = total >= threshold - _EPS if done == d else total + ra[part, done, None] * rb[None, :, done] >= threshold - _EPS
            few = np.count_nonzero(alive)
            if done == d or few * 20 < alive.size:
                break
        i, j = np.nonzero(alive)
        acc = total[i, j].astype(np.float64)
        i = i + at
        if same:
            keep = i < j
            i, j, acc = i[keep], j[keep], acc[keep]
        while done < d:  # the few that are left, pair by pair
            step = min(d, done + max(8, d // 4))
            acc = acc + np.einsum("ij,ij->i", a[i, done:step], b[j, done:step])
            done = step
            rest = 0.0 if done == d else ra[i, done] * rb[j, done]
            ok = acc + rest >= threshold - _EPS
            i, j, acc = i[ok], j[ok], acc[ok]
        exact = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
        out_i.append(i[exact])
        out_j.append(j[exact])
    return np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Of pairs of ids, as many as connect the same."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    a, b = [], []
    for u, v in zip(x.tolist(), y.tolist(), strict=True):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            a.append(u)
            b.append(v)
    return a, b


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, group_id, n_links, kept): the group of every row, named by its least id, whose row is kept.

    Groups are the connected components of pairs whose cosine is at least ``threshold``; all pairs are decided exactly,
    in double precision. Equal unit vectors are compared once; n_links is the number of other ones that the row's own is near.
    Vectors of different lengths are never near. Ties don't arise.

    A vector that is null, empty or zero, or holds a null, NaN or infinity, has no direction: it is a group of its own and
    kept. A null id gets a null group and is kept. Repeated rows of an id are in one group and all of them say
    ``kept``. An empty table gives an empty result. Other columns are neither read nor returned.
    """
    rows = cut(units(vectors, id_col, vector_col))
    known = rows.where("vec_id is not null and unit is not null")
    points = cut(known.groupBy("dim", "unit").agg(F.min("vec_id").alias("id")))
    same = known.join(points, ["dim", "unit"]).select(F.col("id").alias("a"), F.col("vec_id").alias("b"))
    turned = axes(points)
    far = math.sqrt(max(0.0, 2 - 2 * threshold)) + _EPS

    def rotate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [np.frombuffer(u, "<f8") @ turned[d] for d, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in xs], pa.float64()), pa.array([x.astype("<f8").tobytes() for x in xs], pa.binary())], ["id", "dim", "lead", "x"])

    ordered = points.select("id", "dim", "unit").mapInArrow(rotate, "id long, dim int, lead double, x binary")
    # where tiles are cut only balances the work: each dimension into tiles of about the wanted size
    sizes = {r["dim"]: r["count"] for r in points.groupBy("dim").count().collect()}
    cuts: dict[int, list[float]] = {}
    for d, n in sizes.items():
        k = -(-n // tile)
        if k > 1:
            cuts[d] = sorted(set(ordered.where(F.col("dim") == d).agg(F.percentile_approx("lead", [i / k for i in range(1, k)], 10 * k)).first()[0]))

    @F.pandas_udf("int")
    def which(dim, lead):
        out = np.zeros(len(dim), np.int32)
        for d in cuts:
            own = (dim == d).to_numpy()
            out[own] = np.searchsorted(cuts[d], lead[own])
        return pd.Series(out)

    def gather(t: pa.Table) -> pa.Table:
        d = t.column("dim")[0].as_py()
        ids = t.column("id").to_numpy()
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), "<f8").reshape(-1, d)
        order = np.lexsort((ids, x[:, 0]))
        out = []
        for part, at in enumerate(range(0, len(ids), 2 * tile)):  # equal leads can make a tile large
            o = order[at : at + 2 * tile]
            lead = x[o, :BOX]
            out.append((d, t.column("tile")[0].as_py() * 1_000_000 + part, ids[o].astype("<i8").tobytes(), x[o].tobytes(), lead.min(axis=0).tolist(), lead.max(axis=0).tolist()))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["dim", "tile", "ids", "x", "lo", "hi"])

    tiles = cut(ordered.withColumn("tile", which("dim", "lead")).groupBy("dim", "tile").applyInArrow(gather, "dim int, tile long, ids binary, x binary, lo array<double>, hi array<double>"))
    box = tiles.select("dim", "tile", "lo", "hi")
    # each tile meets each other in one of 32 parts of the join
    a = box.withColumn("part", F.col("tile") % 32).alias("a")
    b = box.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(31)))).alias("b")
    gap = F.zip_with(F.zip_with("a.lo", "b.hi", lambda p, q: p - q), F.zip_with("b.lo", "a.hi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    pairs = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.tile") <= F.col("b.tile")) & (F.element_at("b.lo", 1) - F.element_at("a.hi", 1) <= far))
    pairs = pairs.where(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= far * far).select(F.col("a.dim").alias("dim"), F.col("a.tile").alias("i"), F.col("b.tile").alias("j"))
    # a tile comes first of those that it is compared with, so that it is sent once
    work = pairs.join(tiles.select("dim", F.col("tile").alias("j"), "ids", "x"), ["dim", "j"]).select("dim", "i", "j", "ids", "x").repartition("dim", "i").sortWithinPartitions("dim", "i", "j")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = x = at = None
        for batch in batches:
            for k in range(batch.num_rows):
                d, i, j, q, y = (batch.column(c)[k].as_py() for c in range(5))
                q, y = np.frombuffer(q, "<i8"), np.frombuffer(y, "<f8").reshape(-1, d)
                if (d, i) != at:
                    at, p, x = (d, i), q, y
                u, v = reach(x, y, threshold, i == j)
                one, two = spanning(p[u], q[v])
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.nulls(len(one), pa.int64())], ["a", "b", "n"])
                ids, n = np.unique(np.concatenate([p[u], q[v]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(n)], ["a", "b", "n"])

    found = cut(work.mapInArrow(compare, "a long, b long, n long"))
    roots = components(found.where("n is null").select("a", "b").unionByName(same.where("a <> b")))
    links = same.join(found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")), "a").groupBy(F.col("b").alias("of")).agg(F.max("n").alias("n_links"))
    out = rows.join(roots, rows.vec_id == roots.node, "left").join(links, rows.vec_id == links.of, "left")
    return out.select("vec_id", F.coalesce("root", "vec_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9),
reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id)
links AS (SELECT p.a AS id, count(DISTINCT y.embedding) AS n FROM pairs p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b WHERE x.embedding <> y.embedding GROUP BY p.a)
SELECT reach.id AS vec_id, min(root) AS group_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, reach.id = min(root) AS kept FROM reach LEFT JOIN links ON links.id = reach.id GROUP BY reach.id
"""
