"""Retrieval: exact and indexed nearest neighbours, BM25, rank fusion, reranking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalecrest.functions.text import words


def _packed(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    ids, lists = batch.column(0), batch.column(1)
    size = np.where(np.asarray(lists.is_valid()), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0)
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        whole = np.isfinite(x).all(axis=1)
        at, x = at[whole], x[whole]
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        own = np.asarray(ids.take(pa.array(at)).to_numpy(zero_copy_only=False), dtype="<i8")
        for k in range(0, len(own), rows):
            yield d, own[k : k + rows], x[k : k + rows]


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))


def blocks(vectors: DataFrame, id_col: str, vector_col: str, rows: int) -> DataFrame:
    """(dim, ids, x): vectors of one length in blocks of up to ``rows``, packed, scaled to unit length; a zero vector stays zero.

    Vectors that are null or hold a null or NaN are in none.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own, x in _packed(batch, rows):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "ids", "x"])

    return _vectors(vectors, id_col, vector_col).mapInArrow(pack, "dim int, ids binary, x binary")


def _met(queries: DataFrame, corpus: DataFrame, best: Callable, id_col: str, vector_col: str, rows: int, small: int) -> DataFrame:
    """(query_id, id, similarity) that ``best`` (ids and unit vectors of a block of queries, and of one of the corpus) picks. The corpus stays where it is.

    Queries of up to ``small`` bytes in all are sent out with the function, so a task holds one batch of the corpus at a time, whatever its partition has.
    More are broadcast as blocks, in parts of about that size, one after the other.
    """
    out = "query_id long, id long, similarity double"
    table = lambda qi, ci, v: pa.RecordBatch.from_arrays([pa.array(qi), pa.array(ci), pa.array(v)], ["query_id", "id", "similarity"])
    parts = max(1, -(-8 * (queries.agg(F.sum(F.size(vector_col).cast("long"))).first()[0] or 0) // small))
    if parts == 1:
        by_dim: dict[int, list] = {}
        for d, i, x in blocks(queries, id_col, vector_col, rows).collect():
            by_dim.setdefault(d, []).append((np.frombuffer(i, "<i8"), np.frombuffer(x, "<f8").reshape(-1, d)))
        asked = {d: tuple(np.concatenate(v) for v in zip(*b, strict=True)) for d, b in by_dim.items()}

        def direct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, ci, cx in _packed(batch, rows):
                    qi, qx = asked.get(d, ((), ()))
                    for at in range(0, len(qi), rows):
                        yield table(*best(qi[at : at + rows], qx[at : at + rows], ci, cx))

        return _vectors(corpus, id_col, vector_col).mapInArrow(direct, out)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, qx, ci, cx = (batch.column(i)[r].as_py() for i in range(4))
                qi, ci = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
                yield table(*best(qi, np.frombuffer(qx, "<f8").reshape(len(qi), -1), ci, np.frombuffer(cx, "<f8").reshape(len(ci), -1)))

    c = blocks(corpus, id_col, vector_col, rows).select("dim", F.col("ids").alias("ci"), F.col("x").alias("cx"))
    found = []
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part)
        q = blocks(mine, id_col, vector_col, rows).select("dim", F.col("ids").alias("qi"), F.col("x").alias("qx"))
        found.append(c.join(F.broadcast(q), "dim").select("qi", "qx", "ci", "cx").mapInArrow(joined, out))
    return reduce(DataFrame.unionByName, found)


def knn(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = True, rows: int = 2048, small: int = 64 << 20) -> DataFrame:
    """(query_id, id, similarity, rank): for every query its k nearest by cosine, ties by id. Exact.

    Blocks of queries meet blocks of the corpus of the same length; each pair of blocks keeps k candidates a query, and the best
    of these are ranked. What is shuffled is k rows a query and block, never all pairs. The corpus stays where it is: queries are
    sent to it, beyond ``small`` bytes in parts. A vector that is null, or holds a null or NaN, is neither found nor finds anything.
    """

    def best(qi, qx, ci, cx):
        s = np.round(qx @ cx.T, 12)
        if exclude_self:
            s[qi[:, None] == ci[None]] = -np.inf
        i, j = _best(s, k)
        return qi[i], ci[j], s[i, j]

    return _ranked(_met(queries, corpus, best, id_col, vector_col, rows, small), k)


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k greatest of each row, and of all that tie with the k-th, so that the least ids win in the end."""
    n = min(k, s.shape[1])
    least = np.partition(s, -n, axis=1)[:, -n]
    return np.nonzero((s >= least[:, None]) & np.isfinite(s))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Ivf:
    """An inverted file: each vector in the list of its nearest centroid; a query looks into the nearest ``probes``.

    There are ``lists`` lists, or more so that they are of 16 times their number on average: their sizes grow with the root of the rows. Centroids are fitted by k-means to up
    to ``sample`` vectors, those of least hash of id; all vectors are indexed. Probes are as many as up to 200 vectors of the sample need for ``target`` of their ten nearest in it.
    """

    def __init__(self, corpus: DataFrame, lists: int = 16, sample: int = 10_000, target: float = 0.95, rounds: int = 15, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3):
        self.id_col, self.vector_col, self.corpus = id_col, vector_col, corpus
        there = corpus.where(F.col(vector_col).isNotNull())
        lists = max(lists, int((there.count() / 16) ** 0.5))
        some = there.select(F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64(id_col), id_col).limit(sample).toPandas()["v"]
        x = np.array(some.tolist())
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            of = (x @ c.T).argmax(axis=1)
            c = np.stack([x[of == k].mean(axis=0) if (of == k).any() else c[k] for k in range(len(c))])
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.centroids = c
        q = x[:200]
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = (x @ c.T).argmax(axis=1)[np.argsort(-s, axis=1, kind="stable")[:, :10]]
        # at which probe each of the nearest is met
        at = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)[np.arange(len(q))[:, None], near]
        self.probes = next((p for p in range(1, len(c)) if (at < p).mean() >= target), len(c))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exclude_self: bool = True, rows: int = 2048, small: int = 64 << 20) -> DataFrame:
        """(query_id, id, similarity, rank) of the vectors in the probed lists.

        Vectors stay where they are, and each list of a block is multiplied with the queries that probe it. What is shuffled is k rows a query and block.
        """
        c, probes = self.centroids, probes or self.probes

        def best(qi, qx, ci, cx):
            s = np.full((len(qi), len(ci)), -np.inf)
            if cx.shape[1] == c.shape[1]:
                near = qx @ c.T
                probed = np.zeros(near.shape, bool)
                np.put_along_axis(probed, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                of = (cx @ c.T).argmax(axis=1)
                for own in np.unique(of):
                    i, j = np.flatnonzero(probed[:, own]), np.flatnonzero(of == own)
                    if len(i):
                        s[np.ix_(i, j)] = np.round(qx[i] @ cx[j].T, 12)
            if exclude_self:
                s[qi[:, None] == ci[None]] = -np.inf
            i, j = _best(s, k)
            return qi[i], ci[j], s[i, j]

        return _ranked(_met(queries, self.corpus, best, self.id_col, self.vector_col, rows, small), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact ids that were found."""
    f = found.groupBy("query_id").agg(F.collect_set("id").alias("f"))
    e = exact.groupBy("query_id").agg(F.collect_set("id").alias("e"))
    return e.join(f, "query_id", "left").select("query_id", (F.size(F.array_intersect("e", F.coalesce("f", F.array().cast("array<long>")))) / F.size("e")).alias("recall"))


_TERM = regex.compile(r"[\p{L}\p{N}]+")


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, text: str = "text", k1: float = 1.2, b: float = 0.75, small: int = 8 << 20) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of greatest BM25 for each query, ties by id. Rows with null ids or texts are left out.

    While the texts of the queries take up to ``small`` bytes, each document is scored for all of them where it is, in two
    passes over postings of the queries' terms alone, and only the best of each batch are shuffled. Beyond that
    postings and queries are joined by term. Both give the same rows.
    """
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(text).alias("text")).dropna()
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).dropna()
    if (q.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > small:
        return _bm25_joined(q, d, k, k1, b)
    return _bm25_in_place(q.collect(), d, k, k1, b)


def _bm25_in_place(queries: list, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    term_of: dict[str, int] = {}
    pairs = sorted({(n, term_of.setdefault(w, len(term_of))) for n, (_, s) in enumerate(queries) for w in _TERM.findall(s.lower())}, key=lambda x: x[1])
    who, terms = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    first = np.searchsorted(terms, np.arange(len(term_of) + 1))  # queries that have a term
    ids = np.array([r[0] for r in queries], np.int64)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = term_of.get
        for batch in batches:
            flat, counts, ends, sizes = [], [], [0], []
            for s in batch.column(1).to_pylist():
                w = _TERM.findall(s.lower())
                tf = Counter(t for t in map(get, w) if t is not None)
                sizes.append(len(w))
                flat += tf.keys()
                counts += tf.values()
                ends.append(len(flat))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (flat, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["doc_id", "len", "term", "tf"])

    posts = docs.mapInArrow(post, "doc_id long, len int, term array<int>, tf array<int>").persist(StorageLevel.DISK_ONLY)
    n, mean = posts.agg(F.count("*"), F.avg("len")).first()
    df = np.zeros(len(term_of))
    for t, c in posts.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*")).collect():  # terms of the queries
        df[t] = c
    idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                doc, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                many = pc.list_value_length(batch.column(2)).to_numpy()
                row, t, tf = np.repeat(np.arange(len(doc)), many), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                part = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean))
                hits = first[t + 1] - first[t]
                q = who[np.repeat(first[t] - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())]
                for low in range(0, len(ids), 4096):  # bounds the scores held at once
                    own = (q >= low) & (q < low + 4096)
                    width = min(4096, len(ids) - low)
                    s = np.bincount((q[own] - low) * len(doc) + np.repeat(row, hits)[own], np.repeat(part, hits)[own], width * len(doc)).reshape(width, len(doc))
                    s = np.where(s > 0, np.round(s, 9), -np.inf)
                    i, j = _best(s, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[low + i]), pa.array(doc[j]), pa.array(s[i, j])], ["query_id", "id", "similarity"])

    if not n or not len(ids):
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    found = posts.mapInArrow(score, "query_id long, id long, similarity double")
    return _ranked(found, k).select("query_id", F.col("id").alias("doc_id"), F.col("similarity").alias("score"), "rank")


def _bm25_joined(queries: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    tf = docs.select("doc_id", words(F.col("text")).alias("w"))
    sized = tf.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    wanted = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    posts = sized.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    stats = tf.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg_len"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = wanted.join(posts.join(df, "term"), "term").crossJoin(F.broadcast(stats)).groupBy("query_id", F.col("doc_id").alias("id")).agg(F.round(F.sum(part), 9).alias("similarity"))
    return _ranked(scored, k).select("query_id", F.col("id").alias("doc_id"), F.col("similarity").alias("score"), "rank")


def fuse(dense: DataFrame, lexical: DataFrame, k: int, alpha: float = 0.6, c: int = 60) -> DataFrame:
    """(query_id, id, score, rank): weighted reciprocal rank fusion of two rankings (query_id, id, rank).

    Scores are divided by the query's greatest; what scores 0 is left out.
    """
    parts = dense.select("query_id", "id", (F.lit(alpha) / (c + F.col("rank"))).alias("s")).unionByName(lexical.select("query_id", "id", (F.lit(1 - alpha) / (c + F.col("rank"))).alias("s")))
    summed = parts.groupBy("query_id", "id").agg(F.sum("s").alias("s")).where("s > 0")
    top = F.max("s").over(Window.partitionBy("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return summed.withColumn("score", F.round(F.col("s") / top, 9)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def rerank(ranked: DataFrame, score: Column, k: int) -> DataFrame:
    """The ranking in order of a new score, which replaces the similarity; ties stay in their old order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("new"), "rank")
    return ranked.withColumn("new", score).withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).select("query_id", "id", F.col("new").alias("similarity"), F.col("at").alias("rank"))


def page(ranked: DataFrame, offset: int, k: int, min_similarity: float | None = None) -> DataFrame:
    """Ranks offset + 1 to offset + k, after what is less similar than the minimum is left out."""
    kept = ranked if min_similarity is None else ranked.where(F.col("similarity") >= min_similarity)
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("at", F.row_number().over(w)).where((F.col("at") > offset) & (F.col("at") <= offset + k)).select("query_id", "id", "similarity", F.col("at").alias("rank"))


def recency_order(ranked: DataFrame, now: Column, k: int, alpha: float = 0.85, beta: float = 0.15) -> DataFrame:
    """The first k of the 2 k most similar rows, in the order of similarity and age; the similarity itself stays. ranked has a column ts."""
    near = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    some = ranked.withColumn("at", F.row_number().over(near)).where(F.col("at") <= 2 * k)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(recency(F.col("similarity"), F.col("ts"), now, alpha, beta), 9)), "at")
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")


def listed_first(ranked: DataFrame, named: DataFrame) -> DataFrame:
    """The ranking with what a judge named (query_id, index into it from 0, pos) first: its score is 1 - pos / n, all else keeps order and score."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    j = ranked.withColumn("n", n).join(named.select("query_id", (F.col("index") + 1).alias("rank"), "pos"), ["query_id", "rank"], "left")
    w = Window.partitionBy("query_id").orderBy(F.coalesce("pos", F.col("n") + F.col("rank")))
    score = F.when(F.col("pos").isNotNull(), 1 - F.col("pos") / F.col("n")).otherwise(F.col("similarity"))
    return j.select("query_id", "id", score.alias("similarity"), F.row_number().over(w).alias("rank"))


def cached(asked: DataFrame, known: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(id, hit, similarity): the entry of a cache that answers each row: of the same hash, else the most like it from ``threshold`` on.

    Both have id, hash and vector. A row without either has a null hit.
    """
    same = asked.join(known.select("hash", F.col("id").alias("k")), "hash").groupBy("id").agg(F.min("k").alias("same"))
    near = knn(asked.join(same, "id", "left_anti"), known, 1, "id", "vector", exclude_self=False).where(F.col("similarity") >= threshold)
    out = asked.select("id").join(same, "id", "left").join(near.select(F.col("query_id").alias("id"), F.col("id").alias("near"), "similarity"), "id", "left")
    return out.select("id", F.coalesce("same", "near").alias("hit"), F.when(F.col("same").isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"))


def recency(sim: Column, ts: Column, now: Column, alpha: float = 0.85, beta: float = 0.15) -> Column:
    """alpha sim + beta exp(-age / 30 days); without a time the second part is 0."""
    age = (F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))) / F.lit(2.592e9)
    return alpha * sim + beta * F.coalesce(F.exp(-age), F.lit(0.0))


def scored(scorer) -> Column:
    """A scorer of (query, text) pairs as a column function, in Arrow batches."""

    @F.pandas_udf("double")
    def of(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), t.tolist()), dtype="float64")

    return of
