"""Quality of an index: metrics as one-row frames, their normal values, means, gates and a badge."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalecrest.functions.vectors import cosine, doubles, l2, norm

STOP = "a an and as at be but by for from in is it of on or that the this to with".split()


def clamped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def signed(x: Column) -> Column:
    """From -1 to 1 onto 0 to 1."""
    return clamped((x + 1) / 2)


def falling(x: Column) -> Column:
    return clamped(1 - x)


def banded(x: Column, low: float, high: float) -> Column:
    """1 from ``low`` to ``high``, falling evenly to 0 at 0 and at 1; 0 beyond."""
    return F.when((x <= 0) | (x >= 1), 0.0).when(x < low, x / low).when(x <= high, 1.0).otherwise((1 - x) / (1 - high))


def intrinsic(x: Column) -> Column:
    return banded(x, 0.7, 0.9)


def uniform(x: Column) -> Column:
    return banded(x, 0.7, 0.85)


def coherent(x: Column) -> Column:
    return banded(x, 0.4, 0.6)


def calibrated(mean: Column, std: Column) -> Column:
    """How near scores are to a mean of a half and a deviation of a quarter."""
    return clamped(1 - F.abs(mean - 0.5) - F.abs(std - 0.25))


def cohesion(sentences: DataFrame, chunk: str, vector: str) -> DataFrame:
    """(chunk, n, cohesion): the mean cosine of all pairs of a chunk's sentence vectors, of chunks with two or more.

    Vectors have length 1 or 0, so the sum of all products is the square of the length of their sum: no pair is made.
    """
    v = sentences.select(chunk, F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    sums = v.groupBy(chunk, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).groupBy(chunk).agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.sum("q").alias("q"))
    n = sentences.groupBy(chunk).agg(F.count("*").alias("n")).where("n > 1")
    return n.join(sums, chunk).select(chunk, "n", ((F.col("s") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))


def coherence(rows: DataFrame, order: str, vector: str) -> DataFrame:
    """A frame of one row: the mean cosine of rows that follow each other; a half for fewer than two. Meant for a sample."""
    e = rows.withColumn("_next", F.lead(vector).over(Window.orderBy(order))).where("_next is not null")
    return e.agg(F.coalesce(F.avg(cosine(F.col(vector), F.col("_next"))), F.lit(0.5)).alias("coherence"))


def breadcrumb_consistency(chunks: DataFrame, file: str, crumb: str) -> DataFrame:
    """(consistency): the mean over files of the length of what all their breadcrumbs begin with, over the longest; 1 for a file without any."""
    # all begin with what the least and the greatest of them begin with, so one pass over the chunks is enough
    own = chunks.groupBy(file).agg(F.max(F.size(crumb)).alias("longest"), F.min(crumb).alias("a"), F.max(crumb).alias("b"), F.count_if(F.col(crumb).isNull()).alias("none"))
    same = F.transform(F.arrays_zip("a", "b"), lambda x: x["a"].eqNullSafe(x["b"]))
    at = F.array_position(same, False)  # a shorter one is padded with nulls
    common = F.when(F.col("none") > 0, 0).when(at > 0, at - 1).otherwise(F.col("longest"))
    return own.agg(F.avg(F.when(F.coalesce("longest", F.lit(0)) <= 0, 1.0).otherwise(common / F.col("longest"))).alias("consistency"))


def nearest(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, d1..dk): the distances to the k nearest others. For a sample: all pairs of it are made."""
    a = rows.select(F.col(key).alias("a"), doubles(F.col(vector)).alias("x"))
    pairs = a.join(a.select(F.col("a").alias("b"), F.col("x").alias("y")), F.col("a") != F.col("b")).select("a", l2(F.col("x"), F.col("y")).alias("d"))
    w = Window.partitionBy("a").orderBy("d")
    ranked = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return ranked.groupBy(F.col("a").alias(key)).agg(*[F.max(F.when(F.col("r") == n, F.col("d"))).alias(f"d{n}") for n in range(1, k + 1)])


def uniformity(near: DataFrame, d: str = "d5") -> DataFrame:
    """(uniformity): 1 less the deviation over the mean of distances, within 0 and 1."""
    return near.agg(F.coalesce(clamped(1 - F.stddev_pop(d) / F.nullif(F.avg(d), F.lit(0.0))), F.lit(0.0)).alias("uniformity"))


def outliers(near: DataFrame, d: str = "d1") -> DataFrame:
    """(fraction): the share of distances beyond the median and three median deviations."""
    m = near.crossJoin(F.broadcast(near.agg(F.median(d).alias("m"))))
    a = m.crossJoin(F.broadcast(m.agg(F.median(F.abs(F.col(d) - F.col("m"))).alias("mad"))))
    return a.agg(F.avg((F.col(d) > F.col("m") + 3 * F.col("mad")).cast("double")).alias("fraction"))


def two_nn(near: DataFrame) -> DataFrame:
    """(dimension): -n / sum ln(d1 / d2) over rows whose nearest two are at different distances from 0."""
    r = near.where("d1 > 0 and d1 < d2")
    return r.agg((-F.count("*") / F.sum(F.log(F.col("d1") / F.col("d2")))).alias("dimension"))


def covariance(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(covariance, mean, rows) of the vectors without nulls; each partition gives one sum of products, dim^2 numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                s = x.T @ x + (0 if s is None else s)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.size)), pa.array(s.ravel())], ["at", "s"])

    got = rows.where(F.col(vector).isNotNull()).select(doubles(F.col(vector)).alias("v")).mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    m = np.array([r.s for r in got])
    d = int(round(len(m) ** 0.5))
    m = m.reshape(d, d)
    n = int(m[-1, -1]) if d else 0
    mean = m[-1, :-1] / max(n, 1)
    return m[:-1, :-1] / max(n, 1) - np.outer(mean, mean), mean, n


def spectrum(rows: DataFrame, vector: str, most: int = 64, leading: int = 32) -> tuple[float, float]:
    """(intrinsic dimension, isotropy): the share of dimensions that hold 95 % of the variance of the ``most`` leading axes; the least over the greatest of the ``leading`` eigenvalues."""
    c, _, _ = covariance(rows, vector)
    w = np.maximum(np.linalg.eigvalsh(c)[::-1], 0)
    top = w[:most]
    n = int(np.searchsorted(np.cumsum(top), 0.95 * top.sum() - 1e-12) + 1)
    lead = w[:leading]
    return n / len(w), float(lead[-1] / lead[0]) if lead[0] > 0 else 0.0


def projected(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with x and y: their places on the two principal axes. An axis points where its greatest coordinate is positive."""
    c, mean, _ = covariance(rows, vector)
    axes = np.linalg.eigh(c)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    v = doubles(F.col(vector))
    on = lambda k: F.aggregate(F.zip_with(F.zip_with(v, F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b), F.array(*map(F.lit, axes[:, k].tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    return rows.withColumn("x", on(0)).withColumn("y", on(1))


def feature_ablation(rows: DataFrame, sparse: str, vector: str) -> DataFrame:
    """(ablation, redundancy): the lesser over the greater deviation of the score and of the vector's absolute sum; |correlation| of the score and the vector's length."""
    s = F.coalesce(F.col(sparse), F.lit(0.0))
    size = F.coalesce(F.aggregate(doubles(F.col(vector)), F.lit(0.0), lambda a, x: a + F.abs(x)), F.lit(0.0))
    r = rows.select(s.alias("s"), size.alias("a"), F.coalesce(norm(F.col(vector)), F.lit(0.0)).alias("n"))
    d = r.agg(F.stddev_pop("s").alias("ds"), F.stddev_pop("a").alias("da"), F.stddev_pop("n").alias("dn"), F.covar_pop("s", "n").alias("c"))
    most = F.greatest("ds", "da")
    return d.select(F.when(most == 0, 0.0).otherwise(F.least("ds", "da") / F.nullif(most, F.lit(0.0))).alias("ablation"), F.coalesce(F.abs(F.col("c") / F.nullif(F.col("ds") * F.col("dn"), F.lit(0.0))), F.lit(0.0)).alias("redundancy"))


def reranker(scores: DataFrame, score: str, mrr: Column, baseline: Column) -> DataFrame:
    """(uplift, calibration, gap) from one row of the two MRR and all scores: the gap is the mean of the best five less that of the next twenty."""
    w = Window.orderBy(F.desc(score))
    # a limit of 25 needs no sort of all rows in one task
    top = scores.select(score).orderBy(F.desc(score)).limit(25).withColumn("_rn", F.row_number().over(w))
    gap = top.agg(F.when(F.count("*") > 5, F.greatest(F.avg(F.when(F.col("_rn") <= 5, F.col(score))) - F.avg(F.when(F.col("_rn") > 5, F.col(score))), F.lit(0.0))).otherwise(0.0).alias("gap"))
    return scores.agg(calibrated(F.avg(score), F.stddev_pop(score)).alias("calibration")).crossJoin(gap).select((mrr - baseline).alias("uplift"), "calibration", "gap")


def means(metrics: DataFrame, by: str | None = None, value: str = "value", weight: str = "weight", skipped: str = "skipped") -> DataFrame:
    """Weighted means without what is skipped; 0 if nothing is left."""
    on = ~F.col(skipped)
    w = F.sum(F.when(on, F.col(weight)))
    score = F.coalesce(F.sum(F.when(on, F.col(value) * F.col(weight))) / F.nullif(w, F.lit(0.0)), F.lit(0.0))
    g = metrics.groupBy(by) if by else metrics
    return g.agg(score.alias("score"), F.coalesce(w, F.lit(0.0)).alias("weight"), F.bool_and(F.col(skipped)).alias("skipped"))


def badge(score: Column, passed: Column) -> Column:
    """A colour for a score in whole percent; a failed run is red whatever its score."""
    percent = F.round(score * 100)
    return F.when(~passed, "red").when(percent >= 80, "brightgreen").when(percent >= 70, "green").when(percent >= 55, "yellow").otherwise("orange")
