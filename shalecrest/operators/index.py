"""Keeping an index: what changed, what to delete, upsert, guards."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shalecrest.streaming.events import shared


def diff(current: DataFrame, known: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, status): new, changed, unchanged or deleted; a null revision equals only another null."""
    a = current.select(F.col(key).alias("k"), F.col(revision).alias("a"), F.lit(True).alias("here"))
    b = known.select(F.col(key).alias("k"), F.col(revision).alias("b"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), status.alias("status"))


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in the given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The base with the new rows in place of those of the same key, and the others added."""
    return base.join(new, key, "left_anti").unionByName(new)


def insert_or_ignore(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return base.unionByName(new.join(base, key, "left_anti"))


def orphans(stored: DataFrame, keep: DataFrame, file: str, key: str) -> DataFrame:
    """Stored rows of the files in ``keep`` whose key isn't kept for that file."""
    return stored.join(keep.select(file).distinct(), file, "left_semi").join(keep, [file, key], "left_anti")


def guard(deleted: int, current: int, force: bool = False) -> None:
    """Refuses to delete ten or more files that are half of all or more, unless forced."""
    if not force and deleted >= 10 and 2 * deleted >= current:
        raise RuntimeError(f"would delete {deleted} of {current} files")


def pruned(rows: DataFrame, kind: str, order: str, keep: int) -> DataFrame:
    """The newest rows of each kind."""
    w = Window.partitionBy(kind).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def to_embed(current: DataFrame, stored: DataFrame, file: str, key: str) -> DataFrame:
    """Rows of ``current`` to embed: none of a file whose set of keys is what is stored of it, and of others those stored nowhere."""
    a = current.select(file, key).distinct().withColumn("a", F.lit(True))
    b = stored.select(file, key).distinct().withColumn("b", F.lit(True))
    changed = a.join(b, [file, key], "full_outer").where("a is null or b is null").select(file).distinct()
    return current.join(changed, file, "left_semi").join(stored.select(key).distinct(), key, "left_anti")


def without_sources(rows: DataFrame, gone: DataFrame, file: str) -> DataFrame:
    """Rows but those of the files in ``gone``, by their bare paths."""
    return rows.join(gone.select(file).distinct(), file, "left_anti")


def replaced(stored: DataFrame, new: DataFrame, file: str, key: str) -> DataFrame:
    """``stored`` with the rows of each file in ``new`` replaced by its new ones; other files stay as they are."""
    own = new.withColumn("_rn", F.row_number().over(Window.partitionBy(file, key).orderBy(*new.columns))).where("_rn = 1").drop("_rn")
    return without_sources(stored, new, file).unionByName(own)


def merged_states(store: DataFrame, files: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, revision) of both; where both know a key, the store's."""
    a = store.select(key, F.col(revision).alias("a"))
    return a.join(files.select(key, F.col(revision).alias("b")), key, "full_outer").select(key, F.coalesce("a", "b").alias(revision))


def links_found(chunks: DataFrame, key: str = "id", links: tuple[str, ...] = ("prev", "next")) -> DataFrame:
    """(links, found): how many links chunks have, and how many of them are ids of chunks."""
    each = chunks.select(F.explode(F.array_compact(F.array(*links))).alias("to"))
    ids = chunks.select(F.col(key).alias("to")).distinct().withColumn("there", F.lit(1))
    return each.join(ids, "to", "left").agg(F.count("*").alias("links"), F.count("there").alias("found"))


def rebuild_needed(known: dict | None, model: str, dimensions: int) -> bool:
    """Whether what is stored was made by another model or has other dimensions, so that all of it must be made anew."""
    return known is not None and (known["model"], known["dimensions"]) != (model, dimensions)


def dry_run(current: DataFrame, known: DataFrame, key: str, revision: str) -> DataFrame:
    """(status, n): what an update would do, without doing it."""
    return diff(current, known, key, revision).groupBy("status").agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, order: list[Column], size: Column | None = None) -> DataFrame:
    """``rows`` with _rn, their place in the order from 1 on, and _sum, the sizes up to there.

    Rows are sorted in ranges, which lie in the shared folder; only the ranges' counts go to the driver, so no task has all rows.
    """
    spark = rows.sparkSession
    path = f"{shared(spark)}/ranges-{uuid.uuid4().hex}"
    rows.withColumn("_size", F.lit(1) if size is None else size).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    n = total = 0
    before = []
    for p, k, held in parts.groupBy("_p").agg(F.count("*"), F.sum("_size")).orderBy("_p").collect():
        before.append((p, n, total))
        n, total = n + k, total + (held or 0)
    w = Window.partitionBy("_p").orderBy(*order)
    own = parts.join(F.broadcast(spark.createDataFrame(before, "_p int, _n long, _t long")), "_p")
    return own.select(*rows.columns, (F.row_number().over(w) + F.col("_n")).alias("_rn"), (F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_t")).alias("_sum"))


def sampled(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows evenly over the order of ``key``: those at floor(i len / n). All if there are no more."""
    size = rows.count()
    if size <= n:
        return rows
    return numbered(rows, [F.col(key)]).where(F.col("_rn").isin([i * size // n + 1 for i in range(n)])).drop("_rn", "_sum")


def over_budget(rows: DataFrame, size: Column, order: list[Column], budget: int, step: int = 1000) -> DataFrame:
    """Rows without the oldest: as many steps of ``step`` rows as it takes for the rest to be within ``budget`` bytes."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= budget:
        return rows
    n = numbered(rows, order, size)
    first = n.where(F.col("_sum") >= total - budget).agg(F.min("_rn")).first()[0]
    return n.where(F.col("_rn") > -(-first // step) * step).drop("_rn", "_sum")


class Store:
    """An index as Parquet: versions in folders, of which a pointer names the current one, so that readers never see half of a write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def meta(self) -> dict | None:
        """Model, dimensions and version; null before the first write."""
        fs, path = self._files()
        if not fs.exists(path(f"{self.path}/current")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/current").orderBy(F.desc("value")).first()[0])

    def read(self, columns: list[str] | None = None) -> DataFrame:
        """All rows, or some of their columns: without the vectors the scan doesn't touch them."""
        rows = self.spark.read.parquet(f"{self.path}/{self.meta()['version']}")
        return rows.select(*columns) if columns else rows

    def page(self, columns: list[str], key: str, limit: int, offset: int = 0) -> DataFrame:
        return self.read(columns).orderBy(key).offset(offset).limit(limit)

    def write(self, rows: DataFrame, model: str, dimensions: int) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        fs, path = self._files()
        said = json.dumps({"model": model, "dimensions": dimensions, "version": version})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{self.path}/next-{version}")
        fs.delete(path(f"{self.path}/current"), True)
        fs.rename(path(f"{self.path}/next-{version}"), path(f"{self.path}/current"))

    def upsert(self, new: DataFrame, key: str, model: str, dimensions: int) -> None:
        """New rows in place of those of the same key; of another model or dimensions nothing stays."""
        known = self.meta()
        fresh = known is None or rebuild_needed(known, model, dimensions)
        self.write(new if fresh else upsert(self.read(), new, key), model, dimensions)

    def replace(self, new: DataFrame, file: str, key: str) -> None:
        known = self.meta()
        self.write(replaced(self.read(), new, file, key), known["model"], known["dimensions"])

    def delete_sources(self, gone: DataFrame, file: str) -> None:
        known = self.meta()
        self.write(without_sources(self.read(), gone, file), known["model"], known["dimensions"])
