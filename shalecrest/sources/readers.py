"""Sources and sinks: files, revisions, judgements, logs, run history."""

from __future__ import annotations

import json
import re
import os
import subprocess
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shalecrest.functions.text import glob_regex
from shalecrest.operators.index import diff, pruned
from shalecrest.operators.rules import owners


def files(spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """(path, revision, content): all files below root, by path relative to it, with the SHA-256 of their content.

    A path is left out if any of ``exclude`` matches, or if ``include`` is given and none of it does. Files
    without content have no row, as Spark's reader passes over them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # Spark gives paths of the local disk with a scheme, whether root has one or not
    rel = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(re.sub("^file:/+", "/", root).rstrip("/")) + 2, 1 << 30)
    out = raw.select(rel.alias("path"), F.sha2("content", 256).alias("revision"), "content")
    for g in exclude or []:
        out = out.where(~F.col("path").rlike(glob_regex(g)))
    if include:
        hit = F.lit(False)
        for g in include:
            hit = hit | F.col("path").rlike(glob_regex(g))
        out = out.where(hit)
    return out


def manifest(files_: DataFrame) -> DataFrame:
    """(hash): one hash of all paths and revisions, whatever their order."""
    return files_.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "revision"))), "\n"), 256).alias("hash"))


def byte_range(content, start: int, end: int):
    """Bytes start to end, the latter exclusive, as far as there are any."""
    return F.substring(content, start + 1, max(0, end - start))


def git_blob_sha(content):
    """The id that git gives to this content."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.unhex(F.lit("00")), content))


class GitTree(DataSource):
    """The files of a commit: spark.read.format("git_tree").option("repo", ..).option("revision", "HEAD")."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, revision string, bytes long"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.revision = options.get("repo", "."), options.get("revision", "HEAD")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        out = subprocess.run(["git", "-c", "safe.directory=*", "-C", self.repo, "ls-tree", "-r", "-l", "-z", self.revision], capture_output=True, check=True).stdout
        for line in out.split(b"\0"):
            if line:
                meta, path = line.split(b"\t", 1)
                _, kind, sha, size = meta.split()
                if kind == b"blob":
                    yield path.decode("utf-8", "replace"), sha.decode(), int(size)


def trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) from lines "query 0 document relevance"; lines of another form are left out."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(p) >= 4).select(p[0].alias("query_id"), p[2].alias("doc_id"), F.expr("try_cast(split(trim(value), '\\\\s+')[3] as int)").alias("rel")).where("rel is not null")


def json_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, doc_id, rel) from {"queries": [{"id", "query", "qrels": [{"docId", "relevance"}]}]}."""
    schema = "queries array<struct<id: string, query: string, qrels: array<struct<docId: string, relevance: int>>>>"
    q = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("queries").alias("q"))
    return q.select("q.id", "q.query", F.explode("q.qrels").alias("r")).select(F.col("id").alias("query_id"), "query", F.col("r.docId").alias("doc_id"), F.col("r.relevance").alias("rel"))


def session_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tsv_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) from lines of an id, a tab and a text."""
    p = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(p) == 2).select(p[0].alias("query_id"), p[1].alias("query"))


def judged_queries(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, doc_id, rel) of the queries that have a relevant document."""
    some = qrels.where("rel > 0").select("query_id").distinct()
    return qrels.join(some, "query_id", "left_semi").join(queries, "query_id").select("query_id", "query", "doc_id", "rel")


_DATASET = "version string, queries array<struct<query: string, expectedChunkIds: array<string>, expectedContent: array<string>, groundTruth: string>>"


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """(query, expectedChunkIds, expectedContent, groundTruth) of an evaluation dataset, one JSON document."""
    return spark.read.schema(_DATASET).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")


def write_dataset(queries: DataFrame, path: str, version: str = "1") -> None:
    """One JSON document; a dataset is as small as the people who make it."""
    queries.agg(F.collect_list(F.struct(*queries.columns)).alias("queries")).select(F.lit(version).alias("version"), "queries").coalesce(1).write.json(path)


_CHUNK = "denseTextHash string, denseText string, sparseText string, embedding array<double>, sourceFile string"


def chunk_file(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON documents that are a bare array, as they once were, or hold one in "chunks"."""
    whole = spark.read.text(path, wholetext=True).select("value")
    old = F.from_json("value", f"array<struct<{_typed(_CHUNK)}>>")
    new = F.from_json("value", f"struct<chunks: array<struct<{_typed(_CHUNK)}>>>")
    bare = F.ltrim("value").startswith("[")
    return whole.select(F.explode(F.when(bare, old).otherwise(new["chunks"])).alias("c")).select("c.*")


def _typed(schema: str) -> str:
    return ", ".join(": ".join(f.split(" ", 1)) for f in schema.split(", "))


class PagedSource(DataSource):
    """Rows of JSON pages {"rows": [..]}, in the order of a cursor: spark.read.format("paged_rows").option("pages", ..).schema(..). A folder's files stand for the pages of a service."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options, schema)


class _PagedReader(DataSourceReader):
    def __init__(self, options, schema):
        self.pages, self.names = json.loads(options["pages"]), schema.names

    def partitions(self):
        return [InputPartition(p) for p in self.pages] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            for row in json.loads(partition.value).get("rows", []):
                yield tuple(row.get(n) for n in self.names)


def paged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all pages in a folder, a partition a page."""
    spark.dataSource.register(PagedSource)
    pages = [r.value for r in spark.read.text(path).select("value").toLocalIterator()]
    return spark.read.format("paged_rows").schema(schema).option("pages", json.dumps(pages)).load()


class Source(Protocol):
    """Where files come from."""

    def revision(self) -> str:
        """What names the state of all files."""

    def files(self) -> DataFrame:
        """(path, revision): all files."""

    def changed_since(self, revision: str) -> DataFrame:
        """(path, status): added, modified and deleted files."""

    def read(self, path: str, start: int = 0, end: int | None = None) -> bytes:
        """A file's bytes from start to end, as far as there are any."""


class Folder:
    """The files below a folder; their revisions are hashes of their contents."""

    def __init__(self, spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None):
        self.spark, self.root, self.exclude, self.include = spark, root.rstrip("/"), exclude, include

    def files(self) -> DataFrame:
        return files(self.spark, self.root, self.exclude, self.include).select("path", "revision")

    def revision(self) -> str:
        """A hash of all paths and times of change."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root).select("path", F.unix_millis("modificationTime").alias("revision"))
        return manifest(raw).first().hash

    def changed_since(self, known: DataFrame) -> DataFrame:
        """Against the (path, revision) of an earlier state."""
        return statuses(diff(self.files(), known, "path", "revision"), "path")

    def read(self, path: str, start: int = 0, end: int | None = None) -> bytes:
        row = self.spark.read.format("binaryFile").load(f"{self.root}/{path}").select(byte_range(F.col("content"), start, 1 << 30 if end is None else end).alias("b")).first()
        return bytes(row.b)


def statuses(changes: DataFrame, key: str) -> DataFrame:
    """(key, status): what a diff found, in a source's words, without what is as it was."""
    names = {"new": "added", "changed": "modified", "deleted": "deleted"}
    return changes.where("status <> 'unchanged'").select(key, F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("status")).alias("status"))


class Repository:
    """The files of a git repository at a branch or commit; owners by CODEOWNERS are their tags. Run on the driver, as a repository is on one machine."""

    def __init__(self, spark: SparkSession, repo: str, branch: str = "HEAD", dirty: bool = True):
        spark.dataSource.register(GitTree)
        self.spark, self.repo, self.branch, self.dirty = spark, repo, branch, dirty

    def _git(self, *args: str) -> bytes:
        return subprocess.run(["git", "-c", "safe.directory=*", "-C", self.repo, *args], capture_output=True, check=True).stdout

    def revision(self) -> str:
        return self._git("rev-parse", self.branch).decode().strip()

    def tree(self, revision: str | None = None) -> DataFrame:
        return self.spark.read.format("git_tree").option("repo", self.repo).option("revision", revision or self.branch).load()

    def files(self) -> DataFrame:
        """Committed files with their blobs' ids; of files that differ in the working copy, or aren't committed, the id that their content has."""
        committed = self.tree().select("path", "revision")
        if not self.dirty or self.branch != "HEAD":
            return committed
        changed = []
        for line in self._git("status", "--porcelain", "-z", "--untracked-files=all", "--no-renames").split(b"\0"):
            if line:
                path = line[3:].decode("utf-8", "replace")
                there = os.path.isfile(os.path.join(self.repo, path))
                changed.append((path, self._git("hash-object", "--", path).decode().strip() if there else None))
        if not changed:
            return committed
        own = self.spark.createDataFrame(changed, "path string, own string")
        return committed.join(own.withColumn("seen", F.lit(True)), "path", "full_outer").select("path", F.when(F.col("seen"), F.col("own")).otherwise(F.col("revision")).alias("revision")).where("revision is not null")

    def tagged(self) -> DataFrame:
        """(path, revision, owners) by the last matching line of CODEOWNERS."""
        for name in ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS"):
            got = subprocess.run(["git", "-c", "safe.directory=*", "-C", self.repo, "show", f"{self.branch}:{name}"], capture_output=True)
            if got.returncode == 0:
                lines = [x.split() for x in got.stdout.decode("utf-8", "replace").splitlines() if x.strip() and not x.lstrip().startswith("#")]
                return owners(self.files(), [(p, who) for p, *who in lines if who])
        return owners(self.files(), [])

    def changed_since(self, revision: str) -> DataFrame:
        return statuses(diff(self.tree().select("path", "revision"), self.tree(revision).select("path", "revision"), "path", "revision"), "path")

    def read(self, path: str, start: int = 0, end: int | None = None) -> bytes:
        return self._git("show", f"{self.branch}:{path}")[start:end]


class History:
    """Runs by kind in a folder of Parquet: appended, listed newest first, pruned to the newest of each kind."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 100):
        self.spark, self.path, self.keep = spark, path, keep

    def save(self, runs: DataFrame) -> None:
        runs.write.mode("append").partitionBy("kind").parquet(self.path)

    def prune(self) -> None:
        """Keep the newest of each kind only; the rest of the folder is replaced."""
        kept = f"{self.path}-{uuid.uuid4().hex}"
        self.list().write.parquet(kept)
        self.spark.read.parquet(kept).write.mode("overwrite").partitionBy("kind").parquet(self.path)

    def list(self, kind: str | None = None) -> DataFrame:
        runs = self.spark.read.parquet(self.path)
        if kind is not None:
            runs = runs.where(F.col("kind") == kind)
        return pruned(runs, "kind", "id", self.keep).orderBy("kind", F.desc("id"))

    def newest(self, where: Column | None = None) -> DataFrame:
        """The newest run of each kind, of those that meet a condition."""
        runs = self.list() if where is None else self.list().where(where)
        return pruned(runs, "kind", "id", 1)

    def latest(self, kind: str, where: Column | None = None):
        return self.newest(where).where(F.col("kind") == kind).first()

    def resolve(self, kind: str, ref: str):
        """The run that a reference names: "latest", "latest~n" for the n-th before it, or an id."""
        if ref == "latest" or ref.startswith("latest~"):
            back = int(ref.partition("~")[2] or 0)
            got = self.list(kind).offset(back).limit(1).collect()
            return got[0] if got else None
        return self.list(kind).where(F.col("id").cast("string") == ref).first()
