"""A warm engine: search, browse, lists and counts over a stored index, by calls or by lines of JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalecrest.functions.text import checked_tags, shortened, toon_cell
from shalecrest.operators import search
from shalecrest.operators.embedding import Embedder, HashingEmbedder
from shalecrest.operators.index import Store


class Engine:
    """Answers questions about one index: rows of id, text, file, tags and vector.

    score, if given, reranks (query, text) pairs; then five times as many rows are fetched as are asked for.
    """

    def __init__(self, store: Store, embedder: Embedder | None = None, score: Callable[[list[str], list[str]], list[float]] | None = None):
        self.store, self.embedder, self.score = store, embedder or HashingEmbedder(), score

    def search(self, query: str, k: int = 10, offset: int = 0, tags: list[str] | None = None, least: float | None = None, full: bool = False) -> DataFrame:
        """(id, text, file, similarity, rank): filtered by tags before the ranking, by similarity after it, then paged."""
        rows = self.store.read()
        if tags:
            rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, checked_tags(tags)))))
        spark = rows.sparkSession
        asked = spark.createDataFrame([(0, self.embedder.embed([query])[0].tolist())], "n long, vector array<double>")
        numbered = rows.withColumn("n", F.xxhash64("id"))
        found = search.knn(asked, numbered.select("n", "vector"), (offset + k) * (5 if self.score else 1), "n", "vector", exclude_self=False)
        if self.score:
            of = search.scored(self.score)
            with_text = found.join(numbered.select(F.col("n").alias("id"), "text"), "id").withColumn("_new", of(F.lit(query), F.col("text")))
            found = search.rerank(with_text, F.col("_new"), offset + k)
        page = search.page(found, offset, k, least).select(F.col("id").alias("n"), "similarity", "rank")
        text = F.col("text") if full else shortened(F.col("text"), 800)
        return page.join(numbered, "n").select("id", text.alias("text"), "file", "similarity", "rank").orderBy("rank")

    def browse(self, path: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """(id, file, text) by file and id, of files whose path has a part, whatever its case."""
        rows = self.store.read(["id", "file", "text"])
        if path:
            rows = rows.where(F.contains(F.lower("file"), F.lit(path.lower())))
        return rows.orderBy("file", "id").offset(offset).limit(min(limit, 200))

    def chunk(self, key: str) -> DataFrame:
        return self.store.read(["id", "file", "text"]).where(F.col("id") == key)

    def list_files(self) -> DataFrame:
        return self.store.read(["file"]).groupBy("file").agg(F.count("*").alias("chunks"))

    def stats(self) -> DataFrame:
        return self.store.read(["id", "file"]).agg(F.count("*").alias("chunks"), F.count_distinct("file").alias("files"))

    def answer(self, line: str) -> str:
        """One request {"op": .., arguments} as one line of JSON; what goes wrong is said in "error"."""
        try:
            request = json.loads(line)
            op = request.pop("op", "search")
            if op not in ("search", "browse", "chunk", "list_files", "stats"):
                raise ValueError(f"no operation {op!r}")
            return json.dumps({"rows": [r.asDict(recursive=True) for r in getattr(self, op)(**request).collect()]})
        except Exception as e:  # noqa: BLE001 - a bad request must not end the service
            return json.dumps({"error": f"{type(e).__name__}: {e}"})

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        """Answers to lines as they come, on the session that is there already."""
        yield from (self.answer(line) for line in lines if line.strip())


def toon(name: str, rows: DataFrame) -> str:
    """Rows of an answer as a TOON table."""
    cells = rows.select(*[toon_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns]).collect()
    return f"{name}[{len(cells)}]{{{','.join(rows.columns)}}}:\n" + "".join(f"  {','.join(r)}\n" for r in cells)
