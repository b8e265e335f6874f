"""The corpus pipeline: quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), and what it returns is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shalecrest.llm import packing, pii, quality, simhash
from shalecrest.llm.common import col, shared, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half; others go.

    All rows count, repeated ones each. On a null or empty text all rules abstain, so it has the quality of the prior and mostly
    stays; null ids and other columns stay as they are. An empty table gives an empty one.
    """
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id. Of rows that repeat an id, one of the least text stays.

    Documents with a null id, or without words (null and empty texts too), are never duplicates and stay. Equal texts are one
    group whatever their ids; other columns go with their row, and decide among rows of one id with one text. An empty table gives an
    empty one.
    """
    gone = simhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rest = docs.join(gone, docs.doc_id == gone._gone, "left_anti")
    again = rest.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    if again.isEmpty():
        return rest
    others = [col(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.col("text"), *([F.to_json(F.struct(*others))] if others else [])]  # columns of any type can be told apart so
    one = rest.join(again, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("_nth = 1").select(*map(col, docs.columns))
    return rest.join(again, "doc_id", "left_anti").select(*map(col, docs.columns)).unionByName(one)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their labels, and n_chars counted anew.

    Null texts stay null with their n_chars, empty ones empty; repeated rows give repeated results; ids and other columns
    stay as they are. An empty table gives an empty one.
    """
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packs of token ids, with the documents that their pieces are from.

    Null and empty texts are pieces without tokens, repeated rows are all packed, an empty table gives no packs; columns besides
    id and text aren't read.
    """
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", private), ("packing", packed)]

#: The label model, fingerprints and Hilbert keys aren't SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what lies between them is in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
