"""Event streams: windows with a watermark, sessions, redundancy within five minutes, incremental indexing."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema)
    if os.path.isfile(path.removeprefix("file://")):
        folder, name = os.path.split(path)
        return raw.option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return raw.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums a window; events later than the watermark are left out."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", every), by)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), by, "n", "total")


def sliding(events: DataFrame, size: str = "24 hours", step: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.end").alias("at"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def redundant(searches: DataFrame, minutes: int = 5, threshold: float = 0.8, groups: int = 1024) -> DataFrame:
    """(session, id, redundant): whether an earlier search of the session, up to five minutes before, has a cosine above the threshold.

    searches: a stream of session, id, ts and vector. A session's state is its searches of the last five minutes of event time; it is dropped when the
    watermark has passed them. Within a batch rows are taken in the order of time. Sessions are held and compared together, in ``groups``: a call for
    each of many short sessions takes far longer than its comparisons.
    """
    span = 60_000_000 * minutes
    held_as = {"session": "int64", "none": bool, "at": "int64", "vector": object}

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["at", "id"])
        held = json.loads(state.get[0]) if state.exists else []
        every = rows[list(held_as)]
        if held:
            every = pd.concat([pd.DataFrame(held, columns=list(held_as)).astype(held_as), every], ignore_index=True)
        of = every.groupby(["session", "none"], sort=False).ngroup().to_numpy()
        at = every["at"].to_numpy()
        near = _near(of, at, np.arange(len(every)) >= len(held), every["vector"], span, threshold)[len(held) :]
        yield pd.DataFrame({"session": rows["session"].astype("Int64").mask(rows["none"]).to_numpy(object, na_value=None), "id": rows["id"].to_numpy(), "redundant": near})
        last = np.zeros(of.max() + 1, np.int64)
        last[of] = at  # each session's last row
        passed = state.getCurrentWatermarkMs()
        kept = every[(at >= last[of] - span) & (at >= 1000 * passed - span)]
        state.update((json.dumps([[*r[:3], np.asarray(r[3], float).tolist()] for r in zip(*(kept[c].tolist() for c in held_as), strict=True)]),))
        state.setTimeoutTimestamp(max(int(at.max()) // 1000, passed) + span // 1000 + 1)

    session = F.col("session").cast("long")
    rows = searches.withWatermark("ts", LATE).select(F.coalesce(session, F.lit(0)).alias("session"), session.isNull().alias("none"), "id", "ts", F.unix_micros("ts").alias("at"), "vector")
    return rows.withColumn("by", F.pmod(F.xxhash64("session"), F.lit(groups))).groupBy("by").applyInPandasWithState(update, "session long, id long, redundant boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def _near(of: np.ndarray, at: np.ndarray, new: np.ndarray, vectors: pd.Series, span: int, threshold: float) -> np.ndarray:
    """Which new rows have a cosine above the threshold with a row of the same ``of``, held or new and before them, whose ``at`` is up to ``span`` less.

    A pass compares all rows that are still open with one row each, so passes are as many as rows in the fullest span.
    """
    near = np.zeros(len(of), bool)
    x = [np.atleast_1d(np.asarray(v, float)) for v in vectors]
    sizes = np.array([len(v) for v in x])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        own = own[np.lexsort((own, at[own], new[own], of[own]))]  # of each session the held rows by time, then the new ones
        m = np.concatenate([x[k] for k in own]).reshape(len(own), size)
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        o, t, n = of[own], at[own], new[own]
        opened = np.flatnonzero(n)
        begins = np.flatnonzero(n & np.r_[True, (o[1:] != o[:-1]) | ~n[:-1]])  # each session's first new row
        for fresh in (True, False):
            i = opened[~near[own[opened]]]
            j = (i if fresh else begins[np.searchsorted(begins, i, "right") - 1]) - 1
            while len(i):
                there = (j >= 0) & (o[j] == o[i]) & (n[j] == fresh) & (t[j] >= t[i] - span)
                i, j = i[there], j[there]
                product = norm[i] * norm[j]
                hit = np.einsum("ij,ij->i", m[i], m[j]) > threshold * product
                hit &= product > 0
                near[own[i[hit]]] = True
                i, j = i[~hit], j[~hit] - 1
    return near


def watched(files: DataFrame, apply: Callable[[DataFrame], None], state: str, every: str | None = None):
    """A query that calls ``apply`` with what is new of a stream of files, in batches; ``every`` is the least time between two, else all there is now is taken."""
    w = files.writeStream.option("checkpointLocation", state).foreachBatch(lambda batch, _: apply(batch))
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine."""
    given = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        given = tempfile.mkdtemp(prefix="shalecrest-")
        spark.sparkContext.setCheckpointDir(given)
    return given


def drained(result: DataFrame, mode: str = "append") -> DataFrame:
    """What a streaming query gives over all data there is now, as a table in the shared folder.

    In append mode a window is given once the watermark has passed it, and rows that are later than that are left out. The last
    windows have no successor to close them: they are given with ``mode`` complete or update, the latest state of each.
    """
    spark = result.sparkSession
    base = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def store(batch: DataFrame, epoch: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)  # each batch is the whole result so far
        else:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # the same files if the batch is run again

    q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out).select(*result.columns)
