"""Telemetry: percentiles, buckets, redundancy, rates, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalecrest.functions.vectors import cosine


def percentiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(by, n, ...): of each group's sorted values the one at floor(p n), at most the last; no interpolation, nulls don't count.

    Equal values are counted first, and running counts are made of what is left, so a group's rows don't meet in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy("_v")
    run = counts.select(*by, "_v", F.sum("_c").over(w).alias("_to"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    rank = lambda p: F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    return run.groupBy(*by, "n").agg(*[F.min(F.when(F.col("_to") > rank(p), F.col("_v"))).alias(name) for name, p in at.items()])


def count_bucket(n: Column) -> Column:
    """How many results a search had, in five classes."""
    return F.when(n == 0, "0").when(n <= 3, "1-3").when(n <= 10, "4-10").when(n <= 20, "11-20").otherwise("20+")


def redundant(searches: DataFrame, session: str, key: str, vector: str, seconds: int = 300, threshold: float = 0.8) -> DataFrame:
    """(key): searches with an earlier one of the session, up to five minutes before, of a cosine above the threshold.

    Rows meet those of their own slice of time and the one before, not of the whole session.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    step = seconds * 1_000_000
    b = searches.select(session, F.col(key).alias("k"), t.alias("t"), F.col(vector).alias("v"), F.floor(t / step).alias("slice"))
    a = b.select(session, F.col("k").alias("k0"), F.col("t").alias("t0"), F.col("v").alias("v0"), F.explode(F.array(F.col("slice"), F.col("slice") + 1)).alias("slice"))
    earlier = (F.col("t0") < F.col("t")) | ((F.col("t0") == F.col("t")) & (F.col("k0") < F.col("k")))
    pairs = b.join(a, [session, "slice"]).where(earlier & (F.col("t") - F.col("t0") <= step))
    return pairs.where(cosine(F.col("v"), F.col("v0")) > threshold).select(F.col("k").alias(key)).distinct()


def feedback_sample(searches: DataFrame, session: str, key: str, results: Column, sixteenths: int, most: int) -> DataFrame:
    """Searches to ask about: those with none or over ten results, and of others so many sixteenths, by the MD5 of the key; the first ``most`` of a session."""
    drawn = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 1), 16, 10).cast("int") < sixteenths
    w = Window.partitionBy(session).orderBy("ts", key)
    return searches.where((results == 0) | (results > 10) | drawn).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def unflushed(rows: DataFrame, flushed: DataFrame, key: str, now: Column, age: str) -> DataFrame:
    """Rows to send again: not yet flushed, and not older than ``age``."""
    return rows.where(F.col("ts") >= now - F.expr(f"interval {age}")).join(flushed.select(key), key, "left_anti")


def first_entries(rows: DataFrame, request: str, key: str, order: list[str]) -> DataFrame:
    """The first row of each request; rows without one all stay."""
    w = Window.partitionBy(request).orderBy(*order)
    own = rows.where(F.col(request).isNull())
    return rows.where(F.col(request).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").unionByName(own)


def throughput(runs: DataFrame, what: list[str], seconds: str, order: str, gate: float = 0.20) -> DataFrame:
    """(order, *_s, regression, passed): rates with times of a millisecond at least, the drop of the first against the run before, and whether it is within the gate. A row a run."""
    s = F.greatest(F.col(seconds), F.lit(0.001))
    r = runs.select(order, *[(F.col(x) / s).alias(f"{x}_s") for x in what])
    before = F.lag(f"{what[0]}_s").over(Window.orderBy(order))
    return r.withColumn("regression", (before - F.col(f"{what[0]}_s")) / before).withColumn("passed", F.coalesce(F.col("regression") <= gate, F.lit(True)))


def health(tables: DataFrame, live: Column, dead: Column, hours: Column, lists: Column, large: int = 100_000) -> DataFrame:
    """``tables`` with dead_share, hours since the last cleaning, and advice as a sum: 1 to build the index anew, 2 to use a graph instead of lists, 4 to clean."""
    n = live + dead
    share = F.when(n > 0, dead / n).otherwise(0.0)
    advice = F.when(share > 0.1, 1).otherwise(0) + F.when(lists & (n > large), 2).otherwise(0) + F.when(hours > 168, 4).otherwise(0)
    return tables.select("*", share.alias("dead_share"), hours.alias("hours"), advice.alias("advice"))


def expanded(queries: DataFrame, mean: str, calls: str, most: int = 10) -> DataFrame:
    """A row for each call of a query, ``most`` at most."""
    return queries.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.least(F.col(calls), F.lit(most)).cast("int")))).drop("_n")


#: A number of the text format of metrics, with an exponent of either case.
_NUMBER = r"(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?Inf|NaN)"


def metric_means(texts: DataFrame, text: str, name: str) -> DataFrame:
    """(series, n, mean): of each series of a text of metrics its sum over its count, where that is above 0."""
    values = lambda what: texts.select(F.explode(F.regexp_extract_all(text, F.lit(rf"(?m)^{name}_{what}(\{{[^}}]*\}}\s+{_NUMBER})"), F.lit(1))).alias("x")).select(F.regexp_extract("x", r"^(\{[^}]*\})", 1).alias("series"), F.regexp_extract("x", rf"\s({_NUMBER})$", 1).cast("double").alias(what))
    return values("sum").join(values("count"), "series").where("count > 0").select("series", F.col("count").alias("n"), (F.col("sum") / F.col("count")).alias("mean"))


def token_efficiency(got: DataFrame, sizes: DataFrame, query: str, file: str) -> DataFrame:
    """(query, used, whole, saved, percent): tokens of answers against those of the distinct files that they are from, and a total, of query -1."""
    used = got.groupBy(query).agg(F.sum("used").alias("used"))
    whole = got.select(query, file).distinct().join(sizes, file).groupBy(query).agg(F.sum("whole").alias("whole"))
    g = F.grouping(query)
    out = used.join(whole, query).rollup(query).agg(F.sum("used").alias("used"), F.sum("whole").alias("whole"), g.alias("_g"))
    out = out.withColumn(query, F.when(F.col("_g") == 1, -1).otherwise(F.col(query))).drop("_g")
    return out.withColumn("saved", F.col("whole") - F.col("used")).withColumn("percent", F.round(100 * F.col("saved") / F.col("whole"), 6))


def query_matrix(best: DataFrame, config: str, query: str, sim: str, relevant: Column, floor: float = 0.70, margin: float = 0.15) -> DataFrame:
    """(config, query, passed): a query that must find something has a similarity of ``floor``; one that mustn't stays ``margin`` below the best of those that must."""
    top = best.where(relevant).groupBy(config).agg(F.max(sim).alias("_best"))
    return best.join(top, config).select(config, query, F.when(relevant, F.col(sim) >= floor).otherwise(F.round(F.col("_best") - F.col(sim), 9) >= margin).alias("passed"))
