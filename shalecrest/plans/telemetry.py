"""Telemetry: latencies, sessions, searches, tokens, streams."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from shalecrest.functions.text import chunk_id, nearest_rank, token_estimate
from shalecrest.operators import embedding, evaluation, index, telemetry
from shalecrest.plans.corpus import _PARTS, lines
from shalecrest.plans.registry import query
from shalecrest.plans.retrieval import SKILLS, routed
from shalecrest.plans.store import place
from shalecrest.sources import readers
from shalecrest.streaming import events as streams


_HOURLY = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query("a18_hourly", _HOURLY)
def _(t):
    return t("events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _stream(t):
    """The events as a stream of all files of their table."""
    e = t("events")
    files = e.inputFiles()
    folder = files[0].removeprefix("file://").rsplit("/", 1)[0]
    return streams.stream(e.sparkSession, files[0].removeprefix("file://") if len(files) == 1 else folder)


@query("t4_t9_streaming_hourly", _HOURLY + " HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def _(t):
    # append mode: hours that the watermark has passed
    return streams.drained(streams.tumbling(_stream(t)).withColumn("total", F.round("total", 4)))


@query("t5_rolling_day", "SELECT CAST(h AS TIMESTAMP) AS at, count(*) AS n FROM (SELECT ts, unnest(generate_series(1, 24)) AS k FROM events) x, LATERAL (SELECT date_trunc('hour', ts) + k * INTERVAL 1 HOUR AS h) y GROUP BY h")
def _(t):
    return streams.sliding(t("events"))


@query("t6_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    return streams.sessions(t("events"))


@query("j17_asof_attribution", """SELECT event_id, coalesce(v, -1) AS view_id FROM (SELECT p.event_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts) AS v FROM events p WHERE p.event_type = 'purchase')""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = t("events").where("event_type in ('view', 'purchase')")
    return e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query("f5_metadata_filter", "SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 3 AND event_type = 'click'")
def _(t):
    return t("events").where((F.get_json_object("props", "$.k").cast("int") == 3) & (F.col("event_type") == "click")).select("event_id", "user_id")


@query("a30_status_counts", "SELECT count(*) AS total, count(l.doc_id) AS embedded, count(*) FILTER (l.quality = 1) AS uploaded, count(*) - count(l.doc_id) AS pending FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    j = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return j.agg(F.count("*").alias("total"), F.count_if(F.col("quality").isNotNull()).alias("embedded"), F.count_if(F.col("quality") == 1).alias("uploaded"), F.count_if(F.col("quality").isNull()).alias("pending"))


@query("a34_cube_distinct", """SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def _(t):
    c = t("lineitem").cube("l_returnflag", "l_linestatus")
    return c.agg(F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.grouping_id().cast("long").alias("level"))


@query("o5_set_operations", "SELECT c_nationkey AS k, 'both' AS kind FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey, 'customers' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def _(t):
    c, s = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(c.distinct().exceptAll(s.distinct()).withColumn("kind", F.lit("customers")))


_RANK = "v[CAST(least(floor({} * n), n - 1) AS INTEGER) + 1]"


@query("a14_a19_stage_report", f"""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m, min(value) AS lo, max(value) AS hi, max_by(value, (ts, event_id)) AS latest, avg(CASE WHEN value < 20 THEN 1.0 ELSE 0 END) AS hit FROM events GROUP BY event_type)
SELECT event_type, n, round(m, 6) AS mean, lo AS least, hi AS most, latest, round(hit, 6) AS cache_hits, {_RANK.format(0.5)} AS p50, {_RANK.format(0.95)} AS p95, {_RANK.format(0.99)} AS p99 FROM s""")
def _(t):
    # what takes under 20 came from the cache
    p = telemetry.percentiles(t("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    a = t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.round(F.avg((F.col("value") < 20).cast("double")), 6).alias("cache_hits"))
    return a.join(p, "event_type")


_FOUND = "CAST(floor(value / 8) AS BIGINT)"
_BUCKET = "CASE WHEN {0} = 0 THEN '0' WHEN {0} <= 3 THEN '1-3' WHEN {0} <= 10 THEN '4-10' WHEN {0} <= 20 THEN '11-20' ELSE '20+' END"


@query("a16_count_buckets", f"SELECT {_BUCKET.format(_FOUND)} AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(telemetry.count_bucket(F.floor(F.col("value") / 8)).alias("bucket")).agg(F.count("*").alias("n"))


@query("a15_session_summary", f"""SELECT user_id, count(*) AS n, count(*) FILTER ({_FOUND} = 0) AS empty, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error' AND value < 30) AS recovered, count(DISTINCT event_type) AS kinds, round(avg(value) FILTER (event_type = 'purchase'), 6) AS feedback,
  round(avg(CASE WHEN event_type = 'view' THEN CASE WHEN value < 20 THEN 1.0 ELSE 0 END END), 6) AS cache_hits, {", ".join(f"count(*) FILTER ({_BUCKET.format(_FOUND)} = '{b}') AS found_{b.replace('-', '_').replace('+', '_up')}" for b in ("0", "1-3", "4-10", "11-20", "20+"))}, min(ts) AS started, max(ts) AS ended,
  list_sort(list(value) FILTER (event_type = 'click'))[CAST(least(floor(0.5 * count(*) FILTER (event_type = 'click')), count(*) FILTER (event_type = 'click') - 1) AS INTEGER) + 1] AS click_p50 FROM events GROUP BY user_id""")
def _(t):
    e, v, k = t("events"), F.col("value"), F.col("event_type")
    found = telemetry.count_bucket(F.floor(v / 8))
    s = e.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.floor(v / 8) == 0).alias("empty"),
        F.count_if(k == "error").alias("errors"),
        F.count_if((k == "error") & (v < 30)).alias("recovered"),
        F.count_distinct("event_type").alias("kinds"),
        F.round(F.avg(F.when(k == "purchase", v)), 6).alias("feedback"),
        F.round(F.avg(F.when(k == "view", (v < 20).cast("double"))), 6).alias("cache_hits"),
        *[F.count_if(found == b).alias("found_" + b.replace("-", "_").replace("+", "_up")) for b in ("0", "1-3", "4-10", "11-20", "20+")],
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
    )
    p = telemetry.percentiles(e.where("event_type = 'click'"), ["user_id"], "value", {"click_p50": 0.5}).drop("n")
    return s.join(p, "user_id", "left")


@query("a17_search_analytics", """WITH n AS (SELECT max(ts) AS now FROM events) SELECT count(*) AS n, count(*) FILTER (ts > now - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (ts > now - INTERVAL 24 HOUR) AS last_day, round(avg(value), 6) AS similarity, round(avg(CASE WHEN value < 8 THEN 1.0 ELSE 0 END), 6) AS empty_rate, count(*) FILTER (value < 8 OR value < 25) AS weak FROM events, n""")
def _(t):
    now = F.lit(t("events").agg(F.max("ts")).first()[0])
    v = F.col("value")
    return t("events").agg(F.count("*").alias("n"), F.count_if(F.col("ts") > now - F.expr("interval 1 hour")).alias("last_hour"), F.count_if(F.col("ts") > now - F.expr("interval 24 hours")).alias("last_day"), F.round(F.avg(v), 6).alias("similarity"), F.round(F.avg((v < 8).cast("double")), 6).alias("empty_rate"), F.count_if((v < 8) | (v < 25)).alias("weak"))


_NEAR = "(a.value * b.value + (100 - a.value) * (100 - b.value)) / (sqrt(a.value * a.value + (100 - a.value) * (100 - a.value)) * sqrt(b.value * b.value + (100 - b.value) * (100 - b.value)))"
_REDUNDANT = f"""SELECT DISTINCT b.event_id FROM events b JOIN events a ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.ts <= b.ts AND a.ts >= b.ts - INTERVAL 5 MINUTE AND (a.ts < b.ts OR a.event_id < b.event_id) AND {_NEAR} > 0.8"""


@query("j16_redundant_searches", _REDUNDANT)
def _(t):
    e = t("events").select("user_id", "event_id", "ts", F.array(F.col("value"), 100 - F.col("value")).alias("v"))
    return telemetry.redundant(e, "user_id", "event_id", "v").select("event_id")


@query("t3_stateful_redundancy", _REDUNDANT)
def _(t):
    s = _stream(t).select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts", F.array(F.col("value"), 100 - F.col("value")).alias("vector"))
    return streams.drained(streams.redundant(s)).where("redundant").select(F.col("id").alias("event_id"))


@query("t1_t2_watched_index", f"WITH {_PARTS} SELECT DISTINCT substr(sha256(text), 1, 16) AS id, length(text) AS size FROM p")
def _(t):
    """Documents as they arrive, chunked, embedded and upserted a batch at a time."""
    d = t("documents")
    store = index.Store(d.sparkSession, place(t, "store"))

    def apply(batch):
        chunks = lines(lambda _: batch).select(chunk_id(F.col("text")).alias("id"), "text")
        new = embedding.embedded(index.first_wins(chunks, ["id"], ["text"]), "text")
        store.upsert(new, "id", "hashing", 64)

    files = d.inputFiles()
    path = files[0].removeprefix("file://")
    folder, name = path.rsplit("/", 1)
    s = d.sparkSession.readStream.schema(d.schema).option("pathGlobFilter", name if len(files) == 1 else "*").parquet(folder)
    streams.watched(s, apply, place(t, "state")).awaitTermination()
    return store.read(["id", "text"]).select("id", F.length("text").cast("long").alias("size"))


@query("t7_feedback_sample", f"""WITH s AS (SELECT user_id, event_id, ts, {_FOUND} = 0 OR {_FOUND} > 10 AS odd, substr(md5(CAST(event_id AS VARCHAR)), 1, 1) < '4' AS drawn FROM events), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM s WHERE odd OR drawn) SELECT user_id, event_id FROM r WHERE rn <= 20""")
def _(t):
    return telemetry.feedback_sample(t("events"), "user_id", "event_id", F.floor(F.col("value") / 8), 4, 20).select("user_id", "event_id")


@query("t8_unflushed", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') AND ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY")
def _(t):
    now = F.lit(t("events").agg(F.max("ts")).first()[0])
    return telemetry.unflushed(t("events"), t("events").where("event_type = 'view'"), "event_id", now, "20 days").select("event_id")


@query("a20_token_rollup", """SELECT CASE WHEN grouping(conv_id) = 1 THEN -1 ELSE conv_id END AS conv_id, role, CAST(sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, CAST(grouping(conv_id) + grouping(role) AS BIGINT) AS level FROM conversations GROUP BY ROLLUP (conv_id, role)""")
def _(t):
    c = t("conversations").withColumn("n", token_estimate(F.col("text")))
    whole = F.grouping("conv_id")
    out = c.rollup("conv_id", "role").agg(F.sum("n").alias("tokens"), (whole.cast("long") + F.grouping("role").cast("long")).alias("level"), whole.alias("whole"))
    return out.withColumn("conv_id", F.when(F.col("whole") == 1, -1).otherwise(F.col("conv_id"))).drop("whole")


@query("a21_first_entries", """WITH e AS (SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN user_id || event_type END AS request FROM events) SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(request, 'own' || event_id) ORDER BY ts, event_id) AS rn FROM e) WHERE rn = 1""")
def _(t):
    # errors have no request, so all of them stay
    e = t("events").select("event_id", "ts", F.when(F.col("event_type") != "error", F.concat(F.col("user_id").cast("string"), "event_type")).alias("request"))
    return telemetry.first_entries(e, "request", "event_id", ["ts", "event_id"]).select("event_id")


_DAY = "WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS docs, count(DISTINCT user_id) AS chunks, sum(value) AS tokens, greatest(epoch_us(max(ts)) - epoch_us(min(ts)), 1000) / 1e6 AS s FROM events GROUP BY 1)"


@query("a22_j21_throughput", _DAY + """, r AS (SELECT day, docs / s AS docs_s, chunks / s AS chunks_s, tokens / s AS tokens_s FROM d), g AS (SELECT *, (lag(docs_s) OVER (ORDER BY day) - docs_s) / lag(docs_s) OVER (ORDER BY day) AS drop FROM r)
SELECT day, round(docs_s, 9) AS docs_s, round(chunks_s, 9) AS chunks_s, round(tokens_s, 6) AS tokens_s, round(drop, 6) AS regression, coalesce(drop <= 0.20, true) AS passed FROM g""")
def _(t):
    us = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    d = t("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("docs"), F.count_distinct("user_id").alias("chunks"), F.sum("value").alias("tokens"), ((us(F.max) - us(F.min)) / 1e6).alias("seconds"))
    out = telemetry.throughput(d, ["docs", "chunks", "tokens"], "seconds", "day")
    return out.select("day", F.round("docs_s", 9).alias("docs_s"), F.round("chunks_s", 9).alias("chunks_s"), F.round("tokens_s", 6).alias("tokens_s"), F.round("regression", 6).alias("regression"), "passed")


@query("a24_judged_means", "SELECT round(avg(quality), 6) AS faithfulness, round(avg(1 - toxic), 6) AS relevance, round(avg(least(n_chars / 1000.0, 1)), 6) AS recall, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    j = t("documents").join(t("labels"), "doc_id", "left").select(F.when(F.col("quality").isNotNull(), F.lit("x")).alias("truth"), F.col("quality").alias("faithfulness"), (1 - F.col("toxic")).alias("relevance"), F.least(F.col("n_chars") / 1000, F.lit(1.0)).alias("recall"))
    return evaluation.judged_means(j, "truth", ["faithfulness", "relevance", "recall"])


_SKILLS = ", ".join(f"('{n}', [{', '.join(repr(u) for u in us)}], {k})" for n, us, k in SKILLS)


@query("a25_routing_accuracy", f"""WITH s(name, uses, tokens) AS (VALUES {_SKILLS}), q AS (SELECT item_id, lower(text[1:80]) AS task, CASE WHEN item_id % 2 = 0 THEN 'entor' ELSE 'ba-tor' END AS expected, contains(text, 'plan') AS should FROM benchmark),
x AS (SELECT item_id, name, tokens, expected, should, task, len(list_filter(regexp_split_to_array(task, '\\s+'), lambda w: length(w) > 2 AND contains(lower(name || ' ' || array_to_string(uses, ' ')), w))) + CASE WHEN contains(task, replace(name, '-', ' ')) OR contains(task, name) THEN 2 ELSE 0 END AS score FROM q, s),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, name) AS rn FROM x) WHERE rn = 1), z AS (SELECT *, score > 0 AND name = expected AS ok, regexp_matches(task, '\\b(ka|or|tor)') AS fired FROM y)
SELECT count(*) AS n, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / CAST(count(*) AS DOUBLE), 6) AS accuracy, round(coalesce(count(*) FILTER (should AND fired) / CAST(nullif(count(*) FILTER (should), 0) AS DOUBLE), 0), 6) AS tpr, round(coalesce(count(*) FILTER (NOT should AND fired) / CAST(nullif(count(*) FILTER (NOT should), 0) AS DOUBLE), 0), 6) AS fpr, round(coalesce(avg(greatest(tokens - 150, 0)) FILTER (ok), 0), 6) AS saved FROM z""")
def _(t):
    q = t("benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "entor").otherwise("ba-tor").alias("expected"), F.contains("text", F.lit("plan")).alias("should"))
    return evaluation.routing_accuracy(routed(t).join(q, "item_id"), "expected", F.col("should"), F.col("task").rlike(r"\b(ka|or|tor)"), 150)


@query("a27_index_health", """WITH x AS (SELECT o_orderstatus AS k, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS dead, (epoch(TIMESTAMP '2000-01-01') - epoch(max(o_orderdate))) / 3600 AS hours FROM orders GROUP BY 1)
SELECT k, round(dead / CAST(n AS DOUBLE), 3) AS dead, round(hours, 1) AS hours, CASE WHEN dead / CAST(n AS DOUBLE) > 0.1 THEN 1 ELSE 0 END + CASE WHEN n > 3000 THEN 2 ELSE 0 END + CASE WHEN hours > 168 THEN 4 ELSE 0 END AS advice FROM x""")
def _(t):
    now = F.lit("2000-01-01").cast("timestamp")
    s = t("orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count_if(F.col("o_totalprice") <= 300000).alias("live"), F.count_if(F.col("o_totalprice") > 300000).alias("dead"), F.max("o_orderdate").cast("timestamp").alias("at"))
    return telemetry.health(s, F.col("live"), F.col("dead"), (F.unix_seconds(now) - F.unix_micros("at") / 1e6) / 3600, F.lit(True), large=3000).select("k", F.round("dead_share", 3).alias("dead"), F.round("hours", 1).alias("hours"), F.col("advice").cast("int").alias("advice"))


@query("a28_latency_expansion", f"""WITH q AS (SELECT user_id, count(*) AS calls, round(avg(value), 6) AS mean FROM events GROUP BY user_id), x AS (SELECT mean AS value, unnest(generate_series(1, least(calls, 10))) FROM q), s AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM x)
SELECT {_RANK.format(0.5)} AS p50, {_RANK.format(0.95)} AS p95, (SELECT count(*) FROM q WHERE mean > 50) AS slow FROM s""")
def _(t):
    q = t("events").groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean"))
    x = telemetry.expanded(q, "mean", "calls")
    p = telemetry.percentiles(x.withColumn("all_", F.lit(1)), ["all_"], "mean", {"p50": 0.5, "p95": 0.95}).drop("all_", "n")
    return p.crossJoin(q.agg(F.count_if(F.col("mean") > 50).alias("slow")))


@query("a29_metric_text", "SELECT event_type AS series, count(*) AS n, round(sum(value), 2) / count(*) AS mean FROM events GROUP BY event_type")
def _(t):
    g = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))
    line = lambda what, v: F.concat(F.lit(f"latency_{what}{{kind=\""), "event_type", F.lit("\"} "), v)
    text = g.select(F.concat_ws("\n", F.lit("# HELP latency"), line("sum", F.col("s").cast("string")), line("count", F.col("n").cast("string"))).alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    return telemetry.metric_means(text, "text", "latency").select(F.regexp_extract("series", 'kind="([^"]*)"', 1).alias("series"), F.col("n").cast("long").alias("n"), "mean")


@query("a31_token_efficiency", """WITH f AS (SELECT source, CAST(sum(ceil(strlen(text) / 4.0)) AS BIGINT) AS whole FROM documents GROUP BY source), r AS (SELECT l.quality AS q, d.source, CAST(ceil(least(strlen(d.text), 400) / 4.0) AS BIGINT) AS used FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
x AS (SELECT q, sum(used) AS used FROM r GROUP BY q), y AS (SELECT q, sum(whole) AS whole FROM (SELECT DISTINCT q, source FROM r) s JOIN f ON f.source = s.source GROUP BY q), z AS (SELECT x.q, used, whole FROM x JOIN y ON x.q = y.q)
SELECT CAST(coalesce(q, -1) AS BIGINT) AS query, CAST(sum(used) AS BIGINT) AS used, CAST(sum(whole) AS BIGINT) AS whole, CAST(sum(whole) - sum(used) AS BIGINT) AS saved, round(100 * (sum(whole) - sum(used)) / CAST(sum(whole) AS DOUBLE), 6) AS percent FROM z GROUP BY ROLLUP (q)""")
def _(t):
    sizes = t("documents").groupBy("source").agg(F.sum(token_estimate(F.col("text"))).alias("whole"))
    got = t("documents").join(t("labels"), "doc_id").select(F.col("quality").cast("long").alias("query"), "source", F.ceil(F.least(F.octet_length("text"), F.lit(400)) / 4).alias("used"))
    return telemetry.token_efficiency(got, sizes, "query", "source")


_MATRIX = "m AS (SELECT label AS config, vec_id AS query, round(1 - abs(embedding[1]), 9) AS sim, vec_id % 10 > 0 AS relevant FROM embeddings)"


@query("a32_query_matrix", f"""WITH {_MATRIX}, b AS (SELECT config, max(sim) AS best FROM m WHERE relevant GROUP BY config) SELECT m.config, m.query, CASE WHEN relevant THEN sim >= 0.70 ELSE best - sim >= 0.15 END AS passed FROM m JOIN b ON b.config = m.config""")
def _(t):
    m = t("embeddings").select(F.col("label").alias("config"), F.col("vec_id").alias("query"), F.round(1 - F.abs(F.element_at("embedding", 1)), 9).alias("sim"), (F.col("vec_id") % 10 > 0).alias("relevant"))
    return telemetry.query_matrix(m, "config", "query", "sim", F.col("relevant"))


@query("a33_component_rates", f"WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, sum(value * 1024) AS bytes FROM events GROUP BY event_type), p AS (SELECT event_type, n, bytes, {_RANK.format(0.5)} AS p50 FROM s) SELECT event_type, round(512 / (p50 / 1000), 4) AS tokens_s, round(bytes / 1024 / p50, 4) AS kb_ms, round(n / (p50 / 1000), 4) AS passages_s FROM p")
def _(t):
    e = t("events")
    p = telemetry.percentiles(e, ["event_type"], "value", {"p50": 0.5}).join(e.groupBy("event_type").agg(F.sum(F.col("value") * 1024).alias("bytes")), "event_type")
    return p.select("event_type", F.round(512 / (F.col("p50") / 1000), 4).alias("tokens_s"), F.round(F.col("bytes") / 1024 / F.col("p50"), 4).alias("kb_ms"), F.round(F.col("n") / (F.col("p50") / 1000), 4).alias("passages_s"))


@query("a36_paged_list", "SELECT doc_id, source, substr(text, 1, 60) AS preview, (SELECT count(*) FROM documents WHERE lang = 'en') AS total, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM documents) AS files FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50 OFFSET 50")
def _(t):
    rows = t("documents").where("lang = 'en'")
    files = t("documents").select("source").distinct().agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("files"))
    one = rows.orderBy("doc_id").offset(50).limit(50).select("doc_id", "source", F.substring("text", 1, 60).alias("preview"))
    return one.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).crossJoin(F.broadcast(files))


def _stored(t, name: str, rows: list[str]) -> str:
    """Lines as a text file in the shared folder."""
    path = place(t, name)
    t("region").sparkSession.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


@query("s15_trec_qrels", "WITH q AS (SELECT quality, doc_id, toxic FROM labels) SELECT 'q' || quality AS query_id, 'what ' || quality AS query, CAST(doc_id AS VARCHAR) AS doc_id, toxic AS rel FROM q WHERE quality IN (SELECT quality FROM q GROUP BY quality HAVING max(toxic) > 0)")
def _(t):
    spark = t("labels").sparkSession
    path, queries = place(t, "qrels"), place(t, "queries")
    t("labels").select(F.format_string("q%d 0 %d %d", "quality", "doc_id", "toxic").alias("value")).unionByName(spark.createDataFrame([("broken",)], "value string")).write.text(path)
    t("labels").select(F.format_string("q%d\twhat %d", "quality", "quality").alias("value")).distinct().write.text(queries)
    return readers.judged_queries(readers.trec_qrels(spark, path), readers.tsv_queries(spark, queries))


@query("s16_json_qrels", "SELECT 'b' || item_id AS query_id, text AS query, CAST(item_id + n AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS rel FROM benchmark, (VALUES (0), (2)) v(n)")
def _(t):
    rows = t("benchmark").orderBy("item_id").collect()  # the benchmark's passages as a file
    said = json.dumps({"queries": [{"id": f"b{r.item_id}", "query": r.text, "qrels": [{"docId": str(r.item_id + n), "relevance": n} for n in (0, 2)]} for r in rows]})
    return readers.json_qrels(t("benchmark").sparkSession, _stored(t, "json-qrels", [said]))


@query("s17_eval_dataset", "SELECT text AS query, CAST(item_id AS VARCHAR) AS expected FROM benchmark")
def _(t):
    path = place(t, "dataset")
    readers.write_dataset(t("benchmark").select(F.col("text").alias("query"), F.array(F.col("item_id").cast("string")).alias("expectedChunkIds"), F.array(F.substring("text", 1, 20)).alias("expectedContent")), path)
    return readers.dataset(t("benchmark").sparkSession, path).select("query", F.array_join("expectedChunkIds", ",").alias("expected"))


@query("s18_history", "SELECT event_type AS kind, max(event_id) AS latest, max(event_id) FILTER (value < 50) AS latest_cheap FROM events GROUP BY event_type")
def _(t):
    h = readers.History(t("events").sparkSession, place(t, "history"))
    h.save(t("events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "value"))
    h.save(t("events").where("event_type = 'none'").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "value"))
    every = readers.History(h.spark, h.path, keep=1 << 40)
    return h.newest().select("kind", F.col("id").alias("latest")).join(every.newest(F.col("value") < 50).select("kind", F.col("id").alias("latest_cheap")), "kind", "left")


@query("s19_benchmark_feed", "SELECT event_type AS name, max_by(value, (day, event_id)) AS value FROM (SELECT *, date_trunc('day', ts) AS day FROM events) GROUP BY event_type")
def _(t):
    e = t("events").withColumn("day", F.date_trunc("day", "ts"))
    points = lambda rows: rows.groupBy(F.col("event_type").alias("name")).agg(F.max_by("value", F.struct("day", "event_id")).alias("value"))
    last = F.lit(t("events").agg(F.date_trunc("day", F.max("ts"))).first()[0])
    return index.upsert(points(e), points(e.where(F.col("day") == last)), "name")


@query("s20_s24_chunk_files", "SELECT substr(sha256(text), 1, 16) AS id, text, CAST(item_id AS DOUBLE) AS first FROM benchmark")
def _(t):
    rows = t("benchmark").select(chunk_id(F.col("text")).alias("denseTextHash"), F.col("text").alias("denseText"), F.array(F.col("item_id").cast("double"), F.lit(0.5)).alias("embedding")).toJSON().collect()
    old = _stored(t, "old", ["[" + ",".join(rows[: len(rows) // 2]) + "]"])
    new = _stored(t, "new", [json.dumps({"_meta": {"model": "m"}, "chunks": [json.loads(r) for r in rows[len(rows) // 2 :]]})])
    spark = t("benchmark").sparkSession
    both = readers.chunk_file(spark, old).unionByName(readers.chunk_file(spark, new))
    return both.select(F.col("denseTextHash").alias("id"), F.col("denseText").alias("text"), F.element_at("embedding", 1).alias("first"))


@query("s21_session_log", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def _(t):
    path = place(t, "log")
    t("events").where("event_type = 'click'").select(F.to_json(F.struct("event_id", "user_id")).alias("value")).unionByName(t("region").select(F.lit("{broken").alias("value"))).write.text(path)
    return readers.session_log(t("events").sparkSession, path, "event_id long, user_id long")


@query("s3_manifest_s7_range", "WITH f AS (SELECT doc_id, text FROM documents WHERE octet_length(encode(text)) > 0) SELECT 'range' AS kind, doc_id, sha256(encode(text)[11:30]) AS hash FROM f")
def _(t):
    d = t("documents").select("doc_id", F.col("text").cast("binary").alias("content")).where(F.octet_length("content") > 0)
    return d.select(F.lit("range").alias("kind"), "doc_id", F.sha2(readers.byte_range(F.col("content"), 10, 30), 256).alias("hash"))


@query("s14_s9_paged_source", "SELECT r_regionkey AS key, r_name AS name FROM region")
def _(t):
    """The rows of a source that gives pages by a cursor; here files of a folder, a page each."""
    path = place(t, "pages")
    rows = [(r.r_regionkey, r.r_name) for r in t("region").orderBy("r_regionkey").collect()]
    spark = t("region").sparkSession
    spark.createDataFrame([(n // 2, json.dumps({"rows": [{"key": k, "name": x} for k, x in rows[n : n + 2]]})) for n in range(0, len(rows), 2)], "page int, value string").write.partitionBy("page").text(path)
    return readers.paged(spark, path, "key int, name string")
