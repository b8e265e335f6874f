"""Search over stored vectors and texts, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shalecrest.functions import vectors as v
from shalecrest.operators import evaluation, search
from shalecrest.operators.embedding import embedded
from shalecrest.plans.registry import query

_SIM = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
#: The queries are all vectors whose id is divisible by 100; they are held against all vectors.
_KNN = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_SIM}, 12) AS sim, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)"""


def neighbours(t, k):
    e = t("embeddings")
    return search.knn(e.where("vec_id % 100 = 0"), e, k)


@query("r1_vector_math", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(a, a)), 6) AS norm, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_distance(a, b), 6) AS l2, round(list_distance(list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))), list_transform(b, lambda x: x / sqrt(list_dot_product(b, b)))), 6) AS unit_l2 FROM e WHERE b IS NOT NULL""")
def _(t):
    a, b = F.col("embedding"), F.col("b")
    e = t("embeddings").withColumn("b", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    return e.select("vec_id", F.round(v.norm(a), 6).alias("norm"), F.round(v.cosine(a, b), 6).alias("cosine"), F.round(v.l2(a, b), 6).alias("l2"), F.round(v.l2(v.normalized(a), v.normalized(b)), 6).alias("unit_l2"))


@query("r3_knn", _KNN + " SELECT query_id, id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 5")
def _(t):
    return neighbours(t, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("r12_page_f6_min_similarity", _KNN + " SELECT query_id, id, round(sim, 6) AS similarity, rank FROM r WHERE rank > 5 AND rank <= 10 AND sim >= 0.2")
def _(t):
    return search.page(neighbours(t, 10), 5, 5, 0.2).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("r10_rerank_r13_oversample", _KNN + """, x AS (SELECT query_id, id, rank, round(1.0 / (1 + abs(lb - la)) + sim / 10, 9) AS s FROM r WHERE rank <= 25),
y AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank FROM x)
SELECT query_id, id, round(s, 6) AS similarity, rank FROM y WHERE rank <= 5""")
def _(t):
    e = t("embeddings")
    near = neighbours(t, 25).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb")), "id")
    new = F.round(1.0 / (1 + F.abs(F.col("lb") - F.col("la"))) + F.col("similarity") / 10, 9)
    return search.rerank(near, new, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_BM25 = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark)),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 9) AS score, count(*) AS shared, max(dl) AS dl FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, dl, doc_id) AS other FROM sc)"""
_BM25 = _BM25.replace("GROUP BY ALL),\ndf", "GROUP BY doc_id, dl, term),\ndf").replace("st GROUP BY ALL),", "st GROUP BY query_id, doc_id),")


@query("r6_bm25", _BM25 + " SELECT query_id, doc_id, round(score, 5) AS score, rank FROM sr WHERE rank <= 10")
def _(t):
    return search.bm25(t("benchmark"), t("documents"), 10, "item_id", "doc_id").select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


#: Vectors of the hashing embedder, a row a bucket that isn't zero; of the documents and of the passages.
VECTORS = """(SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM (SELECT id, CAST('0x' || md5(term)[1:4] AS INTEGER) % 64 AS b, CAST(sum(CASE WHEN CAST('0x' || md5(term)[5:5] AS INTEGER) < 8 THEN 1 ELSE -1 END) AS DOUBLE) AS x
  FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM {}) GROUP BY 1, 2) WHERE x <> 0)"""
_HYBRID = _BM25 + f""", dv AS {VECTORS.format("(SELECT doc_id AS id, text FROM documents)")}, qv AS {VECTORS.format("(SELECT item_id AS id, text FROM benchmark)")},
nn AS (SELECT qv.id AS query_id, dv.id AS doc_id, round(sum(qv.x * dv.x), 9) AS sim FROM qv JOIN dv ON qv.b = dv.b GROUP BY qv.id, dv.id), nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM nn)"""


def dense(t, k):
    docs = embedded(t("documents").select("doc_id", "text"), "text").select("doc_id", "vector")
    asked = embedded(t("benchmark").select(F.col("item_id").alias("doc_id"), "text"), "text").select("doc_id", "vector")
    found = search.knn(asked, docs, 2 * k, "doc_id", "vector", exclude_self=False).withColumn("similarity", F.round("similarity", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query("r7_rrf", _HYBRID + """, f AS (SELECT query_id, doc_id, 0.6 / (60 + rank) AS s FROM nr WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 0.4 / (60 + rank) FROM sr WHERE rank <= 20),
g AS (SELECT query_id, doc_id AS id, sum(s) AS s FROM f GROUP BY query_id, doc_id), h AS (SELECT query_id, id, round(s / max(s) OVER (PARTITION BY query_id), 9) AS score FROM g)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 10""")
def _(t):
    lexical = search.bm25(t("benchmark"), t("documents"), 20, "item_id", "doc_id").select("query_id", F.col("doc_id").alias("id"), "rank")
    return search.fuse(dense(t, 20), lexical, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("x1_x7_embedder", f"WITH v AS {VECTORS.format('(SELECT doc_id AS id, text FROM documents)')} SELECT id AS doc_id, count(*) AS buckets, round(sum(abs(x)), 6) AS size, round(sum(x * (b + 1)), 5) AS moment FROM v GROUP BY id")
def _(t):
    d = embedded(t("documents").select("doc_id", "text"), "text").select("doc_id", F.posexplode("vector").alias("b", "x")).where("x <> 0")
    return d.groupBy("doc_id").agg(F.count("*").alias("buckets"), F.round(F.sum(F.abs("x")), 6).alias("size"), F.round(F.sum(F.col("x") * (F.col("b") + 1)), 5).alias("moment"))


@query("r8_recency", _KNN + """, n AS (SELECT max(ts) AS now FROM events), x AS (SELECT r.*, e.ts FROM r LEFT JOIN events e ON e.event_id = r.id WHERE rank <= 10),
y AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(0.85 * sim + 0.15 * coalesce(exp(-(epoch_ms(now) - epoch_ms(ts)) / 2.592e9), 0), 9) DESC, rank) AS rank FROM x, n)
SELECT query_id, id, round(sim, 6) AS similarity, rank FROM y WHERE rank <= 5""")
def _(t):
    stamped = neighbours(t, 10).drop("rank").join(t("events").select(F.col("event_id").alias("id"), "ts"), "id", "left")
    now = F.lit(t("events").agg(F.max("ts")).first()[0])
    return search.recency_order(stamped, now, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("r11_listed_first", _KNN + """, x AS (SELECT query_id, id, sim, rank, CASE WHEN rank = 4 THEN 0 WHEN rank = 2 THEN 1 END AS pos FROM r WHERE rank <= 6)
SELECT query_id, id, round(CASE WHEN pos IS NOT NULL THEN 1 - pos / 6.0 ELSE sim END, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(pos, 6 + rank)) AS rank FROM x""")
def _(t):
    said = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.posexplode(F.array(F.lit(3), F.lit(1))).alias("pos", "index"))
    return search.listed_first(neighbours(t, 6), said).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("f7_min_score", _KNN + """, x AS (SELECT query_id, id, rank, round(1.0 / (1 + abs(lb - la)) + sim / 10, 9) AS s FROM r WHERE rank <= 25), y AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank FROM x)
SELECT query_id, id, round(s, 6) AS similarity FROM y WHERE rank <= 5 AND s >= 0.6""")
def _(t):
    e = t("embeddings")
    near = neighbours(t, 25).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb")), "id")
    ranked = search.rerank(near, F.round(1.0 / (1 + F.abs(F.col("lb") - F.col("la"))) + F.col("similarity") / 10, 9), 5)
    return search.page(ranked, 0, 5, 0.6).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("x2_reranker", "SELECT doc_id, round((length(text) % 97) / 97.0 + CASE WHEN contains(text, 'en') THEN 1 ELSE 0 END, 9) AS score FROM documents")
def _(t):
    # a scorer as a plug-in: any function of queries and texts
    of = search.scored(lambda queries, texts: [len(x) % 97 / 97 + (q in x) for q, x in zip(queries, texts, strict=True)])
    return t("documents").select("doc_id", F.round(of(F.lit("en"), F.col("text")), 9).alias("score"))


@query("r14_postfilter", _KNN + """, x AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE rank <= 20 AND lb = la) SELECT query_id, id, round(sim, 6) AS similarity, rank FROM x WHERE rank <= 5""")
def _(t):
    e = t("embeddings")
    found = neighbours(t, 20).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb")), "id").where("la = lb")
    return search.page(found, 0, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("r15_semantic_cache", """WITH a AS (SELECT *, md5(CAST(embedding AS VARCHAR)) AS h FROM embeddings WHERE vec_id % 100 = 0), k AS (SELECT *, md5(CAST(embedding AS VARCHAR)) AS h FROM embeddings WHERE vec_id % 100 > 0),
same AS (SELECT a.vec_id AS id, min(k.vec_id) AS hit FROM a JOIN k ON a.h = k.h GROUP BY a.vec_id), n AS (SELECT a.vec_id AS id, k.vec_id AS hit, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])), 12) AS sim FROM a, k),
best AS (SELECT id, hit, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, hit) AS rn FROM n) WHERE rn = 1 AND sim >= 0.6) SELECT a.vec_id AS id, coalesce(same.hit, best.hit, -1) AS hit, round(CASE WHEN same.hit IS NOT NULL THEN 1.0 ELSE best.sim END, 6) AS similarity FROM a LEFT JOIN same ON same.id = a.vec_id LEFT JOIN best ON best.id = a.vec_id""")
def _(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.xxhash64("embedding").alias("hash"), F.col("embedding").alias("vector"))
    return search.cached(e.where("id % 100 = 0"), e.where("id % 100 > 0"), 0.6).select("id", F.coalesce("hit", F.lit(-1)).alias("hit"), F.round("similarity", 6).alias("similarity"))


@query("r4_ivf")
def _(t):
    """Neighbours by an inverted file over all vectors; tests hold its recall against brute force."""
    e = t("embeddings")
    return search.Ivf(e).search(e.where("vec_id % 100 = 0"), 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("r5_recall_at_10", _KNN + ", x AS (SELECT query_id, count(*) FILTER (rank <= 12 AND rank % 3 > 0) AS n FROM r WHERE rank <= 10 GROUP BY query_id) SELECT query_id, round(n / 10.0, 6) AS recall FROM x")
def _(t):
    # of the exact ten, those that a list without each third has
    found = neighbours(t, 12).where("rank % 3 > 0")
    return search.recall(found, neighbours(t, 10)).select("query_id", F.round("recall", 6).alias("recall"))


@query("r15_exact_cache", """SELECT doc_id, first_id, first_id < doc_id AS hit FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text), length(text)) AS first_id FROM documents)""")
def _(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.select("doc_id", F.min("doc_id").over(Window.partitionBy("h")).alias("first_id")).withColumn("hit", F.col("first_id") < F.col("doc_id"))


@query("r17_routing", """WITH s(name, uses, tokens) AS (VALUES ('ba-tor', ['renish sul', 'mika'], 900), ('entor', ['ka le ba', 'tomi'], 400), ('ishle', ['or ent sulka'], 100)), q AS (SELECT item_id, lower(text[1:80]) AS task FROM benchmark),
x AS (SELECT item_id, name, len(list_filter(regexp_split_to_array(task, '\\s+'), lambda w: length(w) > 2 AND contains(lower(name || ' ' || array_to_string(uses, ' ')), w))) + CASE WHEN contains(task, replace(name, '-', ' ')) OR contains(task, name) THEN 2 ELSE 0 END AS score FROM q, s)
SELECT item_id, CASE WHEN score > 0 THEN name END AS skill, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, name) AS rn FROM x) WHERE rn = 1""")
def _(t):
    return routed(t).select("item_id", F.when(F.col("score") > 0, F.col("name")).alias("skill"), F.col("score").cast("long").alias("score"))


SKILLS = [("ba-tor", ["renish sul", "mika"], 900), ("entor", ["ka le ba", "tomi"], 400), ("ishle", ["or ent sulka"], 100)]


def routed(t):
    skills = t("benchmark").sparkSession.createDataFrame(SKILLS, "name string, uses array<string>, tokens int")
    q = t("benchmark").select("item_id", F.lower(F.substring("text", 1, 80)).alias("task"))
    return evaluation.routed(q, skills, "item_id", "task")


def _judged(t, k):
    e = t("embeddings")
    labels = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la"))
    ranked = neighbours(t, k).join(labels, "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb")), "id").withColumn("rel", (F.col("la") == F.col("lb")).cast("int"))
    relevant = labels.withColumn("n_relevant", F.count("*").over(Window.partitionBy("la")) - 1).select("query_id", "n_relevant")
    return evaluation.ranking_metrics(ranked, relevant, k)


_JUDGED = _KNN + """, j AS (SELECT query_id, rank, CASE WHEN la = lb THEN 1 ELSE 0 END AS rel FROM r WHERE rank <= 10),
n AS (SELECT vec_id AS query_id, label, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings),
i AS (SELECT k, sum(1 / log2(g + 1)) AS ideal FROM (SELECT unnest(generate_series(1, 10)) AS k) a JOIN (SELECT unnest(generate_series(1, 10)) AS g) b ON g <= k GROUP BY k),
m AS (SELECT j.query_id, n.label, round(sum(rel) / 10.0, 9) AS "precision", round(CASE WHEN n.n > 0 THEN sum(rel) / CAST(n.n AS DOUBLE) ELSE 0 END, 9) AS recall, CAST(max(rel) AS DOUBLE) AS hit_rate,
  round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0), 9) AS rr, round(coalesce(sum(rel / log2(rank + 1)) / max(ideal), 0), 9) AS ndcg
  FROM j JOIN n ON j.query_id = n.query_id LEFT JOIN i ON i.k = least(n.n, 10) GROUP BY j.query_id, n.label, n.n)"""


@query("a1_a5_ranking_metrics", _JUDGED + ' SELECT query_id, round("precision", 6) AS "precision", round(recall, 6) AS recall, hit_rate, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM m')
def _(t):
    return _judged(t, 10).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], "hit_rate", *[F.round(c, 6).alias(c) for c in ("rr", "ndcg")])


@query("a7_a8_macro_average", _JUDGED + """  , by_label AS (SELECT label, avg("precision") AS p, avg(recall) AS r, avg(rr) AS mrr, avg(ndcg) AS g FROM m GROUP BY label)
SELECT round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(g), 6) AS ndcg, avg(mrr) >= 0.30 AS passed FROM by_label""")
def _(t):
    labels = t("embeddings").select(F.col("vec_id").alias("query_id"), "label")
    by = _judged(t, 10).join(labels, "query_id").groupBy("label").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "rr", "ndcg")])
    return by.agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), (F.avg("rr") >= 0.30).alias("passed"))


@query("a11_grid_search", _KNN + """, g AS (SELECT a.a AS alpha, k.k AS top_k, o.o AS oversample FROM (VALUES (0.2), (0.5), (0.8)) a(a), (VALUES (3), (5)) k(k), (VALUES (1), (3)) o(o)),
x AS (SELECT alpha, top_k, oversample, query_id, la, lb, row_number() OVER (PARTITION BY alpha, top_k, oversample, query_id ORDER BY round(alpha / (60 + rank) + (1 - alpha) / (1 + abs(lb - la)), 12) DESC, rank) AS rank FROM g JOIN r ON rank <= top_k * oversample),
y AS (SELECT alpha, top_k, oversample, query_id, min(CASE WHEN la = lb AND rank <= top_k THEN rank END) AS f FROM x GROUP BY ALL), z AS (SELECT alpha, top_k, oversample, round(avg(coalesce(1.0 / f, 0)), 9) AS mrr FROM y GROUP BY alpha, top_k, oversample)
SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(top_k AS INTEGER) AS top_k, CAST(oversample AS INTEGER) AS oversample, round(mrr, 6) AS mrr, row_number() OVER (ORDER BY mrr DESC, alpha, top_k, oversample) = 1 AS best FROM z""".replace("GROUP BY ALL", "GROUP BY alpha, top_k, oversample, query_id"))
def _(t):
    spark = t("embeddings").sparkSession
    grid = spark.createDataFrame([(a,) for a in (0.2, 0.5, 0.8)], "alpha double").crossJoin(spark.createDataFrame([(k,) for k in (3, 5)], "top_k int")).crossJoin(spark.createDataFrame([(o,) for o in (1, 3)], "oversample int"))
    e = t("embeddings")
    r = neighbours(t, 15).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb")), "id")
    fused = F.round(F.col("alpha") / (60 + F.col("rank")) + (1 - F.col("alpha")) / (1 + F.abs(F.col("lb") - F.col("la"))), 12)
    return evaluation.grid(r, grid, fused, F.col("la") == F.col("lb")).select("alpha", "top_k", "oversample", F.round("mrr", 6).alias("mrr"), "best")


@query("a6_graded_ndcg", _KNN + """, j AS (SELECT query_id, rank, CASE WHEN la = lb THEN 3 WHEN abs(la - lb) = 1 THEN 1 ELSE 0 END AS rel FROM r WHERE rank <= 10), g AS (SELECT a.vec_id AS query_id, CASE WHEN a.label = b.label THEN 3 WHEN abs(a.label - b.label) = 1 THEN 1 ELSE 0 END AS rel FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
i AS (SELECT query_id, sum(rel / log2(rn + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS rn FROM g) WHERE rn <= 10 GROUP BY query_id)
SELECT j.query_id, round(sum(rel / log2(rank + 1)) / max(ideal), 6) AS ndcg FROM j JOIN i ON i.query_id = j.query_id GROUP BY j.query_id""")
def _(t):
    e = t("embeddings")
    grade = F.when(F.col("la") == F.col("lb"), 3).when(F.abs(F.col("la") - F.col("lb")) == 1, 1).otherwise(0)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("la"))
    ranked = neighbours(t, 10).join(q, "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb")), "id").select("query_id", "rank", grade.alias("rel"))
    # how many of each grade there are, rather than a row for each judged vector
    per = q.join(e.groupBy(F.col("label").alias("lb")).agg(F.count("*").alias("n")), F.abs(F.col("la") - F.col("lb")) <= 1).select("query_id", grade.alias("rel"), (F.col("n") - (F.col("la") == F.col("lb")).cast("int")).alias("n"))
    return evaluation.graded_ndcg(ranked, per.groupBy("query_id", "rel").agg(F.sum("n").alias("n")), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("a9_relevant_sentences", """WITH d AS (SELECT item_id, string_split(text, ' ') AS docs FROM benchmark), k AS (SELECT item_id, docs, unnest(['0a', '1b', '1c', '5z', '12', 'x9', '99999a']) AS k FROM d), n AS (SELECT item_id, docs, CAST(nullif(regexp_extract(k, '^([0-9]+)', 1), '') AS BIGINT) AS i FROM k)
SELECT DISTINCT item_id, substr(sha256(docs[i + 1]), 1, 16) AS id FROM n WHERE i < len(docs)""")
def _(t):
    q = t("benchmark").select("item_id", F.split("text", " ", -1).alias("docs"), F.array(*map(F.lit, ["0a", "1b", "1c", "5z", "12", "x9", "99999a"])).alias("keys"))
    return evaluation.relevant_by_sentence(q, "item_id")


@query("j23_variants", _KNN + """, v AS (SELECT k, query_id, coalesce(1.0 / min(CASE WHEN la = lb AND rank <= k THEN rank END), 0) AS rr FROM r, (VALUES (2), (5), (10)) k(k) GROUP BY k, query_id)
SELECT CAST(a.k AS INTEGER) AS variant, count(*) AS n, round(avg(a.rr - b.rr), 6) AS delta, count(*) FILTER (a.rr > b.rr) AS better, count(*) FILTER (a.rr < b.rr) AS worse FROM v a JOIN v b ON a.query_id = b.query_id AND b.k = 5 WHERE a.k <> 5 GROUP BY a.k""")
def _(t):
    e = t("embeddings")
    r = neighbours(t, 10).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb")), "id")
    rr = r.select("query_id", F.explode(F.array(F.lit(2), F.lit(5), F.lit(10))).alias("variant"), F.when((F.col("la") == F.col("lb")), F.col("rank")).alias("at")).groupBy("variant", "query_id").agg(F.coalesce(1 / F.min(F.when(F.col("at") <= F.col("variant"), F.col("at"))), F.lit(0.0)).alias("rr"))
    return evaluation.against_baseline(rr, "variant", 5, "query_id", "rr")


@query("a35_norm_anomalies", """WITH n AS (SELECT doc_id, sqrt(list_dot_product(w, w)) AS norm FROM (SELECT doc_id, [CAST(n_chars AS DOUBLE), length(text) / 2.0] AS w FROM documents)),
z AS (SELECT doc_id, CASE WHEN stddev_pop(norm) OVER () = 0 THEN 0 ELSE (norm - avg(norm) OVER ()) / stddev_pop(norm) OVER () END AS z FROM n) SELECT z.doc_id, round(z, 5) AS z, substr(text, 1, 60) AS preview FROM z JOIN documents d ON d.doc_id = z.doc_id WHERE abs(z) > 2.5""")
def _(t):
    d = t("documents").select("doc_id", F.array(F.col("n_chars").cast("double"), F.length("text") / 2).alias("v"), F.substring("text", 1, 60).alias("preview"))
    return evaluation.norm_anomalies(d, "v").select("doc_id", F.round("z", 5).alias("z"), "preview")


@query("a26_label_coherence", """WITH x AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i) SELECT label, round(sqrt(sum(m * m)), 6) AS centroid_norm FROM c GROUP BY label""")
def _(t):
    x = t("embeddings").select("label", F.posexplode(v.doubles(F.col("embedding"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return x.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("centroid_norm"))


@query("a10_bootstrap")
def _(t):
    """Does ranking within ten neighbours beat ranking within three? Reciprocal ranks of all queries, paired."""
    ten, three = _judged(t, 10).select("query_id", F.col("rr").alias("b")), _judged(t, 3).select("query_id", F.col("rr").alias("a"))
    return evaluation.bootstrapped(three.join(ten, "query_id"), "a", "b")
