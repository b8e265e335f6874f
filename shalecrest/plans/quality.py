"""Quality metrics over chunks and vectors, and their scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shalecrest.functions import text as tx
from shalecrest.functions import vectors as v
from shalecrest.operators import chunking, index, quality, search
from shalecrest.operators.embedding import embedded
from shalecrest.plans.chunks import _WINDOWS, doc_chunks
from shalecrest.plans.registry import query
from shalecrest.plans.retrieval import _BM25, VECTORS, neighbours

_PICK = "SELECT doc_id, text, n_chars, lang, source FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) WHERE n <= {k} OR pos IN (SELECT CAST(floor(i * n / {k}.0) AS BIGINT) FROM generate_series(0, {k} - 1) g(i))"
_COS = "sum(a.x * b.x)"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?' || chr(10) || '])', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: strlen(x) > 10)"


def sample(t, n):
    return index.sampled(t("documents"), "doc_id", n)


@query("q1_cohesion_j13", f"""WITH c AS ({_PICK.format(k=50)}), s AS (SELECT doc_id, unnest(generate_series(1, len({_SENTENCES}))) AS n, unnest({_SENTENCES}) AS text FROM c), k AS (SELECT doc_id, max(n) AS n FROM s GROUP BY doc_id HAVING max(n) > 1),
e AS {VECTORS.format("(SELECT doc_id || ':' || n AS id, text FROM s)")}, x AS (SELECT CAST(string_split(id, ':')[1] AS BIGINT) AS doc_id, CAST(string_split(id, ':')[2] AS BIGINT) AS n, b, x FROM e),
p AS (SELECT a.doc_id, sum(a.x * b.x) AS s FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.n < b.n AND a.b = b.b GROUP BY a.doc_id), m AS (SELECT k.doc_id, coalesce(p.s, 0) / (k.n * (k.n - 1) / 2) AS c FROM k LEFT JOIN p ON p.doc_id = k.doc_id)
SELECT count(*) AS chunks, round(avg(c), 5) AS cohesion, round(least(greatest((avg(c) + 1) / 2, 0), 1), 5) AS normal FROM m""")
def _(t):
    s = sample(t, 50).select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    c = quality.cohesion(embedded(s, "s"), "doc_id", "vector").agg(F.count("*").alias("chunks"), F.avg("cohesion").alias("c"))
    return c.select("chunks", F.round("c", 5).alias("cohesion"), F.round(quality.signed(F.col("c")), 5).alias("normal"))


@query("q2_integrity", "SELECT round(sum(quality) / CAST(sum(quality + toxic + 1) AS DOUBLE), 6) AS integrity FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL")
def _(t):
    # a document's nodes: one, and one for each mark it has; those in bounds are the good ones
    d = t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select((F.col("quality") + F.col("toxic") + 1).alias("nodes"), F.col("quality").alias("inside"))
    both = d.where("nodes is not null and inside is not null").agg(F.sum("inside").alias("a"), F.sum("nodes").alias("b"))
    return both.select(F.round(F.col("a") / F.nullif(F.col("b"), F.lit(0)), 6).alias("integrity"))


@query("q3_coherence_j14", f"""WITH c AS ({_PICK.format(k=100)}), e AS {VECTORS.format("(SELECT doc_id AS id, text FROM c)")}, n AS (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY doc_id) AS z FROM c),
s AS (SELECT n.a, coalesce((SELECT {_COS} FROM e a JOIN e b ON a.b = b.b WHERE a.id = n.a AND b.id = n.z), 0) AS s FROM n WHERE z IS NOT NULL), m AS (SELECT avg(s) AS m FROM s)
SELECT round(m, 5) AS coherence, round(CASE WHEN m <= 0 OR m >= 1 THEN 0 WHEN m < 0.4 THEN m / 0.4 WHEN m <= 0.6 THEN 1 ELSE (1 - m) / 0.4 END, 5) AS normal FROM m""")
def _(t):
    c = quality.coherence(embedded(sample(t, 100).select("doc_id", "text"), "text"), "doc_id", "vector")
    return c.select(F.round("coherence", 5).alias("coherence"), F.round(quality.coherent(F.col("coherence")), 5).alias("normal"))


@query("q4_coverage", f"WITH RECURSIVE {_WINDOWS} SELECT round(avg(CASE WHEN ceil(strlen(text) / 4.0) BETWEEN 50 AND 512 THEN 1.0 ELSE 0 END), 6) AS coverage FROM c")
def _(t):
    return chunking.assembled(doc_chunks(t)).agg(F.round(F.avg(F.col("meta.estimated_tokens").between(50, 512).cast("double")), 6).alias("coverage"))


@query("q5_completeness", f"""WITH RECURSIVE {_WINDOWS}, d AS (SELECT doc_id, chunk, bc, truncated, lag(chunk) OVER w AS p, lead(chunk) OVER w AS n FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk))
SELECT round(sum((len(bc) > 0)::INT + (lang <> 'en')::INT + truncated::INT + (p IS NOT NULL OR n IS NOT NULL)::INT) / (4.0 * count(*)), 6) AS completeness FROM d JOIN documents USING (doc_id)""")
def _(t):
    # breadcrumb, a name (documents that aren't English have one here), imports (cut chunks here) and siblings
    a = chunking.assembled(doc_chunks(t)).join(t("documents").select("doc_id", "lang"), "doc_id")
    has = [F.size("crumb") > 0, F.col("lang") != "en", F.col("truncated"), F.size("siblings") > 0]
    return a.agg(F.round(sum((F.sum(h.cast("int")) for h in has[1:]), F.sum(has[0].cast("int"))) / (4 * F.count("*")), 6).alias("completeness"))


@query("q6_breadcrumbs", f"""WITH RECURSIVE {_WINDOWS}, m AS (SELECT doc_id, max(len(bc)) AS longest, count(*) AS n FROM c GROUP BY doc_id), e AS (SELECT doc_id, unnest(generate_series(1, len(bc))) AS i, unnest(bc) AS v FROM c),
sm AS (SELECT e.doc_id, i, count(*) = max(m.n) AND count(DISTINCT v) = 1 AS same FROM e JOIN m ON m.doc_id = e.doc_id GROUP BY e.doc_id, i), fc AS (SELECT doc_id, min(i) - 1 AS common FROM sm WHERE NOT same GROUP BY doc_id)
SELECT round(avg(CASE WHEN longest = 0 THEN 1.0 ELSE coalesce(common, longest) / CAST(longest AS DOUBLE) END), 6) AS consistency FROM m LEFT JOIN fc ON fc.doc_id = m.doc_id""")
def _(t):
    return quality.breadcrumb_consistency(doc_chunks(t).select("doc_id", "crumb"), "doc_id", "crumb").select(F.round("consistency", 6).alias("consistency"))


@query("q7_q8_names_imports", """WITH x AS (SELECT role, conv_id, turn, text FROM conversations), c AS (SELECT count(*) FILTER (role <> 'user') AS code, count(*) FILTER (role <> 'user' AND contains(text, '.')) AS named, sum(strlen(text)) AS total, sum(strlen(replace(text, ' ', ''))) AS resolved FROM x)
SELECT round(named / CAST(nullif(code, 0) AS DOUBLE), 6) AS names, round(resolved / CAST(total AS DOUBLE), 6) AS imports, resolved / total > 0.70 AS passed FROM c""")
def _(t):
    # of turns other than the user's those with a full stop are named; of all characters those that aren't spaces are resolved
    code = F.col("role") != "user"
    a = t("conversations").agg(F.count_if(code).alias("code"), F.count_if(code & F.contains("text", F.lit("."))).alias("named"), F.sum(F.octet_length("text")).alias("total"), F.sum(F.octet_length(F.replace("text", F.lit(" "), F.lit("")))).alias("resolved"))
    share = F.col("resolved") / F.col("total")
    return a.select(F.round(F.col("named") / F.nullif(F.col("code"), F.lit(0)), 6).alias("names"), F.round(share, 6).alias("imports"), (share > 0.70).alias("passed"))


_HALF = "substr(text, 1, length(text) // 2)"


@query("q11_enrichment", f"""WITH c AS ({_PICK.format(k=100)}), a AS {VECTORS.format("(SELECT doc_id AS id, text FROM c)")}, b AS {VECTORS.format(f"(SELECT doc_id AS id, {_HALF} AS text FROM c)")},
s AS (SELECT c.doc_id, coalesce(sum(a.x * b.x), 0) AS s FROM c LEFT JOIN a ON a.id = c.doc_id LEFT JOIN b ON b.id = c.doc_id AND b.b = a.b WHERE c.text <> {_HALF} GROUP BY c.doc_id) SELECT count(*) AS n, round(avg(s), 5) AS enrichment FROM s""")
def _(t):
    c = sample(t, 100).select("doc_id", "text", F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("half")).where("text <> half")
    e = embedded(embedded(c, "text", "a"), "half", "b")
    return e.agg(F.count("*").alias("n"), F.round(F.avg(v.cosine(F.col("a"), F.col("b"))), 5).alias("enrichment"))


@query("q12_self_recall", f"""WITH c AS ({_PICK.format(k=100)}), d AS {VECTORS.format("(SELECT doc_id AS id, text FROM documents)")}, q AS {VECTORS.format("(SELECT doc_id AS id, substr(text, 1, 80) AS text FROM c)")},
s AS (SELECT q.id AS query_id, d.id, round(sum(q.x * d.x), 9) AS sim FROM q JOIN d ON d.b = q.b GROUP BY q.id, d.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
SELECT round(count(*) FILTER (query_id = id AND rank <= 10) / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS recall FROM r""")
def _(t):
    docs = embedded(t("documents").select("doc_id", "text"), "text").select("doc_id", "vector")
    c = sample(t, 100).select("doc_id", F.substring("text", 1, 80).alias("text"))
    n = c.count()
    found = search.knn(embedded(c, "text").select("doc_id", "vector"), docs, 20, "doc_id", "vector", exclude_self=False)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("at", F.row_number().over(w)).where("at <= 10 and id = query_id").agg(F.round(F.count("*") / F.lit(n), 6).alias("recall"))


_VEC = "WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings) WHERE n <= 100 OR pos IN (SELECT CAST(floor(i * n / 100.0) AS BIGINT) FROM generate_series(0, 99) g(i))), d AS (SELECT a.vec_id, list_distance(a.e, b.e) AS d FROM c a JOIN c b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM d)"


def near(t, k):
    return quality.nearest(index.sampled(t("embeddings").select("vec_id", "embedding"), "vec_id", 100), "vec_id", "embedding", k)


@query("q14_uniformity_j12", _VEC + ", u AS (SELECT least(greatest(1 - stddev_pop(d) / avg(d), 0), 1) AS u FROM r WHERE r = 5) SELECT round(u, 5) AS uniformity, round(CASE WHEN u <= 0 OR u >= 1 THEN 0 WHEN u < 0.7 THEN u / 0.7 WHEN u <= 0.85 THEN 1 ELSE (1 - u) / 0.15 END, 5) AS normal FROM u")
def _(t):
    u = quality.uniformity(near(t, 5))
    return u.select(F.round("uniformity", 5).alias("uniformity"), F.round(quality.uniform(F.col("uniformity")), 5).alias("normal"))


@query("q16_outlier_fraction", _VEC + ", x AS (SELECT d FROM r WHERE r = 1), m AS (SELECT median(d) AS m FROM x), a AS (SELECT d, m, median(abs(d - m)) OVER () AS mad FROM x, m) SELECT round(avg(CASE WHEN d > m + 3 * mad THEN 1.0 ELSE 0 END), 6) AS fraction, avg(CASE WHEN d > m + 3 * mad THEN 1.0 ELSE 0 END) < 0.05 AS passed FROM a")
def _(t):
    return quality.outliers(near(t, 1)).select(F.round("fraction", 6).alias("fraction"), (F.col("fraction") < 0.05).alias("passed"))


@query("q31_embedding_metrics", _VEC + """, w AS (SELECT vec_id, max(d) FILTER (r = 1) AS d1, max(d) FILTER (r = 2) AS d2 FROM r GROUP BY vec_id), n AS (SELECT sqrt(list_dot_product(e, e)) AS n FROM c), z AS (SELECT CASE WHEN stddev_pop(n) OVER () < 1e-6 THEN 0 ELSE abs(n - avg(n) OVER ()) / stddev_pop(n) OVER () END AS z FROM n)
SELECT round(-count(*) / sum(ln(d1 / d2)), 4) AS dimension, (SELECT round(avg(CASE WHEN z > 2.5 THEN 1.0 ELSE 0 END), 6) FROM z) AS outliers, (SELECT round(avg(list_cosine_similarity(a.e, b.e)), 5) FROM c a JOIN c b ON a.vec_id < b.vec_id) AS mean_cosine FROM w WHERE d1 > 0 AND d1 < d2""")
def _(t):
    e = index.sampled(t("embeddings").select("vec_id", "embedding"), "vec_id", 100).select("vec_id", v.normalized(F.col("embedding")).alias("u"), v.norm(F.col("embedding")).alias("n")).withColumn("all_", F.lit(1))
    z = F.abs(F.col("n") - F.avg("n").over(Window.partitionBy("all_"))) / F.nullif(F.stddev_pop("n").over(Window.partitionBy("all_")), F.lit(0.0))
    far = e.withColumn("z", F.when(F.stddev_pop("n").over(Window.partitionBy("all_")) < 1e-6, 0.0).otherwise(z)).agg(F.round(F.avg((F.col("z") > 2.5).cast("double")), 6).alias("outliers"))
    # of all pairs of the sample rather than of random ones
    return quality.two_nn(near(t, 2)).select(F.round("dimension", 4).alias("dimension")).crossJoin(far).crossJoin(quality.cohesion(e, "all_", "u").select(F.round("cohesion", 5).alias("mean_cosine")))


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP)
_UNIQUE = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) > 2))"


@query("q17_term_coverage", f"""WITH d AS (SELECT doc_id, {_UNIQUE} AS w FROM documents) SELECT round(avg(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: x NOT IN ({_STOPS}))) / CAST(len(w) AS DOUBLE) END), 6) AS coverage FROM d""")
def _(t):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) > 2))
    d = t("documents").select(w.alias("w"))
    return d.agg(F.round(F.avg(F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.array_except("w", F.array(*map(F.lit, quality.STOP)))) / F.size("w"))), 6).alias("coverage"))


@query("q18_term_sparsity", f"""WITH b AS (SELECT DISTINCT unnest({_UNIQUE}) AS term FROM benchmark), f AS (SELECT DISTINCT unnest({_UNIQUE}) AS term FROM documents WHERE lang = 'en') SELECT count(*) AS terms, round(avg(CASE WHEN b.term IN (SELECT term FROM f) THEN 0.0 ELSE 1 END), 6) AS sparsity FROM b""")
def _(t):
    terms = lambda d: d.select(F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) > 2)).alias("term")).distinct()
    # the passages' terms against the frequencies of the English documents
    j = terms(t("benchmark")).join(terms(t("documents").where("lang = 'en'")).withColumn("there", F.lit(1)), "term", "left")
    return j.agg(F.count("*").alias("terms"), F.round(F.avg(F.col("there").isNull().cast("double")), 6).alias("sparsity"))


_LEX = _BM25.replace("FROM benchmark)", "FROM asked)").replace("SELECT item_id, unnest", "SELECT doc_id AS item_id, unnest").replace("WITH d AS", f"WITH asked AS (SELECT doc_id, substr(text, 1, 80) AS text FROM ({_PICK.format(k=100)})), d AS")


@query("q19_lexical_recall", _LEX + " SELECT round(count(*) FILTER (query_id = doc_id AND rank <= 10) / CAST((SELECT count(*) FROM asked) AS DOUBLE), 6) AS recall FROM sr")
def _(t):
    c = sample(t, 100).select("doc_id", F.substring("text", 1, 80).alias("text"))
    found = search.bm25(c, t("documents"), 10, "doc_id", "doc_id")
    return found.where("query_id = doc_id").agg(F.round(F.count("*") / F.lit(c.count()), 6).alias("recall"))


@query("q20_q23_reranker_inputs", """WITH j AS (SELECT e.vec_id, CASE WHEN l.quality = 1 THEN d.n_chars / 100.0 END AS s, CAST(e.embedding AS DOUBLE[]) AS v, CASE WHEN d.lang = 'en' THEN d.text END AS meta, CASE WHEN l.toxic = 1 THEN d.doc_id + 1 WHEN d.lang = 'fr' THEN d.doc_id END AS src, d.doc_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
k AS (SELECT *, coalesce(s, 0) AS s0, list_sum(list_transform(v, lambda x: abs(x))) AS a, sqrt(list_dot_product(v, v)) * CASE WHEN s IS NULL THEN 1 ELSE 2 END AS n FROM j)
SELECT round(sum((s IS NOT NULL)::INT + (v IS NOT NULL)::INT + (meta IS NOT NULL)::INT) / (3.0 * count(*)), 6) AS completeness, round(least(stddev_pop(s0), stddev_pop(a * CASE WHEN s IS NULL THEN 1 ELSE 2 END)) / greatest(stddev_pop(s0), stddev_pop(a * CASE WHEN s IS NULL THEN 1 ELSE 2 END)), 6) AS ablation,
  round(abs(corr(s0, n)), 5) AS redundancy, round(avg(CASE WHEN src IS NULL OR src = doc_id THEN 1.0 ELSE 0 END), 6) AS consistency FROM k""")
def _(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    j = t("embeddings").join(d, F.col("vec_id") == F.col("doc_id")).select(
        "doc_id",
        F.when(F.col("quality") == 1, F.col("n_chars") / 100).alias("s"),
        F.when(F.col("quality") == 1, F.transform(v.doubles(F.col("embedding")), lambda x: x * 2)).otherwise(v.doubles(F.col("embedding"))).alias("v"),
        F.when(F.col("lang") == "en", F.col("text")).alias("meta"),
        F.when(F.col("toxic") == 1, F.col("doc_id") + 1).when(F.col("lang") == "fr", F.col("doc_id")).alias("src"),
    )
    full = j.agg(F.round((F.count("s") + F.count("v") + F.count("meta")) / (3 * F.count("*")), 6).alias("completeness"), F.round(F.avg((F.col("src").isNull() | (F.col("src") == F.col("doc_id"))).cast("double")), 6).alias("consistency"))
    return full.crossJoin(quality.feature_ablation(j, "s", "v").select(F.round("ablation", 6).alias("ablation"), F.round("redundancy", 5).alias("redundancy")))


_RANKS = "x AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label = b.label AS rel, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS sim, abs(a.label - b.label) AS gap FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM x), k AS (SELECT *, round(1 / (1 + exp(-(sim - gap / 4.0))), 9) AS score FROM r WHERE rank <= 25), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS spot FROM k)"


@query("q24_q26_reranker", f"""WITH {_RANKS}, m AS (SELECT query_id, coalesce(1.0 / min(CASE WHEN rel THEN spot END), 0) AS a, coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0) AS b FROM n GROUP BY query_id), t AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn FROM k)
SELECT (SELECT round(avg(a) - avg(b), 6) FROM m) AS uplift, (SELECT round(least(greatest(1 - abs(avg(score) - 0.5) - abs(stddev_pop(score) - 0.25), 0), 1), 6) FROM k) AS calibration, (SELECT round(greatest(avg(score) FILTER (rn <= 5) - avg(score) FILTER (rn BETWEEN 6 AND 25), 0), 6) FROM t) AS gap""")
def _(t):
    e = t("embeddings")
    r = neighbours(t, 25).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("lb")), "id")
    scored = r.withColumn("score", F.round(tx.sigmoid(F.col("similarity") - F.abs(F.col("la") - F.col("lb")) / 4), 9))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))
    rel = F.col("la") == F.col("lb")
    both = scored.withColumn("at", at).groupBy("query_id").agg(F.coalesce(1 / F.min(F.when(rel, F.col("at"))), F.lit(0.0)).alias("a"), F.coalesce(1 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("b")).agg(F.avg("a"), F.avg("b")).first()
    return quality.reranker(scored, "score", F.lit(both[0]), F.lit(both[1])).select(*[F.round(c, 6).alias(c) for c in ("uplift", "calibration", "gap")])


_BAND = "CASE WHEN x <= 0 OR x >= 1 THEN 0 WHEN x < {0} THEN x / {0} WHEN x <= {1} THEN 1 ELSE (1 - x) / (1 - {1}) END"


@query("q27_normalizers", f"""WITH v AS (SELECT event_id, value / 100 - 0.3 AS x FROM events) SELECT event_id, round(least(greatest(x, 0), 1), 6) AS up, round(least(greatest((x + 1) / 2, 0), 1), 6) AS signed, round(least(greatest(1 - x, 0), 1), 6) AS down, round({_BAND.format(0.7, 0.9)}, 6) AS intrinsic, round({_BAND.format(0.7, 0.85)}, 6) AS uniform, round({_BAND.format(0.4, 0.6)}, 6) AS coherent, round(least(greatest(1 - abs(x - 0.5) - abs(x / 2 - 0.25), 0), 1), 6) AS calibrated FROM v""")
def _(t):
    x = F.col("x")
    n = {"up": quality.clamped(x), "signed": quality.signed(x), "down": quality.falling(x), "intrinsic": quality.intrinsic(x), "uniform": quality.uniform(x), "coherent": quality.coherent(x), "calibrated": quality.calibrated(x, x / 2)}
    return t("events").select("event_id", (F.col("value") / 100 - 0.3).alias("x")).select("event_id", *[F.round(c, 6).alias(k) for k, c in n.items()])


@query("q28_q30_scoring", """WITH m(component, metric, value, weight, skipped, must, bar) AS (VALUES ('a', 'long', (SELECT avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0 END) FROM documents), 2.0, false, true, 0.5), ('a', 'good', (SELECT avg(quality) FROM labels), 1.0, false, true, 0.8), ('a', 'none', 0.0, 3.0, true, false, 0.0),
  ('b', 'clean', (SELECT 1 - avg(toxic) FROM labels), 1.5, false, false, 0.0), ('b', 'english', (SELECT avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) FROM documents), 0.5, false, false, 0.0), ('c', 'no model', 0.0, 2.0, true, false, 0.0)),
c AS (SELECT component, coalesce(sum(value * weight) FILTER (NOT skipped) / sum(weight) FILTER (NOT skipped), 0) AS score, coalesce(sum(weight) FILTER (NOT skipped), 0) AS w, bool_and(skipped) AS skipped FROM m GROUP BY component), o AS (SELECT sum(score * w) FILTER (NOT skipped) / sum(w) FILTER (NOT skipped) AS overall FROM c), g AS (SELECT bool_and(value > bar) AS ok FROM m WHERE must)
SELECT round(overall, 6) AS overall, overall >= 0.70 AND ok AS passed, CASE WHEN NOT (overall >= 0.70 AND ok) THEN 'red' WHEN round(overall * 100) >= 80 THEN 'brightgreen' WHEN round(overall * 100) >= 70 THEN 'green' WHEN round(overall * 100) >= 55 THEN 'yellow' ELSE 'orange' END AS badge FROM o, g""")
def _(t):
    docs = t("documents").agg(F.avg((F.col("n_chars") >= 500).cast("double")).alias("long"), F.avg((F.col("lang") == "en").cast("double")).alias("english"))
    lab = t("labels").agg(F.avg("quality").alias("good"), (1 - F.avg("toxic")).alias("clean"))
    rows = [("a", F.col("long"), 2.0, False, True, 0.5), ("a", F.col("good"), 1.0, False, True, 0.8), ("a", F.lit(0.0), 3.0, True, False, 0.0), ("b", F.col("clean"), 1.5, False, False, 0.0), ("b", F.col("english"), 0.5, False, False, 0.0), ("c", F.lit(0.0), 2.0, True, False, 0.0)]
    m = docs.crossJoin(lab).select(F.inline(F.array(*[F.struct(F.lit(c).alias("component"), x.alias("value"), F.lit(w).alias("weight"), F.lit(s).alias("skipped"), F.lit(must).alias("must"), F.lit(bar).alias("bar")) for c, x, w, s, must, bar in rows])))
    o = quality.means(quality.means(m, "component"), None, "score", "weight", "skipped")
    g = m.where("must").agg(F.bool_and(F.col("value") > F.col("bar")).alias("ok"))
    s = F.col("score")
    passed = (s >= 0.70) & F.col("ok")
    return o.crossJoin(g).select(F.round(s, 6).alias("overall"), passed.alias("passed"), quality.badge(s, passed).alias("badge"))


@query("q13_q15_spectrum")
def _(t):
    """Intrinsic dimension (share of axes for 95 % of the variance) and isotropy (least over greatest of the leading eigenvalues)."""
    n, iso = quality.spectrum(t("embeddings"), "embedding")
    return t("embeddings").sparkSession.createDataFrame([(round(n, 6), round(iso, 6))], "intrinsic_dimension double, isotropy double")


@query("q32_v9_scatter")
def _(t):
    """Points on the two principal axes, with what a reader sees of each; tests hold them against the singular value decomposition."""
    e = quality.projected(t("embeddings"), "embedding").join(t("documents").select(F.col("doc_id").alias("vec_id"), "source", "lang", F.substring("text", 1, 60).alias("preview")), "vec_id", "left")
    return e.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.col("source").alias("file"), F.col("lang").alias("ext"), "preview")
