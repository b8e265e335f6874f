"""Chunks, labels, index maintenance and quality over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shalecrest.functions.text import checked_tags, chunk_id, token_estimate, words
from shalecrest.operators import chunking, index, rules
from shalecrest.plans.registry import query

_PARTS = """x AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS part, regexp_matches(text, '\\A\\s*\\z') AS whole FROM documents),
y AS (SELECT doc_id, pos, part, whole, CASE WHEN whole THEN part ELSE regexp_replace(part, '^\\s+|\\s+$', '', 'g') END AS text FROM x WHERE NOT whole OR pos = 1),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq, text,
  CAST(coalesce(sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM y WHERE text <> '' OR whole)"""


def lines(t, nested=False):
    """The documents' lines that aren't blank."""
    return chunking.paragraphs(t("documents"), "\n", nested=nested)


_TOKENS = "CAST(ceil(strlen(text) / 4.0) AS BIGINT)"


_TWO = _PARTS.replace("string_split(text, chr(10))", "string_split(text, chr(10) || chr(10))").replace("strlen(part) + 1", "strlen(part) + 2").replace("FROM documents", "FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents)")


@query("p2_paragraphs", f"WITH {_TWO} SELECT doc_id, seq, text, start FROM p")
def _(t):
    docs = t("documents").withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\n\n")))
    return chunking.paragraphs(docs).select("doc_id", F.col("seq").cast("long").alias("seq"), "text", F.col("start").cast("long").alias("start"))


@query("c5_packed_chunks", f"""WITH RECURSIVE {_PARTS},
n AS (SELECT doc_id, seq, text, {_TOKENS} AS n FROM p),
f AS (SELECT doc_id, seq, 0 AS chunk, n AS held FROM n WHERE seq = 0
  UNION ALL SELECT n.doc_id, n.seq, CASE WHEN f.held + n.n <= 256 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.held + n.n <= 256 THEN f.held + n.n ELSE n.n END FROM f JOIN n ON n.doc_id = f.doc_id AND n.seq = f.seq + 1)
SELECT f.doc_id, CAST(f.chunk AS BIGINT) AS chunk, CAST(min(f.seq) AS BIGINT) AS "first", CAST(max(f.seq) AS BIGINT) AS "last", CAST(sum(n.n) AS BIGINT) AS n_tokens FROM f JOIN n ON n.doc_id = f.doc_id AND n.seq = f.seq GROUP BY f.doc_id, f.chunk""")
def _(t):
    return chunking.pack(lines(t), 256, in_order=True).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk", "first", "last", "n_tokens")])


@query("c12_sibling_links", f"""WITH {_PARTS}, h AS (SELECT doc_id, seq, substr(sha256(text), 1, 16) AS id FROM p)
SELECT doc_id, seq, id, lag(id) OVER w AS prev, lead(id) OVER w AS next, count(*) OVER (PARTITION BY doc_id) AS total FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""")
def _(t):
    return chunking.linked(lines(t), "seq").select("doc_id", F.col("seq").cast("long").alias("seq"), "id", "prev", "next", "total")


@query("r18_context", f"""WITH {_PARTS}, w AS (SELECT doc_id, seq, text, lag(text) OVER (PARTITION BY doc_id ORDER BY seq) AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM p)
SELECT doc_id, seq, length(concat_ws(chr(10) || '---' || chr(10), a, text, b)) AS n FROM w WHERE a IS NOT NULL OR b IS NOT NULL""")
def _(t):
    p = chunking.paragraphs(t("documents"), "\n", around=True).where("before is not null or after is not null")
    return p.select("doc_id", F.col("seq").cast("long").alias("seq"), F.length(F.concat_ws("\n---\n", "before", "text", "after")).cast("long").alias("n"))


@query("a12_cohesion_report", f"""WITH {_PARTS} SELECT d.lang, count(*) AS n, CAST(round(avg(length(p.text))) AS BIGINT) AS avg_length, round(avg(CASE WHEN regexp_matches(p.text, '[.!?]\\s*$') THEN 1.0 ELSE 0 END), 6) AS sentence_ends FROM p JOIN documents d USING (doc_id) GROUP BY d.lang""")
def _(t):
    # a document's lines are counted before its language is joined, so that no text is shuffled
    own = lines(t).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"), F.count_if(F.col("text").rlike(r"[.!?\n]\s*$")).alias("ends"))
    p = own.join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "size", "ends")])
    return p.select("lang", "n", F.round(F.col("size") / F.col("n")).cast("long").alias("avg_length"), F.round(F.col("ends") / F.col("n"), 6).alias("sentence_ends"))


@query("a13_size_histogram", f"""WITH {_PARTS}, b(lo, hi) AS (VALUES (0, 200), (200, 500), (500, 1000), (1000, 2000), (2000, 2000000000))
SELECT CAST(lo AS BIGINT) AS lo, count(p.doc_id) AS n FROM b LEFT JOIN p ON length(p.text) >= lo AND length(p.text) < hi GROUP BY lo""")
def _(t):
    n = F.length("text")
    lo = F.when(n < 200, 0).when(n < 500, 200).when(n < 1000, 500).when(n < 2000, 1000).otherwise(2000)
    counts = lines(t).groupBy(lo.cast("long").alias("lo")).agg(F.count("*").alias("n"))
    buckets = t("documents").sparkSession.createDataFrame([(x,) for x in (0, 200, 500, 1000, 2000)], "lo long")
    return buckets.join(counts, "lo", "left").select("lo", F.coalesce("n", F.lit(0)).alias("n"))


@query("c3_a23_tokens", f"SELECT lang, CAST(sum({_TOKENS}) AS BIGINT) AS n_tokens, max({_TOKENS}) AS most FROM documents GROUP BY lang")
def _(t):
    n = token_estimate(F.col("text"))
    return t("documents").groupBy("lang").agg(F.sum(n).alias("n_tokens"), F.max(n).alias("most"))


@query("u2_first_wins_c10_ids", "SELECT id, doc_id FROM (SELECT substr(sha256(text), 1, 16) AS id, doc_id, row_number() OVER (PARTITION BY substr(sha256(text), 1, 16) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1")
def _(t):
    return index.first_wins(t("documents").select(chunk_id(F.col("text")).alias("id"), "doc_id", "source"), ["id"], ["source", "doc_id"]).select("id", "doc_id")


def _paths(t):
    return t("documents").select("doc_id", "source", F.concat_ws("/", F.lit("src"), "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang")).alias("path"))


_PATHS = "p AS (SELECT doc_id, source, 'src/' || source || '/' || doc_id || '.' || lang AS path FROM documents)"


@query("f1_f10_label_rules_j4", f"""WITH {_PATHS} SELECT doc_id, path, array_to_string(list_filter([CASE WHEN regexp_matches(path, '^src/src1.*$') THEN 'one' END, CASE WHEN regexp_matches(path, '^.*\\.(en|fr)$') THEN 'west' END,
  CASE WHEN regexp_matches(path, '^src/src.$') OR regexp_matches(path, '^src/src./.*$') THEN 'short' END], lambda x: x IS NOT NULL), ',') AS labels FROM p""")
def _(t):
    out = rules.labels(_paths(t), [("src/src1*", ["one"]), ("**/*.{en,fr}", ["west"]), ("src/src?", ["short"])])
    return out.select("doc_id", "path", F.array_join("labels", ",").alias("labels"))


@query("f11_owners", f"""WITH {_PATHS} SELECT doc_id, CASE WHEN regexp_matches(path, '^src/src7/.*$') THEN 'team:core,owner:ann' WHEN regexp_matches(path, '\\.de$') THEN 'owner:ben' ELSE 'team:all' END AS owners FROM p""")
def _(t):
    return rules.owners(_paths(t), [("*", ["@org/all"]), ("*.de", ["@ben"]), ("/src/src7/", ["@org/core", "@ann"])]).select("doc_id", F.array_join("owners", ",").alias("owners"))


@query("f2_include_ignore_f8_path", f"WITH {_PATHS} SELECT doc_id, path FROM p WHERE regexp_matches(path, '\\.(en|de)$') AND NOT regexp_matches(path, '^src/src1/') AND contains(lower(path), 'src1')")
def _(t):
    from shalecrest.functions.text import glob_regex

    p = F.col("path")
    return _paths(t).where(p.rlike(glob_regex("**/*.{en,de}")) & ~p.rlike(glob_regex("src/src1")) & F.contains(F.lower(p), F.lit("src1"))).select("doc_id", "path")


@query("f3_f4_tag_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'es') OR source IN ('src3')")
def _(t):
    wanted = checked_tags(["en", "es", "src3"])
    return t("documents").where(F.arrays_overlap(F.array("lang", "source"), F.array(*map(F.lit, wanted)))).select("doc_id", "lang")


@query("f15_qualified_keys", "SELECT doc_id, CASE WHEN (SELECT count(DISTINCT source) FROM documents) > 1 THEN source || ':' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS key FROM documents")
def _(t):
    n = t("documents").agg(F.count_distinct("source").alias("n"))
    return t("documents").crossJoin(F.broadcast(n)).select("doc_id", F.when(F.col("n") > 1, F.concat_ws(":", "source", F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("key"))


@query("f16_seen_filter", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left_anti")


@query("f17_token_budget", f"""WITH r AS (SELECT source, doc_id, row_number() OVER w AS rank, sum(least({_TOKENS}, 200)) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, rank FROM r WHERE used <= 2000 OR rank = 1""")
def _(t):
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    r = t("documents").select("source", "doc_id", F.row_number().over(w).cast("long").alias("rank"), F.sum(F.least(token_estimate(F.col("text")), F.lit(200))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return r.where("used <= 2000 or rank = 1").drop("used")


@query("j1_j2_full_diff", """SELECT coalesce(d.doc_id, l.k) AS doc_id, CASE WHEN l.k IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'deleted' WHEN d.n_chars % 2 = l.r THEN 'unchanged' ELSE 'changed' END AS status
FROM documents d FULL OUTER JOIN (SELECT doc_id * 2 AS k, quality AS r FROM labels) l ON d.doc_id = l.k""")
def _(t):
    current = t("documents").select("doc_id", (F.col("n_chars") % 2).alias("r"))
    known = t("labels").select((F.col("doc_id") * 2).alias("doc_id"), F.col("quality").cast("long").alias("r"))
    return index.diff(current, known, "doc_id", "r")


@query("j3_deleted_u7_guard", "SELECT count(*) AS deleted, count(*) >= 10 AND 2 * count(*) >= (SELECT count(*) FROM customer) AS refused FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    gone = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("deleted"))
    return gone.crossJoin(t("customer").agg(F.count("*").alias("n"))).select("deleted", ((F.col("deleted") >= 10) & (2 * F.col("deleted") >= F.col("n"))).alias("refused"))


@query("j5_existing_ids", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t("documents").select("doc_id").join(t("labels").where("quality = 1"), "doc_id", "left_semi")


@query("j7_orphans", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderstatus = 'F' AND k.o_custkey = o.o_custkey AND k.o_orderkey = o.o_orderkey)")
def _(t):
    stored = t("orders").select("o_orderkey", "o_custkey")
    return index.orphans(stored, t("orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query("u3_insert_or_ignore", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return index.insert_or_ignore(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")


@query("u6_current_state", "SELECT source, max(doc_id) AS latest FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.max("doc_id").alias("latest"))


@query("u10_all_or_nothing", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING min(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_and(F.col("o_orderstatus") == "O").alias("ok")).where("ok").select("o_custkey", "n")


@query("s18_pruned_history", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 100")
def _(t):
    return index.pruned(t("events").select("event_type", "event_id"), "event_type", "event_id", 100)


@query("q10_text_purity", "SELECT lang, round(avg(length(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g')) / CAST(length(text) AS DOUBLE)), 6) AS purity FROM documents WHERE length(text) > 0 GROUP BY lang")
def _(t):
    x = F.col("text")
    return t("documents").where(F.length(x) > 0).groupBy("lang").agg(F.round(F.avg(F.length(F.regexp_replace(x, r"[\x00-\x1F\x7F]", "")) / F.length(x)), 6).alias("purity"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query("a26_information_density", f"SELECT doc_id, len(w) AS n, round(len(list_distinct(w)) / CAST(greatest(len(w), 1) AS DOUBLE), 6) AS density FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def _(t):
    d = t("documents").select("doc_id", words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.round(F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1)), 6).alias("density"))


@query("a17_top_terms", f"SELECT lang, term, n, rank FROM (SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rank FROM (SELECT lang, unnest({_WORDS}) AS term FROM documents) GROUP BY lang, term) WHERE rank <= 10")
def _(t):
    c = t("documents").select("lang", F.explode(words(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return c.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")
