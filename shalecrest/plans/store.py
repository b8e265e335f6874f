"""The stored index, its changes, labels of files, and text functions."""

from __future__ import annotations

import json
import os
import subprocess
import uuid
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from shalecrest import serving
from shalecrest.functions import text as tx
from shalecrest.operators import evaluation, index, rules
from shalecrest.operators.embedding import embedded
from shalecrest.plans.chunks import _NAMED, _WINDOWS, doc_chunks, named
from shalecrest.plans.registry import query
from shalecrest.plans.retrieval import VECTORS
from shalecrest.sources import readers
from shalecrest.streaming.events import shared

_ID = "substr(sha256(text), 1, 16)"


def place(t, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared(t('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path at which git finds a folder; the shared one must be mounted, git reads no object store."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"git can't read {path}")
    return parts.path


@query("u1_upsert", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    base = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return index.upsert(base, new, "id")


def _stored(t):
    """What is stored: the documents that are judged, with the judgement as their revision."""
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "source", "lang", "n_chars", F.substring(F.sha2("text", 256), 1, 16).alias("id"), "quality", "toxic")


_STORED = f"s AS (SELECT d.doc_id, source, lang, n_chars, {_ID} AS id, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query("j6_to_embed", f"""WITH {_STORED}, c AS (SELECT doc_id, source || ':' || n_chars AS file, {_ID} AS id FROM documents), k AS (SELECT source || ':' || n_chars AS file, id FROM s),
a AS (SELECT file, list_sort(list(DISTINCT id)) AS ids FROM c GROUP BY file), b AS (SELECT file, list_sort(list(DISTINCT id)) AS ids FROM k GROUP BY file)
SELECT doc_id FROM c WHERE file NOT IN (SELECT a.file FROM a JOIN b ON a.file = b.file AND a.ids = b.ids) AND id NOT IN (SELECT id FROM k)""")
def _(t):
    file = F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("file")
    current = t("documents").select("doc_id", file, F.substring(F.sha2("text", 256), 1, 16).alias("id"))
    return index.to_embed(current, _stored(t).select(file, "id"), "file", "id").select("doc_id")


@query("j8_delete_by_source", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents d JOIN labels l USING (doc_id) GROUP BY source HAVING sum(toxic) > 2)")
def _(t):
    gone = _stored(t).groupBy("source").agg(F.sum("toxic").alias("n")).where("n > 2")
    return index.without_sources(t("documents").select("doc_id", "source"), gone, "source")


@query("j9_upload_diff", f"""WITH {_STORED} SELECT coalesce(d.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN s.quality = 1 THEN 'unchanged' ELSE 'changed' END AS status FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""")
def _(t):
    current = t("documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("commit"))
    known = _stored(t).select("doc_id", F.when(F.col("quality") == 1, F.col("id")).otherwise("old").alias("commit"))
    return index.diff(current, known, "doc_id", "commit")


@query("u9_dry_run", f"""WITH {_STORED} SELECT CASE WHEN s.doc_id IS NULL THEN 'new' WHEN s.quality = 1 THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    current = t("documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("commit"))
    known = _stored(t).select("doc_id", F.when(F.col("quality") == 1, F.col("id")).otherwise("old").alias("commit"))
    return index.dry_run(current, known, "doc_id", "commit")


_GRAM = 8


def containing(passages, docs):
    """(item_id, doc_id) of the documents that a passage's text is in.

    The words inside a passage are whole words of a document that has it, so eight of them in a row lead to the documents;
    only these are searched for the text. Passages of fewer words are looked for in each document.
    """
    inner = lambda c: F.slice(F.split(F.col(c), r"[^\p{L}\p{N}]+", -1), 2, F.greatest(F.size(F.split(F.col(c), r"[^\p{L}\p{N}]+", -1)) - 2, F.lit(0)))
    p = passages.select("item_id", F.col("text").alias("passage")).withColumn("w", inner("passage"))
    long = p.where(F.size("w") >= _GRAM).select("item_id", "passage", F.xxhash64(F.slice("w", 1, _GRAM)).alias("gram"))
    words = docs.select("doc_id", F.split("text", r"[^\p{L}\p{N}]+", -1).alias("w"))
    grams = words.where(F.size("w") >= _GRAM).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - _GRAM + 1), lambda i: F.xxhash64(F.slice("w", i, _GRAM))))).alias("gram"))
    near = grams.join(long.select("gram", "item_id"), "gram").select("doc_id", "item_id").distinct()
    found = near.join(long.select("item_id", "passage"), "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains(F.col("text"), F.col("passage"))).select("item_id", "doc_id")
    short = p.where(F.size("w") < _GRAM)
    if short.isEmpty():
        return found.distinct()
    return found.unionByName(docs.join(short, F.contains(F.col("text"), F.col("passage"))).select("item_id", "doc_id")).distinct()


@query("j10_relevant", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) UNION SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON b.item_id = d.doc_id")
def _(t):
    named_ids = t("benchmark").join(t("documents"), F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id")
    return containing(t("benchmark"), t("documents")).unionByName(named_ids).distinct()


@query("j15_q9_sibling_integrity", f"""WITH RECURSIVE {_WINDOWS}, d AS (SELECT doc_id, chunk, substr(sha256(CASE WHEN len(bc) > 0 THEN array_to_string(bc, ' › ') || '. ' || text ELSE text END), 1, 16) AS id FROM c),
l AS (SELECT doc_id, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)), lk AS (SELECT prev AS k FROM l WHERE prev IS NOT NULL UNION ALL SELECT next FROM l WHERE next IS NOT NULL),
good AS (SELECT id FROM d JOIN labels USING (doc_id) WHERE quality = 1) SELECT count(*) AS links, count(*) FILTER (k IN (SELECT id FROM good)) AS found, round(count(*) FILTER (k IN (SELECT id FROM good)) / CAST(count(*) AS DOUBLE), 6) AS integrity FROM lk""")
def _(t):
    from shalecrest.operators import chunking

    # of the chunks only those of good documents are in the index
    good = t("labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    chunks = chunking.assembled(doc_chunks(t, nested=True)).join(good, "doc_id", "left")
    # a chunk and its links in one pass: each with whether it is in the index, and how many links it is
    at = lambda id, there, n: F.struct(F.col(id).alias("id"), F.coalesce(there, F.lit(False)).alias("there"), F.lit(n).alias("n"))
    each = chunks.select(F.inline(F.array(at("id", F.col("good"), 0), at("prev", F.lit(False), 1), at("next", F.lit(False), 1)))).where("id is not null")
    links = each.groupBy("id").agg(F.max("there").alias("there"), F.sum("n").alias("n"))
    total = links.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.when(F.col("there"), F.col("n"))), F.lit(0)).alias("found"))
    return total.withColumn("integrity", F.round(F.col("found") / F.nullif(F.col("links"), F.lit(0)), 6))


@query("j18_distractors", """WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 2)) AS w FROM documents), b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 2)) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, len(list_intersect(b.w, d.w)) AS n, len(b.w) + len(d.w) AS m FROM b, d), j AS (SELECT item_id, doc_id, round(CASE WHEN m - n = 0 THEN 0.0 ELSE n / CAST(m - n AS DOUBLE) END, 9) AS sim FROM s)
SELECT item_id, doc_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim, doc_id) AS rn FROM j WHERE item_id <> doc_id) WHERE rn = 1 AND sim <= 0.3""")
def _(t):
    return evaluation.least_alike(t("benchmark"), t("documents")).where("sim <= 0.3")


@query("j19_files_chunks_revisions", f"""WITH {_STORED} SELECT d.source, d.n AS chunks, s.revision FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) d LEFT JOIN (SELECT source, max(id) AS revision FROM s WHERE toxic = 1 GROUP BY source) s ON s.source = d.source""")
def _(t):
    counts = t("documents").groupBy("source").agg(F.count("*").alias("chunks"))
    return counts.join(_stored(t).where("toxic = 1").groupBy("source").agg(F.max("id").alias("revision")), "source", "left")


@query("j20_store_wins", f"""WITH {_STORED}, a AS (SELECT doc_id, id AS rev FROM s WHERE quality = 1), b AS (SELECT doc_id, 'seen' AS rev FROM s WHERE toxic = 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.rev, b.rev) AS rev FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def _(t):
    s = _stored(t)
    return index.merged_states(s.where("quality = 1").select("doc_id", F.col("id").alias("rev")), s.where("toxic = 0").select("doc_id", F.lit("seen").alias("rev")), "doc_id", "rev")


@query("u4_replaced_files", f"""WITH {_STORED}, n AS (SELECT DISTINCT source, {_ID} AS id FROM documents WHERE lang = 'fr'), k AS (SELECT DISTINCT source, id FROM s)
SELECT source, id FROM k WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT source, id FROM n""")
def _(t):
    new = t("documents").where("lang = 'fr'").select("source", F.substring(F.sha2("text", 256), 1, 16).alias("id"))
    return index.replaced(_stored(t).select("source", "id").distinct(), new, "source", "id")


@query("u5_marks", f"""SELECT count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS pending_embed, count(*) FILTER (l.doc_id IS NOT NULL AND quality = 0) AS pending_upload, count(*) FILTER (quality = 1) AS uploaded FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    # marking the good ones as uploaded
    marked = rows.withColumn("uploaded", F.coalesce(F.col("quality") == 1, F.lit(False)))
    embedded = F.col("quality").isNotNull()
    return marked.agg(F.count("*").alias("total"), F.count_if(~embedded).alias("pending_embed"), F.count_if(embedded & ~F.col("uploaded")).alias("pending_upload"), F.count_if("uploaded").alias("uploaded"))


@query("u8_s12_model_change", "SELECT vec_id, label FROM embeddings WHERE label = 1")
def _(t):
    e = t("embeddings").select("vec_id", "embedding", "label")
    store = index.Store(e.sparkSession, place(t, "store"))
    store.upsert(e.where("label = 0"), "vec_id", "one", 64)
    store.upsert(e.where("label = 1"), "vec_id", "two", 64)  # another model: what was there is of no use
    return store.read(["vec_id", "label"])


@query("s10_s13_store", "SELECT vec_id, CASE WHEN label = 2 THEN -1 ELSE label END AS label FROM embeddings WHERE label IN (0, 2) OR label = 3")
def _(t):
    e = t("embeddings").select("vec_id", "embedding", "label", F.concat(F.lit("file"), F.col("label").cast("string")).alias("file"))
    store = index.Store(e.sparkSession, place(t, "store"))
    store.upsert(e.where("label in (0, 1, 2)"), "vec_id", "one", 64)
    store.upsert(e.where("label in (2, 3)"), "vec_id", "one", 64)
    store.replace(e.where("label = 2").withColumn("label", F.lit(-1)), "file", "vec_id")
    store.delete_sources(e.where("label = 1").select("file"), "file")
    return store.read(["vec_id", "label"])


@query("s11_scrolled", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 250 OFFSET 250")
def _(t):
    store = index.Store(t("embeddings").sparkSession, place(t, "store"))
    store.write(t("embeddings"), "one", 64)
    return store.page(["vec_id", "label"], "vec_id", 250, 250)


@query("u11_over_budget", """WITH n AS (SELECT event_id, octet_length(encode(props)) + 40 AS size, row_number() OVER (ORDER BY ts, event_id) AS rn, sum(octet_length(encode(props)) + 40) OVER (ORDER BY ts, event_id) AS s FROM events), x AS (SELECT sum(size) AS total FROM n),
f AS (SELECT CASE WHEN total <= 200000 THEN 0 ELSE CAST(ceil((SELECT min(rn) FROM n WHERE s >= total - 200000) / 1000.0) AS BIGINT) * 1000 END AS gone FROM x) SELECT event_id FROM n, f WHERE rn > gone""")
def _(t):
    return index.over_budget(t("events"), F.octet_length("props") + 40, [F.col("ts"), F.col("event_id")], 200_000).select("event_id")


@query("f12_extension_labels", f"""WITH {_NAMED} SELECT doc_id, CASE lower(regexp_extract(path, '\\.([^.]*)$', 1)) WHEN 'md' THEN 'format:markdown' WHEN 'py' THEN 'language:python' WHEN 'ts' THEN 'language:typescript' WHEN 'tex' THEN 'format:latex' WHEN 'docx' THEN 'format:docx' WHEN 'pdf' THEN 'format:pdf' WHEN 'rs' THEN 'language:rust' END AS label FROM p""")
def _(t):
    return named(t).select("doc_id", rules.extension_label(F.col("path")).alias("label"))


_GIVEN = [("", ["all"], True), ("src", ["code", "all"], True), ("src/src1", ["one"], False), ("src/src2", ["two", "code"], True)]


def _inherited(t):
    given = t("region").sparkSession.createDataFrame(_GIVEN, "dir string, add array<string>, inherit boolean")
    # a folder deeper, which is cut where the way down ends
    deep = named(t).withColumn("path", F.regexp_replace("path", r"/([^/]*)$", "/deep/$1"))
    given = given.unionByName(deep.select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir")).distinct().withColumn("add", F.array(F.lit("deep"))).withColumn("inherit", F.lit(True)))
    return rules.inherited(deep, given)


_INHERITED = """CASE WHEN path LIKE 'src/src1/%' THEN 'all,code,all,one' WHEN path LIKE 'src/src2/%' THEN 'all,code,all,two,code,deep' ELSE 'all,code,all,deep' END"""


@query("f13_inherited_labels", f"WITH {_NAMED} SELECT doc_id, {_INHERITED} AS labels FROM p")
def _(t):
    return _inherited(t).select("doc_id", F.array_join("inherited", ",").alias("labels"))


@query("f14_merged_labels", f"""WITH {_NAMED}, l AS (SELECT doc_id, ['team-x', CASE WHEN path LIKE '%.py' THEN 'language:python' END, 'git', CASE WHEN path LIKE '%.md' THEN 'owner:ann' ELSE 'owner:ben' END] || string_split({_INHERITED}, ',') || [CASE WHEN path LIKE 'src/src1%' THEN 'git' END, 'chunked'] AS all_ FROM p),
x AS (SELECT doc_id, list_filter(all_, lambda v: v IS NOT NULL) AS all_ FROM l) SELECT doc_id, array_to_string(list_filter(all_, lambda v, i: list_position(all_, v) = i), ',') AS labels FROM x""")
def _(t):
    p = F.col("path")
    auto = F.array(F.when(p.endswith(".py"), "language:python"))
    out = _inherited(t).select("doc_id", rules.merged(F.array(F.lit("team-x")), auto, F.array(F.lit("git")), F.array(F.when(p.endswith(".md"), "owner:ann").otherwise("owner:ben")), F.col("inherited"), F.array(F.when(p.startswith("src/src1"), "git")), F.array(F.lit("chunked"))).alias("labels"))
    return out.select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("f9_response", """SELECT doc_id, source AS file, CASE WHEN lang = 'en' THEN 'page 1' ELSE 'line ' || n_chars END AS citation, CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '… (' || length(text) || ' characters in all)' ELSE text END AS text FROM documents""")
def _(t):
    own = F.when(F.col("lang") == "en", F.lit("page 1"))
    return t("documents").select("doc_id", F.col("source").alias("file"), F.coalesce(own, F.concat(F.lit("line "), F.col("n_chars").cast("string"))).alias("citation"), tx.shortened(F.col("text"), 800).alias("text"))


_SAID = "CASE event_type WHEN 'error' THEN 'HTTP 4' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') || ' at once' WHEN 'click' THEN 'Access Denied' WHEN 'view' THEN 'File not Found 429' WHEN 'signup' THEN 'status 14290' ELSE 'timed out' END"


@query("f18_retry_predicate", f"SELECT event_id, NOT regexp_matches(lower(m), 'access denied|forbidden|unauthorized|not found') AND (NOT regexp_matches(m, '\\b4[0-9][0-9]\\b') OR regexp_matches(m, '\\b429\\b')) AS retry FROM (SELECT event_id, {_SAID} AS m FROM events)")
def _(t):
    k, e = F.col("event_type"), F.col("event_id")
    said = F.when(k == "error", F.concat(F.lit("HTTP 4"), F.lpad((e % 40).cast("string"), 2, "0"), F.lit(" at once"))).when(k == "click", "Access Denied").when(k == "view", "File not Found 429").when(k == "signup", "status 14290").otherwise("timed out")
    return t("events").select("event_id", tx.retryable(said).alias("retry"))


@query("r16_text_hash", """WITH c AS (SELECT item_id, list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS u FROM benchmark), h AS (SELECT item_id, list_reduce(list_prepend(CAST(5381 AS BIGINT), u), lambda s, x: xor((s * 33) % 4294967296, x)) AS h FROM c)
SELECT item_id, h FROM h""")
def _(t):
    return t("benchmark").select("item_id", F.conv(F.upper(tx.djb2(F.col("text"))), 36, 10).cast("long").alias("h"))


@query("fn_text", """SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?' || chr(10) || '])', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: strlen(x) > 10)) AS sentences,
  CASE WHEN regexp_matches(substr(text, 1, 12), '[,"\\n]|^\\s|\\s$') OR text = '' OR regexp_matches(substr(text, 1, 12), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN '"' || replace(substr(text, 1, 12), '"', '""') || '"' ELSE substr(text, 1, 12) END AS cell FROM documents""")
def _(t):
    return t("documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"), tx.toon_cell(F.substring("text", 1, 12)).alias("cell"))


@query("r9_activations", "SELECT event_id, round(1 / (1 + exp(-value / 50)), 9) AS sigmoid, round(exp(1.0 - greatest(value / 50, 1.0)) / (exp(value / 50 - greatest(value / 50, 1.0)) + exp(1.0 - greatest(value / 50, 1.0))), 9) AS softmax FROM events")
def _(t):
    x = F.col("value") / 50
    return t("events").select("event_id", F.round(tx.sigmoid(x), 9).alias("sigmoid"), F.round(tx.softmax(F.array(x, F.lit(1.0)), 1), 9).alias("softmax"))


@query("o8_even_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) WHERE n <= 100 OR pos IN (SELECT CAST(floor(i * n / 100.0) AS BIGINT) FROM generate_series(0, 99) g(i))")
def _(t):
    return index.sampled(t("documents").select("doc_id"), "doc_id", 100).select("doc_id")


@query("o4_union_of_sets", "SELECT doc_id, 'english' AS set FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'judged' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    d = t("documents").select("doc_id", "lang")
    return d.where("lang = 'en'").select("doc_id", F.lit("english").alias("set")).unionByName(d.join(t("labels"), "doc_id", "left_semi").select("doc_id", F.lit("judged").alias("set")))


def _engine(t) -> serving.Engine:
    """An engine over an index of the documents."""
    rows = t("documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("file"), F.array("lang").alias("tags"))
    store = index.Store(t("region").sparkSession, place(t, "store"))
    store.write(embedded(rows, "text"), "hashing", 64)
    return serving.Engine(store)


_ASKED = "the ing retition of thand enter"


@query("x9_x10_engine_search", f"""WITH d AS {VECTORS.format("(SELECT doc_id AS id, text FROM documents WHERE lang IN ('en', 'fr'))")}, q AS {VECTORS.format(f"(SELECT 0 AS id, '{_ASKED}' AS text)")}, s AS (SELECT d.id, round(sum(q.x * d.x), 9) AS sim FROM q JOIN d ON d.b = q.b GROUP BY d.id)
SELECT rank, round(sim, 6) AS similarity FROM (SELECT sim, row_number() OVER (ORDER BY sim DESC) AS rank FROM s) WHERE rank > 5 AND rank <= 15""")
def _(t):
    found = _engine(t).search(_ASKED, 10, offset=5, tags=["en", "fr"])
    return found.select(F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("x9_x10_engine_files", "SELECT source AS file, count(*) AS chunks FROM documents GROUP BY source")
def _(t):
    return _engine(t).list_files()


@query("t10_daemon", "SELECT 0 AS request, 'chunks' AS key, CAST((SELECT count(*) FROM documents) AS VARCHAR) AS value UNION ALL SELECT 0, 'files', CAST((SELECT count(DISTINCT source) FROM documents) AS VARCHAR) UNION ALL SELECT 1, 'error', 'JSONDecodeError' UNION ALL SELECT 2, 'id', (SELECT CAST(min_by(doc_id, (source, CAST(doc_id AS VARCHAR))) AS VARCHAR) FROM documents WHERE contains(source, '1'))")
def _(t):
    """Requests as lines of JSON, and what each answer says."""
    out = []
    for n, line in enumerate(_engine(t).serve(['{"op": "stats"}', "{broken", '{"op": "browse", "path": "1", "limit": 1}'])):
        said = json.loads(line)
        row = said["rows"][0] if "rows" in said else {"error": said["error"].split(":")[0]}
        out += [(n, k, str(v)) for k, v in row.items() if k in ("chunks", "files", "error", "id")]
    return t("region").sparkSession.createDataFrame(out, "request int, key string, value string")


@query("s1_s2_x4_folder", "SELECT sha256(n_name || chr(10)) AS revision FROM nation")
def _(t):
    path = place(t, "files")
    t("nation").select("n_nationkey", F.col("n_name").alias("value")).repartition(1).write.partitionBy("n_nationkey").text(path)
    return readers.Folder(t("nation").sparkSession, path).files().select("revision")


def _repository(t) -> tuple[readers.Repository, str]:
    """A repository of the nations' names, a file each, in two commits, and a change that isn't committed; with the first commit's id."""
    path = mounted(place(t, "repository"))
    os.makedirs(path)
    git = lambda *args: subprocess.run(["git", "-C", path, "-c", "user.name=x", "-c", "user.email=x@example.org", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)
    rows = t("nation").orderBy("n_nationkey").collect()

    def put(key: int, text: str) -> None:
        with open(f"{path}/{key}.txt", "w") as f:
            f.write(text)

    git("init", "-q")
    for r in rows[:20]:
        put(r.n_nationkey, r.n_name)
    git("add", "-A")
    git("commit", "-qm", "first")
    repo = readers.Repository(t("nation").sparkSession, path)
    first = repo.revision()
    for r in rows[10:]:
        put(r.n_nationkey, r.n_name + "!")
    for r in rows[:5]:
        os.remove(f"{path}/{r.n_nationkey}.txt")
    git("add", "-A")
    git("commit", "-qm", "second")
    put(rows[7].n_nationkey, "changed")
    put(99, "new")
    return repo, first


_BLOB = "sha1('blob ' || strlen(c) || chr(0) || c)"


@query("s4_s5_s8_git_files", f"WITH n AS (SELECT n_nationkey AS k, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), f AS (SELECT k, CASE WHEN i = 7 THEN 'changed' WHEN i >= 10 THEN n_name || '!' ELSE n_name END AS c FROM n WHERE i >= 5 UNION ALL SELECT 99, 'new') SELECT k || '.txt' AS path, {_BLOB} AS revision FROM f")
def _(t):
    return _repository(t)[0].files().select("path", "revision")


@query("s6_git_changes", "WITH n AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) SELECT k || '.txt' AS path, CASE WHEN i < 5 THEN 'deleted' WHEN i < 20 THEN 'modified' ELSE 'added' END AS status FROM n WHERE i < 5 OR i >= 10")
def _(t):
    repo, first = _repository(t)
    return repo.changed_since(first)
