"""Sources, the stored index, streams and the warm engine."""

import json
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shalecrest import serving
from shalecrest.functions import text as tx
from shalecrest.operators import embedding, evaluation, index, quality, search, telemetry
from shalecrest.plans import QUERIES
from shalecrest.plans.store import containing
from shalecrest.sources import readers
from shalecrest.streaming import events as streams

SF = "/root/testdata/sf0.001"


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_repository(spark, tmp_path):
    git(tmp_path, "init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "src/b.py").write_text("two")
    (tmp_path / "CODEOWNERS").write_text("# who\n* @org/all\n/src/ @ben\n")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "1")
    r = readers.Repository(spark, str(tmp_path))
    first = r.revision()
    (tmp_path / "a.md").write_text("changed")
    (tmp_path / "new.txt").write_text("new")
    (tmp_path / "src/b.py").unlink()
    files = dict(r.files().collect())
    assert set(files) == {"a.md", "CODEOWNERS", "new.txt"}
    blob = spark.createDataFrame([(bytearray(b"changed"),)], "c binary").select(readers.git_blob_sha(F.col("c"))).first()[0]
    assert files["a.md"] == blob
    assert {p: o for p, _, o in r.tagged().collect()}["a.md"] == ["team:all"]
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "2")
    assert dict(r.changed_since(first).collect()) == {"a.md": "modified", "new.txt": "added", "src/b.py": "deleted"}
    assert r.read("a.md", 1, 4) == b"han" and r.read("a.md", 5, 99) == b"ed"
    old = readers.Repository(spark, str(tmp_path), branch=first)
    assert {p: o for p, _, o in old.tagged().collect()}["src/b.py"] == ["owner:ben"]


def test_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.txt").write_text("one")
    (tmp_path / "b.log").write_text("two")
    f = readers.Folder(spark, str(tmp_path), exclude=["**/*.log"])
    known = f.files()
    assert readers.Folder(spark, f"file:{tmp_path}", exclude=["**/*.log"]).files().collect() == known.collect()
    assert [r.path for r in known.collect()] == ["x/a.txt"] and f.read("x/a.txt", 1, 9) == b"ne"
    kept = spark.createDataFrame(known.collect())
    before = f.revision()
    time.sleep(0.01)
    (tmp_path / "x/a.txt").write_text("three")
    (tmp_path / "x/c.txt").write_text("four")
    assert f.revision() != before
    assert dict(f.changed_since(kept).collect()) == {"x/a.txt": "modified", "x/c.txt": "added"}


def test_history(spark, tmp_path):
    h = readers.History(spark, str(tmp_path / "h"), keep=3)
    for n in range(5):
        h.save(spark.createDataFrame([("k", n, n / 10)], "kind string, id int, mrr double"))
    assert [r.id for r in h.list("k").collect()] == [4, 3, 2] and h.resolve("k", "latest~2").id == 2 and h.resolve("k", "3").id == 3 and h.resolve("k", "latest~9") is None
    assert h.latest("k", F.col("mrr") < 0.35).id == 3
    h.prune()
    assert spark.read.parquet(str(tmp_path / "h")).count() == 3


def test_store(spark, tmp_path):
    s = index.Store(spark, str(tmp_path / "s"))
    assert s.meta() is None
    s.upsert(spark.createDataFrame([("a", "f", 1), ("b", "f", 1), ("c", "g", 1)], "id string, file string, n int"), "id", "m", 3)
    s.upsert(spark.createDataFrame([("b", "f", 2), ("d", "g", 2)], "id string, file string, n int"), "id", "m", 3)
    assert {(r.id, r.n) for r in s.read().collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 2)}
    s.replace(spark.createDataFrame([("e", "f", 3), ("e", "f", 3)], "id string, file string, n int"), "file", "id")
    assert sorted(r.id for r in s.read(["id"]).collect()) == ["c", "d", "e"]
    s.delete_sources(spark.createDataFrame([("g",)], "file string"), "file")
    assert [r.id for r in s.page(["id"], "id", 5).collect()] == ["e"]
    s.upsert(spark.createDataFrame([("z", "f", 3)], "id string, file string, n int"), "id", "other", 3)
    assert [r.id for r in s.read(["id"]).collect()] == ["z"] and s.meta()["model"] == "other"


def test_guard_and_budget(spark):
    with pytest.raises(RuntimeError):
        index.guard(10, 20)
    index.guard(10, 20, force=True)
    index.guard(9, 9)
    rows = spark.range(5000).withColumn("ts", F.col("id"))
    left = index.over_budget(rows, F.lit(10), [F.col("ts")], 25_000)
    assert left.count() == 2000 and left.agg(F.min("id")).first()[0] == 3000
    assert index.over_budget(rows, F.lit(10), [F.col("ts")], 50_000).count() == 5000
    assert sorted(r.id for r in index.sampled(rows, "id", 7).collect()) == [i * 5000 // 7 for i in range(7)]


def test_knn_with_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, None]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.id): r.rank for r in search.knn(df, df, 1).collect()}
    assert got[1, 2] == 1 and got[2, 1] == 1 and set(got) == {(1, 2), (2, 1), (6, 1)}
    parts = {(r.query_id, r.id): r.rank for r in search.knn(df, df, 1, small=8).collect()}
    assert parts == got


def test_inverted_file_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 100 = 0")
    found, exact = search.Ivf(e).search(q, 10), search.knn(q, e, 10)
    assert search.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert search.Ivf(e).rows.count() == e.count()


def test_bm25_both_ways(spark):
    b, d = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "documents"))
    odd = d.unionByName(spark.createDataFrame([(None, "x", "en", "a", 1), (9999, None, "en", "a", 0), (9998, "", "en", "a", 0)], d.schema))
    one = {(r.query_id, r.doc_id): (r.rank, round(r.score, 6)) for r in search.bm25(b, odd, 10, "item_id", "doc_id").collect()}
    two = {(r.query_id, r.doc_id): (r.rank, round(r.score, 6)) for r in search.bm25(b, odd, 10, "item_id", "doc_id", small=0).collect()}
    assert one == two and one
    assert search.bm25(b.limit(0), d, 10, "item_id", "doc_id").count() == 0


def test_containing_finds_short_and_long_passages(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "xtwo three fourx"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "wo three four five six seven eight nine ten eleven tw"), (2, "two three four"), (3, "nothing of the kind in any of these documents at all")], "item_id long, text string")
    assert {tuple(r) for r in containing(asked, docs).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_pooling():
    h = np.array([[[3.0, 4.0], [9.0, 9.0]], [[0.0, 0.0], [0.0, 0.0]]])
    assert np.allclose(embedding.mean_pooled(h, np.array([[1, 0], [1, 1]])), [[0.6, 0.8], [0, 0]])
    assert np.allclose(embedding.first_pooled(h), [[0.6, 0.8], [0, 0]])


def test_bootstrap(spark):
    df = lambda a, b: spark.createDataFrame([(float(a), float(b))] * 50, "a double, b double")
    assert evaluation.bootstrapped(df(0.1, 0.9), "a", "b").first().recommendation == "accept"
    assert evaluation.bootstrapped(df(0.9, 0.1), "a", "b").first().recommendation == "reject"
    assert evaluation.bootstrapped(df(0.5, 0.5), "a", "b").first().recommendation == "inconclusive"
    rng = np.random.default_rng(0)
    x, y = rng.random(300), rng.random(300) + 0.02
    mixed = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "a double, b double")
    one, two = evaluation.bootstrapped(mixed, "a", "b").first(), evaluation.bootstrap(x, y)
    assert one == evaluation.bootstrapped(mixed.repartition(7), "a", "b").first()
    assert abs(one.lo - two["lo"]) < 0.01 and abs(one.hi - two["hi"]) < 0.01 and abs(one.p - two["p"]) < 0.03
    with pytest.raises(ValueError):
        evaluation.bootstrapped(mixed.limit(0), "a", "b")


def test_projection_is_the_singular_value_decomposition(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = quality.projected(e, "embedding").select("vec_id", "x", "y").orderBy("vec_id").toPandas()
    x = np.array(e.orderBy("vec_id").toPandas().embedding.tolist(), float)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for k, c in enumerate("xy"):
        assert np.allclose(np.abs(got[c]), np.abs(u[:, k] * s[k]), atol=1e-5)
    w = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    n, iso = quality.spectrum(e, "embedding")
    assert np.isclose(iso, w[31] / w[0]) and np.isclose(n * 64, np.searchsorted(np.cumsum(w), 0.95 * w.sum()) + 1)


def test_percentile_rule(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)] + [(2, 7.0), (2, None)], "g int, v double")
    assert {tuple(r) for r in telemetry.percentiles(df, ["g"], "v", {"p": 0.5, "q": 0.99}).collect()} == {(1, 4, 3.0, 4.0), (2, 1, 7.0, 7.0)}


def test_text_functions(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c(F.col("s"))).first()[0]
    assert one(tx.sentences, "One sentence. Hi! Another one here") == ["One sentence.", "Another one here"]
    assert one(lambda c: tx.shortened(c, 3), "abcdef") == "abc… (6 characters in all)"
    assert [one(tx.toon_cell, s) for s in ("a", "", "1.5", "true", "a,b", 'q"', " x")] == ["a", '""', '"1.5"', '"true"', '"a,b"', '"q"""', '" x"']
    assert one(tx.dirname, "a\\b/c.txt") == "a/b" and one(tx.basename, "a\\b\\c.txt") == "c.txt" and one(tx.extension, "a.b/c.TXT") == "txt" and one(tx.extension, "a.b/c") == ""
    h = 5381
    for c in "hello":
        h = (h * 33 & 0xFFFFFFFF) ^ ord(c)
    assert int(one(tx.djb2, "hello"), 36) == h


def test_late_rows_are_left_out(spark, tmp_path):
    rows = lambda name, *at: spark.createDataFrame([(n, x, "a", 1.0) for n, x in enumerate(at)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    rows("1", "2024-01-01 10:05:00", "2024-01-01 12:30:00")
    source = lambda: streams.tumbling(spark.readStream.schema("event_id int, ts timestamp, event_type string, value double").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))

    def run():
        got = []
        q = source().writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(b.collect())).start()
        q.awaitTermination()
        return {(r.hour.hour, r.n) for r in got}

    assert run() == {(10, 1)}
    rows("2", "2024-01-01 10:06:00", "2024-01-01 12:40:00", "2024-01-01 15:00:00")
    assert run() == {(12, 2)}  # the row of ten o'clock is too late


def test_redundancy_state_spans_batches(spark, tmp_path):
    rows = lambda name, *r: spark.createDataFrame([(i, 1, t, v) for i, t, v in r], "id long, session long, ts string, vector array<double>").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    got = []

    def run():
        s = spark.readStream.schema("id long, session long, ts timestamp, vector array<double>").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = streams.redundant(s).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(b.collect())).start()
        q.awaitTermination()

    rows("1", (1, "2024-01-01 10:00:00", [1.0, 0.0]))
    run()
    rows("2", (2, "2024-01-01 10:04:00", [1.0, 0.1]), (3, "2024-01-01 10:09:30", [1.0, 0.0]), (4, "2024-01-01 10:10:00", [0.0, 1.0]))
    run()
    assert {r.id: r.redundant for r in got} == {1: False, 2: True, 3: False, 4: False}


def test_redundancy_of_many_sessions_takes_few_calls(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, None if s == 0 else s, t, v.tolist()) for k, (s, t, v) in enumerate(zip(rng.integers(0, 300, 4000).tolist(), rng.integers(1_704_100_000, 1_704_110_000, 4000).tolist(), rng.normal(size=(4000, 3)), strict=True))]
    rows[7] = (7, 5, 1_704_100_000, [1.0])  # of another length
    schema, got, want = "id long, session long, ts long, vector array<double>", {}, {}
    d = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts"))
    for n, part in enumerate(("ts < timestamp_seconds(1704104000)", "ts >= timestamp_seconds(1704104000)")):
        d.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        s = spark.readStream.schema(d.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = streams.redundant(s, groups=4).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, _: got.update({r.id: (r.session, r.redundant) for r in b.collect()})).start()
        q.awaitTermination()
        assert q.lastProgress is None or max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 4
    for k, s, t, v in rows:
        cos = lambda w: np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) if len(v) == len(w) else 0  # noqa: B023, E731
        want[k] = (s, any(s == s2 and (t2, k2) < (t, k) and t2 >= t - 300 and cos(w) > 0.8 for k2, s2, t2, w in rows))
    assert got == want and any(x for _, x in want.values())


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Elsewhere:
        class sparkContext:
            master = "spark://far:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        streams.shared(Elsewhere)


def test_engine(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"c{i}", s, f"src/F{i % 2}.md", ["a"] if i else ["b"]) for i, s in enumerate(["red apple tree", "green apple", "blue sky " * 200, "deep sea"])], "id string, text string, file string, tags array<string>")
    own = embedding.HashingEmbedder(2048)
    store.write(embedding.embedded(rows, "text", embedder=own), "hashing", 2048)
    e = serving.Engine(store, own)
    assert [r.id for r in e.search("green apple", 2).collect()] == ["c1", "c0"]
    assert [r.id for r in e.search("green apple", 2, tags=["b"]).collect()] == ["c0"]
    assert [(r.id, r.rank) for r in e.search("green apple", 1, offset=1).collect()] == [("c0", 2)]
    assert e.search("green apple", 4, least=0.99).count() == 1
    assert e.search("blue sky", 1).first().text.endswith("(1800 characters in all)") and len(e.search("blue sky", 1, full=True).first().text) == 1800
    turned = serving.Engine(store, own, score=lambda q, t: [len(x) for x in t])
    assert turned.search("green apple", 1).first().id == "c2"
    answers = [json.loads(x) for x in e.serve(['{"op": "stats"}', "", "{broken", '{"op": "drop"}', '{"op": "browse", "path": "f1", "limit": 1}', '{"op": "chunk", "key": "c3"}', '{"op": "list_files"}'])]
    assert answers[0] == {"rows": [{"chunks": 4, "files": 2}]} and "error" in answers[1] and "error" in answers[2]
    assert answers[3]["rows"][0]["id"] == "c1" and answers[4]["rows"][0]["text"] == "deep sea" and len(answers[5]["rows"]) == 2
    assert serving.toon("files", e.list_files().orderBy("file")) == 'files[2]{file,chunks}:\n  src/F0.md,"2"\n  src/F1.md,"2"\n'




def test_metric_means_reads_exponents(spark):
    text = 'm_sum{k="a"} 5.9172E7\nm_count{k="a"} 20\nm_sum{k="b"} -2.5e-3\nm_count{k="b"} 1e1\nm_sum{k="c"} 7.5\nm_count{k="c"} 3'
    got = telemetry.metric_means(spark.createDataFrame([(text,)], "x string"), "x", "m")
    assert {r["series"][4]: r["mean"] for r in got.collect()} == {"a": 2958600.0, "b": -0.00025, "c": 2.5}


def test_breadcrumbs_read_their_chunks_once(spark):
    rows = [(1, ["a", "b"]), (1, ["a", "c"]), (2, []), (2, ["a"]), (3, ["x", "y"]), (3, ["x", "y"]), (4, []), (5, ["a", "b"]), (5, ["a"])]
    d = spark.createDataFrame(rows, "f int, c array<string>").mapInArrow(lambda b: b, "f int, c array<string>")
    got = quality.breadcrumb_consistency(d, "f", "c")
    assert got.first()[0] == pytest.approx((0.5 + 0 + 1 + 1 + 0.5) / 5)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("MapInArrow") == 1


def test_sibling_integrity_walks_once(spark):
    got = QUERIES["j15_q9_sibling_integrity"](spark, SF)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("MapInArrow") == 1


def initial_plan(name, spark):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


@pytest.mark.parametrize(("name", "passes"), [("a13_size_histogram", 1), ("q4_coverage", 2), ("c4_divided", 2), ("q5_completeness", 2), ("c5_packed_chunks", 2), ("r18_context", 1)])
def test_lines_are_read_as_they_lie(spark, name, passes):
    plan = initial_plan(name, spark)
    below = plan[plan.index("MapInArrow") :]
    below = below[: below.index("FileScan")]
    assert below.count("MapInArrow") == passes and not any(x in below for x in ("Exchange", "Sort", "Window", "Generate"))


def test_ids_rather_than_texts_are_shuffled_for_links(spark):
    plan = initial_plan("c12_sibling_links", spark)
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("sha2")


def test_lines_are_counted_before_the_join(spark):
    plan = initial_plan("a12_cohesion_report", spark)
    assert plan.index("Join") < plan.index("keys=[doc_id") < plan.index("MapInArrow")
