import hashlib
import math
import pickle
import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shalecrest.functions import text as tx
from shalecrest.functions import vectors as v
from shalecrest.operators import chunking, embedding, evaluation, index, rules, search
from shalecrest.sources import readers


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(v.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]
    far = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert far.select(v.l2(F.col("a"), F.col("b"))).first()[0] == 5
    assert far.select(v.normalized(F.col("b"))).first()[0] == [0.6, 0.8]


def test_glob():
    import re

    hit = lambda g, p, **k: bool(re.search(tx.glob_regex(g, **k), p))
    assert hit("src", "src/a/b.py") and not hit("src", "srcs/a") and not hit("src", "src/a", directory=False)
    assert hit("**/*.{md,rst}", "docs/x.md") and hit("**/*.{md,rst}", "x.rst") and not hit("**/*.{md,rst}", "x.py")
    assert hit("a?c", "abc") and hit("[!x]b", "ab") and not hit("[!x]b", "xb")


def test_tags():
    assert tx.checked_tags(["ns:acme-corp", "0abc_def"])
    for bad in ("", "Upper", "-dash", "a'b", "a" * 65):
        with pytest.raises(ValueError):
            tx.checked_tags(["ok", bad])


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, i, r, rel) for i, (r, rel) in enumerate([(1, 0), (2, 1), (3, 0), (4, 1)])], "query_id int, id int, rank int, rel int")
    relevant = spark.createDataFrame([(1, 3)], "query_id int, n_relevant int")
    m = evaluation.ranking_metrics(ranked, relevant, 4).first()
    assert (m["precision"], round(m["recall"], 6), m["hit_rate"], m["rr"]) == (0.5, round(2 / 3, 6), 1.0, 0.5)
    perfect = ranked.where("rel = 1").withColumn("rank", (F.col("rank") / 2).cast("int"))
    assert evaluation.ranking_metrics(perfect, spark.createDataFrame([(1, 2)], "query_id int, n_relevant int"), 3).first()["ndcg"] == 1


def test_bootstrap():
    low, high = np.full(50, 0.1), np.full(50, 0.9)
    assert evaluation.bootstrap(low, high)["recommendation"] == "accept"
    assert evaluation.bootstrap(high, low)["recommendation"] == "reject"
    assert evaluation.bootstrap(low, low)["recommendation"] == "inconclusive"
    with pytest.raises(ValueError):
        evaluation.bootstrap(low, high[:3])
    with pytest.raises(ValueError):
        evaluation.bootstrap(low[:0], high[:0])


def test_guard():
    index.guard(9, 10)
    index.guard(10, 21)
    with pytest.raises(RuntimeError):
        index.guard(10, 20)
    index.guard(10, 20, force=True)


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, r string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "q")], "k int, r string")
    assert dict(index.diff(a, b, "k", "r").collect()) == {1: "new", 2: "changed", 3: "unchanged", 4: "deleted"}


def test_rules(spark):
    p = spark.createDataFrame([("docs/a.md",), ("src/x/b.py",)], "path string")
    assert [r["labels"] for r in rules.labels(p, [("docs", ["d"]), ("**/*.md", ["m", "d"])]).orderBy("path").collect()] == [["d", "m"], []]
    assert [r["owners"] for r in rules.owners(p, [("*", ["@o/all"]), ("*.py", ["@ann"])]).orderBy("path").collect()] == [["team:all"], ["owner:ann"]]


def test_fuse(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id int, id int, rank int")
    got = search.fuse(a, b, 5, alpha=0.5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [11, 10] and got[0]["score"] == 1.0
    assert [r["id"] for r in search.fuse(a, b, 5, alpha=0.0).collect()] == [11]


def test_knn_ties_and_zero(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = search.knn(e, e, 2, rows=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (4, 1), (4, 2)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=30), st.integers(4, 20))
def test_pack_is_greedy(spark, sizes, limit):
    parts = spark.createDataFrame([(1, i, "a" * n) for i, n in enumerate(sizes)], "doc_id int, seq int, text string")
    want, held = [], None
    for n in (math.ceil(n / 4) for n in sizes):
        if want and held + n <= limit:
            held += n
            want[-1] = held
        else:
            held = n
            want.append(held)
    assert [r["n_tokens"] for r in chunking.pack(parts, limit).orderBy("chunk").collect()] == want


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("hello")
    (tmp_path / "b.txt").write_text("b")
    (tmp_path / "q.txt").write_text("q1 0 d1 2\nq1 0 d2 0\nbad line\n")
    (tmp_path / "q.json").write_text('{"queries": [{"id": "1", "query": "x", "qrels": [{"docId": "d", "relevance": 3}]}]}')
    got = {r["path"] for r in readers.files(spark, str(tmp_path), exclude=["*.json"], include=["**/*.md", "b.txt"]).collect()}
    assert {p.split("/")[-1] for p in got} == {"x.md", "b.txt"}
    assert readers.trec_qrels(spark, str(tmp_path / "q.txt")).count() == 2
    assert readers.json_qrels(spark, str(tmp_path / "q.json")).first()["rel"] == 3
    blob = spark.createDataFrame([(bytearray(b"hello\n"),)], "c binary").select(readers.git_blob_sha(F.col("c"))).first()[0]
    assert blob == "ce013625030ba8dba906f756967f9e9ca394464a"
    h = readers.History(spark, str(tmp_path / "runs"), keep=2)
    h.save(spark.createDataFrame([(i, random.random(), "eval") for i in range(5)], "id int, mrr double, kind string"))
    assert [r["id"] for r in h.list("eval").collect()] == [4, 3] and h.latest("eval")["id"] == 4


def test_mounted():
    from shalecrest.plans import store

    assert store.mounted("/a/b") == store.mounted("file:/a/b") == store.mounted("file:///a/b") == "/a/b"
    with pytest.raises(ValueError):
        store.mounted("hdfs://host/a")


def test_least_alike_is_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, words=60: " ".join(f"w{rng.randrange(words):02d}X" for _ in range(n))
    docs = [(i, text(rng.randrange(1, 80), 12 if i % 3 else 60)) for i in range(900)] + [(5000, None), (None, "abc"), (5001, "")]
    docs = [(i, x and x + " common") for i, x in docs]  # no pair has similarity 0 but those with the empty text
    items = [(i * 7, text(20) + " Common") for i in range(60)] + [(3, ""), (4, None), (None, "abc"), (7, "abc common")]
    words = lambda x: {w for w in x.lower().split() if len(w) > 2}
    want = {}
    for i, x in items:
        for d, y in docs:
            if None not in (i, x, d, y) and i != d:
                a, b = words(x), words(y)
                s = round(len(a & b) / max(len(a | b), 1), 9)
                want[i] = min(want.get(i, (2, 0)), (s, d))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for small in (8 << 20, 2000):  # in one part, and in several
        got = {r["item_id"]: (r["sim"], r["doc_id"]) for r in evaluation.least_alike(b, d, small=small).collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
        assert all(abs(v[0] - want[k][0]) < 2e-9 for k, v in got.items())


def test_distractors_need_not_form_all_pairs(spark, tmp_path):
    from shalecrest import plans

    for t, n in (("benchmark", 400), ("documents", 4000)):
        k = "item_id" if t == "benchmark" else "doc_id"
        # half of the items share a word with all documents
        rows = spark.range(n).select((F.col("id") + 1).alias(k), F.concat(F.when(F.col("id") % 2 == 0, "shared ").otherwise("" if t == "benchmark" else "shared "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(150)), lambda i: F.concat(F.lit(t[0] * 3), (F.col("id") * 31 + i).cast("string"))), " ")).alias("text"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    import time

    at = time.time()
    assert plans.QUERIES["j18_distractors"](spark, str(tmp_path)).count() == 400
    assert time.time() - at < 30


def test_paragraphs_of_long_texts(spark):
    import time

    long, gap = "\n".join(f"line {i} " + "x" * 60 for i in range(30_000)), "a" + " " * 200_000 + "b"
    docs = spark.createDataFrame([(1, long), (2, gap), (3, " \n "), (4, None), (5, " a  ")], "doc_id long, text string")
    at = time.time()
    got = chunking.paragraphs(docs, "\n").orderBy("doc_id", "seq").collect()
    assert time.time() - at < 30  # the work must not grow with the square of the lines or of the spaces
    assert [r["text"] for r in got if r["doc_id"] == 1] == long.split("\n") and got[1]["start"] == len(long.split("\n")[0]) + 1
    assert [(r["doc_id"], r["seq"], r["text"], r["start"]) for r in got[30_000:]] == [(2, 0, gap, 0), (3, 0, " \n ", 0), (5, 0, " a  ", 0)]


def test_ivf_grows_its_lists_and_keeps_its_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 16))
    x[:, :4] *= 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    ivf = search.Ivf(df)
    q = df.where("vec_id % 100 = 0")
    assert len(ivf.centroids) == 35 and ivf.probes < 35
    found = ivf.search(q, 10)
    assert "Join" not in found._jdf.queryExecution().toString()  # pairs of vectors aren't rows, only what is found
    exact = search.knn(q, df, 10)
    assert search.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    parts = ivf.search(q, 10, small=20_000)  # queries in several parts
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, found.collect()))
    assert sorted(map(tuple, search.knn(q, df, 10, small=20_000).collect())) == sorted(map(tuple, exact.collect()))


def test_embedder_counts_words_and_leaves_its_words_here():
    texts = ["Éa 9x é a9x ½ Ⅷ", "", "a_b A the the", "İstanbul K"]
    e = embedding.HashingEmbedder(7, kept=3)
    want = np.zeros((4, 7))
    for row, s in zip(want, texts, strict=True):
        for w in regex.findall(r"[\p{L}\p{N}]+", s.lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            row[int(h[:4], 16) % 7] += 1 if int(h[4], 16) < 8 else -1
    n = np.linalg.norm(want, axis=1, keepdims=True)
    assert (e.embed(texts) == np.divide(want, n, out=want, where=n > 0)).all() and len(e.known) <= 3
    e = embedding.HashingEmbedder()
    e.embed([" ".join(f"word{k}" for k in range(50_000))])
    assert len(e.known) == 50_000 and len(pickle.dumps(e)) < 1000


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.none() | st.text("a\n \t\x0bé日.", max_size=40), min_size=1, max_size=12), st.sampled_from(["\n", "\n\n"]))
def test_paragraphs_of_each_document_alone(spark, texts, sep):
    space, want = " \t\n\f\r", []
    for i, s in enumerate(texts):
        if s is not None and not s.strip(space):
            want.append((i, 0, s, 0, None, None))
        elif s is not None:
            kept = [x for x in s.split(sep) if x.strip(space)]
            t = [None, *(x.strip(space) for x in kept), None]
            want += [(i, n, t[n + 1], sum(len((x + sep).encode()) for x in kept[:n]), t[n], t[n + 2]) for n in range(len(kept))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = chunking.paragraphs(docs, sep, around=True)
    assert [tuple(r) for r in got.collect()] == want  # in order as they lie
    assert not any(x in initial_plan(got) for x in ("Exchange", "Sort"))
    assert chunking.paragraphs(docs, sep, around=True, nested=True).collect() == got.collect()


def test_batches_are_split_by_bytes():
    import pyarrow as pa

    texts = ["a" * 5, None, "é" * 4, "", "b" * 30, "c"]
    parts = list(chunking._by_bytes(pa.RecordBatch.from_arrays([pa.array(texts)], ["x"]), "x", 13))
    assert [p.column(0).to_pylist() for p in parts] == [["a" * 5, None, "é" * 4, ""], ["b" * 30], ["c"]]


def test_embedder_adds_up_many_texts_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, n)) for n in [*rng.integers(0, 30, 1500), 70_000, 0, 140_000, 65_536, 3]]
    e, calls, real = embedding.HashingEmbedder(16), [], np.bincount
    want = np.concatenate([e.embed([s]) for s in texts])
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert (e.embed(texts) == want).all() and len(calls) < 12
    monkeypatch.undo()
    few = [*texts[:3], None, ""]
    got = embedding.embedded(spark.createDataFrame(list(enumerate(few)), "n int, x string"), "x", embedder=e, batch=2).orderBy("n").collect()
    assert [r["vector"] for r in got] == [None if s is None else e.embed([s])[0].tolist() for s in few]
