"""The corpus operators on small fixtures, against brute force, with the odd cases."""

import json
import math
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shalecrest.llm import bpe, chat, codec, common, embeddings, packing, pii, quality, simhash, urls, words, wrappers

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pattern string, id int, list int, range int, key string, _gone int, f0 int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ren", "to", "mi", "sul", "ka", "ent", "or", "ish", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rng = random.Random(3)
    base = prose(rng, 120)
    changed = base.split()
    changed[5], changed[60] = "other", "words"
    texts = [(1, base), (2, " ".join(changed)), (3, None), (4, ""), (5, "  \n "), (6, prose(rng, 30_000)), (7, base), (7, base), (None, prose(rng, 50)), (8, "***"), (9, prose(rng, 80)), (10, "x" * 300_000), (11, "日本語 🙂 é")]
    return spark.createDataFrame([(i, s, "en", "a", None if s is None else len(s), "p", 0, 0, 0, "k", 0, 0) for i, s in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_empty_tables(spark, empty):
    for f in (bpe.encode_documents, simhash.near_duplicates, quality.score, quality.keep_good, pii.find, pii.redact_documents, packing.pack):
        assert f(empty).count() == 0, f
    assert codec.write(empty)[0].count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.extract(pages).count() == 0
    assert urls.match(pages, spark.createDataFrame(urls.RULES, "rule_id long, rule string, action string")).count() == 0


def test_bpe(spark, odd):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_vocabulary(), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    got = bpe.encode_documents(docs).toPandas().sort_values(["doc_id"], kind="stable")
    assert got.round_trip.dropna().all() and got.n_tokens[got.round_trip.isna()].tolist() == [0]
    want = sorted((ref.encode_ordinary(s) for s in docs.toPandas().text if s is not None), key=lambda x: (len(x), x))
    assert sorted(([*map(int, x)] for x in got.token_ids if x is not None), key=lambda x: (len(x), x)) == want


def test_utf8_machine():
    rng = random.Random(1)
    for _ in range(300):
        b = bytes(rng.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xED, 0xA0]) for _ in range(rng.randrange(12)))
        m, out, i = bpe.Utf8(), "", 0
        while i < len(b):
            k = rng.randint(1, 3)
            out += m.feed(b[i : i + k])
            i += k
        assert out + m.end() == b.decode("utf-8", "replace")


def merged(ranks, b):
    """The merges by definition: the pair of least rank first, the leftmost of equals."""
    parts = [b[i : i + 1] for i in range(len(b))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if r == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_pairs_are_those_of_the_merges():
    t = bpe.encoder(bpe.vocabulary()).fst
    rng = random.Random(2)
    ids = [i for i in range(3000) if merged(t.ranks, t.bytes_of[i]) == [i]]
    assert [i for i in range(3000) if len(t.bytes_of[i]) == 1 or t.left[i] >= 0] == ids
    a, b = (np.array([rng.choice(ids) for _ in range(3000)]) for _ in range(2))
    got = t._apart(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist()):
        assert ok == (merged(t.ranks, t.bytes_of[x] + t.bytes_of[y]) == [x, y])


def test_transducer_on_strange_texts():
    import public_tokenizers
    import tiktoken

    e = bpe.Encoder(bpe.vocabulary(), kept=50)  # begins anew all the time
    e.fst.most = 200
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.fst.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["'s", "'ll", "'", "  ", "\n", " ", "a", "Bc", "the", "é", "日本", "1", "23", ",", "!!", "\u3000", "\t", " 're", "'ve", "🙂", "\xa0", "ß", "'t's", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)] + ["x" * 5000, "日本語の文章" * 200, "".join(rng.choice("abcdefghij") for _ in range(3000)), None, ""]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        ids, ends = e.encode(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [ref.encode_ordinary(s or "") for s in some]
        assert list(bpe.Decoder(e.fst.bytes_of).texts(ids, ends, 3)) == [s or "" for s in some]


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 24))
    x = np.concatenate([base, base[:50] + 0.2 * rng.standard_normal((50, 24)), base[:20], base[:20] + 0.45 * rng.standard_normal((20, 24))])
    odd = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [1.0, 2.0], 0), (None, [1.0], 0), (1003, [float("nan")] * 24, 0), (1004, [], 0)]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>, tile int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, 0.9, 40).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, lab = u @ u.T >= 0.9, np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([lab[near[i]].min() for i in range(len(x))])
        if (new == lab).all():
            break
        lab = new
    assert all(got[i].group_id == lab[i] and got[i].kept == (lab[i] == i) for i in range(len(x)))
    class_of = {i: (u[i].round(12).tobytes()) for i in range(len(x))}  # copies of one vector are one class
    assert all(got[i].n_links == len({class_of[j] for j in np.flatnonzero(near[i])} - {class_of[i]}) for i in range(len(x)))
    again = [(r.vec_id, r.group_id, r.n_links, r.kept) for r in embeddings.near_duplicates(df.unionByName(df.where("vec_id < 5")), 0.9, 40).where("vec_id < 5").collect()]
    assert sorted(again) == sorted([(i, got[i].group_id, got[i].n_links, got[i].kept) for i in range(5)] * 2)
    assert all(got[i].kept for i in (1000, 1001, 1002, 1003, 1004, None))


def test_simhash_recall_and_odd_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = simhash.near_duplicates(docs).collect()
    got, near = {r.doc_id: r.group_id for r in found}, {r.doc_id: r.n_links for r in found}
    f = simhash.fingerprints(docs).dropna().toPandas()
    fp = f[simhash._FP].to_numpy(np.int64).view(np.uint64)
    ids = f.doc_id.to_numpy()
    hit = pairs = 0
    for i in range(len(ids)):
        d = sum(np.bitwise_count(fp[i, k] ^ fp[i + 1 :, k]).astype(int) for k in range(4))
        for j in np.flatnonzero(d <= 45):
            pairs += 1
            hit += got[ids[i]] == got[ids[i + 1 + j]]
    assert pairs > 50 and hit >= 0.98 * pairs
    print_of = {i: tuple(f) for i, f in zip(ids.tolist(), fp.tolist())}
    for i, root in got.items():  # linked with another fingerprint just where the group has another
        assert (near[i] > 0) == any(print_of.get(j) != print_of.get(i) for j in got if got[j] == root)
    rows = [(r.doc_id, r.group_id, r.kept) for r in simhash.near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    assert {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (8, 8, True), (9, 9, True), (None, None, True)} <= set(rows)
    assert rows.count((7, 1, False)) == 2


def apart(rng, n, bits):
    """n random fingerprints and, for each, one that differs in so many bits."""
    a = rng.integers(0, 2**64, (n, 4), dtype=np.uint64)
    flips = np.zeros((n, 256), bool)
    for row in flips:
        row[rng.choice(256, bits, replace=False)] = True
    return a, a ^ np.packbits(flips, axis=1).view("<u8")


def test_simhash_recall_at_each_depth():
    rng = np.random.default_rng(4)
    filters = simhash.Filters(45, 0.98, 7)
    for levels, pairs in ((1, 2000), (2, 1000), (3, 300)):
        a, b = apart(rng, pairs, 45)
        met = np.zeros(pairs, bool)
        for at in range(0, pairs, 50):
            for (_, _, i, x), (_, _, j, y) in zip(filters.lists(a[at : at + 50], levels), filters.lists(b[at : at + 50], levels), strict=True):
                both = np.intersect1d(x * 50 + i, y * 50 + j)
                met[at + both % 50] = True
        assert met.mean() > 0.98 - 3 * math.sqrt(0.98 * 0.02 / pairs), levels  # three standard errors


def test_simhash_pairs_of_deep_lists_and_blocks(spark):
    rng = np.random.default_rng(5)
    n = 25
    a, b = apart(rng, n, 45)
    near, far = apart(rng, n, 46)
    hub = np.repeat(rng.integers(0, 2**64, (1, 4), dtype=np.uint64), 20, axis=0)
    hub[:, 1] ^= np.uint64(1) << np.arange(20, dtype=np.uint64)  # near copies of one, in the same lists at any depth
    fp = np.concatenate([a, b, near, far, hub])
    rows = spark.createDataFrame([(int(k), *(int(v) for v in f.view(np.int64))) for k, f in enumerate(fp)], "id long, f0 long, f1 long, f2 long, f3 long")
    for list_size, task_rows in ((4000, 500_000), (1, 500_000), (1, 10), (1, 2)):  # depth 1, 3 within tasks, 3 with long lists in blocks, 3 of which two are shuffled
        got = {tuple(r) for r in simhash.near_pairs(rows, 45, 0.98, list_size, task_rows, 7).collect()}
        apart_pairs = {p for p in got if p[0] < 4 * n}
        assert apart_pairs <= {(k, k + n) for k in range(n)} and len(apart_pairs) >= n - 3, (list_size, task_rows)
        assert len(dict(common.components(spark.createDataFrame(sorted(got - apart_pairs), "a long, b long")).collect())) == 20


def test_forest_connects_what_brute_force_does():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, (60, 4)).astype(np.uint64)
    b = a[:30] ^ np.uint64(7)
    fp = np.concatenate([a, b, b ^ np.uint64(1 << 40)])
    for f in (simhash.forest, simhash.singles):
        x, y = f(fp, 12)
        lab = np.arange(len(fp))
        for _ in range(5):
            for p, q in zip(x, y):
                lab[p] = lab[q] = min(lab[p], lab[q])
        assert len(set(lab)) == 60


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (5, 5), (None, 3)], "a long, b long")
    got = dict(common.components(e).collect())
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30}


def test_html(spark):
    page = lambda n, ps: f'<html><head><title>T{n}</title><script>x("<p>no</p>")</script></head><body><nav><ul><li><a href=/>Home</a><li>About</ul></nav><article><h1>H{n}</h1><div>Share this</div>{"".join(f"<p>para {n} {i} &amp; <b>more</b></p>" for i in range(ps))}</article><footer>© all</footer></body></html>'
    rows = [(i, "https://A.example.org/x", page(i, k)) for i, k in enumerate((1, 3, 2, 3))] + [(10, "https://a.example.org/y", None), (11, None, "<p>alone"), (12, "https://b.example.org", ""), (13, "https://a.example.org/z", "<<<>& broken <p"), (1, "https://A.example.org/x", page(1, 3))]
    got = wrappers.extract(spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, wrapper string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, k in enumerate((1, 3, 2, 3)):
        assert by[i].matched and by[i].title == f"T{i}"
        assert by[i].text.split("\n")[0] == f"H{i}" and by[i].text.count("para") == k and "& more" in by[i].text
        assert "Home" not in by[i].text and "no" not in by[i].text.split()
    assert by[10].text is None and by[11].text == "alone" and by[12].text == ""


def test_template_text_is_left_out(spark):
    pages = [(i, "https://c.example.org/x", f"<body><div>Share this</div><h1>H{i}</h1></body>") for i in range(3)]
    got = wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"H0", "H1", "H2"} and all(r.n_template == 1 for r in got)


def test_copies_of_a_page_are_no_template(spark):
    copy = "<body><h1>Head</h1><div>one paragraph</div></body>"
    page = lambda k, more="": f"<body><div>Share this</div><h1>H{k}</h1>{more}</body>"
    rows = [(1, "https://d.example.org/1", copy), (2, "https://d.example.org/2", copy), (2, "https://d.example.org/2", copy)]
    rows += [(10 + k, "https://e.example.org/x", page(k)) for k in range(5)] + [(20 + k, "https://e.example.org/y", page(9 + k, "<table>only these two</table>")) for k in range(2)]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got[1].text == got[2].text == "Head\none paragraph" and got[1].n_template == 0
    assert [got[10 + k].text for k in range(5)] == [f"H{k}" for k in range(5)]
    assert got[20].text == "H9\nonly these two" and got[21].text == "H10\nonly these two"


def test_wrapper_with_many_optional_symbols_matches_long_pages():
    group = "(<p>\x1fT)+"
    spec = {"symbols": [group] * 6 + ["<p>", "T"] * 200 + ["</z>"], "optional": [True] * 6 + [False] * 401, "constant": [False] * 407}
    page = ["<p>", "T"] * 200 + ["</z>"]  # matches only without any of the groups
    w = wrappers.Wrapper(spec)
    assert [a for a, *_ in w.slots(page)] == list(range(1, 401, 2))
    assert w.slots(page[:-1]) is None and w.slots(page[2:]) is None and len(w.slots(page[:4] + page)) == 202


def test_matches_are_those_of_the_expression():
    """A wrapper's match against Python's own engine on short streams."""
    import itertools
    import re

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 4)
        symbols = [rng.choice(["a", "b", "T", "(a\x1fT)+", "(b)+", "((a)+\x1fT)+"]) for _ in range(n)]
        optional = [rng.random() < 0.4 for _ in range(n)]
        w = wrappers.Wrapper({"symbols": symbols, "optional": optional, "constant": [False] * n})
        pattern = re.compile("".join(f"(?:{x.replace(chr(31), '')}){'?' if o else ''}" for x, o in zip(symbols, optional)))
        for length in range(6):
            for page in itertools.product("abT", repeat=length):
                got = w.slots(list(page))
                assert (got is not None) == bool(pattern.fullmatch("".join(page))), (symbols, optional, page)
                assert got is None or [a for a, *_ in got] == [i for i, x in enumerate(page) if x == "T"]


def test_alignments_are_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in ((i, j) for i in range(len(a)) for j in range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = wrappers.align(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))


def test_repeats_of_any_period_and_depth():
    item = [f"<t{i}>" for i in range(50)]
    assert len(wrappers.collapse(["<ul>", *item * 4, "</ul>"])) == 3
    nested = ["<p>", "T"]
    for k in range(7):
        nested = [f"<d{k}>", *nested * 2, f"</d{k}>"]
    assert len(wrappers.collapse(nested)) == 3


def test_large_hosts_are_merged_in_parts(spark):
    rng = random.Random(6)
    block = lambda k, i: f"<div class=c{k}><p>{k} {i}</p></div>" if rng.random() < 0.6 else ""
    rows = [(i, "https://big.example.org/x", f"<body><div>Share this</div><h1>H{i}</h1>{''.join(block(k, i) for k in range(5))}<footer>f</footer></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    src = df.select(wrappers.host_of(df.url).alias("host"), "html")
    whole = [r.wrapper for r in wrappers.wrappers(src).collect()]
    parts = [r.wrapper for r in wrappers.wrappers(src, 3, 2).collect()]
    assert len(whole) == len(parts) == 1
    for spec in (whole[0], parts[0]):
        w = wrappers.Wrapper(json.loads(spec))
        for _, _, html in rows:
            labels, texts = wrappers.tokens(html)
            found = w.slots(labels)
            assert found is not None and [texts[n] for n, (_, _, same) in enumerate(found) if same] == ["Share this", "f"]


def test_a_very_long_page_and_equal_pages(spark):
    long = "<body><h1>Head</h1>" + "".join(f"<div><p>para {i}</p><table><tr><td>{i}</td></tr></table></div>" for i in range(20_000)) + "</body>"
    rows = [(1, "https://l.example.org/1", long), (2, "https://l.example.org/2", long.replace("Head", "Other")), (2, "https://l.example.org/2", long.replace("Head", "Other"))]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 3 and all(r.matched and r.text.count("para") == 20_000 for r in got) and got[1].text == got[2].text


def test_chat(spark):
    turns = [("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")]
    text, found = chat.spans(turns, chat.tagged)
    assert "".join(text[a:b] for a, b, _ in found) == text and not any(r for *_, r in found)
    text, found = chat.spans(turns, chat.latest)
    assert [r for *_, r in found] == [False, False, False, False, True] and text == chat.latest(turns)
    rows = [(1, 0, "user", "hi", 0), (1, 0, "user", "hi", 0), (1, None, None, None, 0), (None, 0, "user", "x", 0), (2, 0, "user", "y" * 100_000, 0)]
    got = {(r.conv_id, r.template): r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")).collect()}
    assert len(got) == 6 and got[1, "tagged"].n_turns == 3 and len(got[2, "tagged"].text) > 100_000


def test_codec(spark, odd):
    stored, freq = codec.write(odd)
    back = codec.unpack(stored, freq).toPandas()
    want = codec.tokens(odd).toPandas()
    whole = {}
    for r in back.sort_values("at").itertuples():
        whole.setdefault(None if pd.isna(r.doc_id) else int(r.doc_id), []).append(None if r.token_ids is None else list(r.token_ids))
    for r in want.itertuples():
        own = whole[None if pd.isna(r.doc_id) else int(r.doc_id)]
        if r.ids is None:
            assert own == [None]
        elif r.doc_id != 7:
            assert sum(own, []) == np.frombuffer(r.ids, "<u2").tolist()
    assert freq.sum() == 1 << codec.BITS
    broken = stored.limit(1).withColumn("crc", stored.crc + 1)
    with pytest.raises(Exception, match="damaged"):
        codec.unpack(broken, freq).collect()


def test_stored_tokens_decode_alone(spark, tmp_path):
    codec.query(spark, SF).write.parquet(f"{tmp_path}/tokens")
    stored = spark.read.parquet(f"{tmp_path}/tokens")
    pieces = {}
    for r in sorted(codec.restore(stored).collect(), key=lambda r: r.at):
        pieces.setdefault(r.doc_id, []).extend(r.token_ids)
    want = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in codec.tokens(common.table(spark, SF, "documents")).collect()}
    assert pieces == want
    with pytest.raises(ValueError, match="no headers"):
        codec.restore(stored.where("block_id >= 0"))


def test_codec_from_the_middle():
    rng = np.random.default_rng(0)
    x = np.minimum(rng.geometric(0.05, 300_000), 999)
    t = codec.Table(codec.frequencies(np.bincount(x, minlength=1000)))
    w, o, s = codec.encode(x, t)
    size = codec.LANES * codec.STRIDE
    assert (codec.decode(w, o, s, len(x), t) == x).all()
    assert (codec.decode_segment(w, int(o[1]), s[1], size, t) == x[size : 2 * size]).all()


def test_quality(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    got = quality.score(docs).toPandas().set_index("doc_id")
    j = labels.join(got[["kept"]], on="doc_id")
    assert j.kept[j.quality == 1].mean() > 0.99 and j.kept[j.quality == 0].mean() < 0.1
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == set(got.index[got.kept])
    r = {x.doc_id: x for x in quality.score(odd).collect()}
    assert len(r) == 12 and r[3].votes == [-1] * 12 and r[3].kept
    assert quality.keep_good(odd).columns == odd.columns


def em_by_loops(votes, rounds=200):
    """The label model by the definition: a class for each document, a rate for each class, rule and vote."""
    n, r, c = len(votes), len(quality.RULES), 1 + len(quality.KINDS)
    of = []
    for v in votes:
        bad = [1.001 if any(v[quality.RULES.index(x)] == 0 for x in kind) else 0.001 for kind in quality.KINDS]
        good = 0.1 if max(bad) > 1 else 0.95
        of.append([good] + [b / sum(bad) * (1 - good) for b in bad])
    for _ in range(rounds):
        prior = [(sum(o[k] for o in of) + 1) / (n + c) for k in range(c)]
        rate = [[[1.0, 1.0] for _ in range(r)] for _ in range(c)]
        for v, o in zip(votes, of):
            for k in range(c):
                for i in range(r):
                    if v[i] >= 0:
                        rate[k][i][v[i]] += o[k]
        rate = [[[x / sum(p) for x in p] for p in row] for row in rate]
        new = []
        for v in votes:
            p = [prior[k] * math.prod(rate[k][i][v[i]] for i in range(r) if v[i] >= 0) for k in range(c)]
            new.append([x / sum(p) for x in p])
        moved = max(abs(a - b) for x, y in zip(new, of) for a, b in zip(x, y))
        of = new
        if moved < 1e-10:
            break
    return [o[0] for o in of], rate


def test_quality_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    ids = sorted(got)
    want, rate = em_by_loops([got[i].votes for i in ids])
    assert np.allclose([got[i].quality for i in ids], want, atol=1e-6)
    known = {(r["class"], r.rule): r.good for r in quality.accuracies(docs).collect()}
    assert all(abs(known[k, x] - rate[k][i][1]) < 1e-6 for k in range(5) for i, x in enumerate(quality.RULES))


def test_ties_and_copies_have_one_quality(spark, odd):
    got = [r.quality for r in quality.score(odd).collect() if r.doc_id in (1, 7)]
    assert len(got) == 3 and len(set(got)) == 1


def test_votes_of_one_text_do_not_depend_on_its_neighbours(odd):
    texts = [r.text for r in odd.collect()]
    together = quality.votes(pa.array(texts))
    assert (together == np.concatenate([quality.votes(pa.array([s], pa.string())) for s in texts])).all()
    assert (words.sketch(pa.array(texts)) == np.concatenate([words.sketch(pa.array([s], pa.string())) for s in texts])).all()


def test_urls(spark):
    pages = [(1, "http://M.Ththth.example.net:80/es/1#x", "k"), (2, "https://user@ththth.example.net/es", "k"), (3, None, "k"), (4, "", "k"), (5, "http://notexample.net/", "k"), (6, "http://x.cheap-pills.example.com", "k"), (6, "http://x.cheap-pills.example.com", "k"), (7, "http://10.0.0.1:8080/a?b", "k"), (8, "http://example.net./" + "a" * 100_000, "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, url_key string")
    rules = spark.createDataFrame([*urls.RULES, (98, None, "block"), (99, "", "block")], "rule_id long, rule string, action string")
    small = sorted(map(str, urls.match(df, rules).collect()))
    assert small == sorted(map(str, urls.match(df, rules, small=0).collect())) and len(small) == len(pages)
    got = {r.page_id: r for r in urls.match(df, rules).collect()}
    for page, url, _ in pages:
        key = got[page].url_key
        hits = [(len(p), n, a) for n, p, a in [(n, ",".join(reversed(r.split("/", 1)[0].split("."))) + "," + ("/" + r.split("/", 1)[1] if "/" in r else ""), a) for n, r, a in urls.RULES] if key and key.startswith(p)]
        assert got[page].n_rules == len(hits) and got[page].rule_id == (max(hits)[1] if hits else -1)
    assert got[1].blocked and not got[2].blocked and got[6].blocked and got[3].url_key is None


def test_rules_are_canonical_as_urls_are(spark):
    rules = spark.createDataFrame([(1, "10.0.0.1", "block"), (2, "Example.com:8080", "block"), (3, "example.org.", "block"), (4, "https://shop.test/a", "block"), (None, "example.org", "allow"), (6, "user@mail.test:443", "block"), (7, "[2001:DB8::1]", "block"), (8, "mail.test", "allow"), (8, "mail.test", "block"), (9, None, "block"), (10, "mail.test", None)], "rule_id long, rule string, action string")
    cases = [("http://10.0.0.1/x", 1), ("http://10.0.0.10/x", -1), ("http://example.com:8080/y", 2), ("http://example.com:80801/", -1), ("http://m.example.com:8080/", -1), ("http://www.example.org/", 3), ("http://shop.test/ab", 4), ("http://www.shop.test/ab", -1), ("https://mail.test/", 8), ("http://[2001:db8::1]:80/", 7), ("http://shop.test/" + "b" * 200_000, -1)]
    pages = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(cases)], "page_id long, url string")
    for small in (8 << 20, 0):
        got = {r.page_id: r for r in urls.match(pages, rules, small=small).collect()}
        assert [got[n].rule_id for n in range(len(cases))] == [k for _, k in cases]
        assert got[8].action == "block" and got[8].n_rules == 3  # of one id the greater action; both rows and rule 6 count


def test_pii(spark, odd):
    w = pii.weights()
    cases = pii.examples(99, 200)
    good = sum({(k, a, b) for a, b, k in gold} == set(found) for (_, gold), found in zip(cases, pii.label([s for s, _ in cases], w)))
    assert good >= 0.97 * len(cases)
    got = {r.doc_id: r for r in pii.find(odd).collect()}
    assert got[3].text is None and got[4].text == "" and all(not r.n_entities for r in got.values())
    x = 'mail und.34@mail7.example.com, +1 (017) 555-7713%%% token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" in 2021, version 3.0.'
    clean = pii.redact(x, pii.label([x], w)[0])
    assert clean == 'mail [EMAIL], [PHONE]%%% token = "[SECRET]" in 2021, version 3.0.'
    out = pii.redact_documents(odd.unionByName(spark.createDataFrame([(50, x, "en", "a", len(x), "p", 0, 0, 0, "k", 0, 0)], SCHEMA)))
    assert out.columns == odd.columns and out.where("doc_id = 50").first().n_chars == len(clean)


def test_pii_repeated_with_only_prose_between():
    for x in ("phone 5551234", "call 15551234567", "phone 2015551234"):
        number = x.split()[1]
        text = f"{x} und nobody else at all has {number}, misul"
        assert pii.redact(text, pii.label([text], pii.weights())[0]).count("[PHONE]") == 2, x
    bare = "one 5551234 und 5551234, page 5551234"
    assert pii.label([bare], pii.weights()) == [[]]


def test_pii_clear_mention_decides_any_number_of_others():
    for text in ("phone 5551234 " + "and so on 5551234 " * 400, "and so on 5551234 " * 400 + "phone 5551234", "a 5551234 5551234 b " * 200 + "call 5551234 now"):
        found = pii.label([text], pii.weights())[0]
        assert pii.redact(text, found).count("5551234") == 0 and {k for k, *_ in found} == {"PHONE"}


def test_pii_against_enumeration():
    """The labels of hand-made texts are those of greatest marginal in the whole graph, by summing over all labellings."""
    w = pii.weights()
    for text in ("call 555-7713 or 5557713 now", "mail a1@b.example, ssn 123-45-6789", "card 4111 1111 1111 1111", "version 10.0.0.1 and 10.0.0.1", "x 5551234 page 5551234 phone 5551234"):
        g = pii.Graph()
        g.add(0, text)
        skip, weight = g.skip()
        n, hubs, k = len(g.feats), int(skip[:, 1].max(initial=-1)) + 1, len(pii.LABELS)
        unary = np.stack([w[0][f].sum(axis=0) for f in g.feats])
        total = np.zeros((n, k))
        for y in np.ndindex(*[k] * n):
            s = sum(unary[i, y[i]] for i in range(n)) + sum(w[1][y[a], y[b]] for a, b in g.chain)
            # a hub's label is summed out; in these texts no two of its nodes say the same
            p = math.exp(s)
            for h in range(hubs):
                p *= sum(math.exp(sum(c * w[2][y[i], z] for (i, to), c in zip(skip.tolist(), weight) if to == h)) for z in range(k))
            for i in range(n):
                total[i, y[i]] += p
        want = total.argmax(axis=1)
        marked = [any(a <= x and z <= b for _, a, b in pii.label([text], w)[0]) for _, x, z in g.spans]
        assert marked == [bool(v) for v in want], text


def test_pii_on_text_that_no_generator_made():
    w = pii.weights()
    for text, want in (
        ("Write to jane.doe@mail.example.org or ring +44 (020) 555-0199.", "Write to [EMAIL] or ring [PHONE]."),
        ("Server 192.168.10.44 answered; release 3.11.2 is from 2024-05-01.", "Server [IP] answered; release 3.11.2 is from 2024-05-01."),
        ("a" * 81 + "@mail.example.com wrote", "[EMAIL] wrote"),
        ("long " + "sub." * 30 + "name@" + "x1." * 20 + "example.com end", "long [EMAIL] end"),
    ):
        assert pii.redact(text, pii.label([text], w)[0]) == want
    started = time.time()
    pii.label(["é" * 200_000 + "@ " + "a" * 200_000 + "1"], w)
    assert time.time() - started < 20


def test_labels_do_not_depend_on_neighbours():
    w = pii.weights()
    texts = [s for s, _ in pii.examples(77, 60)] + ["", "none"]
    assert pii.label(texts, w) == [pii.label([s], w)[0] for s in texts]


def test_marginals_run_until_messages_rest():
    n = 300
    u, p = np.zeros((n, 2)), np.array([[4.0, 0.0], [0.0, 4.0]])
    u[0, 1] = 6.0
    edges = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
    got, want = pii.marginals(u, edges, np.repeat(p[None], n - 1, axis=0)), 1 / (1 + math.exp(-6.0)) - 0.5
    for i in (1, 40, 60):
        assert np.allclose(got[i, 1] - 0.5, want * math.tanh(2.0) ** i, rtol=0.05)


def test_marginals_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    u, p = rng.standard_normal((4, 3)), rng.standard_normal((3, 3, 3))
    p = p + p.transpose(0, 2, 1)
    edges = np.array([[0, 1], [1, 2], [1, 3]])
    joint = np.zeros((3, 3, 3, 3))
    for s in np.ndindex(joint.shape):
        joint[s] = math.exp(sum(u[i, s[i]] for i in range(4)) + sum(p[k, s[a], s[b]] for k, (a, b) in enumerate(edges)))
    joint /= joint.sum()
    got = pii.marginals(u, edges, p, rounds=200)
    for i in range(4):
        assert np.allclose(got[i], joint.sum(axis=tuple(k for k in range(4) if k != i)), atol=1e-3)


def test_hilbert_is_a_curve():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = packing.hilbert(g, 3)
    assert sorted(k) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def packed_by_brute_force(rows, capacity, open_packs, range_tokens):
    """The packs of (doc_id, text) rows, by the definition."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_vocabulary(), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    key = packing.keys(pa.array([s for _, s in rows], pa.string()), words.directions(packing.DIMENSIONS, 11)).tolist()
    docs = sorted(((k, (-1 if d is None else d), ref.encode_ordinary(s or ""), d) for k, (d, s) in zip(key, rows)), key=lambda x: x[:2])
    sizes = {}
    for k, _, ids, _ in docs:
        sizes[k >> packing._CELL] = sizes.get(k >> packing._CELL, 0) + len(ids)
    assert max(sizes.values()) < 2 * range_tokens
    ranges, held, out, last = {}, 0, [], 0
    for cell in sorted(sizes):
        if held >= range_tokens and sizes[cell]:
            last, held = last + 1, 0
        ranges[cell] = last
        held += sizes[cell]
    for r in range(last + 1):
        open_, closed, made = [], [], 0
        for k, _, ids, d in docs:
            if ranges[k >> packing._CELL] != r:
                continue
            at = 0
            while len(ids) - at > capacity:
                closed.append((r, made, [(d, at, ids[at : at + capacity])]))
                made, at = made + 1, at + capacity
            for p in open_:
                if sum(len(x) for *_, x in p[2]) + len(ids) - at <= capacity:
                    p[2].append((d, at, ids[at:]))
                    break
            else:
                open_.append((r, made, [(d, at, ids[at:])]))
                made += 1
                if len(open_) > open_packs:
                    closed.append(open_.pop(0))
        out += closed + open_
    return sorted(((r << 32) | n, [d for d, *_ in p], [a for _, a, _ in p], [len(x) for *_, x in p], sum((x for *_, x in p), [])) for r, n, p in out)


def packs(df):
    return sorted((r.pack_id, r.doc_ids, r.starts, r.lengths, r.token_ids) for r in df.collect())


def test_packing(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, capacity, size in ((odd, 512, 1 << 22), (docs, 2048, 20_000)):
        want = packed_by_brute_force([(r.doc_id, r.text) for r in df.collect()], capacity, 4, size)
        assert packs(packing.pack(df, capacity, 4, size)) == want == packs(packing.pack(df.repartition(7), capacity, 4, size))
        assert max(len(w[4]) for w in want) <= capacity and (df is odd or want[-1][0] >> 32 > 1)


def test_a_cell_of_copies_is_divided(spark):
    docs = spark.createDataFrame([(i, "one text that all documents have, and a few words more") for i in range(400)], "doc_id long, text string")
    got = packing.pack(docs, 64, 4, 200).collect()
    assert sorted(d for r in got for d in r.doc_ids) == list(range(400)) and len({r.pack_id >> 32 for r in got}) > 10


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    for docs, rows in ((odd, True), (odd.withColumn("extra", F.create_map(F.lit("a"), F.lit(1))), True), (odd.limit(0), False)):
        columns = docs.columns
        at = tmp_path / f"{len(columns)}{rows}"
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == columns
            out.write.parquet(str(at / name))
            docs = spark.read.parquet(str(at / name))
        kept = [r.doc_id for r in spark.read.parquet(str(at / "near_duplicates")).collect()]
        assert (1 in kept and 2 not in kept and 7 not in kept and None in kept) if rows else not kept
        assert sorted(map(str, {d for r in docs.collect() for d in r.doc_ids})) == sorted(map(str, set(kept)))


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    good, _ = em_by_loops([quality.votes(pa.array([docs[i]]))[0].tolist() for i in ids])
    ids = [i for i, q in zip(ids, good) if q >= 0.5]
    planes = words.directions(simhash.BITS, 7)
    prints = np.concatenate([np.packbits(words.sketch(pa.array([docs[i]])) @ planes > 0, axis=1) for i in ids])
    gone = set()
    group = list(range(len(ids)))  # the least place that is reached
    for _ in ids:
        for k in range(len(ids)):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[k]).sum(axis=1) <= 45)
            group[k] = min(group[n] for n in near)
    gone = {i for k, i in enumerate(ids) if group[k] != k}
    w = pii.weights()
    rows = [(i, pii.redact(docs[i], pii.label([docs[i]], w)[0])) for i in ids if i not in gone]
    assert packs(corpus_pipeline.run(spark, SF)) == packed_by_brute_force(rows, 2048, 16, 1 << 22)
