"""Tokens, packing, page text, chat rendering, quality, toxicity and the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evalpanel.llm import bpe, catalog, chat, packing, pages, quality, toxicity
from evalpanel.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\r\nlines\n\n", "don't we'll I'd", "x" * 3000, "!?" * 500, "日本語のテキスト", "naïve café", "éa", "\x1c \x85\xa0 ",
    "123 4567 a1b2", "<|endoftext|> is text", "word " * 2000, "🙂🙃 emoji", "A" + " " * 50 + "B",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, length string")


def test_bpe_matches_the_library_and_round_trips(spark):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(RANKS, "rb").read()), special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeinorst ,.'\né日 ") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    got = bpe.decode(bpe.encode(frame(spark, texts), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == ref.encode_ordinary(t), t
        assert bytes(r["decoded"]) == t.encode() and r["length"] == "x"
    assert bpe.decode(bpe.encode(frame(spark, []), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_bpe_query_digests(spark, sf):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(RANKS, "rb").read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in catalog.QUERIES["op10_bpe"](spark, sf).collect():
        ids = ref.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(3)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randint(1, 80))), reverse=True)
        rooms, want = [], []
        for n in lengths:
            fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
            i = min(fits)[1] if fits else len(rooms)
            if not fits:
                rooms.append(50)
            want.append(rooms[i])
            rooms[i] -= n
        bins, offsets = packing.best_fit(lengths, 50)
        assert [50 - o for o in offsets] == want and len(set(bins)) == len(rooms)


def test_packing_keeps_every_token_and_fills_sequences(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = ODD + ["some words here. " * n for n in range(1, 60)]
    docs = frame(spark, texts)
    docs = docs.union(docs.filter("doc_id = 3"))
    got = packing.pack(docs, WORDS, capacity=64).toPandas()
    for i, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        mine = got[got["doc_id"] == i].sort_values(["piece", "sequence_id", "offset"])
        raw = b"".join(map(bytes, mine["ids"]))
        assert np.frombuffer(raw, "<u4").tolist() == want * (2 if i == 3 else 1)
        assert (mine["length"].iloc[:-1] == 64).all() or i == 3
    ends = got.sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id")["length"].cumsum() - ends["length"] == ends["offset"]).all()
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 64 and len(filled) <= 1.02 * -(-filled.sum() // 64) + 1
    whole = packing.sequences(packing.pack(docs, WORDS, capacity=64)).toPandas()
    assert (whole["ids"].map(len) == 4 * whole["length"]).all() and whole["length"].sum() == got["length"].sum()
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_packing_query(spark, sf):
    got = catalog.QUERIES["op5_packing"](spark, sf).toPandas()
    tokenizer = Tokenizer.from_file(WORDS)
    total = 0
    by = dict(list(got.groupby("doc_id")))
    for r in table(spark, sf, "documents").collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for p in by[r["doc_id"]].itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.start == 4096 * p.piece
    assert got["length"].sum() == total and got["sequence_id"].nunique() <= -(-total // 4096) + 2


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header><a href="/">Site</a></header><nav class="menu"><ul><li><a>Home</a><li><a>About</a></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="wrap sidebar-right"><article><header><h1>Title %d</h1></header><div class="post-body"><p>First   para<b>graph</b> %d &amp; more&nbsp;here<p>Second<br>line %d
<form><input>Sign up</form><aside>Related</aside><!-- <p>no</p> --><noscript>js</noscript></div><p>Subscribe and follow us daily</p><section id="comments"><article class="comment"><p>Nice!</p></article></section></article></div>
<div class="ad">Buy</div><div class="siteHeader">Top</div><div id="sideBar">Links</div><div style="display: none">Hidden</div><footer>&copy; x</footer></body></html>"""


def test_pages_without_boilerplate(spark):
    html = {i: PAGE % (i, i * 7, i * i) for i in range(6)} | {10: None, 11: "", 12: "just text", 13: "<p>one<p>two <div>three", 14: "<body><div class=comments>c</div><p>only &#8364; &lt;b&gt;"}
    urls = {i: "http://a.example/%d" % i for i in range(6)} | {10: None, 11: "http://b.example", 12: "HTTP://c.example/x", 13: "//d.example/y", 14: "e"}
    rows = [(i, urls[i], html[i], "t", 3) for i in html]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string, host int")
    got = pages.main_text(df).collect()
    assert len(got) == len(rows) + 1
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert by[i] == f"Title {i} First paragraph {i * 7} & more here Second line {i * i}", i
    assert pages.extract(['<main><p>A long text that says a lot.</p><article><p>card</p></article></main>']) == ["A long text that says a lot. card"]
    assert pages.extract(['<div id=side-bar>x</div><div class=header>y</div><div class=header><h1>T</h1></div><p>z']) == ["T z"]
    assert [by[i] for i in (10, 11, 12, 13, 14)] == ["", "", "just text", "one two three", "only € <b>"]
    assert pages.main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text():
    same = [PAGE % (1, 1, 1)] * 8
    near = [(PAGE % (1, 1, 1)).replace("Second", f"Second {k}") for k in range(8)]
    assert all("First paragraph" in t for t in pages.extract(same) + pages.extract(near))


def test_page_query_keeps_article_text(spark, sf):
    import html as H
    import re

    raw = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    for r in catalog.QUERIES["op2_main_text"](spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", raw[r["page_id"]], re.S)[1]
        body = re.sub(r"<(?=[a-zA-Z/!?])[^>]*\Z", "", body)
        want = " ".join(H.unescape(re.sub(r"</?(p|h1|br)[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_chat_collapses_snapshots(spark):
    logs = {1: "abc", 2: "ab", 3: "abc", 4: "abd", 5: "b", 6: "a", 7: "xyz"}
    rows = [(i, k, "user" if k % 2 == 0 else "assistant", ch, 0) for i, s in logs.items() for k, ch in enumerate(s)]
    rows += [(1, 0, "user", "a", 0), (8, 0, None, "a", 0), (9, 0, "user", None, 0), (9, None, "system", "s", 0), (None, 0, "user", "q", 0)]
    rows += [(10, k, "user", str(k), 0) for k in range(600)] + [(11, k, "user", str(k), 0) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    got = chat.rendered(df).toPandas()
    assert sorted(set(got["conv_id"])) == [1, 4, 5, 7, 8, 9, 10]
    assert got.loc[got["conv_id"] == 1, "copies"].item() == 2
    assert got.loc[got["conv_id"] == 9, "text"].item() == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    long = got[got["conv_id"] == 10].sort_values("part")
    assert long["part"].tolist() == [0, 1, 2] and "".join(long["text"]).count("<|im_start|>") == 600
    conversations = df.toPandas()  # noqa: F841  read by the SQL
    conversations["turn"] = conversations["turn"].astype("Int64")
    want = duckdb.sql(chat.SQL).df().sort_values(["conv_id", "part"], ignore_index=True)
    got = got.sort_values(["conv_id", "part"], ignore_index=True)
    assert want["text"].tolist() == got["text"].tolist() and want["copies"].tolist() == got["copies"].tolist()
    assert chat.rendered(df.limit(0)).count() == 0


def test_kneser_ney_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("en", i % 4 == 0, "the cat sat on the mat. " * 3 + str(i)) for i in range(20)], "lang string, aside boolean, text string")
    counts = quality.gram_counts(docs, 3).groupBy("gram").agg(F.sum("c").alias("c"))
    plain = {}
    of = quality.classes()
    for r in docs.collect():
        for g in quality.grams(r["text"].encode(), of, 3).tolist():
            plain[g] = plain.get(g, 0) + 1
    assert {r["gram"]: r["c"] for r in counts.collect()} == plain
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    model = quality.train(docs.withColumn("doc_id", F.monotonically_increasing_id() % 20), labels, order=3)
    p = 2.0 ** (-model.tenths("en").astype(float) / 10)
    assert np.allclose(p.reshape(-1, 64).sum(1), 1, atol=0.04)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.scored(docs, model).join(labels.filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").toPandas()
    kept = got.groupby("quality")["kept"].mean()
    assert kept[1] >= 0.98 and kept[0] <= 0.15


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.scored(docs.drop("source"), model).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    found = got.groupby("label")["toxic"].mean()
    assert found[1] >= 0.9 and found[0] <= 0.01
    assert got["severity"].between(0, 3).all()


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(3000)
    grades = np.searchsorted([-0.5, 0.8, 2.0], 1.5 * x + rng.logistic(size=3000))
    w, t = toxicity.cumulative_link(np.arange(3000), np.zeros(3000, int), x, grades, 1, 0.0, 600)
    assert w[0] == pytest.approx(1.5, abs=0.15) and t == pytest.approx([-0.5, 0.8, 2.0], abs=0.2)


def test_classifiers_without_labels_keep_everything_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, None, 0.5, "k"), (2, "", "en", 0.5, "k"), (2, "", "en", 0.5, "k"), (None, "y " * 50000, "xx", 0.5, "k")], "doc_id long, text string, lang string, bits double, toxic string")
    labels = spark.createDataFrame([(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for out in (quality.good_documents(docs, labels), toxicity.harmless_documents(docs, labels)):
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    empty = docs.limit(0)
    clash = docs.selectExpr("*", "1 AS _bits", "2 AS _kept", "3 AS __kept", "4 AS _toxic", "5 AS _Severity")
    for out in (quality.good_documents(clash, labels), toxicity.harmless_documents(clash, labels)):
        assert out.columns == clash.columns and {(r["_bits"], r["_kept"], r["__kept"], r["_toxic"]) for r in out.collect()} == {(1, 2, 3, 4)}
    assert quality.good_documents(empty, labels.limit(0)).count() == 0 and toxicity.harmless_documents(empty, labels.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_shrink(spark, sf):
    docs = table(spark, sf, "documents")
    ids = {r["doc_id"] for r in docs.collect()}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        now = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == names and now <= ids and now, name
        ids = now
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(final["doc_id"]) == ids


def test_pages_nested_very_deep():
    deep = 100_000
    font, div = "".join(f"<font size={k % 7}>" for k in range(deep)), "<div class='a'>" * deep
    texts = [f"{font}some text {k}</font>" for k in range(3)] + [f"{div}more text {k}" for k in range(3)] + ["<div>x" * deep, "<header class=header>" * 5000 + "<li>y</b>" * 5000]
    got = pages.extract(texts)
    assert got[:6] == [f"some text {k}" for k in range(3)] + [f"more text {k}" for k in range(3)] and got[6] == " ".join(["x"] * deep)


def test_pages_of_a_host_of_any_size_lose_their_template(spark):
    page = "<body><article><p>Same words on every page of this site</p><p>Own words of page %d that are not on any other page of it</p></article></body>"
    rows = [(n * 1000 + i, f"http://{n}.example/{i}", page % i) for n in (3, 64, 65, 66, 129, 130) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = [{r["page_id"]: r["text"] for r in pages.main_text(d).collect()} for d in (df.repartition(7), df.repartition(2).orderBy(F.desc("page_id")))]
    assert results[0] == results[1] == {i: f"Own words of page {i % 1000} that are not on any other page of it" for i, _, _ in rows}


def test_toxicity_reads_long_runs_to_their_end():
    words = toxicity.words_of("短" * 500 + "毒毒毒毒 " + "_".join(["harmless"] * 50 + ["vile"]) + " plain")
    assert "毒毒毒毒" in words and "vile" in words and words[-1] == "plain" and words.count("harmless") == 50
    assert all(len(w) <= toxicity.LONGEST for w in words)
