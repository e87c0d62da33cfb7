"""Personal data: base spans against a plain scan, added spans on planted rewritings, running merges."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from evalpanel.llm import pii


def plain(text):
    out = {k: [] for k in pii.KINDS}
    digits = lambda s: re.sub("[^0-9]", "", s)
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text if "." in text else "") if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in reversed(digits(m[0]))]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k])


def card(rng):
    d = [4, *[rng.randrange(10) for _ in range(14)]]
    total = sum(2 * x - 9 * (x > 4) if i % 2 == 0 else x for i, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def value(rng, kind):
    if kind == "email":
        return f"{rng.choice('abcdef')}{rng.randrange(99)}.x@mail{rng.randrange(9)}.example.com"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    return card(rng) if kind == "card" else f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"


def words(rng, n):
    return " ".join(rng.choice(["the", "at", "ende", "à", "naïve", "日本", "of", "v2.0", "12", "🙂"]) for _ in range(n))


def test_base_spans_match_a_plain_scan(spark):
    rng = random.Random(4)
    texts = [
        None, "", "@", "a@b", "a@b.c.d@e.f_x@y.org", "a@b.com_x@y.org,é@x.y", "x" * 3000 + "@a.b", "1.2.3.4.5.6.7.8 01.002.3.255 1.2.3.256 999.1.1.1.1", "+1+22 (3) 4-5 6 7 8 9", "+1 (269) 555-3296 4524132264652876",
        "4111-1111 1111--1111 4111111111111111 5 4111 1111 1111 1111x", "+" * 50 + "1" * 9, "٣٣٣.1.2.3.4", "🙂 1.2.3.4 🙂🙂 +49 (0) 555 123456",
    ]
    alphabet = "aZ9.%+-@ ()1234\n_é"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    texts += [" ".join(value(rng, rng.choice(pii.KINDS)) + rng.choice(["", ",", " 7", "é"]) for _ in range(rng.randint(1, 700))) for _ in range(8)]
    rows = [(i % 300, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {}
    for r in pii.span_digest(df).collect():
        got.setdefault(r["doc_id"], []).append((r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]))
    want = {}
    for i, t, _ in rows:
        spans = plain(t or "")
        want.setdefault(i, []).append((hashlib.sha256(joined(spans).encode()).hexdigest(), *[len(spans[k]) for k in pii.KINDS]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert pii.span_digest(df.limit(0)).count() == 0


def test_very_long_runs_end(spark):
    texts = ["1" * 200_000, "1-" * 100_000, "1." * 60_000 + "1", "a." * 60_000, "a@b" + ".c" * 60_000, "+1" + " " * 100_000, "(" * 100_000, "a at b dot " * 3000, ("1.2.3.4 " * 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.span_digest(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(joined(plain(t)).encode()).hexdigest(), i


def test_added_spans(spark):
    rng = random.Random(9)
    docs = []
    for i in range(900):
        kind = pii.KINDS[i % 4]
        docs.append((i, f"{words(rng, rng.randint(2, 9))} {value(rng, kind)} {words(rng, 5)}"))
    for i in range(900, 1300):  # what must be left alone
        docs.append((i, rng.choice([words(rng, 12), f'token = "{rng.randbytes(20).hex()}" {words(rng, 3)}', f"version {rng.randrange(9)}.{rng.randrange(9)} {words(rng, 3)}", f"{words(rng, 2)} 12-15 of 2021 {words(rng, 2)}"])))
    planted = {}
    for i in range(1300, 1400):
        phone, number = value(rng, "phone"), value(rng, "card")
        planted[i] = (phone, number)
        docs.append((i, f"{words(rng, 3)} {phone} {number} {words(rng, 3)}"))
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    left_alone = [i for i in range(900, 1300) if not got[i]["_added"]]
    assert len(left_alone) >= 396
    found = 0
    for i, values in planted.items():
        spans = [texts[i][s["start"] : s["end"]] for s in got[i]["_added"]] + [texts[i][m["start"] : m["end"]] for k in pii.KINDS for m in got[i]["_base"][k]]
        found += sum(any(v in s or s in v and len(s) > 10 for s in spans) for v in values)
    assert found >= 180
    for r in got.values():  # added spans overlap nothing
        every = [(m["start"], m["end"]) for k in pii.KINDS for m in r["_base"][k]]
        for s in r["_added"]:
            assert all(s["end"] <= a or b <= s["start"] for a, b in every)
            every.append((s["start"], s["end"]))


def test_without_examples_nothing_is_added(spark):
    df = spark.createDataFrame([(1, "call 555 123 4567"), (2, "a (at) b (dot) org")], "doc_id long, text string")
    assert [r["n_added"] for r in pii.span_digest(df).collect()] == [0, 0]


def test_running_merge(spark):
    rng = random.Random(2)
    rows = [(n, [rng.randrange(100) for _ in range(n)]) for n in (0, 1, 255, 256, 257, 5000)]
    df = spark.createDataFrame(rows, "n int, v array<int>")
    add = pii.running(F.col("v"), F.lit(0), lambda a, b: a + b)
    most = pii.running(F.col("v"), F.lit(-1), lambda a, b: F.greatest(a, b))
    for r in df.select("v", add.alias("s"), most.alias("m")).collect():
        assert r["s"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))] and r["m"] == [max(r["v"][: i + 1]) for i in range(len(r["v"]))]


def test_training_uses_every_span(spark):
    """A kind that is rare beside 42,000 spans of another counts in full, in the fit and in its thresholds."""
    many = [(i, " ".join(f"10.{i}.{j // 256}.{j % 256}" for j in range(700))) for i in range(60)]
    rare = [(1000 + i, f"write to a{i}@mail.example.com now, token 12-{i:03d} 99-77") for i in range(150)]
    found = pii.found_in(spark.createDataFrame(many + rare, "doc_id long, text string")).cache()
    rows = pii.training_rows(found)
    base = {r["kind"]: r["n"] for r in rows.filter("label = 1").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert base == {0: 4 * 150, 1: 2 * 42_000}  # a span and the rewritings that keep what it is
    assert rows.count() < 5000
    score, thresholds = pii.fitted(found)
    assert thresholds[0] < 2 and thresholds[1] < 2
    texts = ["ask b7 (at) mail.example.com there", "a 10 . 3 . 4 . 5 b"]
    got = pii.found_in(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = got.select("doc_id", pii.selected(F.col("_base"), F.col("_proposed"), score, thresholds).alias("a")).orderBy("doc_id").collect()
    assert [[texts[r["doc_id"]][s["start"] : s["end"]] for s in r["a"]] for r in got] == [["b7 (at) mail.example.com"], ["10 . 3 . 4 . 5"]]


def test_every_row_is_a_candidate_for_splits():
    for n in (0, 1, 9_999, 10_001, 250_000, 1_000_001):
        bins = pii.bins_for(n)
        assert max(bins * bins, 10_000) >= n and bins >= 64
