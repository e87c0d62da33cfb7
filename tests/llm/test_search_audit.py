"""Ranked search and filter interaction against brute force, with odd rows."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evalpanel.llm import audit, search

WORDS = ["the", "of", "Über", "x1", "日本", "naïve", *[f"w{i}" for i in range(300)]]


def made_docs(rng, n):
    texts = [None, "", " .,;! ", "The THE the", "a" * 5000, "été ÉTÉ", "x1_x1-x1"]
    weights = [40, 30, *[1] * (len(WORDS) - 2)]
    texts += [" ".join(rng.choices(WORDS, weights, k=rng.randint(1, 120))) + rng.choice([".", " ", "\n", "|"]) for _ in range(n)]
    texts += [texts[9]] * 15  # more ties than there are ranks
    return [(i if i != 20 else None, t) for i, t in enumerate(texts)] + [(12, texts[30])]


def brute(docs, items, top):
    rx = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    cut = lambda t: rx.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(d, Counter(w), len(w)) for d, t in docs if (w := cut(t))]
    N, L = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, tf, _ in rows for t in tf)
    out = []
    for item, text in items:
        terms = {t for t in cut(text) if t in df}
        w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) for t in terms}
        scored = [(-sum(w[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * (10 + 90 * n * N // L))) for t in terms if tf[t]), -math.inf if d is None else d) for d, tf, n in rows]
        out += [(item, r + 1, None if d == -math.inf else d, -s) for r, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:top])]
    return out


@pytest.mark.parametrize("bound", [1_000_000, 150])
def test_search_matches_brute_force(spark, bound):
    rng = random.Random(3)
    docs = made_docs(rng, 400)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))) for i in range(25)] + [(90, None), (91, "unknownterm"), (92, ""), (93, "the of"), (None, "x1 naïve")]
    d = spark.createDataFrame([(i, t, "?", 1) for i, t in docs], "doc_id long, text string, terms string, n int").repartition(5)
    q = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, score double")
    got = [tuple(r) for r in search.search(d, q, 10, bound=bound).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(docs, items, 10), key=key)
    if bound > 150:
        assert search.search(d.limit(0), q).count() == 0 and search.search(d, q.limit(0)).count() == 0


def test_walk_finds_the_best_and_skips():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = 600
        lists = []
        for _ in range(rng.integers(1, 12)):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.004, 0.02, 0.3, 0.9])).astype(np.int32)
            if len(docs):
                adds = rng.integers(1, 50, len(docs))
                lists.append((docs, adds, int(adds.max())))
        lists.sort(key=lambda x: len(x[0]))
        full = np.zeros(n, np.int64)
        for docs, adds, _ in lists:
            full[docs] += adds
        want = sorted(zip(-full, range(n)))[:10]
        docs, scores = search.best(search.accumulated(lists, n), n, 10, 0, run=37)
        assert sorted(zip(-scores, docs.tolist()))[:10] == [(s, d) for s, d in want if s < 0]


def brute_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    first, rows = {}, []
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        rows.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in rows}:
        mine, shapley = [r for r in rows if r[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                stay = [r for r in left if not r[1][f]]
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(r[1][f] for r in mine) - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
                left = stay
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_matches_brute_force(spark):
    rng = random.Random(8)
    base = [None, "", "A|", "word " * 300, " ".join(f"w{i}" for i in range(150)), "\x0b".join(f"v{i}" for i in range(120)) + "\x1c", " ".join("abc" for _ in range(120)), "É" * 10 + "A", "x" * 50_000]
    docs = [(i, rng.choice(base) if i % 3 else " ".join(rng.choice("aB") + str(rng.randrange(400)) for _ in range(rng.randint(80, 130))) + rng.choice(["", "#"]), rng.choice(["en", "fr", None, ""])) for i in range(250)]
    docs += [(None, base[4], "en"), (None, base[4], "en"), (7, docs[7][1], "fr"), (9, base[5], None)]
    labels = [(rng.randrange(250), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    d = spark.createDataFrame([(*r, 3, "c") for r in docs], "doc_id long, text string, lang string, good int, part string")
    m = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in audit.audit(d, m).collect()}
    assert got == brute_audit(docs, labels)
    assert audit.audit(d.limit(0), m).count() == 0
    assert audit.audit(d, m.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
