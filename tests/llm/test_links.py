"""SimHash, embedding duplicates, nearest neighbours, passages and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalpanel.llm import ann, embedding_dedup, passages, simhash
from evalpanel.llm.common import components, forest

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pra", "sti") for b in ("r", "n", "lt", "x", "fo")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def classes(nodes, links):
    low = {n: n for n in nodes}
    while True:
        new = dict(low)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in classes({x for p in links for x in p}, links).items() if k != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = forest(*np.array(links, dtype=np.int64).T)
    assert dict(zip(a.tolist(), b.tolist())) == {k: v for k, v in classes({x for p in links for x in p}, links).items() if k != v}


def plain_fingerprint(t, n):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    hs = [xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("block", [2, 2048])
def test_simhash_links_all_pairs_within_the_radius(spark, block):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:25]:
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << b
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, 3, block).collect()
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4]
    assert classes(signed, [(r["a"], r["b"]) for r in got]) == classes(signed, near) and near


@pytest.mark.parametrize(("radius", "segments"), [(4, 3), (4, 4), (3, 2), (2, 4), (8, 4)])
def test_every_close_pair_meets_in_some_segment(radius, segments):
    rng = random.Random(radius * 10 + segments)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        assert any(r >= 0 and bin((a ^ b) >> low & (1 << width) - 1).count("1") <= r for low, width, r in simhash.segment_plan(segments, radius))


def test_simhash_documents_with_edge_cases(spark):
    rng = random.Random(2)
    base = text(rng, 300)
    rows = [(5, base), (3, base), (9, base.upper()), (11, base + " " + text(rng, 2)), (20, text(rng, 300)), (30, None), (31, ""), (32, " \t\n"), (33, "one two"), (34, "One  TWO"), (None, base), (3, base)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is None:
            assert r["component"] is None
    by = {r["id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in got}
    assert all(by[i][0] == plain_fingerprint(t, 4) for i, t in rows if i is not None)
    links = [(a, b) for a in by if a is not None for b in by if b is not None and bin(by[a][0] ^ by[b][0]).count("1") <= 4]
    assert {k: v[1] for k, v in by.items() if k is not None} == classes([k for k in by if k is not None], links)
    left = simhash.one_of_each(docs).collect()
    assert sorted((r["doc_id"] for r in left if r["doc_id"] is not None)) == sorted(r["id"] for r in got if r["id"] is not None and r["id"] == r["component"])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        v = rng.standard_normal(16)
        rows.append((i, v.tolist(), i % 3))
        if i % 5 == 0:
            rows += [(1000 + i, (3 * v + rng.standard_normal(16) * 0.3).tolist(), i % 3), (2000 + i, v.tolist(), i % 3), (3000 + i, v.tolist(), None)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [None] * 16, 1), (5004, [float("inf")] + [1.0] * 15, 1), (5005, [1.0, 2.0], 1), (None, [1.0] * 16, 2)]
    frame = spark.createDataFrame([(*r, 1.0, "a") for r in rows], "vec_id long, embedding array<float>, label int, score double, key string")
    return frame, {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}, {i: label for i, _, label in rows}


@pytest.mark.parametrize("tile", [16, 4096])
def test_embedding_links_match_all_cosines(spark, tile):
    df, good, label = vectors(spark)
    links = [(a, b) for a in good for b in good if a != b and label[a] is not None and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    low = classes([i for i in got if i is not None], links)
    assert len(got) == df.count() and links
    for i, r in got.items():
        assert r["n_links"] == sum(a == i for a, _ in links), i
        assert r["component"] == (None if i is None else low[i])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quantised_products_stay_within_their_bounds():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((60, 1500)), rng.standard_normal((50, 1500)) ** 3
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    (qa, sa, na, ea), (qb, sb, _, eb) = embedding_dedup.quantised(a), embedding_dedup.quantised(b)
    found = embedding_dedup.products(qa, qb)
    assert (found == qa.astype(np.int64) @ qb.astype(np.int64).T).all()
    assert (np.abs(a @ b.T - found * sa[:, None] * sb) <= na[:, None] * eb + ea[:, None] * (1 + 1e-9)).all()


def test_nearest_neighbours_recall_order_and_edge_cases(spark):
    df, good, _ = vectors(spark)
    good = {i: v for i, v in good.items() if len(v) == 16}
    got = ann.nearest(df, F.col("id") % 20 == 0, 20, shard=64).toPandas()
    hit = total = 0
    for q in [i for i in good if i % 20 == 0]:
        want = sorted(((-(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine["id"])
        assert [(-s, i) for s, i in zip(mine["score"], mine["id"])] == sorted((-s, i) for s, i in zip(mine["score"], mine["id"]))
        assert all(abs(s - good[q] @ good[i]) < 1e-9 for s, i in zip(mine["score"], mine["id"]))
        hit, total = hit + len({i for _, i in want} & set(mine["id"])), total + 20
    assert hit / total >= 0.9
    few = ann.nearest(df.filter("vec_id < 4"), F.col("id") == 0, 20).toPandas()
    assert sorted(few["id"]) == [1, 2, 3]
    assert ann.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_collision_plan_misses_no_more_than_asked():
    rng = np.random.default_rng(3)
    needed = ann.collision_plan(64, 1.0, 0.05)
    assert (np.abs(rng.standard_normal((20000, 64))) <= 1.0).sum(1).__lt__(needed).mean() <= 0.06


def test_passages_exact_fuzzy_nested_and_clean(spark):
    rng = random.Random(9)
    passage = text(rng, 70).split()
    fuzzy = list(passage)
    fuzzy[20], fuzzy[45:47] = "changed", ["cut"]
    halves = passage[:30], passage[30:60]
    make = lambda *middle: " ".join([text(rng, 40), *[" ".join(m) for m in middle], text(rng, 40)])
    docs = {1: make(passage), 2: make(passage), 3: make(fuzzy), 4: text(rng, 200), 5: make(passage[:40]), 6: make(passage, ["between"] * 60, passage), 7: None, 8: "", 9: "short text"}
    docs |= {10: make(halves[0]), 11: make(halves[1]), 12: "x " * 400, 13: "x " * 400}
    frame = spark.createDataFrame([(i, t, 7, "s") for i, t in docs.items()] + [(4, docs[4], 1, "s"), (None, docs[1], 1, "s")], "doc_id long, text string, n_chars long, start string")
    got = passages.repeats(frame).toPandas()
    assert set(got["doc_id"]) == {2, 3, 6, 13}
    two = got[got["doc_id"] == 2].iloc[0]
    words = docs[2].split()[int(two["start"]) : int(two["end"])]
    assert " ".join(passage) in " ".join(words) and len(words) <= 76 and two["source_id"] == 1
    assert got[got["doc_id"] == 3]["identity"].iloc[0] < 1
    cut = {r["doc_id"]: r for r in passages.without_repeats(frame).collect() if r["doc_id"] is not None}
    assert cut[1]["text"] == docs[1] and cut[4]["text"] == docs[4] and cut[7]["text"] is None and cut[8]["text"] == ""
    assert 13 not in cut and " ".join(passage) not in cut[2]["text"] and cut[2]["n_chars"] == len(cut[2]["text"])
    assert cut[2]["text"].split()[:30] == docs[2].split()[:30] and cut[2]["text"].split()[-30:] == docs[2].split()[-30:]
    assert passages.repeats(frame.limit(0)).count() == 0


def test_passages_in_very_many_documents_are_all_found(spark, monkeypatch):
    rng = random.Random(11)
    shared = text(rng, 60)
    frame = spark.createDataFrame([(i, f"{text(rng, 30)} {shared} {text(rng, 30)}") for i in range(400)], "doc_id long, text string")
    for common in (64, 1000):  # matched within tasks first, or all by the shuffle
        monkeypatch.setattr(passages, "COMMON", common)
        got = passages.repeats(frame).toPandas()
        whole = got[got["end"] - got["start"] >= 60]
        assert set(whole["doc_id"]) == set(range(1, 400)) and (whole["source_id"] < whole["doc_id"]).all()


def test_star_over_batches_equals_star_at_once():
    rng = np.random.default_rng(6)
    rows = np.unique(np.stack([rng.integers(0, 12, 600), rng.integers(0, 6, 600), rng.integers(0, 40, 600)]), axis=1)
    seed, doc, place = rows[0], rows[1], rows[2].astype(np.int32)
    matched, ref, y = passages.star(seed, doc, place)
    for i in np.flatnonzero(matched):
        own = [p for s, d, p in rows.T if s == seed[i] and d == doc[i]]
        first = min(d for s, d, _ in rows.T if s == seed[i])
        there = [p for s, d, p in rows.T if s == seed[i] and d == first]
        assert ref[i] == first and y[i] == there[min(own.index(place[i]), len(there) - 1)]
    assert matched.sum() == sum(d > min(e for s2, e, _ in rows.T if s2 == s) for s, d, _ in rows.T)


def test_chains_follow_the_best_order():
    x, y = np.array([0, 4, 8, 12, 16, 20]), np.array([100, 104, 3, 112, 116, 120])
    found = passages.chains_of(x, y)
    assert found[0].tolist() == [0, 1, 3, 4, 5] and [c.tolist() for c in found[1:]] == [[2]]


def test_similar_documents_by_exact_similarity(spark):
    import corpus_pipeline
    from evalpanel.llm import similar

    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    plain = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for k in range(300):  # pairs on both sides of 0.8: a stretch of the end is other text
        base = plain(200)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 200 - k % 50] + plain(k % 50)))]
    rows += [(1000 + k, " ".join(plain(6))) for k in range(3000)]  # two shingles each
    rows += [(5000, None), (5001, ""), (5002, "One two"), (5003, "one  TWO"), (None, rows[0][1]), (0, rows[0][1])]

    def sets(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    held = {i: sets(t) for i, t in rows if i is not None}
    alike = lambda a, b: len(held[a] & held[b]) / len(held[a] | held[b])
    links = [(2 * k, 2 * k + 1) for k in range(300) if alike(2 * k, 2 * k + 1) >= 0.8] + [(5000, 5001), (5002, 5003)]
    assert sum(alike(2 * k, 2 * k + 1) < 0.9 for k in range(300)) > 100 and len(links) < 300
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = similar.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all(r["component"] is None for r in got if r["id"] is None)
    assert {r["id"]: r["component"] for r in got if r["id"] is not None} == classes(list(held), links)
    left = corpus_pipeline.distinct(spark, docs, None).collect()
    assert sorted({r["doc_id"] for r in left if r["doc_id"] is not None}) == sorted({i for i, c in classes(list(held), links).items() if i == c})
    assert similar.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 1024])
def test_links_under_a_key_of_many_nodes_are_dealt_in_tiles(spark, block):
    from evalpanel.llm import similar

    rng = random.Random(21)
    common = [f"w{i}" for i in range(60)]
    texts = [" ".join(common[:40] + [rng.choice(WORDS) for _ in range(rng.choice([2, 4, 30]))]) for _ in range(90)]
    sets = [similar.shingles(t, 5) for t in texts]
    keys = [[1, 10 + i % 3, 2] for i in range(len(texts))]  # key 2 is never the first common one
    rows = [(i, sets[i].tobytes(), keys[i]) for i in range(len(texts))]
    held = spark.createDataFrame(rows, "node long, held binary, keys array<long>")
    left = spark.createDataFrame([(k, i, i // 2) for i in range(len(texts)) for k in keys[i]], "key long, node long, group long").repartition(3)
    got = similar.links_under_keys(left, held, 0.8, block).collect()
    alike = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8
    links = [(i, j) for i in range(90) for j in range(i) if i // 2 != j // 2 and alike(sets[i], sets[j])]
    assert 100 < len(links) < 4000
    assert classes(range(90), [(r["a"], r["b"]) for r in got]) == classes(range(90), links)


def test_spanning_links_are_given_links():
    from evalpanel.llm.common import spanning

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, 900), rng.integers(0, 300, 900)
    x, y = spanning(a, b)
    assert set(zip(x.tolist(), y.tolist())) <= set(zip(a.tolist(), b.tolist()))
    assert classes(range(300), list(zip(x.tolist(), y.tolist()))) == classes(range(300), list(zip(a.tolist(), b.tolist())))
    assert len(x) == 300 - len(set(classes(range(300), list(zip(a.tolist(), b.tolist()))).values()))


def test_near_duplicates_take_the_steps_of_simhash(spark):
    from evalpanel.llm import similar

    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:399], "other"]), " ".join(f"v{i}" for i in range(400))]
    nodes = spark.createDataFrame([(i, similar.majority(similar.shingles(t, 5))) for i, t in enumerate(texts)], "node long, fp long")
    assert [tuple(r) for r in similar.fingerprint_pairs(nodes).collect()] == [(0, 1)]
