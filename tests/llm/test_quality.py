"""The sharded Kneser-Ney model: against a plain one, on letters that folding confuses, on shuffled words, on odd rows."""

import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.llm import kneser_ney, quality, toxicity


def grams(raw, n):
    raw = bytes(n - 1) + raw
    return [raw[i : i + n] for i in range(len(raw) - n + 1)]


def plain_bits(trusted, order):
    """A function text -> bits per byte, by the textbook formulas."""
    top = Counter(g for t in trusted for g in grams(t.encode(), order))
    orders = {order: top}
    for m in range(order, 1, -1):
        orders[m - 1] = Counter(g[1:] for g in {g[len(g) - m :] for g in top})
    tables = {}
    for n, counts in orders.items():
        k = Counter(counts.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else None
        d = []
        for c in (1, 2, 3):
            x = c - (c + 1) * y * k[c + 1] / k[c] if y is not None and k[c] else c / 2
            d.append(min(max(x, c / 10), c))
        total, freed = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        tables[n] = counts, d, total, freed

    def p(g):
        if not g:
            return 1 / 256
        counts, d, total, freed = tables[len(g)]
        context = g[:-1]
        if context not in total:
            return p(g[1:])
        c = counts[g]
        return ((c - d[min(c, 3) - 1]) if c else 0) / total[context] + freed[context] / total[context] * p(g[1:])

    return lambda text: -sum(math.log2(p(g)) for g in grams(text.encode(), order)) / len(text.encode())


def written(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r["doc_id"]: r for r in quality.op4(spark, str(folder)).collect()}


def test_letters_that_folding_confuses_count_as_different(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("АБВГ") for _ in range(5)) for _ in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40)), "ru", "s") for i in range(60)]
    other = docs[0][1].replace("А", "М").replace("Б", "Н")  # the same classes of bytes
    got = written(spark, tmp_path, [*docs, (100, docs[0][1], "ru", "s"), (101, other, "ru", "s")], [(i, 1, 0) for i in range(60)])
    assert got[101]["bits"] > got[100]["bits"] + 0.5
    assert got[100]["kept"] and not got[101]["kept"]


@pytest.mark.parametrize("order", [1, 3, 5])
def test_bits_match_a_plain_model(spark, order):
    rng = random.Random(order)
    text = lambda: "".join(rng.choice("ab éß日 \n") for _ in range(rng.randint(1, 60)))
    docs = [(i, text(), rng.choice(["x", "y"])) for i in range(80)] + [(200, "", "x"), (201, None, "x"), (202, "zz", None), (None, "ab", "x")]
    df = spark.createDataFrame([d for d in docs for _ in range(1 + (d[0] == 7))], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    good = {r["id"]: r["aside"] for r in quality.trusted_ids(labels).collect()}
    assert len(good) == 49 and 0 < sum(good.values()) < 49
    got = kneser_ney.bits(df, quality.trusted_ids(labels), ["doc_id", "lang", "text"], quality.repeats, order=order).collect()
    assert len(got) == len(docs) + 1
    for lang in ("x", "y"):
        mine = [(str(i), t) for i, t, where in docs for _ in range(1 + (i == 7)) if where == lang and str(i) in good]
        for model, trusted in (("bits", [t for _, t in mine]), ("held", [t for i, t in mine if not good[i]])):
            want = plain_bits(trusted, order)
            for r in got:
                if r["lang"] == lang:
                    assert r[model] == (pytest.approx(want(r["text"]), rel=1e-5) if r["text"] else None)
    assert [r["bits"] for r in got if r["lang"] is None] == [None]


def test_long_texts_lie_in_several_pieces():
    raws = [b"", b"abcabc" * 50, b"x", b"hello"]
    plain = [int.from_bytes(g, "big") for raw in raws for g in grams(raw, 5)]
    for most in (7, 1 << 22):
        out, sizes = [], Counter()
        for places, size, codes in kneser_ney.pieces(raws, 5, most):
            assert sum(size) == len(codes)
            out += codes.tolist()
            sizes.update(dict(zip(places, size)) if len(set(places)) == len(places) else {i: sum(s for p, s in zip(places, size) if p == i) for i in set(places)})
        assert out == plain and all(sizes[i] == len(raw) for i, raw in enumerate(raws))


class Grouped:
    """Stands for the tables of a cogroup; ``run`` is what its groups would be handed to."""

    def groupBy(self, *_):
        return self

    cogroup = groupBy

    def applyInArrow(self, run, _):
        self.run = run
        return run


def block_of_texts(texts, per_payload=20):
    payloads = []
    for at in range(0, len(texts), per_payload):
        some, sink = texts[at : at + per_payload], pa.BufferOutputStream()
        rows = pa.table([pa.array(range(at, at + len(some)), pa.int64()), pa.array(["x"] * len(some)), pa.array(some)], ["doc_id", "lang", "text"])
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows)
        payloads.append(sink.getvalue().to_pybytes())
    return pa.table([pa.array([0] * len(payloads), pa.int32()), pa.array(payloads, pa.binary())], ["block", "payload"])


def test_a_block_comes_back_in_small_batches_and_is_counted_in_small_memory():
    """Whole blocks as one batch, and large pieces, took the pipeline's executors over their memory."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefgh ", k=40_000)) for _ in range(300)]  # 12 MB
    left, trusted = block_of_texts(texts), pa.table([pa.array(["1", "2"]), pa.array([False, True])], ["id", "aside"])
    run = kneser_ney.asked(Grouped(), Grouped(), {"x": 0}, 5)
    tracemalloc.start()
    counts = run(left, trusted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    assert all(b.nbytes <= kneser_ney.BATCH for b in counts.to_batches())
    assert sum(counts.column("c").to_pylist()) == len(texts[1]) and sum(counts.column("a").to_pylist()) == len(texts[2])
    assert len(set(counts.column("gram").to_pylist())) == counts.num_rows
    right = pa.table([counts.column("lang"), counts.column("gram"), *(pa.array([0.5] * counts.num_rows, pa.float32()) for _ in "ab")], ["lang", "gram", "p0", "p1"])
    kept = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    out = kneser_ney.scored(Grouped(), Grouped(), kept, len, {"x": 0}, (frozenset([0]), frozenset([0])), 5, ("bits", "held", "size"))(left, right)
    assert out.column("text").to_pylist() == texts and set(out.column("bits").to_pylist()) == {1.0}
    assert out.column("size").to_pylist() == [40_000.0] * 300
    assert max(b.nbytes for b in out.to_batches()) <= kneser_ney.BATCH and len(out.to_batches()) < 6


def test_texts_go_to_workers_in_small_batches(spark):
    """At 10,000 rows a batch, the texts alone took the JVM and the workers of the pipeline over their memory."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "'x' AS lang", "repeat('ab cd ', 1000) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS INT) AS toxic")

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["size"])

    for judge in (lambda: kneser_ney.bits(docs, quality.trusted_ids(labels), ["doc_id"], len), lambda: toxicity.train(docs, labels)):
        judge()
        sizes = [r["size"] for r in docs.mapInArrow(size, "size long").collect()]
        assert sum(sizes) >= 4000 * 6000 and max(sizes) <= 6 << 20
        spark.conf.unset(limit)


def test_quality_on_held_out_labels_by_joins(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs, labels.filter("doc_id % 2 = 0"), ["doc_id"]).join(labels.filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").toPandas()
    kept = got.groupby("quality")["kept"].mean()
    assert kept[1] >= 0.97 and kept[0] <= 0.02
    assert set(docs.columns) == set(quality.good_documents(docs, labels).columns)
    assert quality.judged(docs, labels.filter(F.lit(False)), ["doc_id"]).filter("kept AND bits IS NULL").count() == docs.count()
