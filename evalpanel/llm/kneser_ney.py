"""Interpolated modified Kneser-Ney over UTF-8 bytes as they are: counts, probabilities and lookups are Spark tables sharded by n-gram.

Texts meet in blocks, some ``BLOCK`` bytes each, by a hash of their id. A block counts the n-grams of its trusted texts and asks for
each n-gram that any of its texts holds, once. Counts are summed, continued to lower orders, discounted and normalised by group-bys
and joins; what blocks ask for is joined with the result order by order, and goes back to the blocks, where the logarithms of
each text are added up. Nothing is sent to every task but the numbers of the languages, so the model may grow with the trusted text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalpanel.llm.common import discard, small_batches, worker_of, written

#: Bytes of an n-gram, exact in a long up to seven.
ORDER = 5
#: Bytes of text in a block, and in what a task holds before it compresses its parts of blocks.
BLOCK, HELD = 40 << 20, 48 << 20
#: At least so many blocks, so that small tables use several cores.
BLOCKS = 8
#: n-grams handled by one array operation.
PIECE = 1 << 18
#: Bytes of a batch that a block sends back: the JVM holds one at a time, a worker what it has not sent yet.
BATCH = 4 << 20


def last(m: str | int, bits: int = 8) -> Column:
    """The last m symbols of a gram."""
    return F.expr(f"gram & (shiftleft(1L, {bits} * ({m})) - 1)")


def smoothed(counted: DataFrame, order: int, bits: int = 8) -> DataFrame:
    """(model, lang, n, kind, code, value) from (lang, aside, gram, c): for each order n, ``seen`` probabilities by n-gram after discount, and the
    ``rest`` by context. Model 0 has all counts, model 1 those not set aside. A symbol has ``bits`` bits.

    Below the highest order an n-gram counts as often as it continues different symbols. Discounts for counts of one, two and
    more come from the numbers of n-grams seen once to four times. Orders and models are keys of the same group-bys and joins.
    """
    both = counted.select("lang", "gram", "c", F.explode(F.when(F.col("aside"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("model"))
    top = written(both.groupBy("model", "lang", "gram").agg(F.sum("c").alias("c")))
    longer = top.filter(F.lit(order > 1)).select("model", "lang", "gram", F.explode(F.sequence(F.lit(2), F.lit(order))).alias("m")).select("model", "lang", "m", last("m", bits).alias("gram")).distinct()
    lower = longer.groupBy("model", "lang", (F.col("m") - 1).alias("n"), last("m - 1", bits).alias("gram")).agg(F.count("*").alias("c"))
    c = written(top.select("model", "lang", F.lit(order).alias("n"), "gram", "c").union(lower.select("model", "lang", "n", "gram", "c")))
    discard(top)
    by = ["model", "lang", "n"]
    seen = c.groupBy(*by).agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    discount = lambda k: F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}"), F.lit(k / 2)), F.lit(k / 10)), F.lit(float(k)))
    seen = seen.select(*by, *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
    each = c.join(F.broadcast(seen), by)  # a row for each model, language and order
    each = each.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", F.shiftright("gram", bits))
    sums = each.groupBy(*by, "context").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
    probabilities = each.join(sums, [*by, "context"]).select(*by, F.lit("seen").alias("kind"), F.col("gram").alias("code"), ((F.col("c") - F.col("d")) / F.col("total")).alias("value"))
    return probabilities.union(sums.select(*by, F.lit("rest").alias("kind"), F.col("context").alias("code"), (F.col("freed") / F.col("total")).alias("value")))


def pieces(raws: list[bytes], order: int, most: int = PIECE) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """(places, sizes, grams): the n-gram that ends at each byte, some ``most`` at a time; a long text lies in several pieces.

    Bytes before a text count as zero.
    """
    parts, places, sizes = [], [], []

    def joined():
        codes = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        out = codes.copy()
        for j in range(1, order):
            out[j:] |= codes[:-j] << (8 * j)
        inside = np.ones(len(codes), bool)
        size = np.array(sizes) + order - 1
        inside[(np.cumsum(size) - size)[:, None] + np.arange(order - 1)] = False
        return places, sizes, out[inside]

    total = 0
    for i, raw in enumerate(raws):
        for at in range(0, len(raw), most):
            body = raw[at : at + most]
            parts += [raw[max(0, at - order + 1) : at].rjust(order - 1, b"\0"), body]
            places.append(i)
            sizes.append(len(body))
            total += len(body)
            if total >= most:
                yield joined()
                parts, places, sizes, total = [], [], [], 0
    if parts:
        yield joined()


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of several such pairs together."""
    if not any(len(k) for k, _ in parts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    at = np.argsort(keys, kind="stable")  # merges the sorted runs
    keys, counts = keys[at], counts[at]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def add_to(parts: list[tuple[np.ndarray, np.ndarray]], more: tuple[np.ndarray, np.ndarray]) -> None:
    """Puts ``more`` to ``parts``, which are added up when all but the first outgrow it."""
    parts.append(more)
    if sum(len(k) for k, _ in parts[1:]) > max(PIECE, len(parts[0][0])):
        parts[:] = [added_up(parts)]


def in_batches(tables: Iterable[pa.Table], empty: pa.Table, most: int = BATCH) -> pa.Table:
    """``tables`` as one whose chunks, which travel one by one, have some ``most`` bytes at most, or one row."""
    out, held, size = [], [], 0
    for rows in tables:
        step = max(1, rows.num_rows * most // max(1, rows.nbytes))
        for at in range(0, rows.num_rows, step):
            part = rows.slice(at, step)
            if held and size + part.nbytes > most:
                out.append(pa.concat_tables(held).combine_chunks())
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        out.append(pa.concat_tables(held).combine_chunks())
    return pa.concat_tables(out) if out else empty


def block_of(doc_id: Column, otherwise: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), otherwise)), F.lit(blocks)).cast("int")


def chunks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, payload): the rows of ``docs`` by block, as compressed Arrow streams; texts are shuffled in this form."""
    names = docs.columns

    def packed(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        rows = pa.Table.from_batches(parts).combine_chunks()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
            stream.write_table(rows)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("quality")
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0
        for batch in batches:
            block = batch.column(batch.num_columns - 1).to_numpy()
            rows = pa.RecordBatch.from_arrays(batch.columns[:-1], names)
            for b in np.unique(block).tolist():
                held.setdefault(b, []).append(rows.take(pa.array(np.flatnonzero(block == b))))
            size += batch.nbytes
            if size >= HELD:
                while held:
                    yield packed(*held.popitem())
                size = 0
        while held:
            yield packed(*held.popitem())

    return docs.select("*", block_of(F.col("doc_id"), F.col("text"), blocks)).mapInArrow(run, "block int, payload binary")


def rows_of(payloads: pa.ChunkedArray) -> Iterator[pa.Table]:
    for payload in payloads:
        yield pa.ipc.open_stream(payload.as_buffer()).read_all()


def by_language(rows: pa.Table, numbers: dict[str, int]) -> dict[int, list[int]]:
    """The places of the rows of each language that is numbered."""
    by: dict[int, list[int]] = {}
    for i, lang in enumerate(rows.column("lang").to_pylist()):
        if (number := numbers.get(lang or "")) is not None:
            by.setdefault(number, []).append(i)
    return by


def asked(parts: DataFrame, good: DataFrame, numbers: dict[str, int], order: int) -> DataFrame:
    """(block, lang, gram, c, a): each n-gram of a block, and how often trusted texts have it that are not, or are, set aside.

    ``good`` has (block, id, aside) for the ids that are trusted, as strings.
    """
    names = ["block", "lang", "gram", "c", "a"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_of("quality")
        aside = dict(zip(right.column("id").to_pylist(), right.column("aside").to_pylist()))
        found: dict[tuple[int, int], list] = {}
        for rows in rows_of(left.column("payload")):
            ids, texts = pc.cast(rows.column("doc_id"), pa.string()).to_pylist(), rows.column("text")
            for lang, places in by_language(rows, numbers).items():
                use: dict[int, list[int]] = {}
                for i in places:
                    use.setdefault({None: 0, False: 1, True: 2}[aside.get(ids[i])], []).append(i)
                for kind, some in use.items():
                    raws = [(t or "").encode() for t in texts.take(pa.array(some)).to_pylist()]
                    mine = found.setdefault((lang, kind), [])
                    for _, _, codes in pieces(raws, order):
                        add_to(mine, np.unique(codes, return_counts=True))

        def counts() -> Iterator[pa.Table]:
            for lang in sorted({lang for lang, _ in found}):
                sums = [added_up(found.pop((lang, kind), [])) for kind in (0, 1, 2)]
                keys = np.unique(np.concatenate([k for k, _ in sums]))
                columns = [np.zeros(len(keys), np.int64) for _ in (1, 2)]
                for (k, c), column in zip(sums[1:], columns):
                    column[np.searchsorted(keys, k)] = c
                yield pa.table([np.full(len(keys), left.column("block")[0].as_py(), np.int32), np.full(len(keys), lang, np.int32), keys, *columns], names)

        return in_batches(counts(), pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names))

    return parts.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(run, "block int, lang int, gram long, c long, a long")


def looked_up(grams: DataFrame, values: DataFrame, order: int) -> DataFrame:
    """(lang, gram, p0, p1): the probabilities under models 0 and 1 of the n-grams in ``grams`` (lang, gram), each of them once.

    p is what is seen after discount, plus the rest of the context times the lower order; below order 1 all bytes are alike.
    """
    below = None
    for n in range(1, order + 1):
        mine = grams if n == order else grams.select("lang", last(n).alias("gram")).distinct()
        mine = mine.withColumn("context", F.shiftright("gram", 8)).withColumn("lower", last(n - 1))
        kind = lambda k, code, *to: values.filter((F.col("n") == n) & (F.col("kind") == k)).select("lang", F.col("code").alias(code), *[F.col(f"v{m}").alias(t) for m, t in enumerate(to)])  # noqa: E731, B023
        mine = mine.join(kind("seen", "gram", "s0", "s1"), ["lang", "gram"], "left").join(kind("rest", "context", "r0", "r1"), ["lang", "context"], "left")
        if below is None:
            mine = mine.withColumns({"b0": F.lit(1 / 256), "b1": F.lit(1 / 256)})
        else:
            mine = mine.join(below.select("lang", F.col("gram").alias("lower"), F.col("p0").alias("b0"), F.col("p1").alias("b1")), ["lang", "lower"])
        below = mine.select("lang", "gram", *[(F.coalesce(f"s{m}", F.lit(0.0)) + F.coalesce(f"r{m}", F.lit(1.0)) * F.col(f"b{m}")).alias(f"p{m}") for m in (0, 1)])
    return below


def scored(parts: DataFrame, answers: DataFrame, kept: T.StructType, measure: Callable[[str], float], numbers: dict[str, int], known: tuple[frozenset, frozenset], order: int, added: tuple[str, str, str]) -> DataFrame:
    """The columns ``kept`` of the rows in ``parts``, with bits per UTF-8 byte under models 0 and 1 and a measure of the text.

    Bits are null for empty texts and for languages that a model doesn't know. ``answers`` has (block, lang, gram, p0, p1) for every
    n-gram of a block.
    """
    names = [*kept.names, *added]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_of("quality")
        langs = right.column("lang").to_numpy()
        tables = {}
        for lang in np.unique(langs).tolist():
            mine = right.filter(pa.array(langs == lang))
            keys = mine.column("gram").to_numpy()
            at = np.argsort(keys)
            tables[lang] = keys[at], [-np.log2(mine.column(p).to_numpy()[at].astype(np.float64)) for p in ("p0", "p1")]
        return in_batches((measured(rows, tables) for rows in rows_of(left.column("payload"))), empty)

    def measured(rows: pa.Table, tables: dict[int, tuple]) -> pa.Table:
        texts, n = rows.column("text"), rows.num_rows
        bits, marks = [[None] * n, [None] * n], [measure(t or "") for t in texts.to_pylist()]
        for lang, places in by_language(rows, numbers).items():
            if lang not in tables:
                continue
            keys, costs = tables[lang]
            raws = [(t or "").encode() for t in texts.take(pa.array(places)).to_pylist()]
            sums = np.zeros((2, len(raws)))
            for some, sizes, codes in pieces(raws, order):
                found = np.searchsorted(keys, codes)
                starts = np.cumsum([0, *sizes[:-1]])
                for m in (0, 1):
                    np.add.at(sums[m], some, np.add.reduceat(costs[m][found], starts))
            for j, i in enumerate(places):
                for m in (0, 1):
                    if raws[j] and lang in known[m]:
                        bits[m][i] = sums[m, j] / len(raws[j])
        return pa.table([*(rows.column(c) for c in kept.names), *(pa.array(b, pa.float64()) for b in (*bits, marks))], names)

    to = T.StructType([*kept.fields, *(T.StructField(name, T.DoubleType()) for name in added)])
    empty = to_arrow_schema(to).empty_table()
    return parts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, to)


def bits(docs: DataFrame, good: DataFrame, kept: list[str], measure: Callable[[str], float], added: tuple[str, str, str] = ("bits", "held", "measure"), order: int = ORDER) -> DataFrame:
    """The columns ``kept`` of ``docs`` (doc_id, lang, text and more), with bits per UTF-8 byte under the model of all trusted texts, those
    under the model of texts not set aside, and a measure of the text.

    ``good`` has (id, aside) for trusted ids, as strings. The result is a table in shared storage.
    """
    small_batches(docs.sparkSession)
    langs = docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.sum(F.octet_length("text")).alias("size")).collect()  # a row a language
    numbers = {r["lang"]: i for i, r in enumerate(langs)}
    blocks = max(BLOCKS, -(-sum(r["size"] or 0 for r in langs) // BLOCK))
    parts = chunks(docs, blocks)
    trusted = good.select(block_of(F.col("id"), F.col("id"), blocks).alias("block"), "id", "aside")
    # One shuffle of what blocks ask for gives the counts, the n-grams to look up, and where their answers go.
    by_gram = asked(parts, trusted, numbers, order).repartition("lang", "gram").groupBy("lang", "gram")
    wanted = written(by_gram.agg(F.sum("c").alias("c"), F.sum("a").alias("a"), F.collect_list("block").alias("blocks")))
    sums = wanted.filter("c + a > 0").select("lang", "gram", "c", "a")
    rows = F.explode(F.array(*[F.struct(F.lit(aside).alias("aside"), F.col(c).alias("c")) for aside, c in ((False, "c"), (True, "a"))]))
    counted = written(sums.select("lang", "gram", rows.alias("r")).select("lang", "gram", "r.aside", "r.c").filter("c > 0"))
    seen = counted.groupBy("lang").agg(F.max(~F.col("aside")).alias("others")).collect()  # a row a language
    known = frozenset(r["lang"] for r in seen), frozenset(r["lang"] for r in seen if r["others"])
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("value"))).alias(f"v{m}")
    values = written(smoothed(counted, order).groupBy("lang", "n", "kind", "code").agg(one(0), one(1)))
    discard(counted)
    trained = F.broadcast(values.select("lang").distinct())
    known_here = wanted.select("lang", "gram", "blocks").join(trained, "lang", "left_semi")
    p = looked_up(known_here.select("lang", "gram"), values, order)
    answers = known_here.join(p, ["lang", "gram"]).select(F.explode("blocks").alias("block"), "lang", "gram", *[F.col(f"p{m}").cast("float").alias(f"p{m}") for m in (0, 1)])
    out = written(scored(parts, answers, docs.select(*kept).schema, measure, numbers, known, order, added))
    discard(wanted)
    discard(values)
    return out
