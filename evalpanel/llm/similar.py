"""Near-duplicates by word shingles: SimHash by multi-index hashing, MinHash bands for what its radius misses, and every link
verified by exact Jaccard similarity.

1. A text is the set of its lower-cased word shingles (64-bit hashes); a text of fewer words is one shingle. Equal sets are one node.
2. A node's fingerprint has the majority bits of its shingles. Fingerprints within ``RADIUS`` bits are found by ``simhash.close_links``, as
   pairs that span its groups; nodes of one fingerprint are tied to the first of them.
3. Nodes meet under ``BANDS`` keys of ``ROWS`` minima each. Neighbours in the order of (key, node) and the pairs of step 2 are verified on
   the sets, and verified links make first components; a large group of copies costs a few links a node.
4. All pairs under a key that are still in different components are verified too, so every pair with a common key and a
   similarity of ``least`` is in one component, and no link is below it. At similarity s a pair has a common key with
   probability 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8. No pair is a row: a key's nodes are dealt out in tiles of two blocks, whose
   tasks return forests of their links. A pair with several common keys is verified under the first of them only.

Defined results: null and empty texts are alike; rows with a null id link nothing and belong to no component (null); rows with
one id may have several texts; extra columns are ignored, and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalpanel.llm.common import components, forest, sliced, small_batches, worker_of, written
from evalpanel.llm.passages import mixed
from evalpanel.llm.simhash import close_links

BANDS, ROWS = 16, 4
RADIUS = 4
#: Nodes of a key in one block.
BLOCK = 1024


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of the different shingles of a text, ascending; one for a text of at most ``words`` words, none included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    each = mixed(np.fromiter(map(crc32, parts), np.uint64, len(parts)) + np.uint64(1))
    n = max(len(parts) - words + 1, 1)
    found = np.zeros(n, np.uint64)
    for j in range(min(words, len(parts))):
        found *= np.uint64(0x100000001B3)
        found += each[j : j + n]
    return np.unique(mixed(found))


def multipliers() -> np.ndarray:
    return mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1, 1) | np.uint64(1)


def keys_of(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The key of each band: a hash of its minima."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(low, ((found[at : at + 1024] ^ by[1]) * by[0]).min(1), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(0x100000001B3) + row)
    return out.view(np.int64)


def node_of(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), 7)).astype(np.int64))


def majority(found: np.ndarray) -> int:
    """The SimHash of a set of shingles: the bits set in more than half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 4096):
        ones += np.unpackbits(found[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(np.int64)[0])


def prints(docs: DataFrame, words: int) -> DataFrame:
    """(id, th, node, fp, keys) of ``docs`` (id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("similar")
        by = multipliers()
        for batch in sliced(batches):
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            keys = np.concatenate([keys_of(s, by) for s in sets])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            nodes, fps = pa.array([node_of(s) for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, fps, keys], ["id", "th", "node", "fp", "keys"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, node long, fp long, keys array<long>")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(node, held): the shingles of each different node of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "held"])

    return texts.select("text").mapInArrow(run, "node long, held binary").groupBy("node").agg(F.first("held").alias("held"))


def neighbours(bands: DataFrame) -> DataFrame:
    """(a, b): nodes that follow each other under a key. Long runs of a key go on in the next partition; step 3 sees to their seams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((2, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch.column(c).to_numpy() for c in (0, 1)])], axis=1)
            same = rows[0, 1:] == rows[0, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(rows[1, :-1][same]), pa.array(rows[1, 1:][same])], ["a", "b"])
            last = rows[:, -1:]

    return bands.select("key", "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                few, many = min(len(x), len(y)), max(len(x), len(y))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if few >= least * many else 0
                keep.append(shared >= least * (few + many - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda end, name: sets.select(F.col("node").alias(end), F.col("held").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, fp) with close fingerprints, spanning the groups that all such pairs make."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"_{name}"))
    near = close_links(first, RADIUS, real=True).join(end("a"), "a").join(end("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return same.union(near)


def tile_links(sets: list[np.ndarray], keys: np.ndarray, groups: np.ndarray, key: int, middle: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the pairs of a tile that are in different groups, have ``key`` as their first common key and are similar enough.

    The first ``middle`` sets are compared with the others, or all with each other if there are no others.
    """
    whole = middle == len(sets)
    start = 0 if whole else middle
    sizes = np.array([len(s) for s in sets])
    held = np.concatenate(sets[start:])
    order = np.argsort(held, kind="stable")
    owner, held = np.repeat(np.arange(start, len(sets)), sizes[start:])[order], held[order]
    found: list[tuple[int, np.ndarray]] = []
    for x in range(middle):
        y = np.arange(max(start, x + 1), len(sets))
        y = y[(groups[y] != groups[x]) & (np.minimum(sizes[y], sizes[x]) >= least * np.maximum(sizes[y], sizes[x]))]
        if len(y):
            common = keys[y] == keys[x]
            y = y[keys[x][common.argmax(1)] == key]
        if not len(y):
            continue
        low, high = np.searchsorted(held, sets[x], "left"), np.searchsorted(held, sets[x], "right")
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(owner[at], minlength=len(sets))[y]
        y = y[shared >= least * (sizes[y] + sizes[x] - shared)]
        found.append((x, y))
    x = np.repeat([x for x, _ in found], [len(y) for _, y in found]).astype(np.int64)
    return x, np.concatenate([y for _, y in found]) if found else x


def links_under_keys(left: DataFrame, sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join what all similar pairs of different groups under a key of ``left`` (key, node, group) join.

    ``sets`` has (node, held, keys). A task holds one tile at a time: the sets of two blocks.
    """
    blocks = left.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = left.join(blocks, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), "node", "group")
    rows = dealt.join(sets, "node").select("key", "i", "j", "second", "node", "group", "held", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        waiting = 0

        def links(tile: pa.Table) -> np.ndarray:
            held = [np.frombuffer(h, np.uint64) for h in tile.column("held").to_pylist()]
            keys = np.array(tile.column("keys").to_pylist(), np.int64)
            nodes, groups, second = (tile.column(c).to_numpy() for c in ("node", "group", "second"))
            x, y = tile_links(held, keys, groups, tile.column("key")[0].as_py(), int((~second).sum()), least)
            return np.stack([nodes[x], nodes[y]])

        def tiles() -> Iterator[pa.Table]:
            waits: list[pa.Table] = []
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                marks = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
                if waits and rows.num_rows:
                    last = [waits[-1].column(c)[0].as_py() for c in ("key", "i", "j")]
                    if list(marks[:, 0]) != last:
                        yield pa.concat_tables(waits)
                        waits = []
                cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
                edges = [0, *cuts.tolist(), rows.num_rows]
                for low, high in zip(edges, edges[1:]):
                    if low and waits:
                        yield pa.concat_tables(waits)
                        waits = []
                    if high > low:
                        waits.append(rows.slice(low, high - low))
            if waits:
                yield pa.concat_tables(waits)

        for tile in tiles():
            gathered.append(links(tile))
            waiting += gathered[-1].shape[1]
            if waiting > 500_000:
                gathered, waiting = [np.stack(forest(*np.concatenate(gathered, axis=1)))], 0
        if gathered:
            a, b = forest(*np.concatenate(gathered, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "second").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, component): every row with the smallest id reachable through pairs of similarity ``least`` or more."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    all_rows = written(prints(given, words))
    nodes = all_rows.filter("id IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"), F.min("th").alias("th"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    bands = nodes.select("node", F.explode("keys").alias("key"))
    met = bands.groupBy("key").count().filter("count > 1").select("key")
    bands = written(bands.join(met, "key"))
    tried = written(neighbours(bands).union(fingerprint_pairs(nodes.select("node", "fp"))).distinct())
    ends = bands.select("node").union(tried.select("a")).union(tried.select("b")).distinct()
    asked = nodes.select("node", "th").join(ends, "node", "left_semi").select("th")
    texts = given.groupBy("th").agg(F.first("text").alias("text")).join(asked, "th", "left_semi")
    sets = written(sets_of(texts, words))
    links = written(verified(tried, sets, least))
    grouped = bands.join(components(links).withColumnRenamed("component", "group"), "node", "left").select("key", "node", F.coalesce("group", "node").alias("group"))
    mixed_keys = grouped.select("key", "group").distinct().groupBy("key").count().filter("count > 1").select("key")
    left = written(grouped.join(mixed_keys, "key"))
    links = links.union(links_under_keys(left, sets.join(nodes.select("node", "keys"), "node"), least))
    roots = nodes.select("node", "low").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = roots.groupBy("component").agg(F.min("low").alias("least"))
    by_node = roots.join(lows, "component").select("node", "least")
    return all_rows.select("id", "node").join(by_node, "node", "left").select("id", F.when(F.col("id").isNotNull(), F.col("least")).alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the smallest id of each component only; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **options).filter("id IS NOT NULL AND id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(found, docs[id_col] == found["_gone"], "left_anti")
