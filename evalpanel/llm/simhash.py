"""SimHash near-duplicates: fingerprints of word shingles, linked by multi-index hashing.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows and copies share a
fingerprint; rows with a null id are fingerprinted but link nothing and belong to no component (null); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalpanel.llm.common import components, forest, sliced, spanning, table, worker_of, written
from evalpanel.llm.registry import query

BITS = 64
#: Fingerprints of one bucket that meet in one task; larger buckets are dealt out in blocks of this many.
BLOCK = 2048


def fingerprint(text: str | None, words: int) -> int:
    """Majority bits of the XXH64 (seed 42) of every shingle, as a signed 64-bit integer."""
    from xxhash import xxh64_digest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return 0
    if n <= words:
        found = xxh64_digest(b" ".join(parts), 42)
        return int.from_bytes(found, "big", signed=True)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - words]]).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), 65536):
        raw = b"".join([xxh64_digest(joined[i:j], 42) for i, j in zip(starts[at : at + 65536], stops[at : at + 65536])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        for part in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(stops)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("simhash")
        for batch in sliced(batches):
            fps = pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def segment_plan(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, ball radius) of each segment, so that any two fingerprints within ``radius`` meet.

    With radius = q * segments + r, the first r + 1 segments get balls of radius q and the others of q - 1: were all of
    them missed, the distance would be at least (r + 1)(q + 1) + (segments - r - 1) q = radius + 1.
    """
    q, r = divmod(radius, segments)
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(edges[i], edges[i + 1] - edges[i], q - (i > r)) for i in range(segments)]


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` bits set, zero first."""
    masks = [0]
    for _ in range(max(radius, 0)):
        masks = sorted({m | 1 << b for m in masks for b in range(width)} | set(masks))
    return masks


def close_links(prints: DataFrame, radius: int = 4, segments: int = 3, block: int = BLOCK, real: bool = False) -> DataFrame:
    """(a, b): links that join exactly what pairs of distinct ``fp`` within ``radius`` bits join; with ``real`` all are such pairs.

    Each fingerprint is stored once per segment under the segment's bits and asked for under every key of its ball; keys
    meet by a shuffle, and complete distances are verified. A bucket of more than ``block`` stored fingerprints is dealt
    out in blocks to which its questions are repeated, and each task returns a forest of its links, not its pairs.
    """
    plan = [p for p in segment_plan(segments, radius) if p[2] >= 0]
    reduced = spanning if real else forest
    key = lambda fp, low, width: F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
    seg = lambda i, k: k.bitwiseOR(F.lit(i << 58))  # noqa: E731  segments are far narrower than 58 bits
    fp = F.col("fp")
    kept = prints.select("fp").distinct()
    stored = kept.select("fp", F.explode(F.array(*[seg(i, key(fp, low, width)) for i, (low, width, _) in enumerate(plan)])).alias("key"))
    questions = [seg(i, key(fp, low, width).bitwiseXOR(F.lit(m))) for i, (low, width, r) in enumerate(plan) for m in ball(width, r)]
    asked = kept.select("fp", F.explode(F.array(*questions)).alias("key"))
    full = stored.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    of = lambda side: side.join(full, "key", "left").fillna(1, ["blocks"])
    rows = (
        of(stored).select("fp", "key", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("part"), F.lit(False).alias("ask"))
    ).union(of(asked).select("fp", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(True).alias("ask")))
    met = rows.repartition("key", "part").sortWithinPartitions("key", "part", "ask")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run of equal (key, part) has its stored fingerprints first; questions stream past them."""
        worker_of("simhash")
        last, held = None, np.empty(0, np.uint64)
        gathered: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, parts = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            ask = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1
            starts, stops = np.r_[0, cuts], np.r_[cuts, len(keys)]
            asks = np.add.reduceat(ask.astype(np.int64), starts) if len(keys) else []
            for i, j, q in zip(starts.tolist(), stops.tolist(), list(asks)):
                mine = (keys[i], parts[i])
                if mine != last:
                    last, held = mine, np.empty(0, np.uint64)
                if q < j - i:
                    held = np.concatenate([held, fps[i : j - q]])
                if not len(held):
                    continue
                for at in range(j - q, j, 512):
                    some = fps[at : min(at + 512, j)]
                    x, y = np.nonzero(np.bitwise_count(some[:, None] ^ held[None, :]) <= radius)
                    differ = some[x] != held[y]
                    if differ.any():
                        gathered.append(np.stack([some[x[differ]], held[y[differ]]]).view(np.int64))
                        waiting += gathered[-1].shape[1]
                    if waiting > 500_000:
                        gathered, waiting = [np.stack(reduced(*np.concatenate(gathered, axis=1)))], 0
        if gathered:
            a, b = reduced(*np.concatenate(gathered, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, segments: int = 3) -> DataFrame:
    """(id, fp, component): every row with the smallest id reachable through fingerprints within ``radius`` bits."""
    prints = written(fingerprints(docs, id_col, text_col, words))
    least = prints.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least"))
    joined = components(close_links(prints.filter("id IS NOT NULL"), radius, segments)).withColumnRenamed("node", "fp")
    roots = least.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = roots.groupBy("component").agg(F.min("least").alias("low"))
    by_print = roots.join(low, "component").select("fp", "low")
    return prints.join(by_print, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("low")).alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the smallest id of each component only; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **options).filter("id IS NOT NULL AND id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(found, docs[id_col] == found["_gone"], "left_anti")


@query("op3_simhash")
def op3(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
