"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Only vectors with equal labels meet. Identical vectors form a class with a multiplicity, and the classes of a label are dealt out
into tiles; each pair of tiles is one bounded task. A unit vector x is s q + e with integers q of eight bits and a known
error norm |e|, so x.y differs from s t (q.p) by at most |s q| |e'| + |e| |y|; pairs whose upper bound reaches the threshold are
recomputed in double precision from the original components. A task returns link counts and a forest of its links.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors without label, link with nothing: they
have no links and are their own component; vectors of different lengths never link; a null id has a null component;
rows with equal ids count as vectors of their own; repeated rows are linked copies; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalpanel.llm.common import components, forest, table, written
from evalpanel.llm.registry import query
from evalpanel.llm.vectors import is_usable, matrix

#: Classes in a tile, at most on average.
TILE = 4096
#: Products of 8-bit integers that a float32 sums exactly: 1024 * 127 * 127 < 2**24.
EXACT = 1024
ROWS = 256


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, norm of scale * codes, norm of the error) of each unit vector."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    back = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1) * (1 + 1e-9) + 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two int8 matrices."""
    total = 0.0
    for at in range(0, a.shape[1], EXACT):
        total = total + (a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T).astype(np.float64)
    return total


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine(left[i], right[j]) at least ``threshold``, a strip of rows at a time."""
    left_norm, right_norm = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    qa, sa, na, ea = quantised(left / left_norm[:, None])
    qb, sb, _, eb = quantised(right / right_norm[:, None])
    for at in range(0, len(left), ROWS):
        to = min(at + ROWS, len(left))
        upper = products(qa[at:to], qb) * sa[at:to, None] * sb[None, :] + na[at:to, None] * eb[None, :] + ea[at:to, None] * (1 + 1e-9)
        i, j = np.nonzero(upper >= threshold - 1e-9)
        for some in range(0, len(i), 65536):
            x, y = at + i[some : some + 65536], j[some : some + 65536]
            sure = np.einsum("ij,ij->i", left[x], right[y]) / (left_norm[x] * right_norm[y]) >= threshold
            yield x[sure], y[sure]


def class_links(classes: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """From (key, label, vector, copies): rows (a, b, null) of forests of links, and rows (a, null, n) of link counts."""
    sizes = classes.groupBy("label", F.size("vector").alias("width")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = classes.withColumn("width", F.size("vector")).join(sizes, ["label", "width"]).withColumn("at", F.pmod("key", F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    spread = placed.select("key", "label", "width", "vector", "copies", "at", other)
    low, high = F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high")
    spread = spread.select("key", "vector", "copies", "label", "width", low, high, (F.col("at") == F.least("at", "other")).alias("first"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")  # equal results whatever order the shuffle gave
        first = rows.column("first").to_numpy()
        keys, copies, all_vectors = rows.column("key").to_numpy(), rows.column("copies").to_numpy(), matrix(rows.column("vector"))
        same = rows.column("low")[0] == rows.column("high")[0]
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        counts = np.zeros(len(keys), np.int64)
        kept: list[np.ndarray] = []
        for x, y in tile_links(all_vectors[left], all_vectors[right], threshold):
            x, y = left[x], right[y]
            if same:
                x, y = x[x < y], y[x < y]
            np.add.at(counts, x, copies[y])
            np.add.at(counts, y, copies[x])
            kept.append(np.stack([keys[x], keys[y]]))
            if sum(k.shape[1] for k in kept) > 500_000:
                kept = [np.stack(forest(*np.concatenate(kept, axis=1)))]
        a, b = forest(*np.concatenate(kept, axis=1)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        has = np.flatnonzero(counts)
        null = lambda n: pa.nulls(n, pa.int64())
        columns = ((pa.array(a), pa.array(keys[has])), (pa.array(b), null(len(has))), (null(len(a)), pa.array(counts[has])))
        return pa.table([pa.chunked_array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    return spread.groupBy("label", "width", "low", "high").applyInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """(id, n_links, component): links to other vectors, and the smallest id reachable by links, for every row."""
    usable = is_usable("vector") & F.col("label").isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.select("id", "vector", "label", F.when(usable, F.xxhash64("label", "vector")).alias("key"))
    classes = written(rows.filter("key IS NOT NULL").groupBy("key", "label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("least")))
    links = written(class_links(classes, threshold, tile))
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    joined = components(links.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "key")
    each = classes.select("key", "copies", "least").join(counts, "key", "left").join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    low = each.groupBy("component").agg(F.min("least").alias("low"))
    each = each.join(low, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "low")
    out = rows.select("id", "key").join(each, "key", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component"))


@query("op7_embedding_dedup")
def op7(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
