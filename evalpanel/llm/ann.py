"""Approximate nearest neighbours by inner product with collision-counting hashing.

Vectors are lifted to equal norms (one more component, sqrt(M^2 - |x|^2)), so that a larger inner product is a smaller
distance. Each of ``m`` random directions gives one sorted array of projections. Around the projections of a query, windows
grow in all arrays together (virtual rehashing); a vector found in at least ``needed`` windows is verified by its exact inner
product. Growth ends when the windows are so wide that a vector at the distance of the k-th best verified one would have been
found in enough of them with probability 1 - ``miss``, or when they hold everything; no number of candidates is fixed.

Every row is indexed. The index is dealt out in shards of bounded size; each query visits every shard, in batches that stream
past the shard's arrays, and the shards' best are merged.

Defined results: vectors that are null, zero, or hold null or non-finite components, and null ids, take no part; a query never finds
rows with its own id; of several rows with one id the best counts; ties go to the smaller id; fewer candidates than ``k`` are all
returned; vectors of another length than the query's are passed over; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.llm.common import table, written
from evalpanel.llm.registry import query
from evalpanel.llm.vectors import is_usable, matrix

#: Vectors in a shard, about.
SHARD = 16_384


def collision_plan(m: int, half_width: float, miss: float) -> int:
    """Collisions to ask for: the most that a vector whose distance is the unit reaches, but for a share ``miss``.

    Its projections differ from the query's by a standard normal amount, so it lies in a window of ``half_width`` with
    probability p, and in a binomial number of the ``m`` windows.
    """
    p = math.erf(half_width / math.sqrt(2))
    below, needed = 0.0, 0
    while below + (term := math.comb(m, needed) * p**needed * (1 - p) ** (m - needed)) <= miss:
        below += term
        needed += 1
    return needed


class Shard:
    """The sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, m: int, half_width: float, miss: float, seed: int):
        self.ids, self.vectors, self.largest, self.half_width = ids, vectors, largest, half_width
        self.needed = collision_plan(m, half_width, miss)
        self.directions = np.random.default_rng(seed).standard_normal((m, vectors.shape[1] + 1)).astype(np.float32)
        lift = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(1), 0))
        projected = self.directions[:, :-1] @ vectors.T.astype(np.float32) + self.directions[:, -1:] * lift[None, :].astype(np.float32)
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        # The place of each vector in each array: it lies in a window if its place lies between the window's ends.
        self.places = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=self.places.dtype)[None, :], axis=1)
        self.start = 0.0

    def nearest(self, own: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, inner products) of the best found, nearest first."""
        n, m = len(self.ids), len(self.directions)
        if vector.shape[0] != self.vectors.shape[1]:
            return np.zeros(0, np.int64), np.zeros(0)
        centre = self.directions[:, :-1] @ vector.astype(np.float32)
        hits = np.zeros(n, np.uint8 if m < 256 else np.uint16)
        shifted, inside = np.empty(n, self.places.dtype), np.empty(n, bool)
        waiting = np.ones(n, bool)  # neither verified nor the query itself
        waiting[self.ids == own] = False
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        square = self.largest**2 + float(vector @ vector)
        width = self.start or math.sqrt(square) / 8
        while True:
            hits[:] = 0
            whole = True
            for line, place, low, high in zip(self.sorted, self.places, (centre - width).tolist(), (centre + width).tolist()):
                lo, hi = line.searchsorted(low), line.searchsorted(high, side="right")
                np.subtract(place, shifted.dtype.type(lo), out=shifted)  # wraps around below the window
                np.less(shifted, shifted.dtype.type(hi - lo), out=inside) if hi - lo < n else inside.fill(True)
                np.add(hits, inside, out=hits, casting="unsafe")
                whole = whole and hi - lo == n
            new = np.flatnonzero((hits >= self.needed) & waiting)
            waiting[new] = False
            places, scores = np.concatenate([places, new]), np.concatenate([scores, self.vectors[new] @ vector])
            if len(places) > k:
                near = scores >= np.partition(scores, -k)[-k] - 1e-9 * square
                places = places[near]
                scores = (self.vectors[places] * vector).sum(1)  # copies get one score, whatever the order of a matrix product
                best = np.lexsort((self.ids[places], -scores))[:k]
                places, scores = places[best], scores[best]
            wanted = math.inf
            if len(scores) >= k:
                wanted = self.half_width * math.sqrt(max(square - 2 * float(scores.min()), 0))
            if whole or width >= wanted:
                break
            width = min(max(wanted, width), width * 1.5) if wanted < math.inf else width * 1.5
        if wanted < math.inf:  # where the next query begins: windows that would have done for this one
            self.start = 1.05 * wanted
        scores = (self.vectors[places] * vector).sum(1)
        best = np.lexsort((self.ids[places], -scores))
        return places[best], scores[best]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", m: int = 112, half_width: float = 1.0, miss: float = 0.03, seed: int = 7, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, id, score): for each row that satisfies ``queries``, its ``k`` nearest other rows found.

    ``queries`` is a condition on the column ``id``.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id IS NOT NULL").filter(is_usable("vector"))
    usable = written(usable.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))))
    total, largest = usable.agg(F.count("*"), F.max("norm")).first()
    shards = max(1, -(-total // shard))
    of = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    index = usable.select(of, F.lit(False).alias("asks"), "id", "vector")
    asked = usable.filter(queries).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "vector")
    met = index.union(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "asks", "id")
    top = float(largest or 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of a shard come before its queries, which stream past the arrays made of them."""
        last, ids, held, made = None, [], [], {}
        for batch in batches:
            of_shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(of_shard) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of_shard)]):
                if i == j:
                    continue
                if of_shard[i] != last:
                    last, ids, held, made = of_shard[i], [], [], {}
                part = batch.slice(i, j - i)
                keys, sizes = part.column(2).to_numpy(), part.column(3).value_lengths().to_numpy()
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    found, block = keys[rows], matrix(part.column(3).take(pa.array(rows)))
                    if not asks[i]:
                        ids.append(found)
                        held.append(block)
                        continue
                    if size not in made:
                        mine = [p for p, b in enumerate(held) if b.shape[1] == size]
                        made[size] = mine and Shard(np.concatenate([ids[p] for p in mine]), np.concatenate([held[p] for p in mine]), top, m, half_width, miss, seed)
                    if not made[size]:
                        continue
                    out: tuple[list, list, list] = ([], [], [])
                    for key, vector in zip(found, block):
                        places, scores = made[size].nearest(key, vector, k)
                        for column, value in zip(out, (np.full(len(places), key), made[size].ids[places], scores)):
                            column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", rank.alias("rank"), "id", "score").filter(F.col("rank") <= k)


@query("op1_ann")
def op1(spark, sf_dir):
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
