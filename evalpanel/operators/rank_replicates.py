"""Rank statistics of all bootstrap replicates from level x replicate count matrices.

A replicate changes how often each unit counts, not which values there are. So the rows are turned into cells (combinations of the two
values a statistic needs), and a cell's count is a vector with an entry per replicate, filled in the task that reads the rows: no table of
(row, replicate) exists. Cells travel as (key, block of replicates, cell, packed counts); a task takes all cells of one key for one
block, and the ranks of the whole block are one cumulative sum down that matrix. Blocks are narrow where a key has many cells, so a
task holds about ``HELD`` counts. Keys with more cells than ``MOST_CELLS`` take the level tables of ``ranks`` with the replicate as a key.

Weights are those of ``resample.poisson_draws``: pure functions of (seed, unit, replicate), the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.hashing import continue_hash, md5_uniform, poisson_steps
from evalpanel.functions.levels import spread
from evalpanel.operators import ranks as R
from evalpanel.operators import resample as B
from evalpanel.session import cut_lineage

#: Counts in the matrix of one task, cells of a key up to which it is used, and the bounds of a block's width.
HELD, MOST_CELLS = 1 << 22, 1 << 18
NARROWEST, WIDEST = 16, 512


def unit_weights(units: pd.Series, hashes: np.ndarray, seed: int, first: int, width: int, hasher: str) -> np.ndarray:
    """Poisson(1) weights, units x replicates ``first`` to ``first + width - 1``."""
    turns = np.arange(first, first + width, dtype=np.int32)
    if hasher == "md5":
        u = md5_uniform([f"{seed}:{x}:" for x in units], turns)
    else:
        u = continue_hash(hashes[:, None], turns[None, :])
    return np.searchsorted(np.array(poisson_steps()), u.ravel(), side="right").reshape(u.shape).astype(np.int32)


def replicate_counts(rows: DataFrame, keys: Sequence[str], values: Sequence[str], reps: int, width: int, seed: int, unit: str = "unit", hasher: str = "xx", measure: str | None = None) -> DataFrame:
    """(keys, values, block, counts[, sums]): the counts of every cell in each block of ``width`` replicates, as packed int64.

    With ``measure`` also its weighted sums, as packed doubles. Rows are sorted by cell inside a task, so that a task gives a cell
    about once, whatever the number of its rows. The parts of a cell, one or two a task, are added up before a block comes together, so the
    task of a block holds a row per cell and not one per cell and task.
    """
    by, carried = [*keys, *values], [measure] if measure else []
    packed = [T.StructField(c, T.BinaryType()) for c in ["counts", *(["sums"] if measure else [])]]
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("block", T.IntegerType()), *packed])

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell = frame.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            heads = frame.iloc[order[starts]][by]
            known, at = np.unique(frame["_u"].to_numpy(object), return_inverse=True)
            hashes = np.zeros(len(known), np.int64)
            hashes[at] = frame["_h"].to_numpy(np.int64)
            for block in range(-(-reps // width)):
                first = block * width + 1
                weights = unit_weights(known, hashes, seed, first, min(width, reps - first + 1), hasher)
                weights = weights[at[order]]
                out = heads.assign(block=np.int32(block), counts=[x.tobytes() for x in np.add.reduceat(weights, starts, axis=0).astype("<i4")])
                if measure:
                    out["sums"] = [x.tobytes() for x in np.add.reduceat(weights * frame[measure].to_numpy(float)[order, None], starts, axis=0)]
                yield out

    source = spread(rows.select(*by, *carried, F.col(unit).cast("string").alias("_u"), F.xxhash64(F.lit(seed), F.col(unit)).alias("_h")), "_u").sortWithinPartitions(*by)
    names = [f.name for f in packed]
    parts = source.mapInPandas(fill, schema).groupBy(*by, "block").agg(*[F.collect_list(c).alias(c) for c in names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = batch.columns[: -len(names)]
            for kind, column in zip(("<i4", "<f8"), batch.columns[-len(names) :]):
                sums = [np.frombuffer(b"".join(x), kind).reshape(len(x), -1).sum(0, dtype="<i8" if kind == "<i4" else kind) for x in column.to_pylist()]
                out.append(pa.array([x.tobytes() for x in sums], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [*by, "block", *names])

    return parts.mapInArrow(add, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def block_width(cells: int, reps: int) -> int:
    """Replicates in a block, such that a matrix of ``cells`` rows holds about ``HELD`` counts."""
    return min(reps, WIDEST, max(NARROWEST, HELD // max(cells, 1)))


def _statistic_by_block(counts: DataFrame, keys: Sequence[str], values: Sequence[str], width: int, solve: Callable) -> DataFrame:
    """(keys, rep, theta, n): ``solve(first values, second values, matrix cells x replicates)`` for every key and block."""
    schema = T.StructType([*[counts.schema[k] for k in keys], T.StructField("rep", T.IntegerType()), T.StructField("theta", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(held: pa.Table) -> pa.Table:
        a, b = (held.column(v).to_numpy(zero_copy_only=False) for v in values)
        matrix = np.stack([np.frombuffer(x, "<i8") for x in held.column("counts").to_pylist()])
        theta, n = solve(a, b, matrix)
        first = held.column("block")[0].as_py() * width + 1
        size = matrix.shape[1]
        heads = {k: pa.array([held.column(k)[0].as_py()] * size, held.schema.field(k).type) for k in keys}
        return pa.table({**heads, "rep": pa.array(np.arange(first, first + size), pa.int32()), "theta": pa.array(theta, pa.float64(), from_pandas=True), "n": pa.array(n, pa.int64())})

    return counts.groupBy(*keys, "block").applyInArrow(run, schema)


def level_sums(values: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level of each cell, levels x replicates): the cells' counts summed by value, levels ascending."""
    _, level = np.unique(values, return_inverse=True)
    order = np.argsort(level, kind="stable")
    return level, np.add.reduceat(matrix[order], np.flatnonzero(np.diff(level[order], prepend=-1)), axis=0)


def spearman_block(x: np.ndarray, y: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of mid-ranks in every replicate. Ranks are taken about their mean, which the cumulative counts give at once."""
    total = matrix.sum(0)

    def centred(values: np.ndarray) -> np.ndarray:
        level, counts = level_sums(values, matrix)
        return (np.cumsum(counts, 0) - counts + (counts - total) / 2.0)[level]

    a, b = centred(x), centred(y)
    den = np.sqrt((matrix * a * a).sum(0) * (matrix * b * b).sum(0))
    return np.where(den > 0, (matrix * a * b).sum(0) / np.where(den > 0, den, 1), np.nan), total


def auc_block(score: np.ndarray, positive: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(score of a negative > score of a positive) + half the ties in every replicate."""
    yes = positive.astype(bool)[:, None]
    _, both = level_sums(score, np.concatenate([matrix * yes, matrix * ~yes], axis=1))
    pos, neg = both[:, : matrix.shape[1]], both[:, matrix.shape[1] :]
    pairs = pos.sum(0) * neg.sum(0)
    hits = (neg * (np.cumsum(pos, 0) - pos / 2.0)).sum(0)
    return np.where(pairs > 0, hits / np.where(pairs > 0, pairs, 1), np.nan), matrix.sum(0)


def _replicates(rows: DataFrame, keys: Sequence[str], values: Sequence[str], reps: int, seed: int, unit: str, hasher: str, solve: Callable, beyond: Callable, most_cells: int) -> DataFrame:
    given = rows.filter(" AND ".join(f"`{v}` IS NOT NULL" for v in values)).select(*keys, *values, unit)
    stored = cut_lineage(given)
    sizes = stored.select(*keys, *values).distinct().groupBy(*keys).agg(F.count("*").alias("n")) if keys else stored.select(*values).distinct().agg(F.count("*").alias("n"))
    cells = sizes.agg(F.max("n")).first()[0] or 1
    if cells > most_cells:
        weights = B.poisson_draws(stored.select(unit).distinct(), seed, reps, unit, hasher)
        return beyond(B.weighted_rows(stored, weights, unit), [*keys, "rep"])
    width = block_width(cells, reps)
    counts = replicate_counts(stored, keys, values, reps, width, seed, unit, hasher)
    return _statistic_by_block(counts, keys, values, width, solve)


def spearman_replicates(rows: DataFrame, keys: Sequence[str], x: str, y: str, reps: int, seed: int, unit: str = "unit", hasher: str = "xx", most_cells: int = MOST_CELLS) -> DataFrame:
    """(keys, rep, theta, n): the rank correlation of ``x`` and ``y`` in every replicate; NULL where a replicate has one level only."""
    beyond = lambda weighted, by: R.spearman(weighted, by, x, y, "w").select(*by, F.col("rho").alias("theta"), F.col("n").cast("long").alias("n"))
    return _replicates(rows, keys, [x, y], reps, seed, unit, hasher, spearman_block, beyond, most_cells)


def auc_replicates(rows: DataFrame, keys: Sequence[str], score: str, positive: str, reps: int, seed: int, unit: str = "unit", hasher: str = "xx", most_cells: int = MOST_CELLS) -> DataFrame:
    """(keys, rep, theta, n): the discrimination of ``score`` in every replicate; NULL without both classes."""
    beyond = lambda weighted, by: R.auc(weighted, by, score, positive, "w").select(*by, F.col("auc").alias("theta"), (F.col("n_pos") + F.col("n_neg")).alias("n"))
    return _replicates(rows, keys, [score, positive], reps, seed, unit, hasher, auc_block, beyond, most_cells)


def pair_percentage_replicates(rows: DataFrame, keys: Sequence[str], score: str, feature: str, reps: int, seed: int, unit: str = "unit", hasher: str = "xx") -> DataFrame:
    """(keys, rep, theta): the percentage of (feature, other) pairs in which the feature row scores lower, in every replicate."""
    return auc_replicates(rows, keys, score, feature, reps, seed, unit, hasher).withColumn("theta", 100 * F.col("theta"))


def spearman_difference_replicates(rows: DataFrame, keys: Sequence[str], x: str, other: str, y: str, reps: int, seed: int, unit: str = "unit", hasher: str = "xx") -> DataFrame:
    """(keys, rep, theta): correlation of ``x`` with ``y`` less that of ``other`` with ``y``, both from the same draws and rows."""
    whole = rows.filter(F.col(x).isNotNull() & F.col(other).isNotNull())
    long = whole.select(*keys, unit, y, F.explode(F.array(F.struct(F.lit(True).alias("_first"), F.col(x).alias("_x")), F.struct(F.lit(False).alias("_first"), F.col(other).alias("_x")))).alias("_s"))
    found = spearman_replicates(long.select(*keys, unit, y, "_s.*"), [*keys, "_first"], "_x", y, reps, seed, unit, hasher)
    gap = F.max(F.when(F.col("_first"), F.col("theta"))) - F.max(F.when(~F.col("_first"), F.col("theta")))
    return found.groupBy(*keys, "rep").agg(gap.alias("theta"))
