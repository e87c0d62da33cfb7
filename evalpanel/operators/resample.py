"""Unit resampling as weight tables.

A resample is a weight per (replicate, unit); a statistic is weighted sums of per-unit sufficient
statistics followed by a formula. All replicates and all configurations are one aggregation:

* ``multinomial``: n draws with replacement out of n units. The n draws of a replicate are split over the
  halves of the units' dense places, again and again, by binomial numbers seeded with the part; any task
  finds the counts of its units by going down to them, so no draw is a row. The ``md5`` hasher draws
  positions one by one instead, which SQL can repeat; they travel packed, by block of places drawn.
* ``poisson``: independent Poisson(1) weights, a hash of (seed, unit, replicate), computed on the unit's
  own row, with either hasher. Nothing but the (replicate, key, bin) sums is shuffled; use this one for very many units.
  The sums of a task are a matrix product of weights and statistics over Arrow batches.

Both repeat small rows many times, so the unit statistics are spread over all shuffle partitions first:
adaptive execution would otherwise pack them into a few tasks by their size on disk.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.hashing import continue_hash, md5_uniform, poisson_steps, poisson_weight, uniform
from evalpanel.functions.levels import join_bounded, join_null_safe, spread


@dataclass(frozen=True)
class Statistic:
    """A user-definable statistic in SQL text: named row expressions that are summed, and a formula
    over the (weighted) sums.

    With ``balanced`` the formula is applied per bin and averaged over the non-empty bins.
    """

    sums: Mapping[str, str]
    value: str
    balanced: bool = False


def mean_of(column: str, balanced: bool = False) -> Statistic:
    return Statistic({"s_n": "1.0D", "s_x": column}, "s_x / s_n", balanced)


def rms_of(column: str) -> Statistic:
    return Statistic({"s_n": "1.0D", "s_q": f"{column} * {column}"}, "sqrt(s_q / s_n)")


def skill_of(model: str, base: str) -> Statistic:
    return Statistic({"s_m": model, "s_b": base}, "CASE WHEN s_b > 0 THEN 1 - s_m / s_b END")


def _group(stat: Statistic, keys: Sequence[str]) -> list[str]:
    return [*keys, "bin"] if stat.balanced and "bin" not in keys else list(keys)


def is_stats(df: DataFrame, stat: Statistic) -> bool:
    return set(stat.sums) <= set(df.columns)


def unit_stats(rows: DataFrame, keys: Sequence[str], stat: Statistic, unit: str = "unit", carry: Sequence[str] = ()) -> DataFrame:
    """Sufficient statistics per (key, unit); every later step is independent of the rows per unit."""
    by = [*_group(stat, keys), *[c for c in carry if c not in _group(stat, keys)], unit]
    return rows.groupBy(*by).agg(*[F.sum(F.expr(c)).alias(n) for n, c in stat.sums.items()])


def finish(sums: DataFrame, keys: Sequence[str], stat: Statistic, name: str = "theta") -> DataFrame:
    """From sums per (key[, bin]) to one value per key, with the number of bins present."""
    valued = sums.withColumn("_v", F.expr(stat.value))
    if not stat.balanced:
        return valued.select(*keys, F.col("_v").alias(name))
    grouped = valued.groupBy(*keys) if keys else valued.groupBy()
    return grouped.agg(F.avg("_v").alias(name), F.count("*").alias("bins_present"))


def point(stats: DataFrame, keys: Sequence[str], stat: Statistic) -> DataFrame:
    by = _group(stat, keys)
    grouped = stats.groupBy(*by) if by else stats.groupBy()
    sums = grouped.agg(*[F.sum(n).alias(n) for n in stat.sums])
    return finish(sums, keys, stat, "theta_hat").drop("bins_present")


# ---- draws ----

def unit_index(
    units: DataFrame, unit: str = "unit", strata: Sequence[str] = (), hasher: str = "xx", slots: int = 1024, carry: Sequence[str] = ()
) -> DataFrame:
    """Dense position 0..n-1 per stratum in the order (hash slot, unit), without a global sort; other columns can be carried along."""
    strata, carry = list(strata), list(carry)
    slot = F.floor(uniform(0, [unit], hasher) * F.lit(slots)).alias("_slot")
    group = (F.struct(*[F.col(c) for c in strata]) if strata else F.lit(0)).alias("_key")
    placed = units.select(*strata, unit, *carry, group, slot)
    sizes = placed.groupBy("_key", "_slot").agg(F.count("*").alias("_k"))
    before = W.partitionBy("_key").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_key",
        "_slot",
        F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"),
        F.sum("_k").over(W.partitionBy("_key")).alias("n"),
    )
    inside = F.row_number().over(W.partitionBy("_key", "_slot").orderBy(unit))
    ranked = placed.withColumn("_i", inside)
    return ranked.join(offsets, ["_key", "_slot"]).select(
        *strata, unit, *carry, (F.col("_o") + F.col("_i") - 1).alias("idx"), "n"
    )


def drawn_positions(index: DataFrame, seed: int, reps: int, strata: Sequence[str] = (), hasher: str = "xx") -> DataFrame:
    """One row per draw: position ``idx`` of the unit drawn, for every (replicate, position)."""
    strata = list(strata)
    rep = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    turns = spread(index.select(*strata, "idx", "n"), "idx").select("*", rep)
    u = uniform(seed, [*strata, "rep", "idx"], hasher)
    return turns.select(*strata, "rep", F.floor(u * F.col("n")).alias("idx"))


#: Units of a part that is not split further.
LEAF = 256


def _with_leaf(index: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Add the depth of the stratum's tree, the leaf of the unit's place, and a name of the stratum."""
    name = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(strata)]), {"ignoreNullFields": "false"}) if strata else F.lit("")
    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(LEAF)))).cast("int")
    return index.withColumns({"_depth": deep, "_name": name}).withColumn("_leaf", F.expr("((idx + 1) * shiftleft(1L, _depth) - 1) div n"))


def leaf_weights(seed: int, reps: int):
    """A function (name, n, depth, leaf) -> (first place, replicates x places): how often each place of a leaf is drawn.

    Part j of level l holds the places from j * n / 2^l on. The draws in its first half are binomial given those in the part, from a
    generator seeded with (seed, name, level, part), so all tasks find the same numbers. Replicates do not depend on how many there are.
    """
    halves: dict[int, tuple[tuple, np.ndarray]] = {}

    def generator(*key) -> np.random.Generator:
        text = ":".join(map(str, (seed, *key)))
        return np.random.Generator(np.random.Philox(key=int(hashlib.md5(text.encode()).hexdigest(), 16)))

    def find(name: str, n: int, depth: int, leaf: int) -> tuple[int, np.ndarray]:
        drawn = np.full(reps, n, dtype=np.int64)
        for level in range(depth):
            part = leaf >> (depth - level)
            low, middle, high = (part * n) >> level, ((2 * part + 1) * n) >> (level + 1), ((part + 1) * n) >> level
            key = (name, n, part)
            if level not in halves or halves[level][0] != key:
                halves[level] = (key, generator(name, level, part).binomial(drawn, (middle - low) / (high - low)))
            first = halves[level][1]
            drawn = drawn - first if (leaf >> (depth - level - 1)) & 1 else first
        low, high = (leaf * n) >> depth, ((leaf + 1) * n) >> depth
        cell = generator(name, "leaf", leaf).integers(0, high - low, int(drawn.sum())) + np.repeat(np.arange(reps) * (high - low), drawn)
        return low, np.bincount(cell, minlength=reps * (high - low)).reshape(reps, -1)

    return find


def _by_leaf(seed: int, reps: int):
    """A function from a batch in order of leaves to the weights, replicates x units, of its rows ``first``."""
    find, held = leaf_weights(seed, reps), [None, None]

    def weights_of(batch: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        units = batch.iloc[first].reset_index(drop=True)
        out = np.empty((reps, len(units)))
        for key, where in units.groupby(["_name", "n", "_depth", "_leaf"], sort=False).indices.items():
            if held[0] != key:
                held[:] = key, find(key[0], *map(int, key[1:]))
            low, table = held[1]
            out[:, where] = table[:, units["idx"].to_numpy(np.int64)[where] - low]
        return out

    return weights_of


def _split_draws(index: DataFrame, seed: int, reps: int, strata: Sequence[str], unit: str) -> DataFrame:
    placed = _with_leaf(index.select(*strata, unit, "idx", "n"), strata)
    fields = [*[placed.schema[c] for c in strata], T.StructField("rep", T.IntegerType()), placed.schema[unit], T.StructField("w", T.LongType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights_of = _by_leaf(seed, reps)
        for batch in batches:
            weights = weights_of(batch, np.arange(len(batch))).astype(np.int64)
            rep, at = np.nonzero(weights)
            yield batch[[*strata, unit]].iloc[at].assign(rep=(rep + 1).astype(np.int32), w=weights[rep, at])[[f.name for f in fields]]

    return spread(placed, "_name", "_leaf").sortWithinPartitions("_name", "_leaf").mapInPandas(run, T.StructType(fields))


def draws(index: DataFrame, seed: int, reps: int, strata: Sequence[str] = (), unit: str = "unit", hasher: str = "xx") -> DataFrame:
    """Multinomial weights (rep, unit, w); units with weight 0 have no row."""
    if hasher == "xx":
        return _split_draws(index, seed, reps, list(strata), unit)
    hits = drawn_positions(index, seed, reps, strata, hasher).groupBy(*strata, "rep", "idx").agg(F.count("*").alias("w"))
    return join_null_safe(hits, index.select(*strata, "idx", unit), [*strata, "idx"]).select(*strata, "rep", unit, "w")


def poisson_draws(units: DataFrame, seed: int, reps: int, unit: str = "unit", hasher: str = "xx") -> DataFrame:
    """Poisson(1) weights (all columns of ``units``, rep, w), computed in place."""
    rows = spread(units, unit).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return rows.withColumn("w", poisson_weight(uniform(seed, [unit, "rep"], hasher))).filter(F.col("w") > 0)


def _summed(parts: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Partial sums added up, without the (by, rep) in which nothing has a weight."""
    return parts.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names], F.sum("_w").alias("_w")).filter("_w > 0").drop("_w")


def _weighted_sums(rows: DataFrame, by: Sequence[str], names: Sequence[str], reps: int, weights_of) -> DataFrame:
    """Weighted sums per (by, rep) from rows (by, _h, names, ...), where ``_h`` identifies a unit.

    The rows of a unit meet in one batch, so its weights are made once. A task keeps one (replicates x
    sums) matrix per ``by`` group, whose number is a vocabulary size, and gives its partial sums at its
    end. ``weights_of(batch, first)`` returns replicate weights, replicates x units, for the units whose
    first rows in the batch are ``first``.
    """
    by, names = list(by), list(names)
    summed = [*names, "_w"]
    turns = np.arange(1, reps + 1, dtype=np.int32)
    chunk = max(1, 2_000_000 // reps)

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = np.column_stack([batch[names].to_numpy(dtype=float), np.ones(len(batch))])
            _, first, row_unit = np.unique(batch["_h"].to_numpy(dtype=np.int64), return_index=True, return_inverse=True)
            order = np.argsort(first)  # units in the order of their rows
            first, row_unit = first[order], np.argsort(order)[row_unit]
            groups = batch.groupby(by, dropna=False, sort=False).indices if by else {(): np.arange(len(batch))}
            wide = np.zeros((len(first), len(groups), len(summed)))
            for g, where in enumerate(groups.values()):
                np.add.at(wide[:, g], row_unit[where], values[where])
            wide = wide.reshape(len(first), -1)
            total = np.zeros((reps, wide.shape[1]))
            for at in range(0, len(first), chunk):
                total += weights_of(batch, first[at : at + chunk]) @ wide[at : at + chunk]
            for key, part in zip(groups, np.split(total, len(groups), axis=1)):
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums[key] + part if key in sums else part
        for key, held in sums.items():
            out = pd.DataFrame(held, columns=summed)
            out["rep"] = turns
            for name, value in zip(by, key):
                out[name] = value
            yield out

    fields = [rows.schema[k] for k in by] + [T.StructField("rep", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in summed])
    return _summed(rows.mapInPandas(accumulate, schema), by, names)


def poisson_sums(stats: DataFrame, by: Sequence[str], names: Sequence[str], reps: int, seed: int, unit: str = "unit", hasher: str = "xx") -> DataFrame:
    """Sums under the weights of ``poisson_draws``, made inside the task from the unit's hash, once for all rows of a unit in a batch."""
    steps = np.array(poisson_steps())
    turns = np.arange(1, reps + 1, dtype=np.int32)

    def weights_of(batch: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        if hasher == "md5":
            u = md5_uniform(batch["_text"].to_numpy(object)[first], turns).T
        else:
            u = continue_hash(batch["_h"].to_numpy(dtype=np.int64)[first][None, :], turns[:, None])
        return np.searchsorted(steps, u.ravel(), side="right").reshape(u.shape).astype(float)

    base = F.xxhash64(F.lit(seed), F.col(unit)).alias("_h")
    text = [F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string"), F.lit("")).alias("_text")] if hasher == "md5" else []
    rows = spread(stats, unit).sortWithinPartitions(unit)
    rows = rows.select(*by, base, *text, *[F.col(n).cast("double").alias(n) for n in names])
    return _weighted_sums(rows, by, names, reps, weights_of)


#: Draws that a task holds when positions are drawn one by one.
DRAWS = 1 << 20


def _packed_draws(index: DataFrame, seed: int, reps: int, strata: Sequence[str], wide: int) -> DataFrame:
    """(_name, _block, draws): the positions of ``drawn_positions`` as numbers position * reps + replicate inside a block of ``wide`` positions."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in strata], F.lit(""))
    turns = spread(index, "idx").select("_name", text.alias("_text"), "idx", "n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (name, text, n), part in frame.groupby(["_name", "_text", "n"], sort=False):
                at = part["idx"].to_numpy(np.int64)
                for low in range(0, len(at), max(1, 2 * DRAWS // reps)):
                    u = md5_uniform([f"{text}{r}:" for r in range(1, reps + 1)], at[low : low + max(1, 2 * DRAWS // reps)])
                    place = np.floor(u * n).astype(np.int64)
                    block, cell = np.divmod(place, wide)
                    cell = (cell * reps + np.arange(reps)[:, None]).astype("<i4").ravel()
                    block = block.ravel()
                    order = np.argsort(block, kind="stable")
                    starts = np.flatnonzero(np.diff(block[order], prepend=-1))
                    yield pd.DataFrame({"_name": name, "_block": block[order[starts]], "draws": [x.tobytes() for x in np.split(cell[order], starts[1:])]})

    return turns.mapInPandas(run, "_name string, _block long, draws binary")


def _drawn_sums(stats: DataFrame, index: DataFrame, by: Sequence[str], names: Sequence[str], reps: int, seed: int, strata: Sequence[str], unit: str) -> DataFrame:
    """Weighted sums under positions drawn one by one. A block of positions meets the draws that hit it: about ``DRAWS`` of them."""
    wide = max(1, DRAWS // reps)
    name = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(strata)]), {"ignoreNullFields": "false"}) if strata else F.lit("")
    index = index.select(*strata, unit, "idx", "n").withColumn("_name", name)
    own = [*strata, unit]
    placed = join_null_safe(stats, index.select(*own, "idx", "_name"), own)
    rows = placed.select("_name", F.expr(f"idx div {wide}").alias("_block"), (F.col("idx") % wide).alias("_at"), *by, *[F.col(n).cast("double").alias(n) for n in names])
    fields = [rows.schema[k] for k in by] + [T.StructField("rep", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in [*names, "_w"]])

    def run(held: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(drawn):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        cells = np.frombuffer(b"".join(drawn["draws"]), "<i4")
        at = held["_at"].to_numpy(np.int64)
        weights = np.bincount(cells, minlength=(max(int(at.max()), int(cells.max()) // reps) + 1) * reps).reshape(-1, reps)
        values = np.column_stack([held[list(names)].to_numpy(dtype=float), np.ones(len(held))])
        groups = held.groupby(list(by), dropna=False, sort=False).indices if by else {(): np.arange(len(held))}
        out = []
        for key, where in groups.items():
            frame = pd.DataFrame(weights[at[where]].T.astype(float) @ values[where], columns=[*names, "_w"])
            frame["rep"] = np.arange(1, reps + 1, dtype=np.int32)
            for c, v in zip(by, key if isinstance(key, tuple) else (key,)):
                frame[c] = v
            out.append(frame)
        return pd.concat(out)[[f.name for f in schema.fields]]

    draws = _packed_draws(index, seed, reps, strata, wide)
    return _summed(rows.groupBy("_name", "_block").cogroup(draws.groupBy("_name", "_block")).applyInPandas(run, schema), by, names)


def multinomial_sums(
    stats: DataFrame, by: Sequence[str], names: Sequence[str], reps: int, seed: int, strata: Sequence[str] = (), unit: str = "unit", hasher: str = "xx"
) -> DataFrame:
    """Sums under the weights of ``draws``. Split draws are made where the statistics lie, dealt by leaf.

    Positions drawn one by one (``md5``) are packed by block and meet the statistics of the block's units.
    """
    strata = list(strata)
    index = unit_index(stats.select(*strata, unit).distinct(), unit, strata, hasher)
    if hasher == "xx":
        own = [*strata, unit]
        placed = _with_leaf(join_null_safe(stats, index.select(*own, "idx", "n"), own), strata)
        rows = spread(placed, "_name", "_leaf").sortWithinPartitions("_name", "_leaf", "idx")
        rows = rows.select(*by, F.xxhash64("_name", "idx").alias("_h"), "_name", "n", "_depth", "_leaf", "idx", *[F.col(n).cast("double").alias(n) for n in names])
        return _weighted_sums(rows, by, names, reps, _by_leaf(seed, reps))
    return _drawn_sums(stats, index, by, names, reps, seed, strata, unit)


# ---- replicates ----

def replicates(
    rows: DataFrame,
    keys: Sequence[str],
    stat: Statistic,
    reps: int,
    seed: int,
    method: str = "multinomial",
    strata: Sequence[str] = (),
    unit: str = "unit",
    hasher: str = "xx",
) -> DataFrame:
    """(keys, rep, theta): every replicate of every key in one aggregation.

    ``strata`` (such as the bin) resamples each stratum to its own size. The same draws serve all keys,
    so differences between keys of one replicate stay paired. ``rows`` may already be ``unit_stats``
    (with the strata carried), which a caller who needs them again should write out once.
    """
    by = _group(stat, keys)
    stats = rows if is_stats(rows, stat) else unit_stats(rows, keys, stat, unit, strata)
    if method == "poisson":
        if strata:
            raise ValueError("poisson weights already act per unit; strata apply to multinomial draws")
        return finish(poisson_sums(stats, by, list(stat.sums), reps, seed, unit, hasher), [*keys, "rep"], stat)
    if method == "multinomial":
        return finish(multinomial_sums(stats, by, list(stat.sums), reps, seed, strata, unit, hasher), [*keys, "rep"], stat)
    raise ValueError("method must be 'multinomial' or 'poisson'")


def paired_replicates(reps: DataFrame, level: str, within: Sequence[str] = ()) -> DataFrame:
    """Differences between all level pairs inside each replicate (levels are a small vocabulary)."""
    from evalpanel.operators.paired import level_pairs

    return level_pairs(reps, level, "theta", within, (), "rep").select(*within, "a", "b", "rep", F.col("d").alias("theta"))


def empty_bin_share(reps: DataFrame, keys: Sequence[str], n_bins: int = 5, limit: float = 0.01) -> DataFrame:
    """Replicates that lost a bin, and whether the stratified scheme should govern."""
    lost = F.count_if(F.col("bins_present") < n_bins)
    return reps.groupBy(*keys).agg(
        lost.alias("n_violations"),
        (lost / F.count("*")).alias("violation_share"),
        (lost / F.count("*") > F.lit(limit)).alias("use_stratified"),
    )


# ---- jackknife ----

def jackknife(stats: DataFrame, keys: Sequence[str], stat: Statistic, unit: str = "unit", per_unit: bool = False) -> DataFrame:
    """Leave-one-unit-out in closed form: totals minus the unit's own sums.

    Returns the acceleration constant per key, or with ``per_unit`` the leave-one-out values.
    """
    by = _group(stat, keys)
    names = list(stat.sums)
    grouped = stats.groupBy(*by) if by else stats.groupBy()
    totals = grouped.agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("_units"))
    valued = totals.withColumn("_full", F.expr(stat.value))
    if stat.balanced:
        over = W.partitionBy(*keys)
        valued = valued.withColumns({"_all": F.sum("_full").over(over), "_k": F.count("*").over(over)})
    else:
        valued = valued.withColumns({"_all": F.col("_full"), "_k": F.lit(1)})
    tot = valued.select(*by, *[F.col(n).alias(f"_t_{n}") for n in names], "_units", "_full", "_all", "_k")
    both = join_bounded(stats, tot, by)
    both = both.withColumns({n: F.col(f"_t_{n}") - F.col(n) for n in names}).withColumn("_out", F.expr(stat.value))
    if stat.balanced:
        left = F.when(F.col("_units") > 1, (F.col("_all") - F.col("_full") + F.col("_out")) / F.col("_k")).otherwise(
            (F.col("_all") - F.col("_full")) / (F.col("_k") - 1)
        )
    else:
        left = F.col("_out")
    values = both.select(*keys, unit, left.alias("theta_out"), (F.col("_all") / F.col("_k")).alias("_c"))
    if per_unit:
        return values.drop("_c")
    # Moments are taken about the full value, which the leave-one-out values hug.
    d = F.col("theta_out") - F.col("_c")
    grouped = values.groupBy(*keys) if keys else values.groupBy()
    m = grouped.agg(F.avg(d).alias("_m1"), F.avg(d * d).alias("_m2"), F.avg(d * d * d).alias("_m3"), F.count(d).alias("_n"))
    m1, m2, m3, n = (F.col(c) for c in ("_m1", "_m2", "_m3", "_n"))
    var = m2 - m1 * m1
    third = -(m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1)
    return m.select(*keys, F.when(var > 0, n * third / (6 * F.pow(n * var, F.lit(1.5)))).alias("accel"))


def weighted_rows(rows: DataFrame, weights: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows with their replicate weight, for rank statistics that take ``weight`` and ``rep`` in the keys."""
    return rows.join(weights.select(unit, "rep", "w"), unit)
