"""Ordered-alternative trend test with mid-ranks, its permutation null, and stratified form."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalpanel.functions.bijection import all_step_keys, permuted
from evalpanel.functions.hashing import uniform
from evalpanel.functions.levels import Grain, adaptive_cuts, join_null_safe, running, spread
from evalpanel.operators.ranks import group_levels, ordered_pair_counts
from evalpanel.operators.resample import unit_index
from evalpanel.session import cut_lineage


def _moments(k: int, variance: str) -> dict[str, Column]:
    sizes = [F.col(f"n_{i}").cast("double") for i in range(k)]
    n = sum(sizes, F.lit(0.0))

    def over(f) -> Column:
        return sum((f(s) for s in sizes), F.lit(0.0))

    mean = (n * n - over(lambda s: s * s)) / 4
    top = sum((sizes[i] * sizes[j] for i in range(k) for j in range(i + 1, k)), F.lit(0.0))
    if variance == "textbook":
        var = (n * (n - 1) * (2 * n + 5) - over(lambda s: s * (s - 1) * (2 * s + 5)) - F.col("tie_a")) / 72
        var = var + F.when(n >= 3, over(lambda s: s * (s - 1) * (s - 2)) * F.col("tie_b") / (36 * n * (n - 1) * (n - 2))).otherwise(0.0)
        var = var + F.when(n >= 2, over(lambda s: s * (s - 1)) * F.col("tie_c") / (8 * n * (n - 1))).otherwise(0.0)
    elif variance == "pooled":
        var = (n * n * (2 * n + 3) - over(lambda s: s * s * (2 * s + 3)) - F.col("tie_d") / 2) / 72
    else:
        raise ValueError("variance must be 'textbook' or 'pooled'")
    return {"mean_j": mean, "max_j": top, "var_j": var}


def trend(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    group: str,
    groups: Sequence,
    variance: str = "textbook",
    drop_missing: bool = False,
    grain: Grain = "auto",
    weight: str | None = None,
) -> DataFrame:
    """J, its null mean and variance, z, and the size-free j_bar in [-1, 1].

    A missing or non-finite value fails the job unless ``drop_missing``; then the count is reported.
    """
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    keys = list(keys)
    k = len(groups)
    if drop_missing:
        clean = df.filter(~bad)
    else:
        stop = F.raise_error(F.lit("trend: non-finite value")).cast("double")
        clean = df.withColumn(value, F.when(bad, stop).otherwise(F.col(value)))
    core = ordered_pair_counts(group_levels(clean, keys, value, group, groups, weight, grain), keys, k)
    j = F.col("above") + F.col("equal") / F.lit(2.0)
    m = _moments(k, variance)
    out = core.select(
        *keys, *[f"n_{i}" for i in range(k)], j.alias("j"), *[c.alias(name) for name, c in m.items()]
    )
    excess = F.col("j") - F.col("mean_j")
    out = out.withColumns(
        {
            "z": F.when(F.col("var_j") > 0, excess / F.sqrt("var_j")).otherwise(0.0),
            "j_bar": F.when(F.col("max_j") > 0, 2 * excess / F.col("max_j")),
        }
    )
    if drop_missing:
        lost = df.groupBy(*keys).agg(F.count_if(bad).alias("n_dropped"))
        out = join_null_safe(out, lost, keys) if keys else out.join(F.broadcast(lost))
    return out


def stratified_trend(per_stratum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of J, mean and variance over strata, with the pooled z."""
    grouped = per_stratum.groupBy(*keys) if keys else per_stratum.groupBy()
    out = grouped.agg(F.sum("j").alias("j"), F.sum("mean_j").alias("mean_j"), F.sum("var_j").alias("var_j"))
    return out.withColumn("z", F.when(F.col("var_j") > 0, (F.col("j") - F.col("mean_j")) / F.sqrt("var_j")).otherwise(0.0))


def permuted_groups(
    units: DataFrame,
    unit: str,
    value: str,
    group: str,
    groups: Sequence,
    reps: int,
    seed: int,
    hasher: str = "xx",
    slots: int = 256,
) -> DataFrame:
    """Per replicate, deal the group labels (sizes kept) to units in the order of a hash.

    The position in that order is a running count over hash slots, so no task sorts all units.
    """
    sizes = units.groupBy().agg(*[F.count_if(F.col(group) == F.lit(g)).alias(f"_s{i}") for i, g in enumerate(groups)])
    keyed = spread(units.select(unit, value), unit).select(
        unit, value, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    ).withColumn("_u", uniform(seed, ["rep", unit], hasher))
    pos = running(keyed.withColumn("_n", F.lit(1).cast("bigint")), ["rep"], "_u", ["_n"], 1.0 / slots)
    placed = pos.join(F.broadcast(sizes))
    out, edge = F.lit(None).cast(units.schema[group].dataType), F.lit(0)
    marks = []
    for i, g in enumerate(groups):
        edge = edge + F.col(f"_s{i}")
        marks.append((edge, g))
    for top, g in reversed(marks):
        out = F.when(F.col("below__n") < top, F.lit(g)).otherwise(out)
    return placed.select("rep", unit, value, out.alias(group))


#: Replicates that a task handles at a time, and rows x replicates of one step.
BLOCK, STEP = 64, 1 << 20


def permuted_statistics(units: DataFrame, unit: str, value: str, group: str, groups: Sequence, reps: int, seed: int, hasher: str = "xx") -> DataFrame:
    """(rep, j): the statistic after dealing the group labels anew, sizes kept, without a row per unit and replicate.

    A replicate permutes the units' dense places by a keyed bijection, and the first so many places belong to the first group and so on,
    so the task that holds a unit knows its group in every replicate. Units are dealt by intervals of the value; a task counts the pairs
    inside its interval and the group totals of every replicate, and the pairs across intervals are running sums of those totals. A value
    that fills whole intervals is split, for it needs totals alone. ``unit`` must be unique; units of other groups take no part.
    """
    groups, k = list(groups), len(groups)
    own = cut_lineage(unit_index(units.filter(F.col(group).isin(groups)), unit, (), hasher, carry=[value, group]))
    # One number per group reaches the driver.
    edges = np.cumsum(list(own.agg(*[F.count_if(F.col(group) == F.lit(g)) for g in groups]).first()))
    keys = all_step_keys(seed, "trend", reps)

    def within(held: pd.DataFrame) -> pd.DataFrame:
        head = held.iloc[0]
        held = held.sort_values(value, kind="stable")
        starts = np.flatnonzero(np.diff(held[value].to_numpy(float), prepend=np.nan) != 0)
        places, out = held["idx"].to_numpy(np.int64), []
        for block in range(-(-reps // BLOCK)):
            some = keys[block * BLOCK : (block + 1) * BLOCK]
            rows = max(1, STEP // len(some))
            dealt = np.concatenate([np.searchsorted(edges, permuted(places[at : at + rows], int(head["n"]), some), side="right").astype(np.int8) for at in range(0, len(places), rows)])
            inside, below, totals = np.zeros(len(some)), np.zeros((len(starts), len(some))), []
            for g in range(k):
                counts = np.add.reduceat((dealt == g).astype(np.int64), starts, axis=0)
                inside += (counts * below).sum(0)
                below += np.cumsum(counts, 0) - counts / 2.0
                totals.append(counts.sum(0))
            # Parts of a split value do not see each other: their pairs are counted from the sum of their totals.
            out.append((head["_cut"], head["_share"] > 0, block, (inside if head["_share"] == 0 else inside * 0).tobytes(), np.array(totals).tobytes()))
        return pd.DataFrame(out, columns=["cut", "one_value", "block", "inside", "totals"])

    def across(held: pd.DataFrame) -> pd.DataFrame:
        order = held.groupby(["cut", ~held["one_value"]]).ngroup().to_numpy()
        totals = np.stack([np.frombuffer(x, np.int64).reshape(k, -1) for x in held["totals"]])
        sums = np.zeros((order.max() + 1, *totals.shape[1:]))
        np.add.at(sums, order, totals)
        alone = np.zeros(len(sums))
        alone[order] = held["one_value"]
        before = np.cumsum(sums, 0) - sums + alone[:, None, None] * sums / 2
        j = sum((sums[:, g] * before[:, :g].sum(1)).sum(0) for g in range(1, k)) + np.stack([np.frombuffer(x) for x in held["inside"]]).sum(0)
        return pd.DataFrame({"rep": np.arange(len(j), dtype=np.int32) + 1 + int(held["block"].iloc[0]) * BLOCK, "j": j})

    cut = adaptive_cuts(own.select(F.col(value).cast("double").alias(value), "idx", "n"), value, points=True)
    cut = cut.withColumn("_part", F.when(F.col("_share") > 0, F.col("idx") % F.col("_share")).otherwise(0))
    parts = cut.groupBy("_cut", "_share", "_part").applyInPandas(within, "cut int, one_value boolean, block int, inside binary, totals binary")
    return parts.groupBy("block").applyInPandas(across, "rep int, j double")


def permutation_trend(
    units: DataFrame,
    unit: str,
    value: str,
    group: str,
    groups: Sequence,
    reps: int,
    seed: int,
    alpha: float,
    hasher: str = "xx",
    grain: Grain = "auto",
) -> DataFrame:
    """Observed trend with p = (1 + exceedances) / (reps + 1); ``alpha`` gates the direction label.

    Mean and variance do not change under permutation, so replicates compare |J* - mean|.
    """
    seen = trend(units, [], value, group, groups, grain=grain)
    js = permuted_statistics(units, unit, value, group, groups, reps, seed, hasher).withColumnRenamed("j", "_js")
    one = seen.select("*", F.abs(F.col("j") - F.col("mean_j")).alias("_gap"))
    beyond = js.join(F.broadcast(one.select("mean_j", "_gap"))).agg(
        F.count_if(F.abs(F.col("_js") - F.col("mean_j")) >= F.col("_gap")).alias("exceedances")
    )
    p = (1 + F.col("exceedances")) / F.lit(float(reps + 1))
    out = seen.join(F.broadcast(beyond)).withColumns(
        {"p_perm": p, "at_floor": F.col("exceedances") == 0, "floor": F.lit(1.0 / (reps + 1))}
    )
    way = F.when(F.col("z") > 0, "increasing").otherwise("decreasing")
    return out.withColumn("direction", F.when(F.col("p_perm") < F.lit(alpha), way).otherwise("null"))
