"""Cluster-level sensitivity: everything is computed from per-cluster sums."""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.functions.distributions import t_critical
from evalpanel.functions.hashing import uniform
from evalpanel.functions.levels import attach_totals, join_bounded, join_null_safe
from evalpanel.operators.metrics import TOO_FEW

# The six-point weight distribution.
SIX_POINT = (-math.sqrt(1.5), -1.0, -0.5, 0.5, 1.0, math.sqrt(1.5))


def bin_weights(contrib: DataFrame, keys: Sequence[str], n_bins: int = 5) -> DataFrame:
    """Weights (1 / k) / n_bin, so that the weighted mean of d is the balanced difference."""
    sizes = contrib.groupBy(*keys, "bin").agg(F.count("*").alias("_n"))
    return join_bounded(contrib, sizes, [*keys, "bin"]).withColumn("weight", 1 / (F.lit(float(n_bins)) * F.col("_n"))).drop("_n")


def cluster_sums(contrib: DataFrame, keys: Sequence[str], cluster: str, d: str = "d", weight: str | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return contrib.groupBy(*keys, cluster).agg(F.sum(w * F.col(d)).alias("swd"), F.sum(w).alias("sw"), F.count("*").alias("n"))


def clustered_interval(sums: DataFrame, keys: Sequence[str], cluster: str, alpha: float = 0.05, interval: bool = True) -> DataFrame:
    """Weighted mean, cluster-jackknife standard error, and its t interval with G - 1 degrees of freedom."""
    whole = W.partitionBy(*keys)
    st, wt = F.sum("swd").over(whole), F.sum("sw").over(whole)
    gap = (st - F.col("swd")) / (wt - F.col("sw")) - st / wt
    rows = sums.withColumns({"_gap": gap, "_b": st / wt})
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    g = F.count("*")
    out = grouped.agg(
        F.max("_b").alias("estimate"),
        g.alias("n_clusters"),
        F.sqrt((g - 1) / g * F.sum(F.col("_gap") * F.col("_gap"))).alias("se"),
    )
    out = out.withColumn("t_obs", F.when(F.col("se") > 0, F.col("estimate") / F.col("se")))
    if not interval:
        return out
    crit = t_critical(F.lit(1 - alpha / 2), (F.col("n_clusters") - 1).cast("double"))
    out = out.withColumn("_t", F.when(F.col("n_clusters") > 1, crit))
    return out.withColumns(
        {"ci_lo": F.col("estimate") - F.col("_t") * F.col("se"), "ci_hi": F.col("estimate") + F.col("_t") * F.col("se")}
    ).drop("_t")


def width_ratio(clustered: DataFrame, headline: DataFrame, keys: Sequence[str]) -> DataFrame:
    h = headline.select(*keys, (F.col("ci_hi") - F.col("ci_lo")).alias("_h"))
    both = join_null_safe(clustered, h, keys)
    return both.withColumn("width_ratio", F.when(F.col("_h") != 0, (F.col("ci_hi") - F.col("ci_lo")) / F.col("_h"))).drop("_h")


def _pick(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in SIX_POINT]), i.cast("int") + 1)


def wild_replicates(
    sums: DataFrame, keys: Sequence[str], cluster: str, reps: int, seed: int = 0, enumerate_all: bool = False, hasher: str = "xx"
) -> DataFrame:
    """t* per replicate with the null imposed: d is multiplied by one six-point weight per cluster.

    ``enumerate_all`` walks every weight vector (6^G, for a handful of clusters) instead of drawing; ``reps`` is then
    derived from the number of clusters.
    The cluster jackknife of a replicate expands into plain sums, so one aggregation is enough.
    """
    if enumerate_all:
        sizes = sums.groupBy(*keys) if keys else sums.groupBy()
        most = sizes.agg(F.count_distinct(cluster).alias("g")).agg(F.max("g")).first()[0] or 0
        if most > 8:
            raise ValueError(f"{most} clusters give 6^{most} weight vectors; draw them instead")
        reps = 6**most
    whole = W.partitionBy(*keys)
    wt = F.sum("sw").over(whole)
    base = sums.withColumns(
        {
            "_a": 1 / (wt - F.col("sw")),
            "_c": 1 / (wt - F.col("sw")) - 1 / wt,
            "_wt": wt,
            "_pos": F.row_number().over(whole.orderBy(cluster)) - 1,
        }
    )
    if enumerate_all:
        spread = base.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))))
        digit = F.floor(F.col("rep") / F.pow(F.lit(6.0), F.col("_pos"))) % 6
        v = _pick(digit)
    else:
        spread = base.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(reps).cast("bigint"))))
        v = _pick(F.floor(uniform(seed, ["rep", cluster], hasher) * 6))
    s = v * F.col("swd")
    parts = spread.groupBy(*keys, "rep").agg(
        F.count("*").alias("_g"),
        F.max("_wt").alias("_wt"),
        F.sum(s).alias("_t"),
        F.sum(F.col("_c") * F.col("_c")).alias("_cc"),
        F.sum(F.col("_c") * F.col("_a") * s).alias("_ca"),
        F.sum(F.col("_a") * F.col("_a") * s * s).alias("_aa"),
    )
    t = F.col("_t")
    var = (F.col("_g") - 1) / F.col("_g") * (t * t * F.col("_cc") - 2 * t * F.col("_ca") + F.col("_aa"))
    return parts.select(*keys, "rep", F.when(var > 1e-12 * (t * t * F.col("_cc") + F.col("_aa")), t / F.col("_wt") / F.sqrt(var)).alias("t_star"))


def wild_test(observed: DataFrame, stars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p = (1 + #{|t*| >= |t|}) / (valid + 1), floored at the resolution of the clusters: 6^G weight vectors come in pairs of opposite sign."""
    t = observed.select(*keys, "t_obs", (2 / F.pow(F.lit(float(len(SIX_POINT))), F.col("n_clusters"))).alias("_floor"))
    both = join_null_safe(stars, t, keys) if keys else attach_totals(stars, t)
    mag = F.round(F.abs("t_star"), 10)
    grouped = both.groupBy(*keys) if keys else both.groupBy()
    out = grouped.agg(
        F.max("t_obs").alias("t_obs"),
        F.max("_floor").alias("_floor"),
        F.count("t_star").alias("n_valid"),
        F.count_if(mag >= F.round(F.abs("t_obs"), 10)).alias("n_beyond"),
        F.count_distinct(mag).alias("n_distinct_abs_t"),
    )
    raw = (1 + F.col("n_beyond")) / (F.col("n_valid") + 1)
    ok = F.col("t_obs").isNotNull() & (F.col("n_valid") > 0)
    return out.withColumns(
        {
            "p_webb": F.when(ok, F.greatest(raw, F.col("_floor"))),
            "below_resolution_floor": F.when(ok, raw < F.col("_floor")).otherwise(F.lit(False)),
        }
    ).drop("_floor")


# ---- leave one cluster out ----

def leave_one_out_balanced(
    panel: DataFrame, keys: Sequence[str], cluster: str, value: str = "abs_e", n_bins: int = 5, min_n: int = 10, unit: str = "unit"
) -> DataFrame:
    """Balanced mean with each cluster dropped, by subtracting its sums; refused if a bin has < min_n units."""
    per_unit = panel.groupBy(*keys, "bin", cluster, unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    cell = per_unit.groupBy(*keys, "bin", cluster).agg(
        F.sum("_s").alias("s"), F.sum("_n").alias("n"), F.count("*").alias("u")
    )
    names = cell.groupBy(*keys).agg(F.array_sort(F.collect_set(cluster)).alias("_all"))
    bins = cell.groupBy(*keys, "bin").agg(
        F.sum("s").alias("ts"),
        F.sum("n").alias("tn"),
        F.sum("u").alias("tu"),
        F.map_from_entries(F.collect_list(F.struct(cluster, F.struct("s", "n", "u")))).alias("_own"),
    )
    both = join_null_safe(bins, names, keys) if keys else attach_totals(bins, names)
    out = both.withColumn("dropped", F.explode("_all")).withColumn("_o", F.col("_own")[F.col("dropped")])
    left = out.select(
        *keys,
        "dropped",
        "bin",
        (F.col("ts") - F.coalesce("_o.s", F.lit(0.0))).alias("s"),
        (F.col("tn") - F.coalesce("_o.n", F.lit(0))).alias("n"),
        (F.col("tu") - F.coalesce("_o.u", F.lit(0))).alias("u"),
    ).filter(F.col("n") > 0)
    got = left.groupBy(*keys, "dropped").agg(
        F.avg(F.col("s") / F.col("n")).alias("v"), F.count("*").alias("k"), F.min("u").alias("least"), F.sum("u").alias("n_units")
    )
    short = (F.col("k") < n_bins) | (F.col("least") < min_n)
    return got.select(
        *keys, "dropped", "n_units", F.when(~short, F.col("v")).alias("balanced_mae"), F.when(short, F.lit(TOO_FEW)).alias("reason")
    )


#: How two partial results of an aggregate are merged.
MERGES = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}
AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def complements(df: DataFrame, keys: Sequence[str], cluster: str, measures: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(keys, dropped, measures): the aggregates of all rows but those of one cluster, for every cluster of ``df``.

    ``measures`` names (aggregate, column) pairs; an aggregate is sum, count, min or max. The rows are aggregated once to (keys, cluster);
    the complement of a cluster is what stands before it merged with what stands after it, so no row is repeated and nothing
    needs to be subtracted again. With a value among the keys the result is the level table of the other clusters. A key that lacks a
    cluster keeps all of its rows when that is dropped; a complement without rows has NULL measures, and the NULL cluster is one of its own.
    """
    keys = list(keys)
    parts = df.groupBy(*keys, F.col(cluster).alias("dropped")).agg(*[AGGREGATES[how](c).alias(m) for m, (how, c) in measures.items()])
    names = df.select(F.col(cluster).alias("dropped")).distinct().agg(F.collect_list(F.struct("dropped")).alias("_all"))  # a vocabulary
    grid = attach_totals(parts.select(*keys).distinct(), names).select(*keys, F.explode("_all").alias("_d")).select(*keys, "_d.dropped")
    full = join_null_safe(grid, parts, [*keys, "dropped"], "left")
    ordered = W.partitionBy(*keys).orderBy("dropped")
    sides = (ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(1, W.unboundedFollowing))
    over = {"count": F.sum}

    def merged(m: str, how: str) -> Column:
        before, after = (over.get(how, AGGREGATES[how])(m).over(w) for w in sides)
        return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(MERGES[how](before, after)).alias(m)

    return full.select(*keys, "dropped", *[merged(m, how) for m, (how, _) in measures.items()])


def refit_range(refits: DataFrame, keys: Sequence[str], value: str, expected: int = 3) -> DataFrame:
    grouped = refits.groupBy(*keys) if keys else refits.groupBy()
    out = grouped.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n_usable"))
    note = F.concat(F.lit("built from "), F.col("n_usable").cast("string"), F.lit(f"/{expected} usable refits"))
    return out.withColumn("note", F.when(F.col("n_usable") == expected, F.lit("")).otherwise(note))
