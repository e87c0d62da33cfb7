"""Paired comparisons: every pair of levels in one job, rank statistics from level tables."""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.distributions import normal_p, sign_p
from evalpanel.functions.levels import Grain, join_null_safe, level_table, quantiles, running, spread
from evalpanel.session import cut_lineage


def level_pairs(
    panel: DataFrame,
    level: str,
    value: str = "abs_e",
    within: Sequence[str] = (),
    carry: Sequence[str] = ("bin",),
    unit: str = "unit",
) -> DataFrame:
    """All pairs a < b of ``level`` per unit: x and y are the values, d = x - y.

    The levels are a declared vocabulary (raters, conditions, configurations), so a unit carries a
    short array; it is built with one shuffle on the unit instead of a self-join.
    """
    packed = panel.groupBy(*within, unit, *carry).agg(
        F.array_sort(F.collect_list(F.struct(F.col(level).alias("l"), F.col(value).alias("v")))).alias("_p")
    )
    left = packed.select("*", F.posexplode("_p").alias("_i", "_x"))
    both = left.select(
        *within, unit, *carry, "_x", F.explode(F.slice("_p", F.col("_i") + 2, F.size("_p"))).alias("_y")
    )
    return both.select(
        *within,
        unit,
        *carry,
        F.col("_x.l").alias("a"),
        F.col("_y.l").alias("b"),
        F.col("_x.v").alias("x"),
        F.col("_y.v").alias("y"),
        (F.col("_x.v") - F.col("_y.v")).alias("d"),
    )


def paired_on(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, carry: Sequence[str]) -> DataFrame:
    """Pair two tables one-to-one on a key: x from the left, y from the right."""
    r = right.select(*on, F.col(value).alias("y"))
    return left.select(*on, *carry, F.col(value).alias("x")).join(r, list(on)).withColumn("d", F.col("x") - F.col("y"))


def difference_summary(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, means, wins, skew of the differences: one map-side combined aggregate."""
    d = F.col("d")
    n = F.count("d")
    return pairs.groupBy(*keys).agg(
        n.alias("n"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        F.avg("d").alias("mean_d"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms_x"),
        F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rms_y"),
        F.skewness("d").alias("skew"),
        F.count_if(d < 0).alias("n_wins_a"),
        F.count_if(d > 0).alias("n_wins_b"),
        F.count_if(d == 0).alias("n_ties"),
        (F.count_if(d < 0) / n).alias("win_rate_a"),
        (F.count_if(d > 0) / n).alias("win_rate_b"),
        (F.count_if(d == 0) / n).alias("tie_rate"),
        (F.count_if(d == 0) / n > F.lit(0.40)).alias("tie_burden_exceeded"),
    )


def balanced_difference(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = pairs.groupBy(*keys, "bin").agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    return per.groupBy(*keys).agg(
        F.avg("_x").alias("balanced_x"),
        F.avg("_y").alias("balanced_y"),
        (F.avg("_x") - F.avg("_y")).alias("delta_balanced"),
    )


def signed_rank(pairs: DataFrame, keys: Sequence[str], grain: Grain = "auto") -> DataFrame:
    """Signed-rank sums with zeros ranked and then dropped (Pratt), tie and continuity corrected z.

    Ranks among the non-zero differences come from a level table; including the zeros adds their
    number to every rank, so one running count serves both this test and the rank-biserial effect.
    """
    d = F.col("d")
    counts = pairs.groupBy(*keys).agg(F.count("d").alias("_n"), F.count_if(d == 0).alias("_z"))
    mags = level_table(
        pairs.filter(d != 0).withColumn("_m", F.abs(d)),
        keys,
        "_m",
        {"t": F.lit(1), "pos": (d > 0).cast("bigint"), "neg": (d < 0).cast("bigint")},
    )
    r = running(mags, keys, "_m", ["t"], grain)
    rank = F.col("below_t") + (F.col("t") + F.lit(1)) / F.lit(2.0)
    t = F.col("t").cast("double")
    sums = r.groupBy(*keys).agg(
        F.sum(rank * F.col("pos")).alias("_wp"),
        F.sum(rank * F.col("neg")).alias("_wn"),
        F.sum("pos").alias("_np"),
        F.sum("neg").alias("_nn"),
        F.sum(t * t * t - t).alias("_tt"),
        F.sum(F.when(F.col("t") > 1, F.col("t")).otherwise(F.lit(0))).alias("n_tied_ranks"),
    )
    one = join_null_safe(counts, sums, keys, "left") if keys else counts.join(F.broadcast(sums))
    zero = F.lit(0.0)
    wp, wn = F.coalesce("_wp", zero), F.coalesce("_wn", zero)
    n, z = F.col("_n").cast("double"), F.col("_z").cast("double")
    w_plus = wp + z * F.coalesce("_np", F.lit(0))
    w_minus = wn + z * F.coalesce("_nn", F.lit(0))
    stat = F.least(w_plus, w_minus)
    mean = (n * (n + 1) - z * (z + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.coalesce("_tt", zero) / 2) / 24
    gap = stat - mean
    return one.select(
        *keys,
        F.col("_n").alias("n_used"),
        F.col("_z").alias("n_zero_diff"),
        F.coalesce("n_tied_ranks", F.lit(0)).cast("bigint").alias("n_tied_ranks"),
        w_plus.alias("w_plus"),
        w_minus.alias("w_minus"),
        stat.alias("statistic"),
        F.when(var > 0, (gap - F.signum(gap) * 0.5) / F.sqrt(var)).alias("z"),
        F.when(wp + wn > 0, (wp - wn) / (wp + wn)).alias("rank_biserial"),
    )


_BRACKET = T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])


def _median_bracket(levels: DataFrame, facts: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    """An interval sure to hold the median pair sum, from a histogram of the levels per key.

    Pairs of cells i and j have sums in [i + j, i + j + 2) cell widths, so counting pairs per i + j (a
    convolution of at most ``cells`` numbers) bounds the median to two widths.
    """
    join = (lambda d, s: join_null_safe(d, s, keys)) if keys else (lambda d, s: d.join(F.broadcast(s)))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / F.lit(float(cells)), F.lit(1e-9))
    cell = F.least(F.floor((F.col("d") - F.col("_lo")) / width), F.lit(cells - 1)).cast("int")
    ends = facts.select(*keys, "_lo", "_hi")
    hist = join(levels, ends).groupBy(*keys, cell.alias("_b")).agg(F.sum("n").alias("_n"))
    grouped = hist.groupBy(*keys) if keys else hist.groupBy()
    packed = join(grouped.agg(F.collect_list(F.struct("_b", "_n")).alias("_h")), facts).withColumn("_w", width)

    @F.pandas_udf(_BRACKET)
    def bound(cell_ids: pd.Series, counts: pd.Series, low: pd.Series, w: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for b, c, lo, step, total in zip(cell_ids, counts, low, w, n):
            h = np.zeros(cells)
            h[np.asarray(b, dtype=int)] = np.asarray(c, dtype=float)
            pairs = np.convolve(h, h)
            pairs[::2] += h
            upto = np.cumsum(pairs / 2)
            k = total * (total + 1) / 2
            first = int(np.searchsorted(upto, (k + 1) // 2 * (1 - 1e-12)))
            last = int(np.searchsorted(upto, (k // 2 + 1) * (1 + 1e-12)))
            # The offset keeps the ends off the round values that sums of data fall on.
            out.append((2 * lo + (first - 0.1415926535) * step, 2 * lo + (last + 2.1415926535) * step))
        return pd.DataFrame(out, columns=["lo", "hi"])

    got = bound("_h._b", "_h._n", "_lo", "_w", F.col("_total").cast("double"))
    return packed.select(*keys, got.alias("_r")).select(*keys, "_r.lo", "_r.hi")


def hodges_lehmann(
    pairs: DataFrame,
    keys: Sequence[str],
    grain: float = 1.0,
    cells: int = 2048,
    probes: int = 16,
    budget: int = 200_000,
    max_rounds: int = 14,
) -> DataFrame:
    """Median of all Walsh averages (d_i + d_j) / 2, i <= j, exact, without listing the pairs.

    Differences are compressed to levels and a histogram gives an interval around the median pair sum.
    The number of pairs with sum <= t is a sum of running counts at t - d_i; it places the interval's
    ends, and narrows it while more than ``budget`` level pairs, and four times the levels, are inside: one sum
    alone can be that of a pair for every level. The pairs left are then found by an equi-join on slots of the interval's width. Only a few numbers per contrast come to the driver.
    """
    spark = pairs.sparkSession
    keys = list(keys)
    levels = cut_lineage(spread(level_table(pairs.filter(F.col("d").isNotNull()), keys, "d", {"n": F.lit(1)}), *keys, "d"))
    facts = levels.groupBy(*keys).agg(
        F.sum("n").alias("_total"), F.count("*").alias("_levels"), F.min("d").alias("_lo"), F.max("d").alias("_hi")
    )
    start = _median_bracket(levels, facts, keys, cells).withColumnsRenamed({"lo": "_from", "hi": "_to"})
    known = join_null_safe(facts, start, keys) if keys else facts.join(F.broadcast(start))
    brackets: dict[tuple, dict] = {}
    for row in known.collect():
        pairs_total = row["_total"] * (row["_total"] + 1) // 2
        inside = row["_levels"] * (row["_levels"] + 1) // 2
        brackets[tuple(row[k] for k in keys)] = {
            "lo": 2 * row["_lo"] - 1.0,
            "hi": 2 * row["_hi"] + 1.0,
            "base": 0,
            "levels": (0, inside),
            "n_levels": row["_levels"],
            "ask": [row["_from"], row["_to"]],
            "k1": (pairs_total + 1) // 2,
            "k2": pairs_total // 2 + 1,
        }
    key_schema = [levels.schema[k] for k in keys]
    types = {"ask": T.ArrayType(T.DoubleType()), "lo": T.DoubleType(), "hi": T.DoubleType()}

    def as_frame(fields: Sequence[str], chosen: Mapping[tuple, dict]) -> DataFrame:
        schema = T.StructType(key_schema + [T.StructField(f, types.get(f, T.LongType())) for f in fields])
        return spark.createDataFrame([(*k, *[v[f] for f in fields]) for k, v in chosen.items()], schema)

    def attach(df: DataFrame, small: DataFrame) -> DataFrame:
        # One row per contrast, built on the driver.
        return join_null_safe(df, F.broadcast(small), keys) if keys else df.join(F.broadcast(small))

    for turn in range(max_rounds):
        chosen = {k: v for k, v in brackets.items() if turn == 0 or v["levels"][1] - v["levels"][0] > max(budget, 4 * v["n_levels"])}
        if not chosen:
            break
        for key, found in _pairs_up_to(attach(levels, as_frame(["ask"], chosen)), keys, grain).items():
            b = brackets[key]
            under = [f for f in found if f[1] < b["k1"]]
            over = [f for f in found if f[1] >= b["k2"]]
            low, high = b["levels"]
            if under:
                b["lo"], b["base"], low = max(under)
            if over:
                b["hi"], _, high = min(over)
            b["levels"] = (low, high)
            step = (b["hi"] - b["lo"]) / (probes + 1)
            b["ask"] = [b["lo"] + step * (m + 0.8584073464) for m in range(probes)]

    small = as_frame(["lo", "hi", "base", "k1", "k2"], brackets)
    rows = attach(levels, small).withColumn("_w", F.greatest(F.col("hi") - F.col("lo"), F.abs("hi") * 1e-12, F.lit(1e-300)))
    slot = lambda c: F.floor(c / F.col("_w"))
    left = rows.withColumn(
        "_s", F.explode(F.sequence(slot(F.col("lo") - F.col("d")) - 1, slot(F.col("hi") - F.col("d")) + 1))
    )
    right = rows.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("d").alias("d2"), F.col("n").alias("n2"), slot(F.col("d")).alias("_s2"))
    cond = (F.col("_s") == F.col("_s2")) & (F.col("d") <= F.col("d2"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    total = F.col("d") + F.col("d2")
    found = left.join(right, cond).filter((total > F.col("lo")) & (total <= F.col("hi")))
    count = F.when(F.col("d") < F.col("d2"), F.col("n") * F.col("n2")).otherwise(F.shiftright(F.col("n") * (F.col("n") + 1), 1))
    sums = found.groupBy(*keys, total.alias("s"), "base", "k1", "k2").agg(F.sum(count).alias("_c"))
    # At most about ``budget`` sums are left per contrast.
    upto = F.col("base") + F.sum("_c").over(W.partitionBy(*keys).orderBy("s").rowsBetween(W.unboundedPreceding, 0))
    ordered = sums.withColumn("_u", upto)
    hit = lambda k: F.min(F.when(F.col("_u") >= F.col(k), F.col("s")))
    return ordered.groupBy(*keys).agg(((hit("k1") + hit("k2")) / 4).alias("hodges_lehmann"))


def _pairs_up_to(bounds: DataFrame, keys: Sequence[str], grain: float) -> dict[tuple, list]:
    """Per key and asked threshold t: (t, value pairs with sum <= t, level pairs with sum <= t).

    Levels and thresholds less a level are put in one order and counted by running sums over cuts of
    the value axis.
    """
    zero, cut = F.lit(0).cast("bigint"), F.floor(F.col("pos") / F.lit(grain)).alias("_cut")
    data = bounds.select(
        *keys, F.col("d").alias("pos"), F.lit(0).alias("kind"), "n", F.lit(1).cast("bigint").alias("one"),
        zero.alias("w"), F.lit(None).cast("double").alias("t"), "d",
    )
    asked = bounds.select(*keys, "d", "n", F.explode("ask").alias("t")).select(
        *keys, (F.col("t") - F.col("d")).alias("pos"), F.lit(1).alias("kind"), zero.alias("n"), zero.alias("one"),
        F.col("n").alias("w"), "t", "d",
    )
    events = data.unionByName(asked).select("*", cut)
    # Cuts without data still hold thresholds, so the totals are taken over both.
    totals = events.groupBy(*keys, "_cut").agg(F.sum("n").alias("_n"), F.sum("one").alias("_k"))
    before = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_cut", F.coalesce(F.sum("_n").over(before), zero).alias("_on"), F.coalesce(F.sum("_k").over(before), zero).alias("_ok")
    )
    inside = W.partitionBy(*keys, "_cut").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0)
    counted = events.withColumns({"_in": F.sum("n").over(inside), "_ik": F.sum("one").over(inside)}).filter("kind = 1")
    placed = join_null_safe(counted, offsets, [*keys, "_cut"])
    twice = F.col("d") + F.col("d") <= F.col("t")
    got = placed.groupBy(*keys, "t").agg(
        # Ordered pairs plus pairs with itself, halved.
        F.shiftright(F.sum(F.col("w") * (F.col("_on") + F.col("_in"))) + F.sum(F.when(twice, F.col("w")).otherwise(zero)), 1).alias("_c"),
        F.shiftright(F.sum(F.col("_ok") + F.col("_ik")) + F.count_if(twice), 1).alias("_lv"),
    )
    out: dict[tuple, list] = {}
    for row in got.collect():
        out.setdefault(tuple(row[k] for k in keys), []).append((row["t"], row["_c"], row["_lv"]))
    return out


def contrast_table(
    pairs: DataFrame, keys: Sequence[str], grain: Grain = "auto", p_values: bool = True, location: bool = True
) -> DataFrame:
    """One row per pair: differences, effects, signed-rank and sign tests, and their checks.

    The pairs are written once, as five aggregations read them.
    """
    pairs = cut_lineage(pairs)
    out = difference_summary(pairs, keys)
    parts = [balanced_difference(pairs, keys), signed_rank(pairs, keys, grain)]
    parts.append(quantiles(pairs, keys, "d", {"median_d": 0.5}, grain))
    if location:
        parts.append(hodges_lehmann(pairs, keys))
    for part in parts:
        out = join_null_safe(out, part, keys)
    out = out.withColumn("symmetry_violated", F.abs("skew") > 1)
    if location:
        out = out.withColumn("hl_minus_median", F.col("hodges_lehmann") - F.col("median_d"))
    if p_values:
        out = out.withColumns(
            {
                "wilcoxon_p": normal_p("z"),
                "sign_test_p": sign_p(F.col("n_wins_a").cast("double"), (F.col("n_wins_a") + F.col("n_wins_b")).cast("double")),
            }
        )
    return out


def by_bin(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-bin paired difference."""
    return pairs.groupBy(*keys, "bin").agg(
        F.count("d").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.avg("d").alias("mean_d")
    )


def baseline_contrast(panel: DataFrame, baseline: DataFrame, keys: Sequence[str], unit: str = "unit") -> DataFrame:
    """Per key against a one-row-per-unit baseline, aggregated to units before the join.

    ``baseline`` has columns unit, base_e, base_abs_e; ``opposed`` marks biases of opposite sign.
    """
    agg = panel.groupBy(*keys, unit).agg(
        F.avg("e").alias("e"), F.avg("abs_e").alias("abs_e"), F.min("bin").alias("bin")
    )
    both = agg.join(baseline.select(unit, "base_e", "base_abs_e"), unit)
    per = both.groupBy(*keys, "bin").agg(
        F.count("*").alias("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in ("e", "abs_e", "base_e", "base_abs_e")],
        F.sum(F.col("e") * F.col("e")).alias("_q"),
        F.sum(F.col("base_e") * F.col("base_e")).alias("_qb"),
    )
    n = F.sum("_n")
    bias, base_bias = F.sum("_s_e") / n, F.sum("_s_base_e") / n
    return per.groupBy(*keys).agg(
        n.alias("n"),
        (F.avg(F.col("_s_abs_e") / F.col("_n")) - F.avg(F.col("_s_base_abs_e") / F.col("_n"))).alias("delta_balanced"),
        ((F.sum("_s_abs_e") - F.sum("_s_base_abs_e")) / n).alias("delta_mae"),
        (F.sqrt(F.sum("_q") / n) - F.sqrt(F.sum("_qb") / n)).alias("delta_rmse"),
        bias.alias("bias"),
        base_bias.alias("base_bias"),
        (F.abs(bias) - F.abs(base_bias)).alias("delta_abs_bias"),
        (F.signum(bias) * F.signum(base_bias) < 0).alias("opposed"),
    )


# ---- reproducibility floor ----

def repeat_floor(runs: DataFrame, rater: str = "rater", unit: str = "unit", grain: Grain = "auto") -> DataFrame:
    """Run-to-run agreement per rater from pairs seen in both runs."""
    both = runs.groupBy(rater, unit).pivot("run", ["run1", "run2"]).agg(F.min("pred"))
    d = both.dropna(subset=["run1", "run2"]).withColumn("d", F.abs(F.col("run1") - F.col("run2")))
    agg = d.groupBy(rater).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("d") == 0).alias("n_exact"),
        F.avg("d").alias("floor"),
        F.max("d").alias("max_diff"),
    )
    med = quantiles(d.filter(F.col("d") > 0), [rater], "d", {"median_nonzero": 0.5}, grain)
    return join_null_safe(agg, med, [rater], "left")


def within_floor(effects: DataFrame, floors: DataFrame, rater: str, effect: str, estimable: Column | None = None) -> DataFrame:
    """Flag effects smaller than the run-to-run floor of their rater; the floor has a row per rater."""
    out = join_null_safe(effects, floors.select(rater, "floor"), [rater], "left")
    ok = F.lit(True) if estimable is None else estimable
    return out.withColumns(
        {
            "within_floor": F.when(ok, F.abs(effect) < F.col("floor")),
            "floor_note": F.when(~ok, F.lit("not estimable for balanced")),
        }
    )
