"""Deterministic group metrics over a panel with columns unit, pred, reference, e, abs_e, bin."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.functions.columns import within
from evalpanel.functions.levels import Grain, attach_totals, join_bounded, join_null_safe, quantiles

TOO_FEW = "not computed (bin n < 10)"


# ---- pooled accuracy ----

def error_metrics(panel: DataFrame, keys: Sequence[str], zero_tol: float = 1e-8) -> DataFrame:
    """MAE, RMSE, mean bias, R2, share within 5 and 10, exact-zero rate."""
    sse = F.sum(F.col("e") * F.col("e"))
    r = F.col("reference")
    sst = F.sum(r * r) - F.sum(r) * F.sum(r) / F.count(r)
    return panel.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("abs_e").alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg("e").alias("bias"),
        F.when(sst > 0, F.lit(1.0) - sse / sst).alias("r2"),
        within("abs_e", 5).alias("p_within_5"),
        within("abs_e", 10).alias("p_within_10"),
        F.avg((F.abs("pred") <= zero_tol).cast("double")).alias("zero_rate"),
    )


def median_bias(panel: DataFrame, keys: Sequence[str], grain: Grain = "auto") -> DataFrame:
    return quantiles(panel, keys, "e", {"median_bias": 0.5}, grain)


def pool_axis(panel: DataFrame, keys: Sequence[str], unit: str = "unit") -> DataFrame:
    """Per-unit mean of |e| over the axes not in ``keys``: the mean of |e|, never |mean e|."""
    return panel.groupBy(*keys, unit).agg(F.avg("abs_e").alias("abs_e"))


def unit_means(
    panel: DataFrame,
    keys: Sequence[str],
    means: Sequence[str],
    carry: Sequence[str] = (),
    unit: str = "unit",
    digits: int | None = None,
) -> DataFrame:
    """Per-unit means of the named columns; ``carry`` holds columns constant within a unit.

    ``digits`` rounds the means, for use before a rank statistic: equal means summed in another order
    differ in the last bit and would lose their tie.
    """

    def mean(c: str) -> Column:
        return F.avg(c) if digits is None else F.round(F.avg(c), digits)

    return panel.groupBy(*keys, unit).agg(
        *[mean(c).alias(c) for c in means], *[F.min(c).alias(c) for c in carry]
    )


# ---- per bin and balanced ----

def bin_grid(per_key: DataFrame, keys: Sequence[str], n_bins: int) -> DataFrame:
    """Every key with every bin index: a generator over the known bins, not a join."""
    return per_key.select(*keys).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))
    )


def per_bin(panel: DataFrame, keys: Sequence[str], n_bins: int | None = None) -> DataFrame:
    """Rows, MAE, bias, spread per bin; with ``n_bins`` empty bins appear with n = 0."""
    got = panel.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"),
        F.avg("abs_e").alias("mae"),
        F.avg("e").alias("bias"),
        F.stddev_samp("e").alias("sd_e"),
        F.min("reference").alias("min_reference"),
    )
    if n_bins is None:
        return got
    return join_null_safe(bin_grid(got, keys, n_bins), got, [*keys, "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )


def units_per_bin(panel: DataFrame, keys: Sequence[str], n_bins: int, unit: str = "unit") -> DataFrame:
    """Distinct units per bin, zero-filled."""
    got = panel.groupBy(*keys, "bin").agg(F.countDistinct(unit).alias("n_units"))
    return join_null_safe(bin_grid(got, keys, n_bins), got, [*keys, "bin"], "left").withColumn(
        "n_units", F.coalesce("n_units", F.lit(0).cast("bigint"))
    )


def bin_spread(panel: DataFrame, keys: Sequence[str], value: str = "e", grain: Grain = "auto") -> DataFrame:
    """Mean, median, sd, IQR of a value per bin."""
    moments = panel.groupBy(*keys, "bin").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    q = quantiles(panel, [*keys, "bin"], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, grain)
    return join_null_safe(moments, q, [*keys, "bin"]).withColumn("iqr", F.col("q3") - F.col("q1"))


def balanced(
    panel: DataFrame,
    keys: Sequence[str],
    value: str = "abs_e",
    n_bins: int = 5,
    min_n: int | None = None,
    include_n: int | None = None,
    unit: str | None = None,
) -> DataFrame:
    """Unweighted mean of the non-empty per-bin means, always with those means and counts.

    ``include_n``: bins under it are reported but left out of the mean.
    ``min_n``: if any bin is under it the value is NULL and ``reason`` says so.
    ``unit``: counts and floors are of distinct units instead of rows.
    """
    size = F.count(value) if unit is None else F.count_distinct(F.when(F.col(value).isNotNull(), F.col(unit)))
    bins = panel.groupBy(*keys, "bin").agg(size.alias("n"), F.avg(value).alias("m"))
    use = F.lit(True) if include_n is None else F.col("n") >= F.lit(include_n)
    entry = F.struct("bin", "n", F.col("m").alias("mae"), use.alias("included"))
    out = bins.groupBy(*keys).agg(
        F.avg(F.when(use, F.col("m"))).alias("balanced_mae"),
        F.sum("n").alias("n"),
        F.count("*").alias("bins_present"),
        F.min("n").alias("smallest_bin"),
        F.array_sort(F.collect_list(entry)).alias("per_bin"),
    )
    if min_n is None:
        return out
    short = (F.col("bins_present") < F.lit(n_bins)) | (F.col("smallest_bin") < F.lit(min_n))
    return out.withColumns(
        {
            "balanced_mae": F.when(~short, F.col("balanced_mae")),
            "reason": F.when(short, F.lit(TOO_FEW.replace("10", str(min_n)))),
        }
    )


def metrics_by_axis(panel: DataFrame, rater: str = "rater", cond: str = "cond") -> DataFrame:
    """Overall and balanced error by rater, by condition and by both, from one grouping-sets pass."""
    bins = panel.groupingSets(
        [[rater, "bin"], [cond, "bin"], [rater, cond, "bin"]], rater, cond, "bin"
    ).agg(
        F.grouping_id().alias("_g"),
        F.sum("abs_e").alias("_s"),
        F.sum("e").alias("_e"),
        F.sum(F.col("e") * F.col("e")).alias("_q"),
        F.count("*").alias("_n"),
    )
    # grouping_id bits follow (rater, cond, bin): 2 = by rater, 4 = by condition, 0 = both.
    axis = F.when(F.col("_g") == 2, rater).when(F.col("_g") == 4, cond).otherwise("config")
    return (
        bins.withColumn("axis", axis)
        .groupBy("axis", rater, cond)
        .agg(
            F.sum("_n").alias("n"),
            (F.sum("_s") / F.sum("_n")).alias("mae"),
            F.sqrt(F.sum("_q") / F.sum("_n")).alias("rmse"),
            (F.sum("_e") / F.sum("_n")).alias("bias"),
            F.avg(F.col("_s") / F.col("_n")).alias("balanced_mae"),
        )
    )


# ---- tables of counts ----

def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long two-way table with structural zeros and row shares.

    The level lists come from the counted cells, so their size is the number of distinct levels.
    """
    got = df.groupBy(a, b).agg(F.count("*").alias("n"))
    lists = got.agg(F.collect_set(a).alias("_a"), F.collect_set(b).alias("_b"))
    grid = lists.select(F.explode("_a").alias(a), "_b").select(a, F.explode("_b").alias(b))
    full = grid.join(got, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return full.withColumn("share_of_row", F.col("n") / F.sum("n").over(W.partitionBy(a)))


def value_mass(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct levels and the largest level's share, per key."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("levels"),
            (F.max("_n") / F.sum("_n")).alias("largest_share"),
            F.count_if(F.col("_n") < 30).alias("levels_under_30"),
        )
    )


def zero_rates(panel: DataFrame, keys: Sequence[str], unit: str = "unit", tol: float = 1e-8) -> DataFrame:
    """True-zero and false-zero rates by rows, and true zeros by unit (all / any of its rows)."""
    flagged = panel.select(
        *keys, unit, (F.col("reference") == 0).alias("_z"), (F.abs("pred") <= tol).alias("_p")
    )
    per_unit = flagged.groupBy(*keys, unit, "_z").agg(
        F.count("*").alias("_n"),
        F.count_if("_p").alias("_k"),
        F.bool_and("_p").alias("_all"),
        F.bool_or("_p").alias("_any"),
    )
    z = F.col("_z")
    return per_unit.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(z, F.col("_n"))), F.lit(0).cast("bigint")).alias("n_zero_rows"),
        F.coalesce(F.sum(F.when(~z, F.col("_n"))), F.lit(0).cast("bigint")).alias("n_nonzero_rows"),
        (F.sum(F.when(z, F.col("_k"))) / F.sum(F.when(z, F.col("_n")))).alias("true_zero_rate"),
        (F.sum(F.when(~z, F.col("_k"))) / F.sum(F.when(~z, F.col("_n")))).alias("false_zero_rate"),
        F.avg(F.when(z, F.col("_all").cast("double"))).alias("true_zero_all"),
        F.avg(F.when(z, F.col("_any").cast("double"))).alias("true_zero_any"),
    )


# ---- ranking and picking ----

def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` tuple per key; the picked names come last as tie-break."""
    chosen = F.min_by(F.struct(*pick), F.struct(*order, *[p for p in pick if p not in order]))
    agg = df.groupBy(*keys).agg(chosen.alias("_b")) if keys else df.agg(chosen.alias("_b"))
    return agg.select(*keys, *[F.col(f"_b.{p}").alias(p) for p in pick])


def ranked(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Minimum and average rank. For tables of configurations, whose rows per key are few."""
    w = W.partitionBy(*keys).orderBy(by)
    return df.withColumns(
        {
            "rank_min": F.rank().over(w),
            "rank_avg": F.rank().over(w) + (F.count("*").over(W.partitionBy(*keys, by)) - 1) / F.lit(2.0),
        }
    )


def extreme_rows(
    panel: DataFrame, keys: Sequence[str], value: str, carry: Sequence[str], unit: str = "unit"
) -> DataFrame:
    """Best and worst example per stratum: an aggregate, so the stratum is never sorted."""
    body = F.struct(unit, value, *carry)
    return panel.groupBy(*keys).agg(
        F.min_by(body, F.struct(F.col(value), F.col(unit))).alias("best"),
        F.max_by(body, F.struct(F.col(value), -F.col(unit))).alias("worst"),
    )


def top_k_average(panel: DataFrame, k: int, limit: float, rater: str = "rater", unit: str = "unit") -> DataFrame:
    """Average the predictions of the k best raters per unit and flag errors of at least ``limit``."""
    board = panel.groupBy(rater).agg(F.avg("abs_e").alias("_m"))
    top = board.orderBy("_m", rater).limit(k).select(rater)
    kept = panel.join(top, rater, "left_semi")
    out = kept.groupBy(unit).agg(F.avg("pred").alias("pred"), F.min("reference").alias("reference"))
    return out.withColumn("abs_e", F.abs(F.col("pred") - F.col("reference"))).withColumn(
        "flagged", F.col("abs_e") >= F.lit(float(limit))
    )


# ---- baselines ----

def constant_baselines(unit_frame: DataFrame, constants: Mapping[str, float], grain: Grain = "auto") -> DataFrame:
    """MAE of predicting the median, the mean, or fixed constants for every unit."""
    mean = unit_frame.agg(F.avg("reference").alias("c_mean"))
    med = quantiles(unit_frame, [], "reference", {"c_median": 0.5}, grain)
    wide = attach_totals(attach_totals(unit_frame, mean), med)
    cols = {"mean": F.col("c_mean"), "median": F.col("c_median")}
    cols |= {name: F.lit(float(c)) for name, c in constants.items()}
    entries = F.array(*[F.struct(F.lit(n).alias("baseline"), c.cast("double").alias("constant")) for n, c in cols.items()])
    long = wide.select("unit", "reference", "bin", F.explode(entries).alias("_e")).select(
        "unit", "bin", "reference", "_e.baseline", "_e.constant"
    )
    return long.withColumn("e", F.col("constant") - F.col("reference")).withColumn("abs_e", F.abs("e"))


# ---- decompositions ----

def axis_spread(config_table: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Mean over ``outer`` of the (max - min) over ``inner``."""
    per = config_table.groupBy(outer).agg((F.max(value) - F.min(value)).alias("_s"))
    return per.agg(F.lit(inner).alias("axis"), F.avg("_s").alias("mean_spread"))


def variance_components(panel: DataFrame, unit: str = "unit", rater: str = "rater", cond: str = "cond") -> DataFrame:
    """Two-way moment decomposition of |e| into unit, rater, condition, interaction and residual shares.

    Four group means are reduced to sums of squares; the rater, condition and cell means are tables of
    vocabulary size, the unit means are aggregated without coming back to the rows.
    """
    total = panel.agg(
        F.avg("abs_e").alias("g"),
        F.count("*").alias("n"),
        (F.sum(F.col("abs_e") * F.col("abs_e")) - F.sum("abs_e") * F.sum("abs_e") / F.count("*")).alias("ss_total"),
    )
    by_unit = attach_totals(panel.groupBy(unit).agg(F.avg("abs_e").alias("m")), total.select("g"))
    u = by_unit.agg(F.count("*").alias("n_u"), F.sum((F.col("m") - F.col("g")) ** 2).alias("s_u"))
    cell = panel.groupBy(rater, cond).agg(F.sum("abs_e").alias("s"), F.count("*").alias("k"))
    wr, wc = W.partitionBy(rater), W.partitionBy(cond)
    means = attach_totals(
        cell.select(
            rater,
            cond,
            (F.col("s") / F.col("k")).alias("mc"),
            (F.sum("s").over(wr) / F.sum("k").over(wr)).alias("mr"),
            (F.sum("s").over(wc) / F.sum("k").over(wc)).alias("md"),
            F.count("*").over(wr).alias("n_c"),
            F.count("*").over(wc).alias("n_r"),
        ),
        total.select("g"),
    )
    g = F.col("g")
    side = means.agg(
        F.max("n_c").alias("n_c"),
        F.max("n_r").alias("n_r"),
        F.sum(((F.col("mr") - g) ** 2) / F.col("n_c")).alias("s_r"),
        F.sum(((F.col("md") - g) ** 2) / F.col("n_r")).alias("s_c"),
        F.sum((F.col("mc") - F.col("mr") - F.col("md") + g) ** 2).alias("s_i"),
    )
    one = attach_totals(attach_totals(total, u), side)
    ss = {
        "unit": F.col("n_r") * F.col("n_c") * F.col("s_u"),
        "rater": F.col("n_u") * F.col("n_c") * F.col("s_r"),
        "cond": F.col("n_u") * F.col("n_r") * F.col("s_c"),
        "interaction": F.col("n_u") * F.col("s_i"),
    }
    resid = F.col("ss_total") - sum(ss.values(), F.lit(0.0))
    shares = {f"share_{k}": v / F.col("ss_total") for k, v in ss.items()}
    inner = ss["rater"] + ss["cond"] + ss["interaction"]
    return one.select(
        *[v.alias(k) for k, v in shares.items()],
        (F.greatest(resid, F.lit(0.0)) / F.col("ss_total")).alias("share_residual"),
        *[F.when(inner > 0, ss[k] / inner).alias(f"renorm_{k}") for k in ("rater", "cond", "interaction")],
    )


def share_of_difference(per_bin_pair: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Per-bin difference and its share of the balanced difference."""
    w = W.partitionBy(*keys)
    delta = F.col(a) - F.col(b)
    total = F.avg(delta).over(w)
    return per_bin_pair.withColumns(
        {
            "delta": delta,
            "share": F.when(total != 0, delta / F.count("*").over(w) / total),
            "ratio": F.when(F.col(b) != 0, F.col(a) / F.col(b)),
        }
    )


def feasibility(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over-prediction: seen, and arithmetically possible given the largest prediction of the key."""
    top = panel.groupBy(*keys).agg(F.max("pred").alias("max_pred"))
    flagged = join_bounded(panel, top, keys)
    return flagged.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pred") > F.col("reference")).alias("n_over"),
        F.min("reference").alias("min_reference"),
        F.max("max_pred").alias("max_pred"),
        F.count_if(F.col("reference") < F.col("max_pred")).alias("n_feasible"),
        (F.min("reference") < F.max("max_pred")).alias("possible"),
    )


def change_counts(pairs: DataFrame, keys: Sequence[str], d: str = "d") -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.count_if(F.col(d) < 0).alias("improved"),
        F.count_if(F.col(d) > 0).alias("worsened"),
        F.count_if(F.col(d) == 0).alias("unchanged"),
    )


def skill_by_bin(panel: DataFrame, keys: Sequence[str], base: str) -> DataFrame:
    """Skill ratio per bin against a baseline error column, and ties of the bounded score at +-1."""
    m, b = F.col("abs_e"), F.col(base)
    score = F.when((m + b) > 0, (b - m) / (b + m)).otherwise(F.lit(0.0))
    return panel.withColumn("_r", score).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"),
        F.when(F.avg(b) > 0, F.lit(1.0) - F.avg(m) / F.avg(b)).alias("skill_ratio"),
        F.avg("_r").alias("mean_skill"),
        F.count_if(F.col("_r") == -1.0).alias("n_at_minus_1"),
        F.count_if(F.col("_r") == 1.0).alias("n_at_plus_1"),
        F.avg((F.col("_r") == 1.0).cast("double")).alias("share_at_plus_1"),
    )


def nested_steps(
    variant_panel: DataFrame, keys: Sequence[str], first: str, middle: str, last: str, variant: str = "variant"
) -> DataFrame:
    """Two-step decomposition of a balanced error: (middle - first) + (last - middle) = last - first."""
    per = variant_panel.groupBy(*keys, variant, "bin").agg(F.avg("abs_e").alias("_m"))
    bal = per.groupBy(*keys, variant).agg(F.avg("_m").alias("_b"))
    wide = bal.groupBy(*keys).agg(
        *[F.max(F.when(F.col(variant) == v, F.col("_b"))).alias(f"balanced_{v}") for v in (first, middle, last)]
    )
    step1 = F.col(f"balanced_{middle}") - F.col(f"balanced_{first}")
    step2 = F.col(f"balanced_{last}") - F.col(f"balanced_{middle}")
    total = F.col(f"balanced_{last}") - F.col(f"balanced_{first}")
    return wide.withColumns(
        {
            "step_1": step1,
            "step_2": step2,
            "total": total,
            "identity_holds": F.abs(step1 + step2 - total) <= 1e-9,
            "step_1_percent": F.when(total != 0, F.lit(100.0) * step1 / total),
        }
    )


def location_and_spread(per_bin_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Against the bottom bin: is a bin wider, and does the mean move by more than the smallest sd?"""
    w = W.partitionBy(*keys)
    low_sd = F.max(F.when(F.col("bin") == 0, F.col("sd"))).over(w)
    low_mean = F.max(F.when(F.col("bin") == 0, F.col("mean"))).over(w)
    return per_bin_table.withColumns(
        {
            "wider_than_bottom": F.coalesce(F.col("sd") > low_sd, F.lit(False)),
            "mean_range": F.max("mean").over(w) - F.min("mean").over(w),
            "location_moves": F.coalesce(F.abs(F.col("mean") - low_mean) > F.min("sd").over(w), F.lit(False)),
        }
    )


def subset_metric(panel: DataFrame, wanted_units: DataFrame, keys: Sequence[str], unit: str = "unit") -> DataFrame:
    return (
        panel.join(wanted_units, unit, "left_semi")
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), F.avg("abs_e").alias("mae"), F.avg("e").alias("bias"))
    )


def with_and_without(df: DataFrame, flagged: Column, operator) -> DataFrame:
    """The same analysis on all rows and without the flagged ones."""
    kept = df.filter(~F.coalesce(flagged, F.lit(False)))
    return operator(df).withColumn("rows_used", F.lit("all")).unionByName(
        operator(kept).withColumn("rows_used", F.lit("without_flagged"))
    )
