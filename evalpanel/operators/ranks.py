"""Rank association and discrimination from level tables. ``weight`` lets each run per replicate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.functions.distributions import fisher_p
from evalpanel.functions.levels import Grain, attach_totals, join_bounded, join_null_safe, level_table, running


def _w(weight: str | None) -> Column:
    return F.lit(1).cast("bigint") if weight is None else F.col(weight)


def spearman(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    weight: str | None = None,
    grain_x: Grain = "auto",
    grain_y: Grain = "auto",
) -> DataFrame:
    """Correlation of mid-ranks. Both rank tables come from one (keys, x, y) count table."""
    keys = list(keys)
    cells = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .withColumn("_w", _w(weight))
        .groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.sum("_w").alias("_n"))
    )

    def ranks(col: str, grain: Grain) -> DataFrame:
        lv = running(cells.groupBy(*keys, col).agg(F.sum("_n").alias("_k")), keys, col, ["_k"], grain)
        centred = F.col("below__k") + (F.col("_k") - F.col("all__k")) / F.lit(2.0)
        return lv.select(*keys, col, centred.alias(f"_r{col}"), F.col("all__k").alias(f"_n{col}"))

    both = join_null_safe(join_null_safe(cells, ranks("_x", grain_x), [*keys, "_x"]), ranks("_y", grain_y), [*keys, "_y"])
    n, a, b = F.col("_n"), F.col("_r_x"), F.col("_r_y")
    den = F.sqrt(F.sum(n * a * a) * F.sum(n * b * b))
    agg = [F.max("_n_x").alias("n"), F.when(den > 0, F.sum(n * a * b) / den).alias("rho")]
    return both.groupBy(*keys).agg(*agg) if keys else both.agg(*agg)


def spearman_t(rho: Column, n: Column) -> Column:
    """t statistic of a rank correlation, with n - 2 degrees of freedom."""
    return F.when(F.abs(rho) < 1, rho * F.sqrt((n - F.lit(2.0)) / (F.lit(1.0) - rho * rho)))


def kendall_tau_b(table: DataFrame, keys: Sequence[str], item: str, x: str, y: str) -> DataFrame:
    """Tau-b and concordant share over a table of items (raters, configurations), packed per key."""
    entry = F.struct(F.col(item), F.col(x).alias("x"), F.col(y).alias("y"))
    grouped = table.groupBy(*keys) if keys else table.groupBy()
    packed = grouped.agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    left = packed.select(*keys, "_p", F.posexplode("_p").alias("_i", "_a"))
    both = left.select(*keys, "_a", F.explode(F.slice("_p", F.col("_i") + 2, F.size("_p"))).alias("_b"))
    sx, sy = F.signum(F.col("_a.x") - F.col("_b.x")), F.signum(F.col("_a.y") - F.col("_b.y"))
    c = F.sum(sx * sy)
    den = F.sqrt(F.count_if(sx != 0) * F.count_if(sy != 0))
    grouped = both.groupBy(*keys) if keys else both.groupBy()
    out = grouped.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(sx * sy > 0).alias("concordant"),
        F.count_if(sx * sy < 0).alias("discordant"),
        F.when(den > 0, c / den).alias("tau_b"),
    )
    return out.withColumn("concordant_share", (F.col("tau_b") + 1) / 2)


def rank_reversals(table: DataFrame, item: str, x: str, y: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Item pairs whose order differs between two columns.

    The item table has one row per configuration. With interval columns of the x-difference attached
    later, a reversal counts as real only if that interval excludes zero (``mark_real``).
    """
    entry = F.struct(F.col(item).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    packed = table.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    left = packed.select("_p", F.posexplode("_p").alias("_i", "_a"))
    both = left.select("_a", F.explode(F.slice("_p", F.col("_i") + 2, F.size("_p"))).alias("_b"))
    dx, dy = F.col("_a.x") - F.col("_b.x"), F.col("_a.y") - F.col("_b.y")
    return both.select(
        F.col("_a.k").alias("a"),
        F.col("_b.k").alias("b"),
        dx.alias("delta_x"),
        dy.alias("delta_y"),
        (F.signum(dx) * F.signum(dy) < 0).alias("reversed"),
    )


def mark_real(reversals: DataFrame, intervals: DataFrame) -> DataFrame:
    """``intervals``: a, b, ci_lo, ci_hi of the x-difference."""
    out = join_null_safe(reversals, intervals.select("a", "b", "ci_lo", "ci_hi"), ["a", "b"], "left")
    clear = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    return out.withColumn("real", F.col("reversed") & F.coalesce(clear, F.lit(False)))


def _labelled_levels(df: DataFrame, keys: Sequence[str], score: str, positive: str, weight: str | None) -> DataFrame:
    w = _w(weight)
    zero = F.lit(0).cast("bigint")
    return level_table(
        df.filter(F.col(score).isNotNull()),
        keys,
        score,
        {"pos": F.when(F.col(positive), w).otherwise(zero), "neg": F.when(~F.col(positive), w).otherwise(zero)},
    )


def auc(
    df: DataFrame, keys: Sequence[str], score: str, positive: str, weight: str | None = None, grain: Grain = "auto"
) -> DataFrame:
    """P(score of a negative > score of a positive) + half the ties, by running counts."""
    lv = running(_labelled_levels(df, keys, score, positive, weight), keys, score, ["pos", "neg"], grain)
    hits = F.sum(F.col("neg") * (F.col("below_pos") + F.col("pos") / F.lit(2.0)))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    grouped = lv.groupBy(*keys) if keys else lv.groupBy()
    return grouped.agg(
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
        F.sum(F.col("pos") * F.col("neg")).alias("n_tied_pairs"),
        F.when((n_pos > 0) & (n_neg > 0), hits / (n_pos * n_neg)).alias("auc"),
    ).withColumn("unstable", F.col("n_pos") < 20)


def mean_auc(cell_auc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over conditions of per-condition AUC; cells without one class are left out."""
    return cell_auc.groupBy(*keys).agg(
        F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_cells"), F.bool_or("unstable").alias("any_unstable")
    )


def roc_points(
    df: DataFrame, keys: Sequence[str], score: str, positive: str, missing: str = "drop", grain: Grain = "auto"
) -> DataFrame:
    """TPR and FPR of the rule score <= level at every realised level.

    ``missing='keep'`` counts rows without a score in the denominators; ``'drop'`` leaves them out.
    """
    if missing not in ("keep", "drop"):
        raise ValueError("missing must be 'keep' or 'drop'")
    lv = running(_labelled_levels(df, keys, score, positive, None), keys, score, ["pos", "neg"], grain)
    base = df if missing == "keep" else df.filter(F.col(score).isNotNull())
    sizes = base.groupBy(*keys).agg(F.count_if(positive).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    both = join_null_safe(lv, sizes, keys) if keys else attach_totals(lv, sizes)
    tp, fp = F.col("below_pos") + F.col("pos"), F.col("below_neg") + F.col("neg")
    return both.select(
        *keys,
        F.col(score).alias("level"),
        (F.col("pos") + F.col("neg")).alias("n_at_level"),
        F.when(F.col("_p") > 0, tp / F.col("_p")).alias("tpr"),
        F.when(F.col("_q") > 0, fp / F.col("_q")).alias("fpr"),
    )


def fill_extremes(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Rows without a score filled strictly below the minimum (``low``) and above the maximum (``high``)."""
    ends = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    both = join_bounded(df, ends, keys)
    return both.withColumns(
        {
            "low": F.coalesce(F.col(score), F.col("_lo") - 1),
            "high": F.coalesce(F.col(score), F.col("_hi") + 1),
        }
    ).drop("_lo", "_hi")


def fill_by_label(filled: DataFrame, positive: str) -> DataFrame:
    """The two worst cases for discrimination: missing scores agree with, or contradict, the label."""
    p = F.col(positive)
    return filled.withColumns(
        {
            "favourable": F.when(p, F.col("low")).otherwise(F.col("high")),
            "adverse": F.when(p, F.col("high")).otherwise(F.col("low")),
        }
    )


def missing_by_label(df: DataFrame, keys: Sequence[str], missing: Column, positive: str, p_value: bool = True) -> DataFrame:
    """2 x 2 counts of missing score by label, with the exact test."""
    p = F.col(positive)
    out = df.groupBy(*keys).agg(
        F.count_if(missing & p).alias("missing_pos"),
        F.count_if(missing & ~p).alias("missing_neg"),
        F.count_if(~missing & p).alias("present_pos"),
        F.count_if(~missing & ~p).alias("present_neg"),
    )
    if p_value:
        cols = [F.col(c).cast("double") for c in ("missing_pos", "missing_neg", "present_pos", "present_neg")]
        out = out.withColumn("fisher_p", fisher_p(*cols))
    return out


def pair_percentage(
    df: DataFrame, keys: Sequence[str], score: str, feature: str, weight: str | None = None, grain: Grain = "auto"
) -> DataFrame:
    """Percent of (feature, reference) pairs in which the feature row has the lower score, ties half."""
    a = auc(df, keys, score, feature, weight, grain)
    return a.select(*keys, F.col("n_pos").alias("n_feature"), F.col("n_neg").alias("n_reference"), (F.col("auc") * 100).alias("pct_lower"))


# ---- ordered groups: shared by trend tests and covariate pairs ----

def group_levels(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    group: str,
    groups: Sequence,
    weight: str | None = None,
    grain: Grain = "auto",
) -> DataFrame:
    """Level table with one count column per ordered group, and running counts."""
    w = _w(weight)
    measures = {f"g{i}": F.sum(F.when(F.col(group) == F.lit(g), w).otherwise(F.lit(0).cast("bigint"))) for i, g in enumerate(groups)}
    lv = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, value).agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    return running(lv, keys, value, list(measures), grain)


def ordered_pair_counts(lv: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Over group pairs i < j: pairs with value_j above, equal to, below value_i; and pairs inside groups."""
    up, same = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for j in range(1, k):
        lower = sum((F.col(f"below_g{i}") for i in range(j)), F.lit(0).cast("bigint"))
        level = sum((F.col(f"g{i}") for i in range(j)), F.lit(0).cast("bigint"))
        up = up + F.col(f"g{j}") * lower
        same = same + F.col(f"g{j}") * level
    t = sum((F.col(f"g{i}") for i in range(k)), F.lit(0).cast("bigint")).cast("double")
    grouped = lv.groupBy(*keys) if keys else lv.groupBy()
    inner_tied = sum((F.col(f"g{i}") * (F.col(f"g{i}") - 1) / 2 for i in range(k)), F.lit(0.0))
    return grouped.agg(
        *[F.sum(f"g{i}").alias(f"n_{i}") for i in range(k)],
        F.sum(up).alias("above"),
        F.sum(same).alias("equal"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias("tie_a"),
        F.sum(t * (t - 1) * (t - 2)).alias("tie_b"),
        F.sum(t * (t - 1)).alias("tie_c"),
        F.sum(t * t * t - t).alias("tie_d"),
        F.sum(inner_tied).alias("inner_tied"),
    )


def pair_percentage_along(
    df: DataFrame, keys: Sequence[str], covariate: str, score: str, levels: Sequence, weight: str | None = None, grain: Grain = "auto"
) -> DataFrame:
    """Percent of pairs, untied on the covariate, in which the row with the larger covariate scores lower.

    Score levels act as ordered groups and the covariate as the value, so pairs are never listed.
    """
    k = len(levels)
    c = ordered_pair_counts(group_levels(df, keys, covariate, score, levels, weight, grain), keys, k)
    sizes = [F.col(f"n_{i}").cast("double") for i in range(k)]
    cross = sum((sizes[i] * sizes[j] for i in range(k) for j in range(i + 1, k)), F.lit(0.0))
    inner = sum((s * (s - 1) / 2 for s in sizes), F.lit(0.0)) - F.col("inner_tied")
    below = cross - F.col("above") - F.col("equal")
    usable = cross - F.col("equal") + inner
    return c.select(*keys, usable.cast("bigint").alias("n_pairs"), F.when(usable > 0, 100 * (below + inner / 2) / usable).alias("pct_lower"))


def percentage_summary(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over cells: median, range, and how many intervals are clear of 50. Cells per key are few."""
    return cells.groupBy(*keys).agg(
        F.median("pct_lower").alias("median_pct"),
        F.min("pct_lower").alias("min_pct"),
        F.max("pct_lower").alias("max_pct"),
        F.count_if(F.col("ci_lo") > 50).alias("n_above"),
        F.count_if(F.col("ci_hi") < 50).alias("n_below"),
    )


# ---- tests on groups ----

def kruskal_wallis(df: DataFrame, keys: Sequence[str], value: str, group: str, grain: Grain = "auto") -> DataFrame:
    """Tie-corrected H with its degrees of freedom."""
    lv = level_table(df, [*keys, group], value, {"n": F.lit(1)})
    pooled = running(lv.groupBy(*keys, value).agg(F.sum("n").alias("t")), keys, value, ["t"], grain)
    ranked = join_null_safe(lv, pooled, [*keys, value])
    rank = F.col("below_t") + (F.col("t") + 1) / F.lit(2.0)
    t = F.col("t").cast("double")
    per = ranked.groupBy(*keys, group).agg(
        F.sum(rank * F.col("n")).alias("_r"),
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * (t * t - 1)).alias("_tt"),
    )
    n = F.sum("_n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.sum(F.col("_r") * F.col("_r") / F.col("_n")) - 3 * (n + 1)
    fix = 1 - F.sum("_tt") / (n * n * n - n)
    grouped = per.groupBy(*keys) if keys else per.groupBy()
    return grouped.agg(
        F.sum("_n").alias("n"),
        (F.count("*") - 1).alias("df"),
        F.when(fix > 0, h / fix).alias("h"),
    )


def mann_whitney(
    df: DataFrame, keys: Sequence[str], value: str, group: str, first, second, grain: Grain = "auto"
) -> DataFrame:
    """U of the first group and its tie- and continuity-corrected z."""
    c = ordered_pair_counts(group_levels(df, keys, value, group, [second, first], None, grain), keys, 2)
    u = F.col("above") + F.col("equal") / F.lit(2.0)
    a, b = F.col("n_1").cast("double"), F.col("n_0").cast("double")
    n = a + b
    var = a * b / 12 * (n + 1 - F.col("tie_d") / (n * (n - 1)))
    big = F.greatest(u, a * b - u)
    return c.select(
        *keys,
        F.col("n_1").alias("n_first"),
        F.col("n_0").alias("n_second"),
        u.alias("u"),
        F.when(var > 0, (big - a * b / 2 - 0.5) / F.sqrt(var)).alias("z"),
    )


def chi_square(table: DataFrame, a: str, b: str) -> DataFrame:
    """Independence statistic from a long two-way table with zeros (``crosstab``)."""
    row, col = W.partitionBy(a), W.partitionBy(b)
    sums = table.withColumns({"_r": F.sum("n").over(row), "_c": F.sum("n").over(col)})
    total = table.agg(F.sum("n").alias("_n"))
    e = F.col("_r") * F.col("_c") / F.col("_n")
    return attach_totals(sums, total).agg(
        F.sum(F.when(e > 0, (F.col("n") - e) * (F.col("n") - e) / e)).alias("chi2"),
        ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("df"),
        F.max("_n").alias("n"),
    )


def normality(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Omnibus K2 from the population skew and kurtosis; p is exp(-K2 / 2)."""
    m = df.groupBy(*keys).agg(
        F.count(value).cast("double").alias("n"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt")
    )
    n, g, b2 = F.col("n"), F.col("skew"), F.col("kurt")
    y = g * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    den = 1 + x * F.sqrt(2 / (a - 4))
    ratio = (1 - 2 / a) / den
    z2 = (1 - 2 / (9 * a) - F.signum(ratio) * F.pow(F.abs(ratio), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return m.withColumn("k2", z1 * z1 + z2 * z2).withColumn("p", F.exp(-F.col("k2") / 2))


def spearman_difference(
    df: DataFrame, keys: Sequence[str], x: str, base: str, y: str, grain: Grain = "auto", weight: str | None = None
) -> DataFrame:
    """Rank correlation of a prediction and of a baseline with the same reference, and their difference."""
    a = spearman(df, keys, x, y, weight, grain, grain).select(*keys, F.col("rho").alias("rho"))
    b = spearman(df, keys, base, y, weight, grain, grain).select(*keys, F.col("rho").alias("base_rho"))
    both = join_null_safe(a, b, keys) if keys else attach_totals(a, b)
    return both.withColumn("delta_rho", F.col("rho") - F.col("base_rho"))
