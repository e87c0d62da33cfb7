"""Agreement of two servings of the same cells."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalpanel.functions.levels import Grain, attach_totals, join_null_safe, quantiles
from evalpanel.operators.ranks import kendall_tau_b, spearman


def path_agreement(pairs: DataFrame, keys: Sequence[str], x: str = "pred", y: str = "pred2", grain: Grain = "auto") -> DataFrame:
    """Exact matches, quantiles of |x - y|, 95 % limits of x - y, rank correlation."""
    d = pairs.withColumns({"_d": F.col(x) - F.col(y), "_a": F.abs(F.col(x) - F.col(y))})
    exact = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((F.col("_d") == 0).cast("double")).alias("exact_rate"), F.avg("_d").alias("mean_diff")
    )
    size = quantiles(d, keys, "_a", {"q1": 0.25, "median_abs": 0.5, "q3": 0.75}, grain)
    limits = quantiles(d, keys, "_d", {"limit_lo": 0.025, "limit_hi": 0.975}, grain)
    rho = spearman(pairs, keys, x, y, grain_x=grain, grain_y=grain).drop("n")
    out = exact
    for part in (size, limits, rho):
        out = join_null_safe(out, part, keys) if keys else attach_totals(out, part)
    return out.withColumn("iqr_abs", F.col("q3") - F.col("q1")).drop("q1", "q3")


def ranking_agreement(table: DataFrame, item: str, x: str, y: str) -> DataFrame:
    """Tau-b of two rankings of the same items and whether they share the winner."""
    tau = kendall_tau_b(table, [], item, x, y)
    win = table.agg(
        F.min_by(item, F.struct(x, item)).alias("winner_x"), F.min_by(item, F.struct(y, item)).alias("winner_y")
    )
    return attach_totals(tau, win).withColumn("same_winner", F.col("winner_x") == F.col("winner_y"))
