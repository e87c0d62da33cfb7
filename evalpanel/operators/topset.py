"""Which configurations cannot be told apart from the best, from a (config, rep, theta) table."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.session import cut_lineage


def best_probability(reps: DataFrame, config: str = "config", better: str = "min") -> DataFrame:
    """Share of replicates in which a configuration is best; the first name wins ties."""
    sign = 1 if better == "min" else -1
    winners = reps.groupBy("rep").agg(F.min_by(config, F.struct((F.col("theta") * sign), F.col(config))).alias(config))
    won = winners.groupBy(config).agg(F.count("*").alias("_w"))
    names = reps.groupBy(config).agg(F.count("*").alias("n_reps"))
    return names.join(won, config, "left").select(
        config, "n_reps", (F.coalesce("_w", F.lit(0)) / F.col("n_reps")).alias("prob_best")
    )


def excess(table: DataFrame, within: Sequence[str], value: str, better: str = "min") -> DataFrame:
    """D = distance to the best of the others; the two best values of the group are all it needs."""
    v = F.col(value) if better == "min" else -F.col(value)
    w = W.partitionBy(*within).orderBy("_v")
    top = table.withColumn("_v", v).withColumn("_rk", F.row_number().over(w))
    whole = W.partitionBy(*within)
    best = F.min("_v").over(whole)
    second = F.min(F.when(F.col("_rk") == 2, F.col("_v"))).over(whole)
    return top.withColumn("d", F.col("_v") - F.when(F.col("_rk") == 1, second).otherwise(best)).drop("_v", "_rk")


def _studentised(reps: DataFrame, points: DataFrame, config: str, better: str, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Per configuration d_hat and se, and the critical value of the largest studentised excess."""
    d_hat = excess(points, [], "theta_hat", better).select(config, "theta_hat", F.col("d").alias("d_hat"))
    d_star = excess(reps, ["rep"], "theta", better).select(config, "rep", F.col("d").alias("d_star"))
    se = d_star.groupBy(config).agg(F.stddev_samp("d_star").alias("se_hat"))
    rows = d_hat.join(se, config)
    tail = d_star.join(rows.select(config, "d_hat", "se_hat"), config).groupBy("rep").agg(
        F.max(F.when(F.col("se_hat") > 0, (F.col("d_star") - F.col("d_hat")) / F.col("se_hat"))).alias("_m")
    )
    # One value per replicate: B values.
    crit = tail.agg(F.percentile("_m", 1 - alpha).alias("critical"))
    return rows, crit


def comparison_set(reps: DataFrame, points: DataFrame, config: str = "config", better: str = "min", alpha: float = 0.05) -> DataFrame:
    """Multiple comparisons with the best: in the set if d_hat - c * se <= 0."""
    rows, crit = _studentised(reps, points, config, better, alpha)
    bound = F.col("d_hat") - F.col("critical") * F.when(F.col("se_hat") > 0, F.col("se_hat"))
    return rows.join(F.broadcast(crit)).withColumns({"lower_bound": bound, "in_mcb": F.coalesce(bound <= 0, F.lit(False))})


def eliminate(reps: DataFrame, points: DataFrame, config: str = "config", better: str = "min", alpha: float = 0.05) -> list[str]:
    """Drop the worst configuration until its statistic is under the critical value of those left.

    At most one round per configuration; a round returns two small aggregates to the driver.
    """
    kept = cut_lineage(reps.select(config, "rep", "theta"))
    left = cut_lineage(points.select(config, "theta_hat"))
    names = sorted(r[config] for r in left.select(config).collect())
    while len(names) > 1:
        rows, crit = _studentised(
            kept.filter(F.col(config).isin(names)), left.filter(F.col(config).isin(names)), config, better, alpha
        )
        t = F.when(F.col("se_hat") > 0, F.col("d_hat") / F.col("se_hat"))
        worst = rows.agg(F.max_by(config, t).alias("name"), F.max(t).alias("t")).join(F.broadcast(crit)).collect()[0]
        if worst["t"] is None or worst["t"] <= worst["critical"]:
            break
        names.remove(worst["name"])
    return names


def top_set(reps: DataFrame, points: DataFrame, config: str = "config", better: str = "min", alpha: float = 0.05) -> DataFrame:
    """Both constructions side by side, with their union, disagreement, and the probability of being best."""
    base = cut_lineage(reps.select(config, "rep", "theta"))
    survivors = eliminate(base, points, config, better, alpha)
    both = comparison_set(base, points, config, better, alpha).join(best_probability(base, config, better), config)
    both = both.withColumn("in_mcs", F.col(config).isin(survivors))
    differ = F.count_if(F.col("in_mcb") != F.col("in_mcs")).over(W.partitionBy())
    return both.withColumns({"in_union": F.col("in_mcb") | F.col("in_mcs"), "sets_disagree": differ > 0})
