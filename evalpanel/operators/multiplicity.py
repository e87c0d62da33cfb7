"""Family-wise correction and verdict labels over tables of p-values."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTRAST_COLUMNS = ("a", "b", "n", "delta_balanced", "mean_d", "z", "rank_biserial", "n_ties")


def holm(df: DataFrame, p: str, family: Sequence[str], sizes: Mapping[str, int] | int) -> DataFrame:
    """Step-down adjusted p-values with a declared family size.

    More p-values than declared, or a family outside the registry, fails the job. A family is a set
    of planned contrasts, so its window holds that many rows.
    """
    if isinstance(sizes, int):
        m: Column = F.lit(sizes)
    else:
        m = F.lit(None).cast("int")
        for name, size in sizes.items():
            m = F.when(F.col(family[0]) == F.lit(name), F.lit(size)).otherwise(m)
    whole = W.partitionBy(*family)
    order = W.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    rn = F.row_number().over(order)
    supplied = F.count(p).over(whole)
    checked = (
        F.when(m.isNull(), F.raise_error(F.lit("family has no declared size")).cast("int"))
        .when(supplied > m, F.raise_error(F.lit("more p-values than the declared family size")).cast("int"))
        .otherwise(m)
    )
    ranked = df.withColumns({"_m": checked, "_rn": rn})
    step = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_rn") + F.lit(1)))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return (
        ranked.withColumn("_s", step)
        .withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("_s").over(upto)))
        .withColumn("family_size", F.col("_m"))
        .drop("_m", "_rn", "_s")
    )


def first_threshold(alpha: float, size: int) -> float:
    return alpha / size


def verdict(p: Column, effect: Column, null: float, alpha: float, companion_agrees: Column | None = None) -> Column:
    """informative / anti-informative / not detected; downgraded when the companion disagrees."""
    name = (
        F.when((p < alpha) & (effect > null), F.lit("informative"))
        .when((p < alpha) & (effect < null), F.lit("anti-informative"))
        .otherwise(F.lit("not detected"))
    )
    if companion_agrees is None:
        return name
    return F.when((p < alpha) & ~F.coalesce(companion_agrees, F.lit(False)), F.lit("label-dependent / not robustly classified")).otherwise(name)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A result table without its full column set is refused before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"result lacks columns {missing}")
    return df
