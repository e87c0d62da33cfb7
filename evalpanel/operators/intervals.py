"""Intervals and p-values from replicate tables.

A key's replicates are a fixed number (B), whatever the size of the data, so they fit one array.
"""

from __future__ import annotations

from statistics import NormalDist
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.levels import attach_totals, join_null_safe

BCA, FALLBACK = "BCa", "percentile (BCa fallback)"
TOO_FEW = "not computed (too many empty-bin resamples)"

_RESULT = T.StructType(
    [
        T.StructField("ci_lo", T.DoubleType()),
        T.StructField("ci_hi", T.DoubleType()),
        T.StructField("ci_method", T.StringType()),
        T.StructField("p_two_sided", T.DoubleType()),
        T.StructField("undefined_share", T.DoubleType()),
        T.StructField("se", T.DoubleType()),
    ]
)


def percentile_interval(reps: DataFrame, keys: Sequence[str], alpha: float = 0.05, min_finite: int = 50) -> DataFrame:
    """Percentile interval, two-sided p with floor 1 / (B + 1), and the share of undefined replicates."""
    grouped = reps.groupBy(*keys) if keys else reps.groupBy()
    t = F.nanvl("theta", F.lit(None).cast("double"))
    out = grouped.agg(
        F.count("*").alias("n_reps"),
        F.count(t).alias("n_defined"),
        F.percentile(t, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q"),
        F.avg((t <= 0).cast("double")).alias("_lo"),
        F.avg((t >= 0).cast("double")).alias("_hi"),
        F.stddev_samp(t).alias("se"),
    )
    enough = F.col("n_defined") >= min_finite
    return out.select(
        *keys,
        F.when(enough, F.col("_q")[0]).alias("ci_lo"),
        F.when(enough, F.col("_q")[1]).alias("ci_hi"),
        F.when(enough, F.lit("percentile")).otherwise(F.lit(TOO_FEW)).alias("ci_method"),
        F.greatest(2 * F.least("_lo", "_hi"), 1 / (F.col("n_reps") + 1)).alias("p_two_sided"),
        (1 - F.col("n_defined") / F.col("n_reps")).alias("undefined_share"),
        "se",
    )


def bca(values: np.ndarray, theta: float, accel: float | None, alpha: float) -> tuple[float | None, float | None, str]:
    normal = NormalDist()
    ends = (alpha / 2, 1 - alpha / 2)
    plain = tuple(float(np.percentile(values, 100 * a)) for a in ends)
    below = float(np.mean(values < theta))
    if np.unique(values).size < 50 or not 0 < below < 1 or accel is None or not np.isfinite(accel):
        return (*plain, FALLBACK)
    z0 = normal.inv_cdf(below)
    points = []
    for a in ends:
        s = z0 + normal.inv_cdf(a)
        den = 1 - accel * s
        if den == 0:
            return (*plain, FALLBACK)
        points.append(normal.cdf(z0 + s / den))
    return (*(float(np.percentile(values, 100 * p)) for p in points), BCA)


def bca_interval(
    reps: DataFrame, points: DataFrame, accel: DataFrame, keys: Sequence[str], alpha: float = 0.05, retained: str | None = None
) -> DataFrame:
    """Bias-corrected accelerated interval; falls back to percentiles and says so.

    ``retained`` names a count column of ``points``; under 30 the method is labelled degenerate.
    """
    grouped = reps.groupBy(*keys) if keys else reps.groupBy()
    t = F.nanvl("theta", F.lit(None).cast("double"))
    arrays = grouped.agg(F.collect_list(t).alias("_reps"), F.count("*").alias("_n"))
    for part in (points, accel):
        arrays = join_null_safe(arrays, part, keys) if keys else attach_totals(arrays, part)

    @F.pandas_udf(_RESULT)
    def solve(values: pd.Series, theta: pd.Series, acc: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for v, t, a, k in zip(values, theta, acc, n):
            v = np.asarray(v, dtype=float)
            if v.size == 0 or t is None or pd.isna(t):
                rows.append((None, None, TOO_FEW, None, 1.0, None))
                continue
            gap = 1 - v.size / k
            if gap > 0:
                ends = (*(float(np.percentile(v, 100 * p)) for p in (alpha / 2, 1 - alpha / 2)), FALLBACK)
            else:
                ends = bca(v, float(t), None if pd.isna(a) else float(a), alpha)
            p = max(2 * min(np.mean(v <= 0), np.mean(v >= 0)), 1 / (k + 1))
            rows.append((*ends, float(p), float(gap), float(np.std(v, ddof=1)) if v.size > 1 else None))
        return pd.DataFrame(rows, columns=[f.name for f in _RESULT.fields])

    solved = arrays.withColumn("_r", solve("_reps", "theta_hat", "accel", "_n"))
    method = F.col("_r.ci_method")
    if retained is not None:
        method = F.when(F.col(retained) < 30, F.concat(method, F.lit(", degenerate: n < 30"))).otherwise(method)
    extra = [retained] if retained else []
    return solved.select(
        *keys, "theta_hat", "_r.ci_lo", "_r.ci_hi", method.alias("ci_method"), "_r.p_two_sided", "_r.undefined_share", "_r.se", *extra
    )


def format_p(p: str, reps: int):
    """Text for a p-value, with the resolution floor shown as such."""
    floor = 1.0 / (reps + 1)
    return F.when(F.col(p) <= F.lit(floor), F.lit(f"< {floor:.1e}")).otherwise(F.format_string("%.5f", F.col(p)))


def band_excludes_zero(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over a simultaneous band (narrower alpha): does every interval of the key exclude zero?"""
    clear = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    return intervals.groupBy(*keys).agg(F.bool_and(clear).alias("all_exclude_zero"), F.count("*").alias("n_intervals"))
