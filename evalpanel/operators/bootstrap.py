"""Statistic in, interval out: the resampling steps in their usual order."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from evalpanel.operators import intervals as I
from evalpanel.operators import resample as B
from evalpanel.session import cut_lineage


def bootstrap(
    rows: DataFrame,
    keys: Sequence[str],
    stat: B.Statistic,
    reps: int,
    seed: int,
    method: str = "poisson",
    strata: Sequence[str] = (),
    alpha: float = 0.05,
    unit: str = "unit",
    hasher: str = "xx",
) -> DataFrame:
    """Estimate, interval and p per key. The unit statistics are written once and read three times."""
    stats = cut_lineage(B.unit_stats(rows, keys, stat, unit, strata))
    boot = B.replicates(stats, keys, stat, reps, seed, method, strata, unit, hasher)
    return I.bca_interval(boot, B.point(stats, keys, stat), B.jackknife(stats, keys, stat, unit), keys, alpha)
