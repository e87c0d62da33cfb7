"""Keeping only rows whose score reaches a cutoff: every realised cutoff in one pass.

Rows are summed per score level (and bin, and replicate), then accumulated from the highest level
down. The number of levels is that of the score's scale, so rows are never repeated per cutoff.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.levels import join_bounded, join_null_safe, running
from evalpanel.operators.intervals import FALLBACK, bca
from evalpanel.operators.rank_replicates import block_width, replicate_counts
from evalpanel.session import cut_lineage


def cutoff_sweep(
    rows: DataFrame,
    keys: Sequence[str],
    score: str,
    missing: str,
    n_bins: int = 5,
    weight: str | None = None,
    value: str = "abs_e",
) -> DataFrame:
    """Error of the retained rows at every cutoff (score >= cutoff).

    ``missing='keep'``: rows without a score are always retained; the balanced error is NULL as soon as
    a bin is empty. ``missing='drop'``: they are left out, a retain-all row (cutoff NULL) is added, and
    the share of the bottom bin is given.
    """
    if missing not in ("keep", "drop"):
        raise ValueError("missing must be 'keep' or 'drop'")
    keys = list(keys)
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    sums = rows.groupBy(*keys, F.col(score).alias("cutoff"), "bin").agg(
        F.sum(w).alias("n"), F.sum(w * F.col(value)).alias("s")
    )
    scored = sums.filter(F.col("cutoff").isNotNull())
    per_level = scored.groupBy(*keys, "cutoff").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "s")))).alias("_m"))
    # One row per (key, level, bin), so that every bin accumulates over all levels.
    grid = per_level.select(*keys, "cutoff", "_m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    cell = grid.select(
        *keys,
        "cutoff",
        "bin",
        F.coalesce(F.col("_m")[F.col("bin")]["n"], F.lit(0)).alias("n"),
        F.coalesce(F.col("_m")[F.col("bin")]["s"], F.lit(0.0)).alias("s"),
    )
    above = running(cell.withColumn("_down", -F.col("cutoff")), [*keys, "bin"], "_down", ["n", "s"])
    kept = above.select(*keys, "cutoff", "bin", (F.col("below_n") + F.col("n")).alias("n"), (F.col("below_s") + F.col("s")).alias("s"))
    blanks = sums.filter(F.col("cutoff").isNull()).select(*keys, "bin", F.col("n").alias("_bn"), F.col("s").alias("_bs"))
    if missing == "keep":
        kept = join_null_safe(kept, blanks, [*keys, "bin"], "left").select(
            *keys,
            "cutoff",
            "bin",
            (F.col("n") + F.coalesce("_bn", F.lit(0))).alias("n"),
            (F.col("s") + F.coalesce("_bs", F.lit(0.0))).alias("s"),
        )
        base = sums
    else:
        everything = scored.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        kept = kept.unionByName(everything.withColumn("cutoff", F.lit(None).cast("double")))
        base = scored
    totals = base.groupBy(*keys).agg(F.sum("n").alias("n_total"))
    lost = sums.groupBy(*keys).agg(F.sum(F.when(F.col("cutoff").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_unusable"))
    full = F.count_if(F.col("n") > 0) == n_bins
    out = kept.groupBy(*keys, "cutoff").agg(
        F.sum("n").alias("n_retained"),
        F.when(F.sum("n") > 0, F.sum("s") / F.sum("n")).alias("mae"),
        F.when(full, F.avg(F.when(F.col("n") > 0, F.col("s") / F.col("n")))).alias("balanced_mae"),
        F.min("n").alias("smallest_bin"),
        F.when(F.sum("n") > 0, F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(F.lit(0))) / F.sum("n")).alias("bottom_share"),
    )
    for part in (totals, lost):
        out = join_null_safe(out, part, keys) if keys else out.join(F.broadcast(part))
    return out.withColumn("retained_fraction", F.col("n_retained") / F.col("n_total"))


# ---- intervals for all cutoffs at once ----

def packed_sweeps(rows: DataFrame, keys: Sequence[str], score: str, missing: str, reps: int, seed: int, n_bins: int = 5, unit: str = "unit", value: str = "abs_e", hasher: str = "xx") -> DataFrame:
    """(keys, cutoff, block, theta, theta_balanced): the sweep of every replicate, a block of replicates packed in a row as doubles.

    Weighted counts and sums per (score level, bin) are matrices with a column per replicate, filled where the rows are read; a task turns
    one key's matrix for one block into all curves by sums from the highest level down. NaN stands where a replicate retains nothing
    (balanced: where it leaves a bin empty). With ``missing='drop'`` the row with cutoff NULL retains all.
    """
    given = rows.select(*keys, F.col(score).cast("double").alias("cutoff"), F.col("bin").cast("int").alias("bin"), unit, F.col(value).cast("double").alias("_v"))
    given = cut_lineage(given if missing == "keep" else given.filter("cutoff IS NOT NULL"))
    sizes = given.select(*keys, "cutoff", "bin").distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    width = block_width(3 * (sizes.agg(F.max("n")).first()[0] or 1), reps)
    cells = replicate_counts(given, keys, ["cutoff", "bin"], reps, width, seed, unit, hasher, measure="_v")
    fields = [given.schema[k] for k in keys] + [T.StructField("cutoff", T.DoubleType()), T.StructField("block", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("theta", T.BinaryType()), T.StructField("theta_balanced", T.BinaryType())])

    def run(held: pa.Table) -> pa.Table:
        level = held.column("cutoff").to_numpy()
        blank = np.isnan(level)
        levels, at = np.unique(level[~blank], return_inverse=True)
        counts = np.stack([np.frombuffer(x, "<i8") for x in held.column("counts").to_pylist()])
        sums = np.stack([np.frombuffer(x) for x in held.column("sums").to_pylist()])
        bins = held.column("bin").to_numpy()
        n, s = (np.zeros((n_bins, len(levels) + 1, counts.shape[1])) for _ in range(2))
        place = np.full(len(level), len(levels))  # rows without a score stand above all levels
        place[~blank] = at
        np.add.at(n, (bins, place), counts)
        np.add.at(s, (bins, place), sums)
        n, s = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (n, s))
        full = n[:, : len(levels)], s[:, : len(levels)]
        cuts = [*levels.tolist()]
        if missing == "drop":
            full, cuts = tuple(np.concatenate([x, y[:, :1]], axis=1) for x, y in zip(full, (n, s))), [*cuts, None]
        n, s = full
        with np.errstate(invalid="ignore", divide="ignore"):
            theta, per_bin = s.sum(0) / n.sum(0), s / n
        balanced = np.where((n > 0).all(0), per_bin.mean(0), np.nan)
        heads = {k: pa.array([held.column(k)[0].as_py()] * len(cuts), held.schema.field(k).type) for k in keys}
        packed = {c: pa.array([np.ascontiguousarray(r).tobytes() for r in x], pa.binary()) for c, x in (("theta", theta), ("theta_balanced", balanced))}
        return pa.table({**heads, "cutoff": pa.array(cuts, pa.float64()), "block": pa.array([held.column("block")[0].as_py()] * len(cuts), pa.int32()), **packed})

    return cells.groupBy(*keys, "block").applyInArrow(run, schema)


def sweep_acceleration(rows: DataFrame, keys: Sequence[str], score: str, missing: str, unit: str = "unit", value: str = "abs_e") -> DataFrame:
    """(keys, cutoff, n_retained, theta_hat, accel, undefined): the jackknife over units of the retained mean, at every cutoff.

    Without a unit the sum S and count N at a cutoff become S - t and N - j, where t and j are the unit's own sums over its rows at or above
    the cutoff. Its value differs from S / N by (j S / N - t) / (N - j), so all that is needed of the units with equal j are their number and the sums
    of t, t^2 and t^3; a unit moves from one j to the next only at its own levels, and sums of these moves from the highest level down give
    every cutoff. No row is repeated per cutoff. Units that retain nothing count as unchanged; ``undefined`` says that leaving one unit
    out leaves no rows.
    """
    keys = list(keys)
    given = rows.select(*keys, unit, F.col(score).cast("double").alias("_c"), F.col(value).cast("double").alias("_v"))
    universe = given.select(*keys, unit).distinct().groupBy(*keys).agg(F.count("*").alias("_units"))
    used = given if missing == "keep" else given.filter("_c IS NOT NULL")
    middle = used.groupBy(*keys).agg(F.avg("_v").alias("_mid"), (F.max("_c") + 1).alias("_top"), F.min("_c").alias("_low"))
    at = join_bounded(used, middle, keys).withColumn("_c", F.coalesce("_c", "_top"))  # always retained: above all levels
    own = at.groupBy(*keys, unit, "_c").agg(F.count("*").alias("_n"), F.sum(F.col("_v") - F.col("_mid")).alias("_s"))
    down = W.partitionBy(*keys, unit).orderBy(F.col("_c").desc()).rowsBetween(W.unboundedPreceding, 0)
    moved = own.withColumns({"_j": F.sum("_n").over(down), "_t": F.sum("_s").over(down)})
    state = lambda j, t, sign: F.struct(j.alias("j"), *[(F.lit(float(sign)) * F.pow(t, F.lit(float(q)))).alias(f"m{q}") for q in range(4)])
    before = F.when(F.col("_j") > F.col("_n"), state(F.col("_j") - F.col("_n"), F.col("_t") - F.col("_s"), -1))
    moves = moved.select(*keys, "_c", F.explode(F.array_compact(F.array(state(F.col("_j"), F.col("_t"), 1), before))).alias("_e")).select(*keys, "_c", "_e.*")
    levels = own.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    most = moved.groupBy(*keys).agg(F.max("_j").alias("_most"))
    nothing = join_bounded(levels, most, keys).select(*keys, "_c", F.explode(F.sequence(F.lit(1).cast("long"), "_most")).alias("j"), *[F.lit(0.0).alias(f"m{q}") for q in range(4)])
    names = [f"m{q}" for q in range(4)]
    each = moves.unionByName(nothing).groupBy(*keys, "j", "_c").agg(*[F.sum(m).alias(m) for m in names])
    above = lambda m: (F.col(f"all_{m}") - F.col(f"below_{m}")).alias(m)
    held = running(each, [*keys, "j"], "_c", names).select(*keys, "j", "_c", *[above(m) for m in names])
    totals = running(levels, keys, "_c", ["_n", "_s"]).select(*keys, "_c", above("_n"), above("_s"))
    both = join_null_safe(held, totals, [*keys, "_c"])
    j, n, a = F.col("j").cast("double"), F.col("_n").cast("double"), F.col("j") * F.col("_s") / F.col("_n")
    m0, m1, m2, m3 = (F.col(m) for m in names)
    rest = F.when(n > j, n - j)
    parts = {"_d1": (a * m0 - m1) / rest, "_d2": (a * a * m0 - 2 * a * m1 + m2) / (rest * rest), "_d3": (a * a * a * m0 - 3 * a * a * m1 + 3 * a * m2 - m3) / (rest * rest * rest)}
    sums = both.groupBy(*keys, "_c").agg(F.max("_n").alias("_n"), F.max("_s").alias("_s"), *[F.sum(c).alias(k) for k, c in parts.items()], F.max((n <= j) & (F.round(m0) > 0)).alias("undefined"))
    for part in (universe, middle):
        sums = join_null_safe(sums, part, keys)
    u = F.col("_units").cast("double")
    e1, e2, e3 = (F.col(c) / u for c in parts)
    var, third = e2 - e1 * e1, -(e3 - 3 * e1 * e2 + 2 * e1 * e1 * e1)
    out = sums.select(
        *keys,
        F.col("_c").alias("cutoff"),
        F.col("_n").alias("n_retained"),
        (F.col("_s") / F.col("_n") + F.col("_mid")).alias("theta_hat"),
        F.when(~F.col("undefined") & (var > 1e-30), u * third / (6 * F.pow(u * var, F.lit(1.5)))).alias("accel"),
        "undefined",
        "_top",
        "_low",
    )
    real = out.filter(F.col("cutoff") < F.col("_top"))
    if missing == "drop":
        real = real.unionByName(out.filter(F.col("cutoff") == F.col("_low")).withColumn("cutoff", F.lit(None).cast("double")))
    return real.drop("_top", "_low")


def sweep_intervals(rows: DataFrame, keys: Sequence[str], score: str, missing: str, reps: int, seed: int, alpha: float = 0.05, n_bins: int = 5, unit: str = "unit", value: str = "abs_e", hasher: str = "xx") -> DataFrame:
    """The retained error at every cutoff with its interval, and the balanced error with its percentile interval.

    BCa where all replicates and all leave-one-out values are defined, else percentiles and the label says so; under 30 retained rows the
    label is degenerate. ``undefined_share`` is the share of replicates that retain nothing; ``balanced_undefined_share`` of those that leave a bin empty.
    """
    keys = list(keys)
    packed = packed_sweeps(rows, keys, score, missing, reps, seed, n_bins, unit, value, hasher)
    join = lambda c: F.array_sort(F.collect_list(F.struct("block", c))).alias(c)
    curves = packed.groupBy(*keys, "cutoff").agg(join("theta"), join("theta_balanced"))
    found = join_null_safe(curves, sweep_acceleration(rows, keys, score, missing, unit, value), [*keys, "cutoff"])
    result = "ci_lo double, ci_hi double, ci_method string, n_defined long, undefined_share double, balanced_lo double, balanced_hi double, balanced_undefined_share double"

    @F.pandas_udf(result)
    def solve(theta: pd.Series, balanced: pd.Series, point: pd.Series, accel: pd.Series, undefined: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for t, b, p, a, u, k in zip(theta, balanced, point, accel, undefined, n):
            t, b = (np.frombuffer(b"".join(part[c] for part in x)) for c, x in (("theta", t), ("theta_balanced", b)))
            some, whole = t[~np.isnan(t)], b[~np.isnan(b)]
            ends = lambda v: np.percentile(v, [100 * alpha / 2, 100 * (1 - alpha / 2)]).tolist() if v.size else [None, None]
            if some.size < t.size or u:
                lo, hi, method = *ends(some), FALLBACK
            else:
                lo, hi, method = bca(some, float(p), None if pd.isna(a) else float(a), alpha)
            out.append((lo, hi, method + (", degenerate: n < 30" if k < 30 else ""), some.size, 1 - some.size / t.size, *ends(whole), 1 - whole.size / b.size))
        return pd.DataFrame(out, columns=[c.split()[0] for c in result.split(", ")])

    solved = found.withColumn("_r", solve("theta", "theta_balanced", "theta_hat", "accel", "undefined", "n_retained"))
    return solved.select(*keys, "cutoff", "n_retained", "theta_hat", "accel", "_r.*")


def representative_cutoff(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cutoff retaining the share closest to one half; ties go to the higher cutoff."""
    real = sweep.filter(F.col("cutoff").isNotNull())
    order = F.struct(F.round(F.abs(F.col("retained_fraction") - 0.5), 9), -F.col("cutoff"))
    return real.groupBy(*keys).agg(
        F.min_by("cutoff", order).alias("cutoff"), F.min_by("retained_fraction", order).alias("retained_fraction")
    )


def before_and_after(rows: DataFrame, chosen: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Per-bin error before and after filtering at the chosen cutoff, over rows with a score."""
    both = join_bounded(rows.filter(F.col(score).isNotNull()), chosen.select(*keys, "cutoff"), keys)
    stay = F.col(score) >= F.col("cutoff")
    return both.groupBy(*keys, "bin").agg(
        F.count("*").alias("n_before"),
        F.avg("abs_e").alias("mae_before"),
        F.count_if(stay).alias("n_after"),
        F.avg(F.when(stay, F.col("abs_e"))).alias("mae_after"),
    )
