"""Level tables: the shared base of every rank statistic.

Rows are first compressed to one row per (keys, value) with summed measures, which combines map-side,
so a value held by a third of all rows is one row afterwards. Running sums are then taken in two
steps: inside (keys, value bucket), and over the few bucket totals of a key. No task ever sees all
rows of one key, although the keys of a panel (raters, conditions, pairs) are few and hot.
The buckets end at quantiles of the levels themselves, so they are even whatever the scale or skew.
"""

from __future__ import annotations

from typing import Literal, Mapping, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

Grain = Union[float, None, Literal["auto"]]


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partition into the session's number of shuffle partitions, kept as it is.

    For small tables whose rows are about to be multiplied: adaptive execution would pack them into few
    tasks by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def level_table(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys, value).agg(*[F.sum(m).alias(n) for n, m in measures.items()])


def adaptive_cuts(df: DataFrame, value: str, cuts: int | None = None, points: bool = False) -> DataFrame:
    """Add ``_cut``: which of ``cuts`` intervals of the value axis, each with about as many rows, holds the row.

    The ends are quantiles from a mergeable sketch of all rows, one short array; a row finds its interval by halving.
    Equal values share an interval, so (key, cut) groups of a level table never hold more than a cut's share of its rows.
    The default is one interval per shuffle partition. NULL falls into the first interval.
    With ``points`` also ``_share``: for a value that is itself an end, how many ends it is, so about its share of the rows in intervals;
    0 for any other value.
    """
    cuts = cuts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = F.hash(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])
    ends = F.percentile_approx(value, [i / cuts for i in range(1, cuts)], max(10_000, 20 * cuts))
    # The hash asks for all columns, so that this branch reads the same shuffled table as the rows themselves.
    points = df.agg(F.when(F.max(every).isNotNull(), ends).alias("_ends"))
    out, step = attach_totals(df, points).withColumn("_cut", F.lit(0)), 1 << (cuts - 1).bit_length()
    while step:
        further = F.col("_cut") + F.lit(step)
        out = out.withColumn("_cut", F.when(F.get("_ends", further - 1) <= F.col(value), further).otherwise(F.col("_cut")))
        step //= 2
    if points:
        at_end = F.coalesce(F.get("_ends", F.col("_cut") - 1) == F.col(value), F.lit(False))
        out = out.withColumn("_share", F.when(at_end, F.col("_cut") - F.array_position("_ends", F.col(value)).cast("int") + 1).otherwise(0))
    return out.drop("_ends")


def running(
    levels: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    grain: Grain = "auto",
) -> DataFrame:
    """Add ``below_<m>`` (sum over smaller values of the key) and ``all_<m>`` (sum over the key).

    ``grain`` "auto" takes ``adaptive_cuts``. A number is the bucket width for values known to be spread evenly (such
    as hashes): any width is correct, it only sets how finely a key is spread over tasks. ``None`` is for keys known
    to hold few levels.
    """
    keys = list(keys)
    if grain is None:
        w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        full = W.partitionBy(*keys)
        return levels.withColumns(
            {f"below_{m}": F.coalesce(F.sum(m).over(w), F.sum(m).over(full) * 0) for m in measures}
            | {f"all_{m}": F.sum(m).over(full) for m in measures}
        )
    # One struct stands for the keys: it equals itself with NULL fields, so windows and join agree on
    # one hash partitioning and the level table is shuffled once.
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    if grain == "auto":
        cut = adaptive_cuts(levels, value).withColumn("_key", group)
    else:
        cut = levels.withColumns({"_key": group, "_cut": F.floor(F.col(value) / F.lit(float(grain)))})
    totals = cut.groupBy("_key", "_cut").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    over_cuts = W.partitionBy("_key").orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("_key")
    offsets = totals.select(
        "_key",
        "_cut",
        *[F.coalesce(F.sum(f"_t_{m}").over(over_cuts), F.col(f"_t_{m}") * 0).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = W.partitionBy("_key", "_cut").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    part = cut.withColumns({f"_i_{m}": F.coalesce(F.sum(m).over(inside), F.col(m) * 0) for m in measures})
    joined = part.join(offsets, ["_key", "_cut"])
    out = joined.withColumns({f"below_{m}": F.col(f"_o_{m}") + F.col(f"_i_{m}") for m in measures})
    return out.drop("_key", "_cut", *[f"_o_{m}" for m in measures], *[f"_i_{m}" for m in measures])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps NULL keys together and leaves one copy of the key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_bounded(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach an aggregate (a row per key) to many rows.

    A plain equi-join: adaptive execution broadcasts the aggregate if it turns out small, and splits hot keys otherwise.
    """
    return join_null_safe(left, right, keys) if keys else attach_totals(left, right)


def mid_rank(count: str = "n") -> Column:
    """Average rank of a level, from ``running`` over ``count``."""
    return F.col(f"below_{count}") + (F.col(count) + F.lit(1.0)) / F.lit(2.0)


def attach_totals(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate to every row.

    The right side comes from an aggregate without grouping, so it has exactly one row at any scale.
    """
    return df.join(F.broadcast(one_row))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    grain: Grain = "auto",
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, read from running counts over the level table."""
    return quantiles_of(level_table(df.filter(F.col(value).isNotNull()), keys, value, {"n": F.lit(1)}), keys, value, points, grain)


def quantiles_of(levels: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], grain: Grain = "auto") -> DataFrame:
    """The quantiles of a level table with counts ``n``."""
    pos = running(levels, keys, value, ["n"], grain)
    first, last = F.col("below_n"), F.col("below_n") + F.col("n") - F.lit(1)
    aggs = []
    for name, p in points.items():
        h = (F.col("all_n") - F.lit(1)) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.ceil(h)
        aggs += [
            F.max(F.when((first <= lo) & (lo <= last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi <= last), F.col(value))).alias(f"_hi_{name}"),
            F.max(h - lo).alias(f"_f_{name}"),
        ]
    got = pos.groupBy(*keys).agg(*aggs)
    return got.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in points
        ],
    )
