"""Linear models from cross-product sums.

The data are read once into X'X and X'y per key (per replicate, per level); what is left to solve is a
p x p system per key, with p the number of design columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.bijection import all_step_keys, permuted, step_keys
from evalpanel.functions.levels import attach_totals, spread
from evalpanel.operators.resample import unit_index
from evalpanel.session import cut_lineage


def design_with_constant(xs: Sequence[str]) -> list[str]:
    return ["const", *xs]


def cross_products(df: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per key: the upper triangle of [1, X, y]'W[1, X, y] as one array, and the row weight n.

    NULL indicator columns count as 0, so a level missing from a subset leaves a zero column.
    """
    cols = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in xs], F.col(y).cast("double")]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = [F.sum(w * cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(F.array(*sums).alias("gram"), F.sum(w).alias("n"))


def _square(gram: Sequence[float], size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = gram
    return m + np.triu(m, 1).T


def _solve(m: np.ndarray, keep: Sequence[int]) -> tuple[np.ndarray, float]:
    """Coefficients (least norm if a column is aliased) and R2 for the design columns ``keep``."""
    xx, xy = m[np.ix_(keep, keep)], m[keep, -1]
    beta = np.linalg.pinv(xx, hermitian=True, rcond=1e-12) @ xy
    centred = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    residual = m[-1, -1] - beta @ xy
    return beta, float(1 - residual / centred) if centred > 0 else float("nan")


def fit(products: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: coefficient array in the order [const, *xs], and R2."""
    size = len(xs) + 2
    schema = T.StructType([T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("r2", T.DoubleType())])

    @F.pandas_udf(schema)
    def solve(gram: pd.Series) -> pd.DataFrame:
        out = [_solve(_square(g, size), list(range(size - 1))) for g in gram]
        return pd.DataFrame({"coef": [list(map(float, b)) for b, _ in out], "r2": [r for _, r in out]})

    return products.withColumn("_f", solve("gram")).select(*keys, "n", "_f.coef", "_f.r2")


def coefficients(fitted: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per key and term."""
    names = F.array(*[F.lit(n) for n in design_with_constant(xs)])
    return fitted.select(*keys, F.explode(F.arrays_zip(names.alias("term"), F.col("coef").alias("coef"))).alias("_z")).select(
        *keys, F.col("_z")["term"].alias("term"), F.col("_z")["coef"].alias("coef")
    )


def delta_r2(products: DataFrame, xs: Sequence[str], block: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """R2 of the full design minus R2 without the block, from the same sums."""
    size = len(xs) + 2
    full = list(range(size - 1))
    base = [0] + [i + 1 for i, x in enumerate(xs) if x not in set(block)]

    @F.pandas_udf(T.DoubleType())
    def gain(gram: pd.Series) -> pd.Series:
        squares = [_square(g, size) for g in gram]
        return pd.Series([_solve(m, full)[1] - _solve(m, base)[1] for m in squares], dtype="float64")

    return products.select(*keys, gain("gram").alias("delta_r2"))


def variance_inflation(products: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Diagonal of the inverse correlation matrix of the design columns; NULL for a constant column."""
    size = len(xs) + 2

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def inflate(gram: pd.Series) -> pd.Series:
        out = []
        for g in gram:
            m = _square(g, size)
            mean = m[0, 1:-1] / m[0, 0]
            cov = m[1:-1, 1:-1] / m[0, 0] - np.outer(mean, mean)
            sd = np.sqrt(np.clip(np.diag(cov), 0, None))
            live = np.flatnonzero(sd > 1e-12)
            row = [None] * len(xs)
            if live.size:
                corr = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
                if np.linalg.matrix_rank(corr, tol=1e-9) < live.size:
                    values = np.full(live.size, np.inf)
                else:
                    values = np.diag(np.linalg.inv(corr))
                for i, v in zip(live, values):
                    row[i] = float(v)
            out.append(row)
        return pd.Series(out)

    names = F.array(*[F.lit(x) for x in xs])
    long = products.withColumn("_v", inflate("gram")).select(*keys, F.explode(F.arrays_zip(names.alias("term"), F.col("_v").alias("vif"))).alias("_z"))
    return long.select(*keys, F.col("_z")["term"].alias("term"), F.col("_z")["vif"].alias("vif"))


def block_flags(vifs: DataFrame, blocks: dict[str, Sequence[str]], limit: float = 10.0) -> DataFrame:
    name = F.lit(None).cast("string")
    for block, cols in blocks.items():
        name = F.when(F.col("term").isin(list(cols)), F.lit(block)).otherwise(name)
    return vifs.groupBy(name.alias("block")).agg(
        F.max("vif").alias("max_vif"), (F.max("vif") > limit).alias("not_separately_identified")
    )


def design_rank(products: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rank of the design with constant, from scaled X'X; ``aliased`` columns add nothing."""
    size = len(xs) + 2

    @F.pandas_udf(T.IntegerType())
    def rank(gram: pd.Series) -> pd.Series:
        out = []
        for g in gram:
            m = _square(g, size)[:-1, :-1]
            s = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
            out.append(int(np.linalg.matrix_rank(m / np.outer(s, s), tol=1e-9)))
        return pd.Series(out, dtype="int32")

    return products.select(*keys, rank("gram").alias("rank")).withColumns(
        {"columns": F.lit(size - 1), "aliased": F.lit(size - 1) - F.col("rank")}
    )


def forbidden_columns(columns: Sequence[str], alone: str, others: Sequence[str]) -> bool:
    """Is an aliased covariate in a design together with one of its parents?"""
    return any(c.startswith(alone) for c in columns) and any(c.startswith(tuple(others)) for c in columns)


def identical_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias("identical"), F.count("*").alias("n"))


#: Distinct block rows, summed over strata, up to which they are held in every task; replicates handled at a time, and rows x replicates.
MOST_BLOCK_ROWS, BLOCK, STEP = 100_000, 64, 1 << 19


def _named(stratum: str) -> Column:
    return F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum")


def permuted_block(units: DataFrame, unit: str, stratum: str, block: Sequence[str], reps: int, seed: int, hasher: str = "xx") -> DataFrame:
    """(rep, unit, block): per replicate, the block's rows moved among the units of a stratum.

    A keyed bijection of a stratum's dense places names the unit from which a unit receives; nothing is sorted per replicate.
    """
    placed = cut_lineage(unit_index(units.select(_named(stratum), unit, *block), unit, ["_stratum"], hasher, carry=block))
    schema = T.StructType([placed.schema["_stratum"], placed.schema[unit], T.StructField("rep", T.IntegerType()), T.StructField("idx", T.LongType())])

    def name_donors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, held in batch.groupby("_stratum", sort=False):
                for first in range(1, reps + 1, BLOCK):
                    turns = range(first, min(first + BLOCK, reps + 1))
                    some = np.array([step_keys(seed, name, rep) for rep in turns])
                    places = permuted(held["idx"].to_numpy(np.int64), int(held["n"].iloc[0]), some)
                    whole = held.loc[held.index.repeat(len(turns)), ["_stratum", unit]]
                    yield whole.assign(rep=np.tile(np.array(turns, dtype=np.int32), len(held)), idx=places.ravel())

    receivers = spread(placed.select("_stratum", unit, "idx", "n"), unit).mapInPandas(name_donors, schema)
    return receivers.join(placed.select("_stratum", "idx", *block), ["_stratum", "idx"]).select("rep", unit, *block)


def permuted_cross_sums(units: DataFrame, unit: str, stratum: str, block: Sequence[str], others: Sequence[str], reps: int, seed: int, hasher: str = "xx", most: int = MOST_BLOCK_ROWS) -> DataFrame | None:
    """(rep, cross): sums of others x block after moving the block's rows within strata, without a row per unit and replicate.

    Places of a stratum are dealt to its distinct block rows in ascending order, as many to each as it has units, so a unit's place under
    the bijection tells the row it receives. The distinct rows (combinations of indicators, as a rule) are held in every task;
    None if there are more than ``most``. NULL counts as 0.
    """
    block, others = list(block), list(others)
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*block, *others]]
    placed = cut_lineage(unit_index(units.select(_named(stratum), unit, *zero), unit, ["_stratum"], hasher, carry=[*block, *others]))
    levels = placed.groupBy("_stratum", *block).agg(F.count("*").alias("_n"))
    found = levels.limit(most + 1).toPandas()
    if len(found) > most:
        return None
    dealt = {name: (np.cumsum(held["_n"]), held[block].to_numpy(float)) for name, held in found.sort_values(["_stratum", *block]).groupby("_stratum")}
    schema = T.StructType([T.StructField("rep", T.IntegerType()), T.StructField("cross", T.ArrayType(T.DoubleType()))])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((reps, len(others), len(block)))
        last, keys = None, None
        for batch in batches:
            for name, held in batch.groupby("_stratum", sort=False):
                if name != last:
                    last, keys = name, all_step_keys(seed, name, reps)
                ends, rows = dealt[name]
                for at in range(0, len(held), STEP // BLOCK):
                    part = held.iloc[at : at + STEP // BLOCK]
                    values = part[others].to_numpy(float).T
                    for first in range(0, reps, BLOCK):
                        places = permuted(part["idx"].to_numpy(np.int64), int(part["n"].iloc[0]), keys[first : first + BLOCK])
                        got = np.searchsorted(ends, places, side="right")
                        for c in range(len(block)):
                            sums[first : first + BLOCK, :, c] += (values @ rows[got, c]).T
        yield pd.DataFrame({"rep": np.arange(1, reps + 1, dtype=np.int32), "cross": list(sums.reshape(reps, -1))})

    parts = spread(placed.select("_stratum", unit, "idx", "n", *others), unit).sortWithinPartitions("_stratum").mapInPandas(add_up, schema)
    size = len(others) * len(block)
    return parts.groupBy("rep").agg(F.array(*[F.sum(F.col("cross")[i]) for i in range(size)]).alias("cross"))


def block_permutation_test(
    units: DataFrame, xs: Sequence[str], y: str, block: Sequence[str], stratum: str, reps: int, seed: int, unit: str = "unit", hasher: str = "xx"
) -> DataFrame:
    """Gain in R2 of a block, with p = (1 + #{gain* >= gain}) / (reps + 1) under moves within strata.

    Moving the block leaves all sums but those of block x others as they are, so a replicate is that part of the cross-products.
    Blocks with very many distinct rows are joined to their receivers instead.
    """
    products = cross_products(units, xs, y)
    seen = delta_r2(products, xs, block)
    rest = [x for x in xs if x not in set(block)]
    cross = permuted_cross_sums(units.withColumn("_one", F.lit(1.0)), unit, stratum, block, ["_one", *rest, y], reps, seed, hasher)
    if cross is None:
        moved = permuted_block(units, unit, stratum, block, reps, seed, hasher).join(units.select(unit, y, *rest), unit)
        stars = delta_r2(cross_products(moved, xs, y, ["rep"]), xs, block, ["rep"]).withColumnRenamed("delta_r2", "_star")
    else:
        size = len(xs) + 2
        moving = [xs.index(x) + 1 for x in block]
        staying = [0, *[xs.index(x) + 1 for x in rest], size - 1]

        @F.pandas_udf(T.DoubleType())
        def gain(gram: pd.Series, crossed: pd.Series) -> pd.Series:
            out = []
            for g, c in zip(gram, crossed):
                m = _square(g, size)
                m[np.ix_(staying, moving)] = np.reshape(c, (len(staying), len(moving)))
                m[np.ix_(moving, staying)] = m[np.ix_(staying, moving)].T
                out.append(_solve(m, list(range(size - 1)))[1] - _solve(m, staying[:-1])[1])
            return pd.Series(out, dtype="float64")

        stars = attach_totals(cross, products.select("gram")).select("rep", gain("gram", "cross").alias("_star"))
    both = attach_totals(stars, seen)
    return both.agg(
        F.max("delta_r2").alias("delta_r2"),
        # A replicate that deals the block as it was seen counts, whatever the rounding of its sums.
        ((1 + F.count_if(F.col("_star") >= F.col("delta_r2") - 1e-12)) / (F.count("*") + 1)).alias("p"),
    )


def median_regression(df: DataFrame, xs: Sequence[str], y: str, rounds: int = 150, tol: float = 1e-9) -> dict[str, float]:
    """Least absolute deviations by reweighted least squares with a line search; ``objective`` is the mean |residual|.

    A round is two passes over the written design: weighted sums, which give a direction, and the objective at several
    step lengths along it. Weights are cut off at a residual that shrinks with the rounds. It ends when the cut-off is
    negligible and three rounds together gain less than ``tol`` of the objective, and raises if ``rounds`` pass before.
    """
    names = design_with_constant(xs)
    data = cut_lineage(spread(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in xs], F.col(y).cast("double").alias(y))))
    size = len(xs) + 2
    spark = df.sparkSession
    cols = F.array(F.lit(1.0), *[F.col(x) for x in xs])
    along = lambda name: F.aggregate(F.zip_with(cols, F.col(name), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    steps = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 9.0, 17.0]

    def weighted_fit(beta: np.ndarray | None, cut: float) -> np.ndarray:
        if beta is None:
            weighted = data.withColumn("_w", F.lit(1.0))
        else:
            # Coefficients travel as a one-row table, so every round runs the same generated code.
            row = spark.createDataFrame([(list(map(float, beta)), cut)], "_beta array<double>, _cut double")
            weighted = attach_totals(data, row).withColumn("_w", 1 / F.greatest(F.abs(F.col(y) - along("_beta")), F.col("_cut")))
        gram = cross_products(weighted, xs, y, weight="_w").collect()[0]["gram"]
        return _solve(_square(gram, size), list(range(size - 1)))[0]

    def objectives(beta: np.ndarray, toward: np.ndarray) -> list[float]:
        row = spark.createDataFrame([(list(map(float, beta)), list(map(float, toward)))], "_beta array<double>, _to array<double>")
        both = attach_totals(data, row).select((F.col(y) - along("_beta")).alias("r"), along("_to").alias("s"))
        return list(both.agg(*[F.avg(F.abs(F.col("r") - t * F.col("s"))) for t in steps]).first())

    beta = weighted_fit(None, 1.0)
    scale = objectives(beta, beta * 0)[0]
    cut, past = scale, [scale]
    for _ in range(rounds):
        cut = max(cut / 6, scale * 1e-9)
        toward = weighted_fit(beta, cut) - beta
        found = objectives(beta, toward)
        best = int(np.argmin(found))
        beta = beta + steps[best] * toward
        past.append(found[best])
        if scale == 0 or (cut <= scale * 1e-9 and len(past) > 3 and past[-4] - past[-1] <= tol * past[-1]):
            return dict(zip(names, map(float, beta))) | {"objective": past[-1]}
    raise ArithmeticError(f"median regression: no convergence in {rounds} rounds; objective {past[-1]}, at first {past[0]}")


def design(units: DataFrame, z: str, bins: int = 5, ordinals: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Bin indicators, ordinal indicators (level 0 left out) and one standardised covariate."""
    one = units.agg(F.avg(z).alias("_m"), F.stddev_samp(z).alias("_s"))
    wide = attach_totals(units, one).withColumn(f"{z}_z", (F.col(z) - F.col("_m")) / F.col("_s")).drop("_m", "_s")
    cols = {f"bin_{i}": (F.col("bin") == i).cast("double") for i in range(1, bins)}
    for o in ordinals:
        cols |= {f"{o}_{lvl}": (F.col(o) == lvl).cast("double") for lvl in (1, 2)}
    return wide.withColumns(cols), [*cols, f"{z}_z"]


def linearity_check(units: DataFrame, base: Sequence[str], continuous: str, quartile: str, y: str) -> DataFrame:
    """R2 with the continuous covariate against R2 with its quartile indicators."""
    wide = units.withColumns({f"_q{i}": (F.col(quartile) == i).cast("double") for i in (1, 2, 3)})
    a_cols, b_cols = [*base, continuous], [*base, "_q1", "_q2", "_q3"]
    a = fit(cross_products(wide, a_cols, y), a_cols).select(F.col("r2").alias("r2_continuous"))
    b = fit(cross_products(wide, b_cols, y), b_cols).select(F.col("r2").alias("r2_quartiles"))
    return attach_totals(a, b).withColumn("delta", F.col("r2_quartiles") - F.col("r2_continuous"))


def level_table_of(rows: DataFrame, scopes: Sequence[str], level: str) -> DataFrame:
    """Scope x level means: pooled over all rows, and inside each scope column's values."""
    parts = [rows.groupBy(F.lit("pooled").alias("scope"), level).agg(F.count("*").alias("n"), F.avg("abs_e").alias("mae"), F.avg("e").alias("bias"))]
    for s in scopes:
        parts.append(rows.groupBy(F.col(s).alias("scope"), level).agg(F.count("*").alias("n"), F.avg("abs_e").alias("mae"), F.avg("e").alias("bias")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
