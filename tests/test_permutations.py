"""Keyed bijections and the tests that permute with them."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from evalpanel.functions import bijection as B
from evalpanel.operators import trend as T


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_every_replicate_permutes_the_places(n):
    moved = B.permuted(np.arange(n), n, B.all_step_keys(4, "x", 20))
    assert (np.sort(moved, axis=0) == np.arange(n)[:, None]).all()
    some = np.array([n - 1, 0])
    assert (B.permuted(some, n, B.all_step_keys(4, "x", 20)) == moved[some]).all()


@pytest.mark.parametrize("n", [3, 4, 5])
def test_small_permutations_are_equally_likely(n):
    seen = Counter(map(tuple, B.permuted(np.arange(n), n, B.all_step_keys(8, "x", 6000)).T))
    share = 6000 / math.factorial(n)
    chi = sum((seen[p] - share) ** 2 / share for p in itertools.permutations(range(n)))
    free = math.factorial(n) - 1
    assert chi < free + 4 * math.sqrt(2 * free)


def j_of(values, groups):
    return sum(
        (values[b] > values[a]) + 0.5 * (values[b] == values[a])
        for a, b in itertools.permutations(range(len(values)), 2)
        if groups[a] < groups[b]
    )


@pytest.mark.parametrize("hot", [False, True])
def test_statistics_of_replicates_equal_the_definition_at_any_partitioning(spark, hot):
    rng = np.random.default_rng(3)
    values = [0.25 if hot and i % 3 else float(v) for i, v in enumerate(rng.normal(size=90).round(1))]
    groups = [int(g) for g in rng.integers(0, 3, 90)]
    df = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(zip(values, groups))], "unit int, v double, g int")
    got = [
        {r["rep"]: r["j"] for r in T.permuted_statistics(df.repartition(parts), "unit", "v", "g", [0, 1, 2], 70, 5).collect()}
        for parts in (1, 7)
    ]
    assert got[0] == got[1] and sorted(got[0]) == list(range(1, 71))
    from evalpanel.operators.resample import unit_index

    place = {r["unit"]: r["idx"] for r in unit_index(df, "unit").collect()}
    edges = np.cumsum(np.bincount(groups))
    moved = B.permuted(np.array([place[i] for i in range(90)]), 90, B.all_step_keys(5, "trend", 70))
    for rep in (1, 35, 64, 65, 70):
        assert got[0][rep] == j_of(values, np.searchsorted(edges, moved[:, rep - 1], side="right"))


def test_permutation_p_is_that_of_all_arrangements(spark):
    values, groups = [1.0, 2.0, 2.0, 5.0, 4.0, 6.0], [0, 0, 1, 1, 2, 2]
    df = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(zip(values, groups))], "unit int, v double, g int")
    seen = abs(j_of(values, groups) - 6)
    every = [abs(j_of(values, list(p)) - 6) >= seen for p in set(itertools.permutations(groups))]
    got = T.permutation_trend(df, "unit", "v", "g", [0, 1, 2], 3000, 5, 0.05).collect()[0]
    assert got["p_perm"] == pytest.approx(np.mean(every), abs=0.02)


def test_permutation_without_units_or_with_strange_groups(spark):
    df = spark.createDataFrame([], "unit int, v double, g int")
    assert T.permuted_statistics(df, "unit", "v", "g", [0, 1], 9, 5).count() == 0
    df = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1), (3, 9.0, 7), (4, 9.0, None)], "unit int, v double, g int")
    assert {r["j"] for r in T.permuted_statistics(df, "unit", "v", "g", [0, 1], 40, 5).collect()} == {0.0, 1.0}


def test_block_sums_of_replicates_equal_moved_rows(spark):
    from evalpanel.operators import regress as L
    from evalpanel.operators.resample import unit_index

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"unit": range(120), "bin": rng.integers(0, 3, 120), "u": rng.integers(0, 2, 120) * 1.0, "w": rng.integers(0, 3, 120) * 1.0, "v": rng.normal(size=120)})
    pdf["y"] = 0.3 * pdf["v"] + rng.normal(size=120) + 0.2 * pdf["u"]
    df = spark.createDataFrame(pdf)
    one, many = (
        {r["rep"]: r["cross"] for r in L.permuted_cross_sums(df.repartition(parts), "unit", "bin", ["u", "w"], ["v", "y"], 66, 9).collect()} for parts in (1, 5)
    )
    assert sorted(one) == list(range(1, 67)) and all(one[r] == pytest.approx(many[r]) for r in one)
    place = {(r["bin"], r["unit"]): (r["idx"], r["n"]) for r in unit_index(df.select("bin", "unit"), "unit", ["bin"]).collect()}
    moved = {rep: pdf.copy() for rep in (1, 64, 65, 66)}
    for b, held in pdf.groupby("bin"):
        rows = held.sort_values(["u", "w"])[["u", "w"]].to_numpy()
        for rep, out in moved.items():
            idx = np.array([place[b, u][0] for u in held["unit"]])
            to = B.permuted(idx, len(held), B.step_keys(9, b, rep)[None])[:, 0]
            assert sorted(to) == list(range(len(held)))
            out.loc[held.index, ["u", "w"]] = rows[to]
    for rep, out in moved.items():
        assert one[rep] == pytest.approx((out[["v", "y"]].T.to_numpy() @ out[["u", "w"]].to_numpy()).ravel())
    test = L.block_permutation_test(df, ["u", "v", "w"], "y", ["u", "w"], "bin", 66, 9).collect()[0]

    def r2(frame, xs):
        a = np.column_stack([np.ones(120), frame[xs]])
        r = frame["y"] - a @ np.linalg.lstsq(a, frame["y"], rcond=None)[0]
        return 1 - (r**2).sum() / ((frame["y"] - frame["y"].mean()) ** 2).sum()

    assert test["delta_r2"] == pytest.approx(r2(pdf, ["u", "v", "w"]) - r2(pdf, ["v"]))
    stars = [r2(f, ["u", "v", "w"]) - r2(f, ["v"]) for f in (_moved(pdf, place, rep) for rep in range(1, 67))]
    assert test["p"] == pytest.approx((1 + sum(s >= test["delta_r2"] - 1e-12 for s in stars)) / 67)
    assert L.permuted_cross_sums(df, "unit", "bin", ["v"], ["y"], 3, 9, most=50) is None


def _moved(pdf, place, rep):
    out = pdf.copy()
    for b, held in pdf.groupby("bin"):
        idx = np.array([place[b, u][0] for u in held["unit"]])
        to = B.permuted(idx, len(held), B.step_keys(9, b, rep)[None])[:, 0]
        out.loc[held.index, ["u", "w"]] = held.sort_values(["u", "w"])[["u", "w"]].to_numpy()[to]
    return out


def test_split_draws_are_multinomial():
    from evalpanel.operators.resample import leaf_weights

    n, depth, reps = 1000, 2, 400
    parts = [leaf_weights(3, reps)("", n, depth, leaf) for leaf in range(4)]
    assert [low for low, _ in parts] == [0, 250, 500, 750]
    weights = np.concatenate([table for _, table in parts], axis=1)
    assert weights.shape == (reps, n) and (weights.sum(1) == n).all()
    # Counts of one place are binomial: mean 1, variance 1 - 1/n, and any two have covariance -1/n, so halves vary by n/4.
    assert np.var(weights) == pytest.approx(1 - 1 / n, rel=0.01)
    assert np.var(weights[:, :500].sum(1)) == pytest.approx(n / 4, rel=0.25)
    for k, share in enumerate([0.3677, 0.3681, 0.1840, 0.0613]):
        assert np.mean(weights == k) == pytest.approx(share, abs=0.003)
    # Other leaves first, or fewer replicates, and the numbers stay.
    find = leaf_weights(3, 50)
    assert all((find("", n, depth, leaf)[1] == parts[leaf][1][:50]).all() for leaf in (2, 0, 3, 1))
    assert (leaf_weights(3, reps)("other", n, depth, 0)[1] != parts[0][1]).any()


def test_split_sums_are_those_of_the_split_draws(spark):
    from pyspark.sql import functions as F

    from evalpanel.operators import resample as R

    rows = spark.range(700).select(F.col("id").alias("unit"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("bin"), (F.col("id") % 13).cast("double").alias("x"))
    stat = R.mean_of("x")
    for strata in ([], ["bin"]):
        index = R.unit_index(rows.select(*strata, "unit"), "unit", strata)
        w = R.draws(index.repartition(5), 4, 30, strata)
        want = {r["rep"]: r["t"] for r in w.join(rows.select("unit", "x"), "unit").groupBy("rep").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("t")).collect()}
        got = {r["rep"]: r["theta"] for r in R.replicates(rows.repartition(3), [], stat, 30, 4, "multinomial", strata).collect()}
        assert got == pytest.approx(want) and len(got) == 30
        sizes = {tuple(r) for r in rows.groupBy(*strata).count().collect()} if strata else {(700,)}
        assert {tuple(r) for r in w.groupBy(*strata, "rep").agg(F.sum("w").alias("s")).select(*strata, "s").distinct().collect()} == sizes
