"""Replicates of rank statistics by count matrices, and cutoff intervals, against weighted recomputation and refits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalpanel.operators import cutoffs as C
from evalpanel.operators import rank_replicates as RR
from evalpanel.operators import resample as B


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(31)
    pdf = pd.DataFrame(
        {
            "unit": np.repeat(np.arange(70), 3),
            "k": rng.choice(["p", "q", None], 210, p=[0.6, 0.3, 0.1]),
            "x": np.round(rng.normal(0, 2, 210) * 1e-3, 3),
            "z": np.round(rng.normal(0, 2, 210), 1),
            "y": np.round(rng.normal(0, 2, 210) + 1e6),
            "lab": rng.random(210) < 0.3,
            "bin": rng.integers(0, 3, 210),
            "abs_e": np.round(rng.random(210) * 20, 2),
            "conf": rng.choice([0.1, 0.4, 0.5, 0.9, np.nan], 210),
        }
    )
    df = spark.createDataFrame(pdf).withColumn("conf", F.nanvl("conf", F.lit(None).cast("double")))
    return df.cache(), pdf


def weights(spark, df, seed, reps):
    w = B.poisson_draws(df.select("unit").distinct(), seed, reps).select("unit", "rep", "w").toPandas()
    return {rep: dict(zip(g["unit"], g["w"])) for rep, g in w.groupby("rep")}


def repeated(sub, w):
    return sub.loc[sub.index.repeat([w.get(u, 0) for u in sub["unit"]])]


@pytest.mark.parametrize("most", [RR.MOST_CELLS, 0])
def test_spearman_and_auc_of_every_replicate(spark, rows, most):
    df, pdf = rows
    w = weights(spark, df, 5, 7)
    got = {(r["k"], r["rep"]): r for r in RR.spearman_replicates(df.repartition(5), ["k"], "x", "y", 7, 5, most_cells=most).collect()}
    area = {(r["k"], r["rep"]): r for r in RR.auc_replicates(df, ["k"], "x", "lab", 7, 5, most_cells=most).collect()}
    assert len(got) == len(area) == 21
    for (k, rep), r in got.items():
        sub = repeated(pdf[pdf["k"].isna() if k is None else pdf["k"] == k], w[rep])
        assert r["theta"] == pytest.approx(sub["x"].rank().corr(sub["y"].rank())) and r["n"] == len(sub)
        pos, neg = sub.loc[sub["lab"], "x"].to_numpy(), sub.loc[~sub["lab"], "x"].to_numpy()
        assert area[k, rep]["theta"] == pytest.approx(np.mean((neg[:, None] > pos) + 0.5 * (neg[:, None] == pos)))


def test_replicates_do_not_depend_on_blocks_or_partitions(spark, rows, monkeypatch):
    df, _ = rows
    key = lambda d: d.toPandas().sort_values(["k", "rep"], na_position="first").reset_index(drop=True)
    one = key(RR.spearman_replicates(df.repartition(1), ["k"], "x", "y", 40, 9))
    monkeypatch.setattr(RR, "HELD", 1)  # the narrowest blocks
    many = key(RR.spearman_replicates(df.repartition(9), ["k"], "x", "y", 40, 9))
    pd.testing.assert_frame_equal(one, many)


def test_one_level_one_class_and_difference(spark, rows):
    df, pdf = rows
    flat = RR.spearman_replicates(df.withColumn("x", F.lit(1.0)), ["k"], "x", "y", 3, 1).collect()
    assert len(flat) == 9 and all(r["theta"] is None for r in flat)
    assert all(r["theta"] is None for r in RR.auc_replicates(df.filter("lab"), ["k"], "x", "lab", 3, 1).collect())
    w = weights(spark, df, 6, 4)
    for r in RR.spearman_difference_replicates(df.filter("k = 'p'"), ["k"], "x", "z", "y", 4, 6).collect():
        sub = repeated(pdf[pdf["k"] == "p"], w[r["rep"]]).rank(numeric_only=True)
        assert r["theta"] == pytest.approx(sub["x"].corr(sub["y"]) - sub["z"].corr(sub["y"]))
    assert RR.spearman_replicates(df.limit(0), ["k"], "x", "y", 3, 1).count() == 0


@pytest.mark.parametrize("missing", ["drop", "keep"])
def test_cutoff_jackknife_and_curves(spark, rows, missing):
    """Units have several rows at several levels, so a unit leaves different numbers of rows at different cutoffs."""
    df, pdf = rows
    acc = {(r["k"], r["cutoff"]): r for r in C.sweep_acceleration(df, ["k"], "conf", missing).collect()}
    assert len(acc) == 3 * (5 if missing == "drop" else 4)
    full = {(r["k"], r["cutoff"]): r for r in C.sweep_intervals(df, ["k"], "conf", missing, 60, 8, n_bins=3).collect()}
    assert set(full) == set(acc)
    w = weights(spark, df, 8, 60)
    for (k, cut), r in acc.items():
        sub = pdf[pdf["k"].isna() if k is None else pdf["k"] == k]
        stay = sub[(sub["conf"] >= (-1 if cut is None else cut)) | (sub["conf"].isna() if missing == "keep" else False)]
        outs = np.array([stay.loc[stay["unit"] != u, "abs_e"].mean() for u in sub["unit"].unique()])
        d = outs.mean() - outs
        assert r["n_retained"] == len(stay) and r["theta_hat"] == pytest.approx(stay["abs_e"].mean())
        assert r["accel"] == pytest.approx((d**3).sum() / (6 * (d**2).sum() ** 1.5))
        draws = [repeated(stay, w[rep]) for rep in range(1, 61)]
        means = np.array([x["abs_e"].mean() for x in draws])
        balanced = np.array([x.groupby("bin")["abs_e"].mean().mean() if x["bin"].nunique() == 3 else np.nan for x in draws])
        f = full[k, cut]
        assert f["n_defined"] == np.isfinite(means).sum() and f["balanced_undefined_share"] == pytest.approx(np.isnan(balanced).mean())
        assert f["balanced_lo"] == pytest.approx(np.nanpercentile(balanced, 2.5))
        assert ("degenerate" in f["ci_method"]) == (len(stay) < 30)
        if f["ci_method"].startswith("percentile"):
            assert f["ci_lo"] == pytest.approx(np.nanpercentile(means, 2.5))


def test_a_cutoff_that_one_unit_reaches(spark):
    df = spark.createDataFrame([(u, "a", 0.1 * (u < 9) + 0.9 * (u == 9), float(u), 0) for u in range(10)], "unit int, k string, conf double, abs_e double, bin int")
    got = {r["cutoff"]: r for r in C.sweep_acceleration(df, ["k"], "conf", "drop").collect()}
    assert got[0.9]["undefined"] and got[0.9]["accel"] is None and not got[0.1]["undefined"]
    last = [r for r in C.sweep_intervals(df, ["k"], "conf", "drop", 80, 2, n_bins=1).collect() if r["cutoff"] == 0.9][0]
    assert last["ci_method"] == "percentile (BCa fallback), degenerate: n < 30" and last["undefined_share"] > 0


def test_a_block_gets_one_row_per_cell_whatever_the_number_of_tasks(spark, rows):
    df, pdf = rows
    given = df.repartition(7).select("k", "x", "y", "unit", "abs_e")
    got = RR.replicate_counts(given, ["k"], ["x", "y"], 12, 5, 4, measure="abs_e").toPandas()
    assert len(got) == 3 * len(pdf[["k", "x", "y"]].drop_duplicates())
    w = weights(spark, df, 4, 12)
    assert sum(np.frombuffer(x, "<i8").sum() for x in got["counts"]) == sum(w[r].get(u, 0) for u in pdf["unit"] for r in range(1, 13))
