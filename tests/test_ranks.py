import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalpanel.operators import cutoffs as C
from evalpanel.operators import ranks as R
from evalpanel.operators import trend as T


def mid(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    n = 90
    pdf = pd.DataFrame(
        {
            "unit": np.arange(n),
            "k": np.where(np.arange(n) % 3 == 0, "a", "b"),
            "x": np.round(rng.normal(0, 3, n), 0),
            "y": np.round(rng.normal(0, 3, n), 1),
            "g": rng.integers(0, 4, n),
            "lab": rng.random(n) < 0.4,
        }
    )
    return spark.createDataFrame(pdf).cache(), pdf


def test_spearman_and_weighted_spearman(spark, data):
    df, pdf = data
    for r in R.spearman(df, ["k"], "x", "y").collect():
        sub = pdf[pdf["k"] == r["k"]]
        assert r["rho"] == pytest.approx(np.corrcoef(mid(sub["x"]), mid(sub["y"]))[0, 1])
    w = df.withColumn("w", F.col("unit") % 3)
    r = R.spearman(w, [], "x", "y", "w").collect()[0]
    rep = pdf.loc[pdf.index.repeat(pdf["unit"] % 3)]
    assert r["rho"] == pytest.approx(np.corrcoef(mid(rep["x"]), mid(rep["y"]))[0, 1])


def test_auc_by_all_pairs_with_weights_and_one_class(spark, data):
    df, pdf = data
    r = R.auc(df, [], "x", "lab").collect()[0]
    pos, neg = pdf.loc[pdf["lab"], "x"].to_numpy(), pdf.loc[~pdf["lab"], "x"].to_numpy()
    want = np.mean((neg[:, None] > pos[None, :]) + 0.5 * (neg[:, None] == pos[None, :]))
    assert r["auc"] == pytest.approx(want) and r["n_tied_pairs"] == (neg[:, None] == pos[None, :]).sum()
    assert R.auc(df.filter("lab"), [], "x", "lab").collect()[0]["auc"] is None


def test_roc_denominators(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (None, True), (2.0, True)], "s double, lab boolean")
    drop = {r["level"]: (r["tpr"], r["fpr"]) for r in R.roc_points(df, [], "s", "lab", "drop").collect()}
    keep = {r["level"]: (r["tpr"], r["fpr"]) for r in R.roc_points(df, [], "s", "lab", "keep").collect()}
    assert drop == {1.0: (0.5, 0.0), 2.0: (1.0, 1.0)}
    assert keep[2.0] == pytest.approx((2 / 3, 1.0))


def test_kendall_and_reversals(spark):
    rows = [("p", 1.0, 2.0), ("q", 2.0, 1.0), ("r", 3.0, 3.0), ("s", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "item string, x double, y double")
    tau = R.kendall_tau_b(df, [], "item", "x", "y").collect()[0]
    s = [np.sign(a[1] - b[1]) * np.sign(a[2] - b[2]) for a, b in itertools.combinations(rows, 2)]
    assert tau["tau_b"] == pytest.approx(sum(s) / math.sqrt(5 * 6))
    rev = R.rank_reversals(df, "item", "x", "y").filter("reversed").collect()
    assert [(r["a"], r["b"]) for r in rev] == [("p", "q")]
    iv = spark.createDataFrame([("p", "q", -2.0, -0.5)], "a string, b string, ci_lo double, ci_hi double")
    assert R.mark_real(R.rank_reversals(df, "item", "x", "y"), iv).filter("real").count() == 1


def test_pair_percentage_along_covariate_by_enumeration(spark, data):
    df, pdf = data
    got = R.pair_percentage_along(df, [], "y", "g", [0, 1, 2, 3]).collect()[0]
    n = hit = 0.0
    for i, j in itertools.permutations(range(len(pdf)), 2):
        if pdf["y"][i] < pdf["y"][j]:
            n += 1
            hit += (pdf["g"][j] < pdf["g"][i]) + 0.5 * (pdf["g"][j] == pdf["g"][i])
    assert got["n_pairs"] == n and got["pct_lower"] == pytest.approx(100 * hit / n)


def test_trend_statistic_and_exact_variance(spark):
    values, groups = [1.0, 1.0, 2.0, 3.0, 3.0, 3.0], [0, 1, 0, 2, 1, 2]
    df = spark.createDataFrame(list(zip(values, groups)), "v double, g int")
    r = T.trend(df, [], "v", "g", [0, 1, 2]).collect()[0]

    def j_of(gs):
        return sum((b > a) + 0.5 * (b == a) for (a, x), (b, y) in itertools.permutations(list(zip(values, gs)), 2) if x < y)

    every = [j_of(p) for p in itertools.permutations(groups)]
    assert r["j"] == j_of(groups) and r["mean_j"] == pytest.approx(np.mean(every)) and r["var_j"] == pytest.approx(np.var(every))
    assert r["j_bar"] == pytest.approx(2 * (r["j"] - r["mean_j"]) / 12)


def test_trend_refuses_or_reports_missing_values(spark):
    df = spark.createDataFrame([(1.0, 0), (float("nan"), 1), (3.0, 1)], "v double, g int")
    with pytest.raises(Exception, match="non-finite"):
        T.trend(df, [], "v", "g", [0, 1]).collect()
    r = T.trend(df, [], "v", "g", [0, 1], drop_missing=True).collect()[0]
    assert r["n_dropped"] == 1 and r["j"] == 1.0


def test_permutation_keeps_sizes_and_finds_a_strong_trend(spark):
    rows = [(i, float(i // 10) + 0.01 * (i % 7), i // 10) for i in range(50)]
    df = spark.createDataFrame(rows, "unit int, v double, g int")
    moved = T.permuted_groups(df, "unit", "v", "g", [0, 1, 2, 3, 4], 8, 5).toPandas()
    assert (moved.groupby(["rep", "g"]).size() == 10).all()
    assert moved.sort_values("unit").groupby("rep")["g"].apply(tuple).nunique() == 8
    r = T.permutation_trend(df, "unit", "v", "g", [0, 1, 2, 3, 4], 99, 5, 0.05).collect()[0]
    assert r["p_perm"] == pytest.approx(0.01) and r["at_floor"] and r["direction"] == "increasing"


def test_group_tests_against_definitions(spark, data):
    df, pdf = data
    kw = R.kruskal_wallis(df, [], "x", "g").collect()[0]
    r, n = mid(pdf["x"]), len(pdf)
    _, t = np.unique(pdf["x"], return_counts=True)
    h = 12 / (n * (n + 1)) * sum(r[pdf["g"] == g].sum() ** 2 / (pdf["g"] == g).sum() for g in range(4)) - 3 * (n + 1)
    assert kw["h"] == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)))
    mw = R.mann_whitney(df.withColumn("lab", F.col("lab").cast("string")), [], "x", "lab", "true", "false").collect()[0]
    a, b = pdf.loc[pdf["lab"], "x"].to_numpy(), pdf.loc[~pdf["lab"], "x"].to_numpy()
    assert mw["u"] == ((a[:, None] > b) + 0.5 * (a[:, None] == b)).sum()


def test_normality_of_a_known_sample(spark):
    v = np.concatenate([np.linspace(-2, 2, 40), [5.0, 6.0]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    r = R.normality(df, [], "v").collect()[0]
    assert r["p"] == pytest.approx(math.exp(-r["k2"] / 2)) and 0 < r["p"] < 1
    flat = R.normality(spark.createDataFrame([(float(x),) for x in range(1, 31)], "v double"), [], "v").collect()[0]
    assert flat["skew"] == pytest.approx(0, abs=1e-12)


def test_cutoff_sweep_by_brute_force(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"k": "a", "conf": rng.choice([0.2, 0.5, 0.9, np.nan], 80), "bin": rng.integers(0, 5, 80), "abs_e": rng.random(80)})
    df = spark.createDataFrame(pdf).withColumn("conf", F.nanvl("conf", F.lit(None).cast("double")))
    for missing in ("keep", "drop"):
        got = {r["cutoff"]: r for r in C.cutoff_sweep(df, ["k"], "conf", missing).collect()}
        assert set(got) == ({0.2, 0.5, 0.9} | ({None} if missing == "drop" else set()))
        for cut, r in got.items():
            keep = pdf["conf"] >= (cut or 0)
            if missing == "keep":
                keep |= pdf["conf"].isna()
            sub = pdf[keep]
            assert r["n_retained"] == len(sub) and r["mae"] == pytest.approx(sub["abs_e"].mean())
            per = sub.groupby("bin")["abs_e"].mean()
            assert r["balanced_mae"] == (pytest.approx(per.mean()) if len(per) == 5 else None)
    sweep = spark.createDataFrame([("a", 0.2, 0.75), ("a", 0.5, 0.25), ("a", None, 1.0)], "k string, cutoff double, retained_fraction double")
    assert C.representative_cutoff(sweep, ["k"]).collect()[0]["cutoff"] == 0.5
