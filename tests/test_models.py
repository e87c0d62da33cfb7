import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalpanel.operators import ensembles as E
from evalpanel.operators import metrics as M
from evalpanel.operators import raster as RA
from evalpanel.operators import regress as L


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(14)
    n = 120
    pdf = pd.DataFrame({"unit": np.arange(n), "bin": np.arange(n) % 4, "u": rng.normal(size=n), "v": rng.integers(0, 2, n).astype(float)})
    pdf["y"] = 1 + 2 * pdf["u"] - pdf["v"] + rng.normal(size=n)
    return spark.createDataFrame(pdf).cache(), pdf


def lstsq(pdf, xs, y="y"):
    a = np.column_stack([np.ones(len(pdf)), *[pdf[x] for x in xs]])
    beta, *_ = np.linalg.lstsq(a, pdf[y], rcond=None)
    r = pdf[y] - a @ beta
    return beta, 1 - (r**2).sum() / ((pdf[y] - pdf[y].mean()) ** 2).sum()


def test_least_squares_grouped_and_weighted(spark, units):
    df, pdf = units
    xs = ["u", "v"]
    for r in L.fit(L.cross_products(df, xs, "y", ["bin"]), xs, ["bin"]).collect():
        beta, r2 = lstsq(pdf[pdf["bin"] == r["bin"]], xs)
        assert r["coef"] == pytest.approx(list(beta)) and r["r2"] == pytest.approx(r2)
    r = L.fit(L.cross_products(df.withColumn("w", F.col("unit") % 3), xs, "y", weight="w"), xs).collect()[0]
    assert r["coef"] == pytest.approx(list(lstsq(pdf.loc[pdf.index.repeat(pdf["unit"] % 3)], xs)[0]))


def test_aliased_columns_and_missing_levels(spark, units):
    df, _ = units
    wide = df.withColumns({"copy": F.col("v"), "none": F.lit(None).cast("double")})
    products = L.cross_products(wide, ["u", "v", "copy", "none"], "y")
    r = L.design_rank(products, ["u", "v", "copy", "none"]).collect()[0]
    assert (r["rank"], r["aliased"]) == (3, 2)
    vif = {x["term"]: x["vif"] for x in L.variance_inflation(products, ["u", "v", "copy", "none"]).collect()}
    assert vif["copy"] == float("inf") and vif["none"] is None


def test_variance_inflation_and_block_gain(spark, units):
    df, pdf = units
    products = L.cross_products(df, ["u", "v"], "y")
    vif = {x["term"]: x["vif"] for x in L.variance_inflation(products, ["u", "v"]).collect()}
    assert vif["u"] == pytest.approx(1 / (1 - np.corrcoef(pdf["u"], pdf["v"])[0, 1] ** 2))
    gain = L.delta_r2(products, ["u", "v"], ["v"]).collect()[0]["delta_r2"]
    assert gain == pytest.approx(lstsq(pdf, ["u", "v"])[1] - lstsq(pdf, ["u"])[1])


def test_block_rows_move_within_their_stratum(spark, units):
    df, pdf = units
    moved = L.permuted_block(df, "unit", "bin", ["u", "v"], 4, 3).toPandas().merge(pdf[["unit", "bin"]], on="unit")
    assert len(moved) == 480
    for (_, b), g in moved.groupby(["rep", "bin"]):
        assert sorted(zip(g["u"], g["v"])) == sorted(zip(pdf.loc[pdf["bin"] == b, "u"], pdf.loc[pdf["bin"] == b, "v"]))
    test = L.block_permutation_test(df, ["u", "v"], "y", ["u"], "bin", 49, 3).collect()[0]
    assert test["p"] == pytest.approx(1 / 50)


def test_median_regression_minimises_absolute_error(spark, units):
    df, pdf = units
    got = L.median_regression(df, ["u", "v"], "y")
    objective = got.pop("objective")
    loss = lambda b: np.abs(pdf["y"] - b[0] - b[1] * pdf["u"] - b[2] * pdf["v"]).sum()
    best = loss(list(got.values()))
    a = np.column_stack([np.ones(len(pdf)), pdf["u"], pdf["v"]])
    exact = min(
        loss(np.linalg.solve(a[list(i)], pdf["y"].to_numpy()[list(i)]))
        for i in itertools.combinations(range(40), 3)
        if abs(np.linalg.det(a[list(i)])) > 1e-9
    )
    assert best <= exact * (1 + 1e-6)
    assert objective == pytest.approx(best / len(pdf))


def test_median_regression_raises_rather_than_stop_early(spark, units):
    with pytest.raises(ArithmeticError, match="no convergence in 2 rounds"):
        L.median_regression(units[0], ["u", "v"], "y", rounds=2)


def test_forbidden_columns():
    assert L.forbidden_columns(["clean_1", "rooted_1"], "clean", ["rooted", "nonrooted"])
    assert not L.forbidden_columns(["rooted_1", "nonrooted_1"], "clean", ["rooted", "nonrooted"])


# ---- ensembles ----

def test_ensembles_by_brute_force(spark):
    rng = np.random.default_rng(15)
    raters, conds = ["a", "b", "c"], ["s", "t"]
    rows = []
    for u in range(40):
        ref = float(10 * (u % 5) + 3)
        for i, r in enumerate(raters):
            for j, c in enumerate(conds):
                p = ref + rng.normal(i - j, 4)
                rows.append((u, r, c, f"{r}|{c}", u % 5, ref, float(p), float(p - ref), float(abs(p - ref))))
    cols = "unit int, rater string, cond string, config string, bin int, reference double, pred double, e double, abs_e double"
    panel = spark.createDataFrame(rows, cols).cache()
    pdf = pd.DataFrame(rows, columns=panel.columns)
    folds = E.stratified_folds(panel.select("unit", "bin").distinct(), 4, 2, 9)
    members = E.membership(E.selections(E.fold_sums(panel, folds)), raters, conds)
    got = E.ensemble_metrics(panel, folds, members).toPandas().set_index(["rep", "name", "selection"])
    fd = folds.toPandas()
    assert (fd.groupby(["rep", "bin", "fold"]).size() == 2).all()
    assert len(got) == 2 * (6 + (5 * 3 - 6) * 2 + 2 * 2)

    def ranked(train, level, arm):
        rowset = []
        for name, g in train.groupby(level):
            bal, ov = g.groupby("bin")["abs_e"].mean().mean(), g["abs_e"].mean()
            rowset.append((*((bal, ov) if arm == "balanced" else (ov, bal)), abs(g["e"].mean()), name))
        return [x[-1] for x in sorted(rowset)]

    for rep in (1, 2):
        for arm in ("overall", "balanced"):
            errors = {"top2R x t": [], "all3R@own": [], "top2R x all2C": []}
            for fold in range(4):
                held = set(fd[(fd["rep"] == rep) & (fd["fold"] == fold)]["unit"])
                train, test = pdf[~pdf["unit"].isin(held)], pdf[pdf["unit"].isin(held)]
                order = ranked(train, "rater", arm)
                own = {r: ranked(train[train["rater"] == r], "cond", arm)[0] for r in raters}
                sets = {
                    "top2R x t": [f"{r}|t" for r in order[:2]],
                    "all3R@own": [f"{r}|{own[r]}" for r in raters],
                    "top2R x all2C": [f"{r}|{c}" for r in order[:2] for c in conds],
                }
                for name, cfg in sets.items():
                    m = test[test["config"].isin(cfg)].groupby(["unit", "bin", "reference"])["pred"].mean().reset_index()
                    errors[name].append(m.assign(a=(m["pred"] - m["reference"]).abs()))
            for name, parts in errors.items():
                full = pd.concat(parts)
                assert got.loc[(rep, name, arm), "overall"] == pytest.approx(full["a"].mean())
                assert got.loc[(rep, name, arm), "balanced"] == pytest.approx(full.groupby("bin")["a"].mean().mean())


# ---- metrics ----

def test_balanced_is_null_with_a_reason_below_the_floor(spark):
    rows = [("k", b, 1.0 * b) for b in range(5) for _ in range(10 if b else 9)]
    df = spark.createDataFrame(rows, "k string, bin int, abs_e double")
    r = M.balanced(df, ["k"], min_n=10).collect()[0]
    assert r["balanced_mae"] is None and r["reason"] == "not computed (bin n < 10)" and len(r["per_bin"]) == 5
    r = M.balanced(df, ["k"], include_n=10).collect()[0]
    assert r["balanced_mae"] == 2.5 and [b["included"] for b in r["per_bin"]] == [False, True, True, True, True]


def test_pooling_is_the_mean_of_absolute_errors(spark):
    df = spark.createDataFrame([("m", 1, -4.0, 4.0), ("m", 1, 4.0, 4.0)], "rater string, unit int, e double, abs_e double")
    assert M.pool_axis(df, ["rater"]).collect()[0]["abs_e"] == 4.0


# ---- rasters ----

def test_index_of_hand_made_pixels(spark):
    df = spark.createDataFrame([("i", 0, 0, 10.0, 20.0, 10.0), ("i", 1, 1, 0.0, 0.0, 0.0)], "unit string, x int, y int, r double, g double, b double")
    got = {r["x"]: r["index"] for r in RA.vegetation_index(df).collect()}
    assert got[0] == pytest.approx(3 * 0.5 - 2.4 * 0.25 - 0.25) and got[1] == 0.0
    assert RA.inside_border(df, 3, 3, 1).select("x").collect()[0]["x"] == 1


def test_decoded_image_rows_become_pixels(spark):
    data = bytes([1, 2, 3, 4, 5, 6])
    img = spark.createDataFrame([("i", (1, 2, 3, bytearray(data)))], "unit string, image struct<height:int,width:int,nChannels:int,data:binary>")
    got = sorted((r["x"], r["r"], r["g"], r["b"]) for r in RA.pixels(img).collect())
    assert got == [(0, 3.0, 2.0, 1.0), (1, 6.0, 5.0, 4.0)]


def test_exemplar_pool_is_bounded_and_without_replacement(spark):
    px = spark.range(0, 500).select((F.col("id") % 5).cast("string").alias("unit"), (F.col("id") / 5).cast("int").alias("x"), F.lit(0).alias("y"), F.rand(1).alias("index"))
    ref = spark.createDataFrame([(str(i), float(i)) for i in range(5)], "unit string, reference double")
    pool = RA.exemplar_pool(px, ref, 1, 2.0, 2, 7).toPandas()
    assert len(pool) == 14 and pool["unit"].nunique() == 2 and not pool.duplicated(["unit", "x"]).any()
    assert set(pool["unit"]) <= {"0", "1", "2"}
