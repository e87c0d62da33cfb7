from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalpanel.operators import cluster as K
from evalpanel.operators import intervals as I
from evalpanel.operators import resample as B
from evalpanel.operators import topset as TS
from evalpanel.operators.bootstrap import bootstrap

BAL = B.mean_of("abs_e", balanced=True)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows = [
        (u, c, int(u % 4), "c%d" % (u % 3), float(np.round(abs(rng.normal(5 + 3 * (u % 4) + i, 3)), 1)))
        for u in range(60)
        for i, c in enumerate("pqr")
    ]
    df = spark.createDataFrame(rows, "unit int, config string, bin int, clus string, abs_e double").cache()
    return df, pd.DataFrame(rows, columns=df.columns)


def balanced(pdf, w=None):
    w = np.ones(len(pdf)) if w is None else w
    g = pd.DataFrame({"b": pdf["bin"], "w": w, "s": w * pdf["abs_e"]}).groupby("b").sum()
    g = g[g["w"] > 0]
    return (g["s"] / g["w"]).mean()


def test_draws_keep_n_and_are_the_same_for_any_partitioning(spark, panel):
    df, _ = panel
    ids = df.select("unit").distinct()
    one = B.draws(B.unit_index(ids.repartition(1)), 3, 7).toPandas()
    many = B.draws(B.unit_index(ids.repartition(13)), 3, 7).toPandas()
    assert (one.groupby("rep")["w"].sum() == 60).all()
    key = ["rep", "unit"]
    assert one.sort_values(key).reset_index(drop=True).equals(many.sort_values(key).reset_index(drop=True))


def test_stratified_draws_keep_each_stratum(spark, panel):
    df, _ = panel
    got = B.draws(B.unit_index(df.select("bin", "unit").distinct(), strata=["bin"]), 3, 5, ["bin"]).toPandas()
    assert (got.groupby(["bin", "rep"])["w"].sum() == 15).all()
    assert (got["unit"] % 4 == got["bin"]).all()


def test_multinomial_replicates_equal_weighted_recomputation(spark, panel):
    df, pdf = panel
    reps = B.replicates(df, ["config"], BAL, 6, 11).toPandas().set_index(["config", "rep"])["theta"]
    w = B.draws(B.unit_index(df.select("unit").distinct()), 11, 6).toPandas().set_index(["rep", "unit"])["w"]
    for (config, rep), theta in reps.items():
        sub = pdf[pdf["config"] == config]
        weights = np.array([w.get((rep, u), 0) for u in sub["unit"]])
        assert theta == pytest.approx(balanced(sub, weights))


def test_batched_and_row_wise_poisson_sums_agree(spark, panel):
    df, _ = panel
    fast = B.replicates(df, ["config"], BAL, 9, 12, "poisson").toPandas()
    stats = B.unit_stats(df, ["config"], BAL)
    slow = B.poisson_draws(stats, 12, 9).groupBy("config", "bin", "rep").agg(
        *[F.sum(F.col("w") * F.col(n)).alias(n) for n in BAL.sums]
    )
    slow = B.finish(slow, ["config", "rep"], BAL).toPandas()
    key = ["config", "rep"]
    a, b = fast.sort_values(key), slow.sort_values(key)
    assert np.allclose(a["theta"], b["theta"]) and len(a) == 27


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = B.poisson_draws(spark.range(0, 2000).withColumnRenamed("id", "unit"), 5, 20).toPandas()["w"]
    full = np.concatenate([w, np.zeros(40000 - len(w))])
    assert abs(full.mean() - 1) < 0.02 and abs(full.var() - 1) < 0.04


def test_jackknife_matches_leaving_units_out(spark, panel):
    df, pdf = panel
    stats = B.unit_stats(df, ["config"], BAL)
    got = B.jackknife(stats, ["config"], BAL, per_unit=True).toPandas().set_index(["config", "unit"])["theta_out"]
    accel = B.jackknife(stats, ["config"], BAL).toPandas().set_index("config")["accel"]
    for config, sub in pdf.groupby("config"):
        out = np.array([balanced(sub[sub["unit"] != u]) for u in sub["unit"]])
        assert np.allclose(out, [got[config, u] for u in sub["unit"]])
        m = out.mean() - out
        assert accel[config] == pytest.approx((m**3).sum() / (6 * (m**2).sum() ** 1.5))


def test_bca_matches_its_formula(spark, panel):
    df, _ = panel
    stats = B.unit_stats(df, ["config"], BAL)
    reps = B.replicates(stats, ["config"], BAL, 300, 13).cache()
    point, jack = B.point(stats, ["config"], BAL), B.jackknife(stats, ["config"], BAL)
    got = I.bca_interval(reps, point, jack, ["config"]).toPandas().set_index("config")
    values, theta = reps.toPandas(), point.toPandas().set_index("config")["theta_hat"]
    acc = jack.toPandas().set_index("config")["accel"]
    nd = NormalDist()
    for config, v in values.groupby("config")["theta"]:
        z0 = nd.inv_cdf((v < theta[config]).mean())
        ends = [nd.cdf(z0 + (z0 + z) / (1 - acc[config] * (z0 + z))) for z in (nd.inv_cdf(0.025), nd.inv_cdf(0.975))]
        assert got.loc[config, "ci_method"] == "BCa"
        assert got.loc[config, "ci_lo"] == pytest.approx(np.percentile(v, 100 * ends[0]))
        assert got.loc[config, "ci_hi"] == pytest.approx(np.percentile(v, 100 * ends[1]))
        assert got.loc[config, "p_two_sided"] == pytest.approx(1 / 301)


def test_bca_falls_back_when_degenerate(spark):
    rows = spark.createDataFrame([(u, "k", 0, 5.0) for u in range(10)], "unit int, config string, bin int, abs_e double")
    r = bootstrap(rows, ["config"], BAL, 60, 1).collect()[0]
    assert r["ci_method"] == "percentile (BCa fallback)" and r["ci_lo"] == r["ci_hi"] == 5.0


def test_percentile_interval_refuses_few_replicates(spark):
    reps = spark.createDataFrame([("k", i, float(i) if i < 40 else None) for i in range(100)], "k string, rep int, theta double")
    r = I.percentile_interval(reps, ["k"]).collect()[0]
    assert r["ci_lo"] is None and r["undefined_share"] == pytest.approx(0.6)


def test_p_value_text(spark):
    df = spark.createDataFrame([(1 / 101,), (0.25,)], "p double")
    assert [r[0] for r in df.select(I.format_p("p", 100)).collect()] == ["< 9.9e-03", "0.25000"]


def test_simultaneous_band(spark):
    df = spark.createDataFrame([("a", 0.1, 0.2), ("a", -0.3, -0.1), ("b", -0.1, 0.1)], "k string, ci_lo double, ci_hi double")
    assert {r["k"]: r["all_exclude_zero"] for r in I.band_excludes_zero(df, ["k"]).collect()} == {"a": True, "b": False}


# ---- clusters ----

def cr3(d, c, w):
    full = np.average(d, weights=w)
    gaps = [np.average(d[c != k], weights=w[c != k]) - full for k in np.unique(c)]
    g = len(gaps)
    return full, (g - 1) / g * np.sum(np.square(gaps))


def test_wild_cluster_test_matches_enumeration(spark, panel):
    df, pdf = panel
    rows = df.filter("config = 'p'").withColumn("d", F.col("abs_e") - 8.0)
    weighted = K.bin_weights(rows, ["config"], 4)
    sums = K.cluster_sums(weighted, ["config"], "clus", weight="weight")
    seen = K.clustered_interval(sums, ["config"], "clus")
    got = K.wild_test(seen, K.wild_replicates(sums, ["config"], "clus", 216, enumerate_all=True), ["config"]).collect()[0]
    sub = pdf[pdf["config"] == "p"]
    d, c, w = sub["abs_e"].to_numpy() - 8, sub["clus"].to_numpy(), np.full(60, 1 / 60)
    full, var = cr3(d, c, w)
    t_obs = full / np.sqrt(var)
    stars = []
    for i in range(216):
        v = {k: K.SIX_POINT[(i // 6**p) % 6] for p, k in enumerate(sorted(set(c)))}
        b, s = cr3(d * np.array([v[k] for k in c]), c, w)
        stars.append(b / np.sqrt(s))
    stars = np.round(np.abs(stars), 10)
    assert got["t_obs"] == pytest.approx(t_obs) and got["n_distinct_abs_t"] == len(set(stars))
    assert got["p_webb"] == pytest.approx(max((1 + (stars >= round(abs(t_obs), 10)).sum()) / 217, 2 / 216))
    row = seen.collect()[0]
    assert row["ci_hi"] - row["ci_lo"] == pytest.approx(2 * 4.302652729911275 * np.sqrt(var))


def test_leave_one_cluster_out_by_subtraction(spark, panel):
    df, pdf = panel
    got = {(r["config"], r["dropped"]): r for r in K.leave_one_out_balanced(df, ["config"], "clus", n_bins=4, min_n=10).collect()}
    for (config, dropped), r in got.items():
        sub = pdf[(pdf["config"] == config) & (pdf["clus"] != dropped)]
        assert r["balanced_mae"] == pytest.approx(balanced(sub))
    refused = K.leave_one_out_balanced(df, ["config"], "clus", n_bins=4, min_n=11).collect()
    assert all(r["balanced_mae"] is None and r["reason"] == "not computed (bin n < 10)" for r in refused)


def test_refit_range_note(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 3.0), ("k", None)], "k string, v double")
    r = K.refit_range(df, ["k"], "v").collect()[0]
    assert (r["lo"], r["hi"], r["note"]) == (1.0, 3.0, "built from 2/3 usable refits")


# ---- top sets ----

def brute_sets(theta, stars, alpha=0.05):
    def dist(v):
        return np.array([v[j] - np.delete(v, j).min() for j in range(len(v))])

    def parts(idx):
        d = dist(theta[idx])
        ds = np.apply_along_axis(dist, 1, stars[:, idx])
        se = ds.std(axis=0, ddof=1)
        return d, se, np.percentile(((ds - d) / se).max(axis=1), 100 * (1 - alpha))

    d, se, c = parts(list(range(len(theta))))
    mcb = {j for j in range(len(theta)) if d[j] - c * se[j] <= 0}
    left = list(range(len(theta)))
    while len(left) > 1:
        d, se, c = parts(left)
        worst = int(np.argmax(d / se))
        if (d / se)[worst] <= c:
            break
        left.pop(worst)
    return mcb, set(left)


def test_top_sets_match_brute_force(spark):
    rng = np.random.default_rng(9)
    theta = np.array([5.0, 5.1, 5.6, 7.0, 9.0])
    stars = theta + rng.normal(0, [0.3, 0.3, 0.3, 0.4, 0.5], (120, 5))
    reps = spark.createDataFrame([(f"c{j}", b, float(stars[b, j])) for b in range(120) for j in range(5)], "config string, rep int, theta double")
    points = spark.createDataFrame([(f"c{j}", float(t)) for j, t in enumerate(theta)], "config string, theta_hat double")
    got = {r["config"]: r for r in TS.top_set(reps, points).collect()}
    mcb, mcs = brute_sets(theta, stars)
    assert {int(k[1]) for k, r in got.items() if r["in_mcb"]} == mcb
    assert {int(k[1]) for k, r in got.items() if r["in_mcs"]} == mcs
    best = np.bincount(stars.argmin(axis=1), minlength=5) / 120
    assert [got[f"c{j}"]["prob_best"] for j in range(5)] == pytest.approx(list(best))
    assert got["c0"]["sets_disagree"] == (mcb != mcs)


def test_a_unit_in_two_strata_is_drawn_in_both(spark):
    rows = spark.createDataFrame([(u, b, 1.0) for u in range(40) for b in (0, 1)], "unit int, bin int, abs_e double")
    stat = B.Statistic({"s_n": "1.0D"}, "s_n")
    found = B.replicates(rows, [], stat, 6, 5, "multinomial", ["bin"]).collect()
    assert [r["theta"] for r in found] == [80.0] * 6


def test_complements_of_clusters(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "c": rng.choice(["x", "y", "z", None], 60), "v": rng.integers(-9, 9, 60)})
    pdf.loc[pdf["k"] == "b", "c"] = pdf.loc[pdf["k"] == "b", "c"].replace("x", "y")  # a key without one cluster
    pdf.loc[len(pdf)] = ["only", "z", 5]
    df = spark.createDataFrame(pdf)
    v = F.col("v")
    got = K.complements(df, ["k"], "c", {"s": ("sum", v), "n": ("count", v), "lo": ("min", v), "hi": ("max", v)}).collect()
    assert len(got) == 3 * 4
    for r in got:
        rest = pdf[(pdf["k"] == r["k"]) & (pdf["c"].notna() if r["dropped"] is None else (pdf["c"] != r["dropped"]))]["v"]
        want = (rest.sum(), len(rest), rest.min(), rest.max()) if len(rest) else (None,) * 4
        assert (r["s"], r["n"], r["lo"], r["hi"]) == want
    levels = K.complements(df, ["k", "v"], "c", {"n": ("count", v)}).filter("n > 0").groupBy("k", "dropped").agg(F.sum("n").alias("n")).collect()
    assert {(r["k"], r["dropped"]): r["n"] for r in levels} == {(r["k"], r["dropped"]): r["n"] for r in got if r["n"]}


def test_wild_floor_follows_the_number_of_clusters(spark):
    for groups, floor in ((2, 2 / 36), (3, 2 / 216), (4, 2 / 1296)):
        sums = spark.createDataFrame([(c, 10.0 + 0.01 * c, 1.0) for c in range(groups)], "c int, swd double, sw double")
        stars = K.wild_replicates(sums, [], "c", 0, enumerate_all=True)
        r = K.wild_test(K.clustered_interval(sums, [], "c", interval=False), stars, []).collect()[0]
        assert r["p_webb"] >= floor and r["p_webb"] == pytest.approx(max(floor, (1 + r["n_beyond"]) / (r["n_valid"] + 1)))


@pytest.mark.parametrize("method", ["poisson", "multinomial"])
def test_md5_weights_are_made_where_the_statistics_lie(spark, panel, method):
    """No row per unit and replicate: such rows would come from a Generate."""
    df, _ = panel
    reps = B.replicates(df, ["config"], BAL, 40, 9, method, hasher="md5")
    assert "Generate" not in reps._jdf.queryExecution().optimizedPlan().toString()
    ids = df.select("unit").distinct()
    weights = B.poisson_draws(ids, 9, 40, hasher="md5") if method == "poisson" else B.draws(B.unit_index(ids, hasher="md5"), 9, 40, hasher="md5")
    want = df.join(weights.select("unit", "rep", "w"), "unit").groupBy("config", "bin", "rep").agg((F.sum(F.col("w") * F.col("abs_e")) / F.sum("w")).alias("m"))
    want = {(r["config"], r["rep"]): r["t"] for r in want.groupBy("config", "rep").agg(F.avg("m").alias("t")).collect()}
    got = {(r["config"], r["rep"]): r["theta"] for r in reps.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("method", ["poisson", "multinomial"])
@pytest.mark.parametrize("hasher", ["md5", "xx"])
def test_a_replicate_without_any_unit_of_a_bin_has_no_row_for_it(spark, method, hasher):
    rows = spark.createDataFrame([(u, "p", int(u == 0), float(u)) for u in range(6)], "unit int, config string, bin int, abs_e double")
    got = B.replicates(rows, ["config"], BAL, 60, 3, method, hasher=hasher).collect()
    assert {r["bins_present"] for r in got} == {1, 2}
