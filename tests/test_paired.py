import numpy as np
import pytest
from pyspark.sql import functions as F

from evalpanel.operators import multiplicity as H
from evalpanel.operators import paired as Q


def frame(spark, groups):
    rows = [(k, i, 0, float(d), 0.0, float(d)) for k, ds in groups.items() for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, "k string, unit int, bin int, x double, y double, d double")


def mid_ranks(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def walsh_median(d):
    i, j = np.triu_indices(len(d))
    return float(np.median((np.asarray(d)[i] + np.asarray(d)[j]) / 2))


CASES = {
    "ties": np.round(np.random.default_rng(3).normal(1, 4, 120), 0),
    "continuous": np.random.default_rng(4).normal(0, 3, 121),
    "skewed": np.random.default_rng(5).exponential(10, 90),
    "one_third_zero": np.where(np.arange(90) % 3 == 0, 0.0, np.random.default_rng(6).normal(2, 5, 90)),
}


def test_signed_rank_matches_its_definition(spark):
    got = {r["k"]: r for r in Q.signed_rank(frame(spark, CASES), ["k"]).collect()}
    for k, d in CASES.items():
        r = mid_ranks(np.abs(d))
        n, z = len(d), int((d == 0).sum())
        wp, wn = r[d > 0].sum(), r[d < 0].sum()
        _, t = np.unique(np.abs(d[d != 0]), return_counts=True)
        mean = n * (n + 1) / 4 - z * (z + 1) / 4
        var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - (t**3 - t).sum() / 2) / 24
        stat = min(wp, wn)
        assert got[k]["w_plus"] == wp and got[k]["w_minus"] == wn and got[k]["n_zero_diff"] == z
        assert got[k]["z"] == pytest.approx((stat - mean - np.sign(stat - mean) * 0.5) / np.sqrt(var))
        s = mid_ranks(np.abs(d[d != 0]))
        a, b = s[d[d != 0] > 0].sum(), s[d[d != 0] < 0].sum()
        assert got[k]["rank_biserial"] == pytest.approx((a - b) / (a + b))
        assert got[k]["n_tied_ranks"] == t[t > 1].sum()


def test_all_zero_differences_give_no_statistic(spark):
    r = Q.signed_rank(frame(spark, {"z": [0.0] * 5}), ["k"]).collect()[0]
    assert r["n_zero_diff"] == 5 and r["rank_biserial"] is None and r["z"] is None


@pytest.mark.parametrize("budget", [10, 200_000])
def test_walsh_median_is_exact_with_and_without_narrowing(spark, budget):
    got = {r["k"]: r[1] for r in Q.hodges_lehmann(frame(spark, CASES), ["k"], budget=budget, cells=16).collect()}
    for k, d in CASES.items():
        assert got[k] == pytest.approx(walsh_median(d), abs=1e-9), k


def test_walsh_median_where_one_sum_belongs_to_more_pairs_than_the_budget(spark):
    even = [float(x) for x in range(1000)]
    tenths = [round(0.1 * x, 1) for x in range(301)]
    got = {r["k"]: r[1] for r in Q.hodges_lehmann(frame(spark, {"even": even, "tenths": tenths}), ["k"], budget=100).collect()}
    assert got == {"even": pytest.approx(499.5), "tenths": pytest.approx(15.0)}


def test_walsh_median_of_one_and_two_values(spark):
    got = {r["k"]: r[1] for r in Q.hodges_lehmann(frame(spark, {"one": [3.0], "two": [1.0, 4.0], "same": [2.0] * 7}), ["k"]).collect()}
    assert got == {"one": 3.0, "two": 2.5, "same": 2.0}


def test_pairs_cover_every_level_pair_once(spark):
    rows = [(u, c, float(u * 10 + i)) for u in range(3) for i, c in enumerate("abcd")]
    pairs = Q.level_pairs(spark.createDataFrame(rows, "unit int, lv string, abs_e double").withColumn("bin", F.lit(0)), "lv")
    got = sorted((r["unit"], r["a"], r["b"], r["d"]) for r in pairs.collect())
    assert len(got) == 18 and all(a < b for _, a, b, _ in got)
    assert got[0] == (0, "a", "b", -1.0)


def test_holm_steps_down_with_declared_size(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None)], "family string, k string, p double")
    got = {r["k"]: r["p_holm"] for r in H.holm(df, "p", ["family"], {"f": 5}).collect()}
    assert got["a"] == pytest.approx(0.05) and got["c"] == pytest.approx(0.12) and got["b"] == pytest.approx(0.12) and got["d"] is None
    assert H.first_threshold(0.05, 5) == pytest.approx(0.01)


def test_holm_refuses_more_tests_than_declared_or_unknown_family(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.02)], "family string, p double")
    with pytest.raises(Exception, match="declared family size"):
        H.holm(df, "p", ["family"], {"f": 1}).collect()
    with pytest.raises(Exception, match="no declared size"):
        H.holm(df, "p", ["family"], {"g": 5}).collect()


def test_verdict_is_downgraded_never_invented(spark):
    df = spark.createDataFrame([(0.01, 0.6, True), (0.01, 0.6, False), (0.01, 0.4, True), (0.2, 0.9, False)], "p double, e double, ok boolean")
    got = [r[0] for r in df.select(H.verdict(F.col("p"), F.col("e"), 0.5, 0.05, F.col("ok"))).collect()]
    assert got == ["informative", "label-dependent / not robustly classified", "anti-informative", "not detected"]


def test_contrast_table_has_its_columns(spark):
    table = Q.contrast_table(frame(spark, CASES).withColumnsRenamed({"k": "a"}).withColumn("b", F.lit("ref")), ["a", "b"])
    H.require_columns(table, H.CONTRAST_COLUMNS)
    rows = {r["a"]: r for r in table.collect()}
    for k, d in CASES.items():
        m = d - d.mean()
        assert rows[k]["skew"] == pytest.approx((m**3).mean() / (m**2).mean() ** 1.5)
        assert rows[k]["median_d"] == pytest.approx(np.median(d))
    assert 0 <= rows["ties"]["wilcoxon_p"] <= 1
    with pytest.raises(ValueError):
        H.require_columns(table.drop("z"), H.CONTRAST_COLUMNS)
