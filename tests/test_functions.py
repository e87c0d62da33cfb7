import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalpanel.functions import columns as C
from evalpanel.functions import distributions as D
from evalpanel.functions.hashing import continue_hash, poisson_steps, uniform
from evalpanel.functions.levels import adaptive_cuts, level_table, quantiles, running


def test_bins_are_right_closed_and_bottom_is_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 20.0, 20.5, 40.0, 80.0, 100.0, -0.1, 100.1)], "v double")
    got = [r[0] for r in df.select(C.right_closed_bin("v", C.FIVE_EDGES)).collect()]
    assert got == [0, 0, 1, 1, 3, 4, None, None]


def test_eight_bins_nest_in_five(spark):
    df = spark.range(0, 1001).select((F.col("id") / 10.0).alias("reference"))
    both = C.with_bins(C.with_bins(df, C.FIVE_EDGES), C.EIGHT_EDGES, name="fine")
    assert both.groupBy("fine").agg(F.countDistinct("bin").alias("k")).filter("k <> 1").count() == 0
    assert [r["n"] for r in both.groupBy("fine").agg(F.count("*").alias("n")).orderBy("fine").collect()] == [11, 40, 50, 100, 200, 200, 200, 200]


def test_errors_turn_nan_into_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (3.0, 1.0)], "pred double, reference double")
    assert [r["abs_e"] for r in C.with_errors(df).collect()] == [None, 2.0]


def test_skill_and_sape_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (2.0, 6.0)], "m double, b double")
    assert [r[0] for r in df.select(C.relative_skill("m", "b")).collect()] == [0.0, 1.0, -1.0, 0.5]
    assert [r[0] for r in df.select(C.symmetric_ape("m", "b")).collect()] == [0.0, 2.0, 2.0, 1.0]


def test_vocabulary_map_is_idempotent(spark):
    df = spark.createDataFrame([("old",), ("new",), ("x",)], "v string")
    once = df.select(C.mapped("v", {"old": "new"}).alias("v"))
    assert [r[0] for r in once.collect()] == ["new", "new", None]
    assert [r[0] for r in once.select(C.mapped("v", {"old": "new"})).collect()] == ["new", "new", None]


@pytest.mark.parametrize("grain", [None, 0.01, 1.0, 1000.0])
def test_running_counts_do_not_depend_on_the_grain(spark, grain):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k in ("a", "b") for v in np.round(rng.normal(0, 5, 200), 1)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = running(level_table(df, ["k"], "v", {"n": F.lit(1)}), ["k"], "v", ["n"], grain)
    for r in got.collect():
        values = [v for k, v in rows if k == r["k"]]
        assert r["below_n"] == sum(v < r["v"] for v in values) and r["all_n"] == 200


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k in ("a", "b") for v in np.round(rng.gamma(1, 20, 77), 0)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p97": 0.97}).collect()}
    assert "d" not in got
    for k in ("a", "b", "c"):
        values = [v for kk, v in rows if kk == k]
        for name, p in (("p10", 10), ("p50", 50), ("p97", 97)):
            assert got[k][name] == pytest.approx(np.percentile(values, p))


def test_python_and_jvm_weights_are_the_same_numbers(spark):
    df = spark.range(0, 50).select(F.col("id").alias("unit"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rep"))
    rows = df.select("unit", "rep", uniform(7, ["unit", "rep"]).alias("u"), F.xxhash64(F.lit(7), "unit").alias("h")).collect()
    got = continue_hash(np.array([r["h"] for r in rows]), np.array([r["rep"] for r in rows], dtype=np.int32))
    assert np.array_equal(got, np.array([r["u"] for r in rows]))


def test_uniform_is_flat_and_poisson_steps_are_probabilities(spark):
    u = np.array([r[0] for r in spark.range(0, 20000).select(uniform(3, ["id"])).collect()])
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.histogram(u, 10, (0, 1))[0] - 2000).max() < 250
    steps = poisson_steps()
    assert steps[0] == pytest.approx(math.exp(-1)) and all(a < b for a, b in zip(steps, steps[1:]))


def test_tail_probabilities():
    assert D.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert D.t_quantile(0.975, 2) == pytest.approx(4.302652729911275)
    assert D.t_quantile(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert D.t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-7)
    assert D.chi2_upper(9.487729036781154, 4) == pytest.approx(0.05)
    assert D.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    exact = sum(math.comb(20, i) for i in range(6)) / 2**20 * 2
    assert D.binomial_half_two_sided(5, 20) == pytest.approx(exact)
    assert D.binomial_half_two_sided(10, 20) == 1.0
    assert D.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503496503495)


def test_sign_test_stays_exact_for_many_rows():
    n, k = 40_000, 19_700
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    assert D.binomial_half_two_sided(k, n) == pytest.approx(2 * math.fsum(map(math.exp, logs)), rel=1e-8)


def test_running_counts_keep_null_keys_and_shuffle_levels_once(spark):
    from evalpanel.functions.levels import join_bounded

    rows = [(None, 1.0), (None, 2.5), ("a", 1.0), ("a", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    lv = level_table(df, ["k"], "v", {"n": F.lit(1)})
    got = {(r["k"], r["v"]): r["below_n"] for r in running(lv, ["k"], "v", ["n"]).collect()}
    assert got == {(None, 1.0): 0, (None, 2.5): 1, ("a", 1.0): 0, ("a", 7.0): 1}
    small = df.groupBy("k").agg(F.max("v").alias("top"))
    out = join_bounded(df, small, ["k"])
    assert sorted((r["v"], r["top"]) for r in out.collect()) == [(1.0, 2.5), (1.0, 7.0), (2.5, 2.5), (7.0, 7.0)]


def test_a_hot_key_is_spread_over_tasks(spark):
    # One key with a third of all rows, and one value with a third of the key.
    df = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.when(F.col("id") % 9 == 0, 0.0).otherwise((F.col("id") % 997) / 10.0).alias("v"),
    )
    lv = level_table(df, ["k"], "v", {"n": F.lit(1)})
    assert lv.filter("k = 'hot' AND v = 0").count() == 1
    r = running(lv, ["k"], "v", ["n"])
    top = r.filter("k = 'hot'").agg(F.max(F.col("below_n") + F.col("n")), F.max("all_n"), F.count("*")).collect()[0]
    assert top[0] == top[1] == 10_000 and top[2] > 500


SHAPES = {
    "tiny_range": lambda r, n: 5.0 + 1e-9 * r.random(n),
    "huge_range": lambda r, n: np.exp(r.uniform(-300, 300, n)) * r.choice([-1, 1], n),
    "skewed": lambda r, n: r.lognormal(0, 4, n),
    "whole_numbers": lambda r, n: r.integers(0, 50, n).astype(float),
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_running_sums_on_even_cuts_for_any_scale(spark, shape):
    r = np.random.default_rng(8)
    values = SHAPES[shape](r, 4000)
    # One key holds most rows.
    pdf = pd.DataFrame({"k": np.where(r.random(4000) < 0.8, "hot", "cold"), "v": values, "m": r.integers(1, 9, 4000)})
    pdf = pdf.groupby(["k", "v"], as_index=False)["m"].sum()
    levels = spark.createDataFrame(pdf).repartition(3)
    got = running(levels, ["k"], "v", ["m"]).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    below = pdf.groupby("k")["m"].cumsum() - pdf["m"]
    assert (got["below_m"] == below).all() and (got["all_m"] == pdf.groupby("k")["m"].transform("sum")).all()
    sizes = adaptive_cuts(levels, "v", 16).groupBy("k", "_cut").count().toPandas()["count"]
    assert sizes.max() <= max(2 * len(pdf) / 16, 2)


def test_running_sums_with_null_values_and_no_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), ("a", float("nan"), 4), (None, 1.0, 8), (None, 3.0, 16)], "k string, v double, m int")
    got = {(x["k"], x["m"]): x["below_m"] for x in running(df, ["k"], "v", ["m"]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 4): 3, (None, 8): 0, (None, 16): 8}
    assert running(df.limit(0), ["k"], "v", ["m"]).collect() == []


def test_md5_numbers_by_arrays():
    import hashlib

    import numpy as np

    from evalpanel.functions.hashing import md5_uniform

    heads = ["31:8:", "31:12:", "31:9999999:", "x" * 54 + ":", "é:", "a", ""]
    numbers = np.array([1, 7, 10, 99, 100, 12345678901])
    want = [[int(hashlib.md5(f"{h}{n}".encode()).hexdigest()[:13], 16) / 2.0**52 for n in numbers] for h in heads]
    assert md5_uniform(heads, numbers).tolist() == want
