"""Projection, filter and aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalpanel.functions import columns as C
from evalpanel.functions.levels import attach_totals, join_bounded, join_null_safe, quantiles
from evalpanel.operators import metrics as M
from evalpanel.plans import panels as P
from evalpanel.plans.registry import D, N, query
from evalpanel.session import cut_lineage

PANEL = P.with_sql(P.PANEL_SQL)
BALANCED_CTE = """
pb AS (SELECT rater, cond, config, bin, count(*) AS n, avg(abs_e) AS m FROM panel GROUP BY ALL),
bal AS (SELECT rater, cond, config, avg(m) AS balanced_mae, sum(n) AS n FROM pb GROUP BY ALL)
"""
PANEL_BAL = P.with_sql(P.PANEL_SQL, BALANCED_CTE)


@query(
    "balanced_ranking",
    f"""{PANEL_BAL}
SELECT rater, cond, {N('n', 'n')}, {D('balanced_mae', 'balanced_mae')},
       {N('rank() OVER (ORDER BY balanced_mae)', 'rank_min')} FROM bal""",
)
def balanced_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal = M.balanced(P.base_panel(spark, sf_dir), ["rater", "cond"])
    return M.ranked(bal, [], "balanced_mae").select("rater", "cond", "n", "balanced_mae", "rank_min")


@query(
    "panel_rows",
    f"""{PANEL} SELECT unit, rater, cond, clus, {D('reference', 'reference')}, {D('pred', 'pred')}, {D('e', 'e')},
{D('abs_e', 'abs_e')}, bin FROM panel""",
)
def panel_rows(spark, sf_dir):
    return P.base_panel(spark, sf_dir).select("unit", "rater", "cond", "clus", "reference", "pred", "e", "abs_e", "bin")


@query(
    "error_metrics_by_config",
    f"""{PANEL} SELECT rater, cond, {N('count(*)', 'n')}, {D('avg(abs_e)', 'mae')}, {D('sqrt(avg(e*e))', 'rmse')},
{D('avg(e)', 'bias')}, {D('1 - sum(e*e)/(sum(reference*reference)-sum(reference)*sum(reference)/count(*))', 'r2')},
{D('avg(CASE WHEN abs_e<=5 THEN 1.0 ELSE 0 END)', 'p_within_5')}, {D('avg(CASE WHEN abs_e<=10 THEN 1.0 ELSE 0 END)', 'p_within_10')},
{D('avg(CASE WHEN abs(pred)<=1e-8 THEN 1.0 ELSE 0 END)', 'zero_rate')}, {D('median(e)', 'median_bias')}
FROM panel GROUP BY rater, cond""",
)
def error_metrics_by_config(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    return M.error_metrics(panel, ["rater", "cond"]).join(M.median_bias(panel, ["rater", "cond"]), ["rater", "cond"])


@query(
    "metrics_by_axis",
    f"""{PANEL}, b AS (
 SELECT 'rater' AS axis, rater, NULL AS cond, bin, abs_e, e FROM panel UNION ALL
 SELECT 'cond', NULL, cond, bin, abs_e, e FROM panel UNION ALL
 SELECT 'config', rater, cond, bin, abs_e, e FROM panel),
 c AS (SELECT axis, rater, cond, bin, count(*) AS n, sum(abs_e) AS s, sum(e) AS se, sum(e*e) AS q FROM b GROUP BY ALL)
SELECT axis, rater, cond, {N('sum(n)', 'n')}, {D('sum(s)/sum(n)', 'mae')}, {D('sqrt(sum(q)/sum(n))', 'rmse')},
 {D('sum(se)/sum(n)', 'bias')}, {D('avg(s/n)', 'balanced_mae')} FROM c GROUP BY axis, rater, cond""",
)
def metrics_by_axis(spark, sf_dir):
    return M.metrics_by_axis(P.base_panel(spark, sf_dir))


@query(
    "pooled_over_conditions",
    f"""{PANEL}, u AS (SELECT rater, unit, bin, avg(abs_e) AS a FROM panel GROUP BY ALL)
SELECT rater, {N('count(*)', 'units')}, {D('avg(a)', 'mae')} FROM u GROUP BY rater""",
)
def pooled_over_conditions(spark, sf_dir):
    return M.pool_axis(P.base_panel(spark, sf_dir), ["rater"]).groupBy("rater").agg(
        F.count("*").alias("units"), F.avg("abs_e").alias("mae")
    )


@query(
    "unit_means",
    f"""{PANEL} SELECT unit, {D('avg(e)', 'e')}, {D('avg(abs_e)', 'abs_e')}, {D('avg(pred)', 'pred')}, {D('min(reference)', 'reference')}
FROM panel GROUP BY unit""",
)
def unit_means(spark, sf_dir):
    return M.unit_means(P.base_panel(spark, sf_dir), [], ["e", "abs_e", "pred"], ["reference"])


@query(
    "per_bin_error",
    f"""{PANEL} SELECT rater, cond, bin, {N('count(*)', 'n')}, {D('avg(abs_e)', 'mae')}, {D('avg(e)', 'bias')},
{D('stddev_samp(e)', 'sd_e')}, {D('min(reference)', 'min_reference')} FROM panel GROUP BY rater, cond, bin""",
)
def per_bin_error(spark, sf_dir):
    return M.per_bin(P.base_panel(spark, sf_dir), ["rater", "cond"], 5)


def _size_quantile(panel, keys, share: float) -> int:
    """A floor inside the range of bin sizes in units, so that both branches are seen at any scale."""
    sizes = panel.groupBy(*keys, "bin").agg(F.count_distinct("unit").alias("n"))
    return sizes.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY n)").cast("long")).first()[0]


@query(
    "balanced_by_fine_bins",
    f"""{PANEL}, f AS (SELECT rater, unit, abs_e, CASE WHEN reference<=1 THEN 0 WHEN reference<=5 THEN 1 WHEN reference<=10 THEN 2
 WHEN reference<=20 THEN 3 WHEN reference<=40 THEN 4 WHEN reference<=60 THEN 5 WHEN reference<=80 THEN 6 ELSE 7 END AS b FROM panel),
 g AS (SELECT rater, b, count(DISTINCT unit) AS n, avg(abs_e) AS m FROM f GROUP BY ALL), q AS (SELECT quantile_disc(n, 0.25) AS floor FROM g)
SELECT rater, {N('sum(n)', 'n')}, {N('count(*)', 'bins_present')}, {N('min(n)', 'smallest_bin')},
 {D('avg(CASE WHEN n>floor THEN m END)', 'balanced_mae')} FROM g, q GROUP BY rater""",
)
def balanced_by_fine_bins(spark, sf_dir):
    fine = C.with_bins(P.base_panel(spark, sf_dir).drop("bin"), C.EIGHT_EDGES)
    floor = _size_quantile(fine, ["rater"], 0.25)
    return M.balanced(fine, ["rater"], n_bins=8, include_n=floor + 1, unit="unit").drop("per_bin")


@query(
    "balanced_with_floor",
    f"""{PANEL}, b AS (SELECT clus, rater, bin, count(DISTINCT unit) AS n, avg(abs_e) AS m FROM panel GROUP BY ALL), q AS (SELECT quantile_disc(n, 0.1) AS floor FROM b),
 c AS (SELECT clus, rater, avg(m) AS v, sum(n) AS n, count(*) AS k, min(n) AS s FROM b GROUP BY clus, rater)
SELECT clus, rater, {N('n', 'n')}, {D('CASE WHEN k=5 AND s>=floor THEN v END', 'balanced_mae')},
 CASE WHEN NOT (k=5 AND s>=floor) THEN 'not computed (bin n < ' || floor || ')' END AS reason FROM c, q""",
)
def balanced_with_floor(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    floor = _size_quantile(panel, ["clus", "rater"], 0.1)
    return M.balanced(panel, ["clus", "rater"], min_n=floor, unit="unit").select("clus", "rater", "n", "balanced_mae", "reason")


@query(
    "ten_bin_counts",
    f"""{PANEL}, t AS (SELECT CAST(greatest(ceil(reference/10)-1, 0) AS BIGINT) AS bin, rater, unit, abs_e FROM panel),
 g AS (SELECT r.rater, b.bin FROM (SELECT DISTINCT rater FROM panel) r, (SELECT unnest(range(10)) AS bin) b),
 c AS (SELECT rater, bin, count(DISTINCT unit) AS n FROM t GROUP BY ALL)
SELECT g.rater, g.bin, {N('coalesce(c.n,0)', 'n_units')} FROM g LEFT JOIN c ON g.rater=c.rater AND g.bin=c.bin""",
)
def ten_bin_counts(spark, sf_dir):
    ten = C.with_bins(P.base_panel(spark, sf_dir).drop("bin"), C.TEN_EDGES)
    return M.units_per_bin(ten, ["rater"], 10)


@query(
    "bin_location_and_spread",
    f"""{P.with_sql(P.PANEL_SQL, P.VARIANT_SQL)}, w AS (
 SELECT unit, rater, cond, bin, max(CASE WHEN variant='mid' THEN abs_e END)-max(CASE WHEN variant='base' THEN abs_e END) AS d
 FROM variants GROUP BY ALL),
 s AS (SELECT rater, bin, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, quantile_cont(d,0.25) AS q1,
  median(d) AS median, quantile_cont(d,0.75) AS q3 FROM w GROUP BY ALL)
SELECT rater, bin, {N('n', 'n')}, {D('mean', 'mean')}, {D('sd', 'sd')}, {D('q1', 'q1')}, {D('median', 'median')}, {D('q3', 'q3')},
 {D('q3-q1', 'iqr')}, coalesce(sd > max(CASE WHEN bin=0 THEN sd END) OVER (PARTITION BY rater), false) AS wider_than_bottom,
 {D('max(mean) OVER (PARTITION BY rater) - min(mean) OVER (PARTITION BY rater)', 'mean_range')},
 coalesce(abs(mean - max(CASE WHEN bin=0 THEN mean END) OVER (PARTITION BY rater)) > min(sd) OVER (PARTITION BY rater), false) AS location_moves
FROM s""",
)
def bin_location_and_spread(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, variants=True)
    d = panel.withColumn("d", F.abs(F.col("pred_mid") - F.col("reference")) - F.col("abs_e"))
    return M.location_and_spread(M.bin_spread(d, ["rater"], "d"), ["rater"])


@query(
    "quartile_bins",
    f"""WITH {P.COVARIATE_SQL}, q AS (SELECT quantile_cont(cont,0.25) AS a, quantile_cont(cont,0.5) AS b, quantile_cont(cont,0.75) AS c FROM covs)
SELECT {N('CASE WHEN cont<=a THEN 0 WHEN cont<=b THEN 1 WHEN cont<=c THEN 2 ELSE 3 END', 'quartile')}, {N('count(*)', 'n')},
 {D('min(cont)', 'lo')}, {D('max(cont)', 'hi')} FROM covs, q GROUP BY 1""",
)
def quartile_bins(spark, sf_dir):
    return (
        with_quartiles(P.covariates(spark, sf_dir), "cont")
        .groupBy("quartile")
        .agg(F.count("*").alias("n"), F.min("cont").alias("lo"), F.max("cont").alias("hi"))
    )


def with_quartiles(df: DataFrame, value: str) -> DataFrame:
    """Right-closed quartile index from interpolated edges (ties stay together)."""
    edges = quantiles(df, [], value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    v = F.col(value)
    idx = F.when(v <= F.col("_q1"), 0).when(v <= F.col("_q2"), 1).when(v <= F.col("_q3"), 2).when(v.isNotNull(), 3)
    return attach_totals(df, edges).withColumn("quartile", idx).drop("_q1", "_q2", "_q3")


@query(
    "score_errors_by_bin",
    f"""{PANEL}, s AS (SELECT rater, bin, abs_e, pred, reference,
 CASE WHEN abs(pred)+abs(reference)>0 THEN abs_e/((abs(pred)+abs(reference))/2) ELSE 0 END AS sape FROM panel)
SELECT rater, bin, {D('avg(sape)', 'mean_sape')}, {D('median(sape)', 'median_sape')}, {D('avg(abs_e)/max(CASE bin WHEN 0 THEN 10.0 WHEN 1 THEN 30 WHEN 2 THEN 50 WHEN 3 THEN 70 ELSE 90 END)', 'mae_over_midpoint')}
FROM s GROUP BY rater, bin""",
)
def score_errors_by_bin(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir).withColumn("sape", C.symmetric_ape("pred", "reference"))
    means = panel.groupBy("rater", "bin").agg(F.avg("sape").alias("mean_sape"), F.avg("abs_e").alias("_m"))
    med = quantiles(panel, ["rater", "bin"], "sape", {"median_sape": 0.5}, 0.01)
    out = join_null_safe(means, med, ["rater", "bin"])
    return out.withColumn("mae_over_midpoint", F.col("_m") / C.bin_midpoint("bin", C.FIVE_EDGES)).drop("_m")


@query(
    "skill_by_bin",
    f"""{PANEL}, med AS (SELECT median(reference) AS c FROM (SELECT DISTINCT unit, reference FROM panel)),
 u AS (SELECT unit, bin, avg(abs_e) AS m, abs(min(reference)-min(c)) AS b FROM panel, med GROUP BY ALL),
 r AS (SELECT *, CASE WHEN m+b>0 THEN (b-m)/(b+m) ELSE 0 END AS r FROM u)
SELECT bin, {N('count(*)', 'n')}, {D('CASE WHEN avg(b)>0 THEN 1-avg(m)/avg(b) END', 'skill_ratio')}, {D('avg(r)', 'mean_skill')},
 {N('count(*) FILTER (r=-1)', 'n_at_minus_1')}, {N('count(*) FILTER (r=1)', 'n_at_plus_1')},
 {D('avg(CASE WHEN r=1 THEN 1.0 ELSE 0 END)', 'share_at_plus_1')} FROM r GROUP BY bin""",
)
def skill_by_bin(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], ["abs_e"], ["reference", "bin"])
    med = quantiles(per_unit, [], "reference", {"_c": 0.5})
    wide = attach_totals(per_unit, med).withColumn("base_e", F.abs(F.col("reference") - F.col("_c")))
    return M.skill_by_bin(wide, [], "base_e")


@query(
    "constant_baselines",
    f"""{PANEL}, u AS (SELECT DISTINCT unit, reference, bin FROM panel),
 k AS (SELECT 'mean' AS baseline, avg(reference) AS c FROM u UNION ALL SELECT 'median', median(reference) FROM u
  UNION ALL SELECT 'zero', 0 UNION ALL SELECT 'fifty', 50)
SELECT baseline, {D('avg(abs(c-reference))', 'mae')}, {D('avg(c-reference)', 'bias')}, {D('max(c)', 'constant')} FROM u, k GROUP BY baseline""",
)
def constant_baselines(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], [], ["reference", "bin"])
    rows = M.constant_baselines(per_unit, {"zero": 0.0, "fifty": 50.0})
    return rows.groupBy("baseline").agg(
        F.avg("abs_e").alias("mae"), F.avg("e").alias("bias"), F.max("constant").alias("constant")
    )


@query(
    "crosstab_with_zeros",
    f"""WITH t AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey=r_regionkey),
 g AS (SELECT x.a, y.b FROM (SELECT DISTINCT a FROM t) x, (SELECT DISTINCT b FROM t) y),
 c AS (SELECT a, b, count(*) AS n FROM t GROUP BY ALL)
SELECT g.a AS nation, g.b AS region, {N('coalesce(n,0)', 'n')},
 {D('coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY g.a)', 'share_of_row')} FROM g LEFT JOIN c ON g.a=c.a AND g.b=c.b""",
)
def crosstab_with_zeros(spark, sf_dir):
    nation, region = P.table(spark, sf_dir, "nation"), P.table(spark, sf_dir, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return M.crosstab(named.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region")), "nation", "region")


@query(
    "cluster_by_bin_composition",
    f"""{PANEL}, u AS (SELECT DISTINCT unit, clus, bin FROM panel), c AS (SELECT clus, bin, count(*) AS n FROM u GROUP BY ALL)
SELECT clus, bin, {N('n', 'n')}, {D('n/sum(n) OVER (PARTITION BY clus)', 'share_of_row')} FROM c""",
)
def cluster_by_bin_composition(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], [], ["clus", "bin"])
    return M.crosstab(per_unit, "clus", "bin")


@query(
    "score_levels",
    f"""{PANEL}, c AS (SELECT rater, conf, count(*) AS n FROM panel WHERE conf IS NOT NULL GROUP BY ALL)
SELECT rater, {N('count(*)', 'levels')}, {D('max(n)/sum(n)', 'largest_share')}, {N('count(*) FILTER (n<30)', 'levels_under_30')} FROM c GROUP BY rater""",
)
def score_levels(spark, sf_dir):
    return M.value_mass(P.base_panel(spark, sf_dir, scores=True), ["rater"], "conf")


@query(
    "zero_rates",
    f"""WITH t AS (SELECT l_partkey AS unit, l_returnflag AS rater, floor(l_quantity/10)*10 AS pred, CASE WHEN l_tax<=0.02 THEN 0 ELSE 10 END AS reference FROM lineitem),
 u AS (SELECT rater, unit, reference=0 AS z, count(*) AS n, count(*) FILTER (pred=0) AS k, bool_and(pred=0) AS al, bool_or(pred=0) AS an FROM t GROUP BY ALL)
SELECT rater, {N('sum(CASE WHEN z THEN n ELSE 0 END)', 'n_zero_rows')}, {N('sum(CASE WHEN NOT z THEN n ELSE 0 END)', 'n_nonzero_rows')},
 {D('sum(CASE WHEN z THEN k END)/sum(CASE WHEN z THEN n END)', 'true_zero_rate')}, {D('sum(CASE WHEN NOT z THEN k END)/sum(CASE WHEN NOT z THEN n END)', 'false_zero_rate')},
 {D('avg(CASE WHEN z THEN CAST(al AS INT) END)', 'true_zero_all')}, {D('avg(CASE WHEN z THEN CAST(an AS INT) END)', 'true_zero_any')} FROM u GROUP BY rater""",
)
def zero_rates(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("unit"),
        F.col("l_returnflag").alias("rater"),
        (F.floor(F.col("l_quantity") / 10) * 10).cast("double").alias("pred"),
        F.when(F.col("l_tax") <= 0.02, 0.0).otherwise(10.0).alias("reference"),
    )
    return M.zero_rates(rows, ["rater"])


@query(
    "best_condition_per_rater",
    f"""{PANEL_BAL}, o AS (SELECT rater, cond, avg(abs_e) AS mae FROM panel GROUP BY ALL),
 t AS (SELECT b.rater, b.cond, balanced_mae, mae, row_number() OVER (PARTITION BY b.rater ORDER BY balanced_mae, mae, b.cond) AS rn
 FROM bal b JOIN o ON b.rater=o.rater AND b.cond=o.cond)
SELECT rater, cond, {D('balanced_mae', 'balanced_mae')}, {D('mae', 'mae')} FROM t WHERE rn=1""",
)
def best_condition_per_rater(spark, sf_dir):
    by_axis = M.metrics_by_axis(P.base_panel(spark, sf_dir)).filter(F.col("axis") == "config")
    return M.best_row(by_axis, ["rater"], ["balanced_mae", "mae"], ["cond", "balanced_mae", "mae"])


@query(
    "pearson_and_moments",
    f"""{PANEL} SELECT rater, {D('corr(pred, reference)', 'r')}, {D('avg(e)', 'm1')}, {D('avg(e*e)', 'm2')}, {D('avg(e*e*e)', 'm3')} FROM panel GROUP BY rater""",
)
def pearson_and_moments(spark, sf_dir):
    e = F.col("e")
    return P.base_panel(spark, sf_dir).groupBy("rater").agg(
        F.corr("pred", "reference").alias("r"),
        F.avg("e").alias("m1"),
        F.avg(e * e).alias("m2"),
        F.avg(e * e * e).alias("m3"),
    )


@query(
    "axis_spread",
    f"""{PANEL_BAL}, a AS (SELECT cond, max(balanced_mae)-min(balanced_mae) AS s FROM bal GROUP BY cond),
 b AS (SELECT rater, max(balanced_mae)-min(balanced_mae) AS s FROM bal GROUP BY rater)
SELECT 'rater' AS axis, {D('avg(s)', 'mean_spread')} FROM a UNION ALL SELECT 'cond', {D('avg(s)', 'mean_spread')} FROM b""",
)
def axis_spread(spark, sf_dir):
    bal = M.balanced(P.base_panel(spark, sf_dir), ["rater", "cond"])
    return M.axis_spread(bal, "cond", "rater", "balanced_mae").unionByName(
        M.axis_spread(bal, "rater", "cond", "balanced_mae")
    )


@query(
    "variance_components",
    f"""{PANEL}, g AS (SELECT avg(abs_e) AS g, count(DISTINCT unit) AS nu, count(DISTINCT rater) AS nr, count(DISTINCT cond) AS nc FROM panel),
 u AS (SELECT sum((m-g)*(m-g)) AS s FROM (SELECT unit, avg(abs_e) AS m FROM panel GROUP BY 1), g),
 r AS (SELECT rater, avg(abs_e) AS m FROM panel GROUP BY 1), c AS (SELECT cond, avg(abs_e) AS m FROM panel GROUP BY 1),
 x AS (SELECT rater, cond, avg(abs_e) AS m FROM panel GROUP BY 1,2),
 i AS (SELECT sum((x.m-r.m-c.m+g)*(x.m-r.m-c.m+g)) AS s FROM x JOIN r ON x.rater=r.rater JOIN c ON x.cond=c.cond, g),
 t AS (SELECT sum((abs_e-g)*(abs_e-g)) AS t FROM panel, g),
 s AS (SELECT t, nr*nc*u.s AS su, nu*nc*(SELECT sum((m-g)*(m-g)) FROM r, g) AS sr, nu*nr*(SELECT sum((m-g)*(m-g)) FROM c, g) AS sc, nu*i.s AS si FROM g, u, i, t)
SELECT {D('su/t', 'share_unit')}, {D('sr/t', 'share_rater')}, {D('sc/t', 'share_cond')}, {D('si/t', 'share_interaction')},
 {D('greatest(t-su-sr-sc-si,0)/t', 'share_residual')}, {D('sr/(sr+sc+si)', 'renorm_rater')}, {D('sc/(sr+sc+si)', 'renorm_cond')}, {D('si/(sr+sc+si)', 'renorm_interaction')} FROM s""",
)
def variance_components(spark, sf_dir):
    return M.variance_components(P.base_panel(spark, sf_dir))


@query(
    "difference_share_by_bin",
    f"""{PANEL}, m AS (SELECT cond, bin, rater, avg(abs_e) AS m FROM panel GROUP BY ALL),
 b AS (SELECT x.cond, x.bin, x.rater AS rater_a, y.rater AS rater_b, x.m AS a, y.m AS b FROM m x JOIN m y ON x.cond=y.cond AND x.bin=y.bin AND x.rater<y.rater)
SELECT cond, rater_a, rater_b, bin, {D('a', 'mae_a')}, {D('b', 'mae_b')}, {D('a-b', 'delta')}, {D('(a-b)/5/avg(a-b) OVER (PARTITION BY cond, rater_a, rater_b)', 'share')}, {D('a/b', 'ratio')} FROM b""",
)
def difference_share_by_bin(spark, sf_dir):
    # A row per condition, bin and rater: vocabularies, whatever the number of units.
    mean = cut_lineage(P.base_panel(spark, sf_dir).groupBy("cond", "bin", "rater").agg(F.avg("abs_e").alias("m")))
    sides = [mean.select("cond", "bin", F.col("rater").alias(f"rater_{s}"), F.col("m").alias(f"mae_{s}")) for s in "ab"]
    pair = sides[0].join(sides[1], ["cond", "bin"]).filter("rater_a < rater_b")
    return M.share_of_difference(pair, ["cond", "rater_a", "rater_b"], "mae_a", "mae_b")


@query(
    "overprediction_feasibility",
    f"""{PANEL}, m AS (SELECT rater, cond, max(pred) AS t FROM panel GROUP BY ALL)
SELECT p.rater, p.cond, bin, {N('count(*)', 'n')}, {N('count(*) FILTER (pred>reference)', 'n_over')}, {D('min(reference)', 'min_reference')},
 {D('max(t)', 'max_pred')}, {N('count(*) FILTER (reference<t)', 'n_feasible')}, min(reference)<max(t) AS possible
FROM panel p JOIN m ON p.rater=m.rater AND p.cond=m.cond GROUP BY p.rater, p.cond, bin""",
)
def overprediction_feasibility(spark, sf_dir):
    return M.feasibility(cut_lineage(P.base_panel(spark, sf_dir)), ["rater", "cond"])


@query(
    "variant_change_counts",
    f"""{PANEL}, d AS (SELECT config, abs(pred_mid-reference)-abs_e AS d FROM panel)
SELECT config, {N('count(*) FILTER (d<0)', 'improved')}, {N('count(*) FILTER (d>0)', 'worsened')}, {N('count(*) FILTER (d=0)', 'unchanged')} FROM d GROUP BY config""",
)
def variant_change_counts(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, variants=True)
    return M.change_counts(panel.withColumn("d", F.abs(F.col("pred_mid") - F.col("reference")) - F.col("abs_e")), ["config"])


@query(
    "extreme_rows",
    f"""{PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY rater, cond, bin ORDER BY abs_e, unit) AS lo,
 row_number() OVER (PARTITION BY rater, cond, bin ORDER BY abs_e DESC, unit) AS hi FROM panel)
SELECT rater, cond, bin, max(CASE WHEN lo=1 THEN unit END) AS best_unit, {D('max(CASE WHEN lo=1 THEN abs_e END)', 'best_e')},
 max(CASE WHEN hi=1 THEN unit END) AS worst_unit, {D('max(CASE WHEN hi=1 THEN abs_e END)', 'worst_e')} FROM r GROUP BY rater, cond, bin""",
)
def extreme_rows(spark, sf_dir):
    out = M.extreme_rows(P.base_panel(spark, sf_dir), ["rater", "cond", "bin"], "abs_e", ["pred"])
    return out.select(
        "rater",
        "cond",
        "bin",
        F.col("best.unit").alias("best_unit"),
        F.col("best.abs_e").alias("best_e"),
        F.col("worst.unit").alias("worst_unit"),
        F.col("worst.abs_e").alias("worst_e"),
    )


@query(
    "nested_variant_steps",
    f"""{P.with_sql(P.PANEL_SQL, P.VARIANT_SQL)}, b AS (SELECT rater, cond, variant, bin, avg(abs_e) AS m FROM variants GROUP BY ALL),
 v AS (SELECT rater, cond, variant, avg(m) AS v FROM b GROUP BY ALL),
 w AS (SELECT rater, cond, max(CASE WHEN variant='base' THEN v END) AS b0, max(CASE WHEN variant='med' THEN v END) AS b1, max(CASE WHEN variant='mid' THEN v END) AS b2 FROM v GROUP BY ALL)
SELECT rater, cond, {D('b0', 'balanced_base')}, {D('b1', 'balanced_med')}, {D('b2', 'balanced_mid')}, {D('b1-b0', 'step_1')}, {D('b2-b1', 'step_2')},
 {D('b2-b0', 'total')}, abs(b1-b0+b2-b1-(b2-b0))<=1e-9 AS identity_holds, {D('100*(b1-b0)/(b2-b0)', 'step_1_percent')} FROM w""",
)
def nested_variant_steps(spark, sf_dir):
    return M.nested_steps(P.variant_panel(spark, sf_dir), ["rater", "cond"], "base", "med", "mid")


@query(
    "configs_under_baseline",
    f"""{PANEL}, u AS (SELECT DISTINCT unit, reference FROM panel), k AS (SELECT avg(abs(reference-m)) AS b FROM u, (SELECT median(reference) AS m FROM u)),
 c AS (SELECT config, avg(abs_e) AS mae FROM panel GROUP BY 1)
SELECT {N('count(*)', 'configs')}, {N('count(*) FILTER (mae<b)', 'under_baseline')}, {D('max(b)', 'baseline_mae')} FROM c, k""",
)
def configs_under_baseline(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    per_unit = M.unit_means(panel, [], [], ["reference", "bin"])
    base = M.constant_baselines(per_unit, {}).filter(F.col("baseline") == "median").agg(F.avg("abs_e").alias("b"))
    configs = panel.groupBy("config").agg(F.avg("abs_e").alias("mae"))
    return attach_totals(configs, base).agg(
        F.count("*").alias("configs"),
        F.count_if(F.col("mae") < F.col("b")).alias("under_baseline"),
        F.max("b").alias("baseline_mae"),
    )


@query(
    "top_two_average",
    f"""{PANEL}, b AS (SELECT rater FROM panel GROUP BY rater ORDER BY avg(abs_e), rater LIMIT 2),
 a AS (SELECT unit, avg(pred) AS pred, min(reference) AS reference FROM panel WHERE rater IN (SELECT rater FROM b) GROUP BY unit)
SELECT unit, {D('pred', 'pred')}, {D('reference', 'reference')}, {D('abs(pred-reference)', 'abs_e')}, abs(pred-reference)>=20 AS flagged FROM a""",
)
def top_two_average(spark, sf_dir):
    return M.top_k_average(P.base_panel(spark, sf_dir), 2, 20.0)


@query(
    "subset_metric",
    f"""{PANEL} SELECT cond, {N('count(*)', 'n')}, {D('avg(abs_e)', 'mae')}, {D('avg(e)', 'bias')} FROM panel
WHERE unit IN (SELECT p_partkey FROM part WHERE p_size % 3 = 2) GROUP BY cond""",
)
def subset_metric(spark, sf_dir):
    wanted = P.covariates(spark, sf_dir).filter(F.col("ord_a") == 2).select("unit")
    return M.subset_metric(P.base_panel(spark, sf_dir), wanted, ["cond"])


@query(
    "condition_subset_reanalysis",
    f"""{PANEL}, b AS (SELECT rater, bin, avg(abs_e) AS m, count(*) AS n FROM panel WHERE cond IN ('F') GROUP BY ALL)
SELECT rater, {D('avg(m)', 'balanced_mae')}, {N('sum(n)', 'n')} FROM b GROUP BY rater""",
)
def condition_subset_reanalysis(spark, sf_dir):
    return M.balanced(P.base_panel(spark, sf_dir).filter(F.col("cond").isin("F")), ["rater"]).select(
        "rater", "balanced_mae", "n"
    )


@query(
    "unit_outliers_by_fence",
    f"""{PANEL}, u AS (SELECT unit, avg(abs_e) AS a FROM panel GROUP BY unit), q AS (SELECT quantile_cont(a,0.75)+1.5*(quantile_cont(a,0.75)-quantile_cont(a,0.25)) AS f FROM u)
SELECT {N('count(*)', 'units')}, {N('count(*) FILTER (a>f)', 'outliers')}, {N('count(*) FILTER (a>20)', 'over_20')}, {D('max(f)', 'fence')} FROM u, q""",
)
def unit_outliers_by_fence(spark, sf_dir):
    per_unit = M.pool_axis(P.base_panel(spark, sf_dir), [])
    q = quantiles(per_unit, [], "abs_e", {"q1": 0.25, "q3": 0.75})
    fence = F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))
    wide = attach_totals(per_unit, q).withColumn("fence", fence)
    return wide.agg(
        F.count("*").alias("units"),
        F.count_if(F.col("abs_e") > F.col("fence")).alias("outliers"),
        F.count_if(F.col("abs_e") > 20).alias("over_20"),
        F.max("fence").alias("fence"),
    )


@query(
    "row_outliers_by_bin_quantile",
    f"""{PANEL}, q AS (SELECT config, bin, quantile_cont(abs_e,0.9) AS q FROM panel GROUP BY ALL)
SELECT p.config, p.bin, {N('count(*) FILTER (abs_e>q)', 'outliers')}, {N('count(*)', 'n')} FROM panel p JOIN q ON p.config=q.config AND p.bin=q.bin GROUP BY ALL""",
)
def row_outliers_by_bin_quantile(spark, sf_dir):
    panel = cut_lineage(P.base_panel(spark, sf_dir))
    q = quantiles(panel, ["config", "bin"], "abs_e", {"q": 0.9})
    return join_bounded(panel, q, ["config", "bin"]).groupBy("config", "bin").agg(
        F.count_if(F.col("abs_e") > F.col("q")).alias("outliers"), F.count("*").alias("n")
    )


@query(
    "standardised_covariates",
    f"""WITH {P.COVARIATE_SQL}, m AS (SELECT avg(cont) AS a, stddev_samp(cont) AS s FROM covs)
SELECT unit, {D('(cont-a)/s', 'z')}, {D('CASE WHEN ord_a=1 THEN 1 ELSE 0 END', 'a_1')}, {D('CASE WHEN ord_a=2 THEN 1 ELSE 0 END', 'a_2')} FROM covs, m""",
)
def standardised_covariates(spark, sf_dir):
    covs = P.covariates(spark, sf_dir)
    one = covs.agg(F.avg("cont").alias("_a"), F.stddev_samp("cont").alias("_s"))
    wide = attach_totals(covs, one).withColumn("z", (F.col("cont") - F.col("_a")) / F.col("_s"))
    return wide.withColumns(C.indicators("ord_a", [0, 1, 2], "a")).select("unit", "z", "a_1", "a_2")
