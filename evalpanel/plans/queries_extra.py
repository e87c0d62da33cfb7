"""Sensitivity, rank-difference, coercion and scoping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalpanel.functions import columns as C
from evalpanel.functions.levels import join_null_safe
from evalpanel.operators import contracts as K
from evalpanel.operators import extract as X
from evalpanel.operators import intervals as I
from evalpanel.operators import metrics as M
from evalpanel.operators import ranks as R
from evalpanel.operators import resample as B
from evalpanel.plans import panels as P
from evalpanel.plans.queries_ranks import mid
from evalpanel.plans.queries_resample import draw_sql, index_sql
from evalpanel.plans.registry import D, N, query

PANEL = P.with_sql(P.PANEL_SQL)
PATHS = P.with_sql(P.PANEL_SQL, P.PATH_SQL)


@query(
    "spearman_difference_of_paths",
    f"""{PATHS}, r AS (SELECT rater, {mid('pred', 'rater')} AS a, {mid('pred2', 'rater')} AS b, {mid('reference', 'rater')} AS c FROM paths)
SELECT rater, {D('corr(a,c)', 'rho')}, {D('corr(b,c)', 'base_rho')}, {D('corr(a,c)-corr(b,c)', 'delta_rho')} FROM r GROUP BY rater""",
)
def spearman_difference_of_paths(spark, sf_dir):
    return R.spearman_difference(P.path_panel(spark, sf_dir), ["rater"], "pred", "pred2", "reference")


@query(
    "flagged_row_sensitivity",
    f"""{PANEL}, x AS (SELECT 'all' AS rows_used, * FROM panel UNION ALL SELECT 'without_flagged', * FROM panel WHERE conf IS NOT NULL AND conf>=0.7),
 b AS (SELECT rows_used, rater, bin, count(*) AS n, avg(abs_e) AS m FROM x GROUP BY ALL)
SELECT rows_used, rater, {N('sum(n)', 'n')}, {D('avg(m)', 'balanced_mae')} FROM b GROUP BY rows_used, rater""",
)
def flagged_row_sensitivity(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, scores=True)
    flag = C.unusable_score("conf") | (F.col("conf") < 0.7)
    return M.with_and_without(panel, flag, lambda df: M.balanced(df, ["rater"]).select("rater", "n", "balanced_mae"))


@query(
    "unusable_scores_by_rater",
    f"""{PANEL} SELECT rater, {N('count(*) FILTER (conf IS NULL)', 'n_unusable')}, {N('count(*)', 'n')} FROM panel GROUP BY rater""",
)
def unusable_scores_by_rater(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, scores=True)
    return panel.groupBy("rater").agg(F.count_if(C.unusable_score("conf")).alias("n_unusable"), F.count("*").alias("n"))


@query(
    "coerced_numbers",
    f"""WITH t AS (SELECT event_id, CASE WHEN event_id%3=0 THEN json_extract_string(props,'$.k') ELSE event_type END AS s FROM events)
SELECT event_id, {D('TRY_CAST(s AS DOUBLE)', 'number')} FROM t""",
)
def coerced_numbers(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).otherwise(F.col("event_type"))
    return P.table(spark, sf_dir, "events").select("event_id", C.numeric_or_null(text).alias("number"))


@query(
    "deduplicated_names",
    f"""WITH t AS (SELECT lower(trim(' '||upper(p_name)||' ')) AS name, p_partkey, p_retailprice FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS rn FROM t)
SELECT name, p_partkey, {D('p_retailprice', 'p_retailprice')} FROM r WHERE rn=1""",
)
def deduplicated_names(spark, sf_dir):
    messy = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))
    part = P.table(spark, sf_dir, "part").select(C.normal_name(messy).alias("name"), "p_partkey", "p_retailprice")
    return X.first_by(part, ["name"], ["p_partkey"])


@query(
    "relative_skill_of_paths",
    f"""{PATHS}, u AS (SELECT unit, avg(abs_e) AS m, avg(abs_e2) AS b FROM paths GROUP BY unit)
SELECT unit, {D('CASE WHEN m+b>0 THEN (b-m)/(b+m) ELSE 0 END', 'skill')}, (CASE WHEN m+b>0 THEN (b-m)/(b+m) ELSE 0 END > 0) = (m < b) AS sign_holds FROM u""",
)
def relative_skill_of_paths(spark, sf_dir):
    per_unit = P.path_panel(spark, sf_dir).groupBy("unit").agg(F.avg("abs_e").alias("m"), F.avg("abs_e2").alias("b"))
    skill = C.relative_skill("m", "b")
    return per_unit.select("unit", skill.alias("skill"), ((skill > 0) == (F.col("m") < F.col("b"))).alias("sign_holds"))


@query(
    "pair_percentage_summary",
    f"""{PANEL}, {index_sql()}, {draw_sql(95, 60)}, rw AS (SELECT d.rep, i.unit FROM dr d JOIN ix i ON d.idx=i.idx),
 s0 AS (SELECT config, 0 AS rep, conf, bin=0 AS f FROM panel WHERE conf IS NOT NULL UNION ALL SELECT config, rep, conf, bin=0 FROM rw JOIN panel p ON rw.unit=p.unit WHERE conf IS NOT NULL),
 l AS (SELECT config, rep, conf, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM s0 GROUP BY ALL),
 t AS (SELECT config, rep, sum(a) AS na, sum(b) AS nb FROM l GROUP BY ALL),
 p AS (SELECT x.config, x.rep, 100*sum(CASE WHEN x.conf<y.conf THEN x.a*y.b WHEN x.conf=y.conf THEN x.a*y.b/2.0 ELSE 0 END)/(max(na)*max(nb)) AS pct
  FROM l x JOIN l y ON x.config=y.config AND x.rep=y.rep JOIN t ON t.config=x.config AND t.rep=x.rep GROUP BY x.config, x.rep),
 c AS (SELECT config, max(CASE WHEN rep=0 THEN pct END) AS pct, quantile_cont(CASE WHEN rep>0 THEN pct END, 0.025) AS lo, quantile_cont(CASE WHEN rep>0 THEN pct END, 0.975) AS hi FROM p GROUP BY config)
SELECT 'bottom bin' AS feature, {D('median(pct)', 'median_pct')}, {D('min(pct)', 'min_pct')}, {D('max(pct)', 'max_pct')}, {N('count(*) FILTER (lo>50)', 'n_above')}, {N('count(*) FILTER (hi<50)', 'n_below')} FROM c""",
)
def pair_percentage_summary(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, scores=True).withColumn("low", F.col("bin") == 0)
    weights = B.draws(B.unit_index(panel.select("unit").distinct(), hasher="md5"), 95, 60, hasher="md5")
    stars = R.pair_percentage(B.weighted_rows(panel, weights), ["config", "rep"], "conf", "low", "w")
    intervals = I.percentile_interval(stars.withColumnRenamed("pct_lower", "theta"), ["config"])
    cells = join_null_safe(R.pair_percentage(panel, ["config"], "conf", "low"), intervals, ["config"])
    return R.percentage_summary(cells.withColumn("feature", F.lit("bottom bin")), ["feature"])


@query(
    "baseline_join_guard",
    f"""{PANEL} SELECT 'one row per unit' AS check_id, count(*)=count(DISTINCT unit) AS passed FROM (SELECT unit, avg(abs_e) FROM panel GROUP BY unit)
UNION ALL SELECT 'panel rows repeat units', count(*)=count(DISTINCT unit) FROM panel""",
)
def baseline_join_guard(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    checks = K.Expectations().add(
        K.unique_key(M.pool_axis(panel, []), "one row per unit", ["unit"]),
        K.unique_key(panel, "panel rows repeat units", ["unit"], severity=K.REPORT),
    )
    return checks.run().select("check_id", "passed")


@query(
    "panel_losses",
    f"""{P.with_sql(P.PANEL_SQL, P.PATH_SQL)}, r AS (SELECT c.rater, c.cond, CASE WHEN f.unit IS NULL THEN 'i' WHEN p.p_partkey IS NULL THEN 'n' WHEN b.unit IS NULL THEN 's' ELSE 'k' END AS why
 FROM cells c LEFT JOIN complete f ON c.unit=f.unit LEFT JOIN part p ON p.p_partkey=c.unit LEFT JOIN path2 b ON b.unit=c.unit AND b.rater=c.rater AND b.cond=c.cond)
SELECT rater, cond, {N('count(*)', 'n')}, {N("count(*) FILTER (why='k')", 'kept')}, {N("count(*) FILTER (why='i')", 'incomplete_unit')}, {N("count(*) FILTER (why='n')", 'no_reference')}, {N("count(*) FILTER (why='s')", 'not_on_second_path')} FROM r GROUP BY rater, cond""",
)
def panel_losses(spark, sf_dir):
    return P.panel_losses(spark, sf_dir)
