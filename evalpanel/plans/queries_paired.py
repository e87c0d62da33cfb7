"""Paired contrasts, their tests, and multiplicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalpanel.functions.levels import join_null_safe
from evalpanel.operators import metrics as M
from evalpanel.operators import multiplicity as H
from evalpanel.operators import paired as Q
from evalpanel.plans import panels as P
from evalpanel.plans.registry import D, N, query


def pair_sql(axis: str, within: str = "", source: str = "panel", value: str = "abs_e", name: str = "prs") -> str:
    """CTE of all level pairs per unit; per-unit means first, as the pairs need one value per level."""
    w = f"{within}, " if within else ""
    on = "".join(f" AND l.{c.strip()}=r.{c.strip()}" for c in within.split(",") if within)
    sel = "".join(f"l.{c.strip()}, " for c in within.split(",") if within)
    return f"""{name}_u AS (SELECT {w}unit, bin, {axis} AS lv, avg({value}) AS v FROM {source} GROUP BY ALL),
{name} AS (SELECT {sel}l.unit, l.bin, l.lv AS a, r.lv AS b, l.v AS x, r.v AS y, l.v-r.v AS d FROM {name}_u l JOIN {name}_u r ON l.unit=r.unit{on} AND l.lv<r.lv)"""


def summary_sql(keys: str) -> str:
    return f"""SELECT {keys}, {N('count(*)', 'n')}, {D('avg(x)', 'mean_x')}, {D('avg(y)', 'mean_y')}, {D('avg(d)', 'mean_d')}, {D('median(d)', 'median_d')},
 {N('count(*) FILTER (d<0)', 'n_wins_a')}, {N('count(*) FILTER (d>0)', 'n_wins_b')}, {N('count(*) FILTER (d=0)', 'n_ties')},
 {D('avg(CASE WHEN d<0 THEN 1.0 ELSE 0 END)', 'win_rate_a')}, {D('avg(CASE WHEN d=0 THEN 1.0 ELSE 0 END)', 'tie_rate')},
 avg(CASE WHEN d=0 THEN 1.0 ELSE 0 END) > 0.4 AS tie_burden_exceeded,
 {D('(avg(d*d*d)-3*avg(d)*avg(d*d)+2*power(avg(d),3))/power(avg(d*d)-avg(d)*avg(d),1.5)', 'skew')}"""


def rank_sql(keys: str, source: str = "prs") -> str:
    """CTEs ending in ``sr``: signed-rank sums with zeros ranked, straight from the definition."""
    return f"""rk AS (SELECT {keys}, d, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1)/2.0 AS r,
  count(*) OVER (PARTITION BY {keys}, abs(d)) AS t, count(*) FILTER (d=0) OVER (PARTITION BY {keys}) AS z0 FROM {source}),
ra AS (SELECT {keys}, count(*) AS n, count(*) FILTER (d=0) AS z, sum(CASE WHEN d>0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d<0 THEN r ELSE 0 END) AS wn,
  sum(CASE WHEN d>0 THEN r-z0 ELSE 0 END) AS bp, sum(CASE WHEN d<0 THEN r-z0 ELSE 0 END) AS bn,
  sum(CASE WHEN d<>0 THEN t*t-1.0 ELSE 0 END) AS tt, count(*) FILTER (d<>0 AND t>1) AS nt FROM rk GROUP BY ALL),
sr AS (SELECT *, least(wp,wn) AS st, n*(n+1)/4.0-z*(z+1)/4.0 AS mu, (n*(n+1)*(2*n+1.0)-z*(z+1)*(2*z+1.0)-tt/2.0)/24.0 AS va FROM ra)"""


RANK_COLUMNS = f"""{N('n', 'n_used')}, {N('z', 'n_zero_diff')}, {N('nt', 'n_tied_ranks')}, {D('wp', 'w_plus')}, {D('wn', 'w_minus')}, {D('st', 'statistic')},
 {D('(st-mu-0.5*sign(st-mu))/sqrt(va)', 'z')}, {D('(bp-bn)/(bp+bn)', 'rank_biserial')}"""

SUMMARY_COLUMNS = ["n", "mean_x", "mean_y", "mean_d", "n_wins_a", "n_wins_b", "n_ties", "win_rate_a", "tie_rate", "tie_burden_exceeded", "skew"]


def rater_pairs(spark, sf_dir):
    pooled = M.unit_means(P.base_panel(spark, sf_dir), ["rater"], ["abs_e"], ["bin"])
    return Q.level_pairs(pooled, "rater")


def config_pairs(spark, sf_dir):
    return Q.level_pairs(P.base_panel(spark, sf_dir), "config")


@query("rater_pair_summary", f"{P.with_sql(P.PANEL_SQL, pair_sql('rater'))} {summary_sql('a, b')} FROM prs GROUP BY a, b")
def rater_pair_summary(spark, sf_dir):
    pairs = rater_pairs(spark, sf_dir)
    out = Q.difference_summary(pairs, ["a", "b"])
    med = Q.quantiles(pairs, ["a", "b"], "d", {"median_d": 0.5})
    return join_null_safe(out, med, ["a", "b"]).select("a", "b", "median_d", *SUMMARY_COLUMNS)


@query("config_pair_signed_rank", f"{P.with_sql(P.PANEL_SQL, pair_sql('config'), rank_sql('a, b'))} SELECT a, b, {RANK_COLUMNS} FROM sr")
def config_pair_signed_rank(spark, sf_dir):
    return Q.signed_rank(config_pairs(spark, sf_dir), ["a", "b"])


@query(
    "condition_pair_signed_rank",
    f"{P.with_sql(P.PANEL_SQL, pair_sql('cond', 'rater'), rank_sql('rater, a, b'))} SELECT rater, a, b, {RANK_COLUMNS} FROM sr",
)
def condition_pair_signed_rank(spark, sf_dir):
    return Q.signed_rank(Q.level_pairs(P.base_panel(spark, sf_dir), "cond", within=["rater"]), ["rater", "a", "b"])


@query(
    "config_pair_balanced_difference",
    f"""{P.with_sql(P.PANEL_SQL, pair_sql('config'))}, b AS (SELECT a, b, bin, avg(x) AS x, avg(y) AS y FROM prs GROUP BY ALL)
SELECT a, b, {D('avg(x)', 'balanced_x')}, {D('avg(y)', 'balanced_y')}, {D('avg(x)-avg(y)', 'delta_balanced')} FROM b GROUP BY a, b""",
)
def config_pair_balanced_difference(spark, sf_dir):
    return Q.balanced_difference(config_pairs(spark, sf_dir), ["a", "b"])


@query(
    "hodges_lehmann_raters",
    f"""{P.with_sql(P.PANEL_SQL, pair_sql('rater'))}
SELECT l.a, l.b, {D('median((l.d+r.d)/2)', 'hodges_lehmann')} FROM prs l JOIN prs r ON l.a=r.a AND l.b=r.b AND l.unit<=r.unit GROUP BY l.a, l.b""",
)
def hodges_lehmann_raters(spark, sf_dir):
    return Q.hodges_lehmann(rater_pairs(spark, sf_dir), ["a", "b"])


@query(
    "variant_contrasts",
    f"""{P.with_sql(P.PANEL_SQL, P.VARIANT_SQL, pair_sql('variant', 'config', 'variants'), rank_sql('config, a, b'))}
SELECT config, a, b, {RANK_COLUMNS} FROM sr""",
)
def variant_contrasts(spark, sf_dir):
    pairs = Q.level_pairs(P.variant_panel(spark, sf_dir), "variant", within=["config"])
    return Q.signed_rank(pairs, ["config", "a", "b"])


@query(
    "variant_contrasts_by_bin",
    f"""{P.with_sql(P.PANEL_SQL, P.VARIANT_SQL, pair_sql('variant', 'rater', 'variants'))}
SELECT rater, a, b, bin, {N('count(*)', 'n')}, {D('avg(x)', 'mean_x')}, {D('avg(y)', 'mean_y')}, {D('avg(d)', 'mean_d')} FROM prs GROUP BY rater, a, b, bin""",
)
def variant_contrasts_by_bin(spark, sf_dir):
    pooled = M.unit_means(P.variant_panel(spark, sf_dir), ["rater", "variant"], ["abs_e"], ["bin"])
    return Q.by_bin(Q.level_pairs(pooled, "variant", within=["rater"]), ["rater", "a", "b"])


@query(
    "path_contrasts",
    f"""{P.with_sql(P.PANEL_SQL, P.PATH_SQL)}, prs AS (SELECT rater, cond, abs_e AS x, abs_e2 AS y, abs_e-abs_e2 AS d FROM paths),
{rank_sql('rater, cond')} SELECT rater, cond, {RANK_COLUMNS} FROM sr""",
)
def path_contrasts(spark, sf_dir):
    paths = P.path_panel(spark, sf_dir)
    pairs = paths.select("rater", "cond", F.col("abs_e").alias("x"), F.col("abs_e2").alias("y"), (F.col("abs_e") - F.col("abs_e2")).alias("d"))
    return Q.signed_rank(pairs, ["rater", "cond"])


@query(
    "baseline_contrasts",
    f"""{P.with_sql(P.PANEL_SQL)}, m AS (SELECT median(reference) AS c FROM (SELECT DISTINCT unit, reference FROM panel)),
 u AS (SELECT rater, unit, bin, avg(e) AS e, avg(abs_e) AS a, min(c-reference) AS be, abs(min(c-reference)) AS ba FROM panel, m GROUP BY ALL),
 b AS (SELECT rater, bin, avg(a) AS a, avg(ba) AS ba FROM u GROUP BY ALL), bb AS (SELECT rater, avg(a)-avg(ba) AS db FROM b GROUP BY rater),
 o AS (SELECT rater, count(*) AS n, avg(a)-avg(ba) AS dm, sqrt(avg(e*e))-sqrt(avg(be*be)) AS dr, avg(e) AS bi, avg(be) AS bb FROM u GROUP BY rater)
SELECT o.rater, {N('n', 'n')}, {D('db', 'delta_balanced')}, {D('dm', 'delta_mae')}, {D('dr', 'delta_rmse')}, {D('bi', 'bias')}, {D('bb', 'base_bias')},
 {D('abs(bi)-abs(bb)', 'delta_abs_bias')}, sign(bi)*sign(bb)<0 AS opposed FROM o JOIN bb ON o.rater=bb.rater""",
)
def baseline_contrasts(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    per_unit = M.unit_means(panel, [], [], ["reference", "bin"])
    base = M.constant_baselines(per_unit, {}).filter(F.col("baseline") == "median")
    base = base.select("unit", F.col("e").alias("base_e"), F.col("abs_e").alias("base_abs_e"))
    return Q.baseline_contrast(panel, base, ["rater"])


@query(
    "holm_over_config_pairs",
    f"""{P.with_sql(P.PANEL_SQL, pair_sql('config'), rank_sql('a, b'))}, p AS (SELECT a, b, 1/(1+abs((st-mu-0.5*sign(st-mu))/sqrt(va))) AS p FROM sr),
 o AS (SELECT *, row_number() OVER (ORDER BY p) AS rn FROM p), s AS (SELECT *, least(1.0, p*(20-rn+1)) AS s FROM o)
SELECT a, b, {D('p', 'p')}, {D('max(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)', 'p_holm')}, {N('20', 'family_size')} FROM s""",
)
def holm_over_config_pairs(spark, sf_dir):
    # A monotone stand-in for the p-value keeps the step-down checkable in plain SQL.
    tests = Q.signed_rank(config_pairs(spark, sf_dir), ["a", "b"])
    p = tests.select("a", "b", F.lit("configs").alias("family"), (F.lit(1.0) / (F.lit(1.0) + F.abs("z"))).alias("p"))
    return H.holm(p, "p", ["family"], {"configs": 20}).drop("family")


@query("full_contrast_rows")
def full_contrast_rows(spark, sf_dir):
    table = Q.contrast_table(rater_pairs(spark, sf_dir), ["a", "b"])
    fam = table.withColumn("family", F.lit("raters"))
    return H.require_columns(H.holm(fam, "wilcoxon_p", ["family"], {"raters": 3}), H.CONTRAST_COLUMNS)


@query(
    "repeat_floor",
    f"""WITH r AS (SELECT l_partkey AS unit, l_returnflag AS rater, CASE WHEN l_linenumber%2=1 THEN 1 ELSE 2 END AS run, avg(l_quantity) AS p FROM lineitem GROUP BY ALL),
 d AS (SELECT a.rater, abs(a.p-b.p) AS d FROM r a JOIN r b ON a.unit=b.unit AND a.rater=b.rater AND a.run=1 AND b.run=2)
SELECT rater, {N('count(*)', 'n')}, {N('count(*) FILTER (d=0)', 'n_exact')}, {D('avg(d)', 'floor')}, {D('max(d)', 'max_diff')},
 {D('median(CASE WHEN d>0 THEN d END)', 'median_nonzero')} FROM d GROUP BY rater""",
)
def repeat_floor(spark, sf_dir):
    return Q.repeat_floor(P.repeat_runs(spark, sf_dir))


@query(
    "effects_within_floor",
    f"""{P.with_sql(P.PANEL_SQL, pair_sql('cond', 'rater'))}, r AS (SELECT l_partkey AS unit, l_returnflag AS rater, CASE WHEN l_linenumber%2=1 THEN 1 ELSE 2 END AS run, avg(l_quantity) AS p FROM lineitem GROUP BY ALL),
 f AS (SELECT a.rater, avg(abs(a.p-b.p)) AS floor FROM r a JOIN r b ON a.unit=b.unit AND a.rater=b.rater AND a.run=1 AND b.run=2 GROUP BY a.rater),
 e AS (SELECT rater, a, b, avg(d) AS mean_d FROM prs GROUP BY ALL)
SELECT e.rater, a, b, {D('mean_d', 'mean_d')}, {D('floor', 'floor')}, abs(mean_d)<floor AS within_floor FROM e JOIN f ON e.rater=f.rater""",
)
def effects_within_floor(spark, sf_dir):
    pairs = Q.level_pairs(P.base_panel(spark, sf_dir), "cond", within=["rater"])
    effects = pairs.groupBy("rater", "a", "b").agg(F.avg("d").alias("mean_d"))
    return Q.within_floor(effects, Q.repeat_floor(P.repeat_runs(spark, sf_dir)), "rater", "mean_d").drop("floor_note")


@query(
    "family_confounds",
    f"""{P.with_sql(P.PANEL_SQL, pair_sql('rater'))}, k AS (SELECT DISTINCT a, b FROM prs)
SELECT a, b, (a='R') <> (b='R') AS confounded FROM k""",
)
def family_confounds(spark, sf_dir):
    from evalpanel.functions.columns import pair_confounded

    family = lambda c: F.when(F.col(c) == "R", "x").otherwise("y")
    pairs = rater_pairs(spark, sf_dir).select("a", "b").distinct()
    return pairs.withColumn("confounded", pair_confounded(family("a"), family("b")))
