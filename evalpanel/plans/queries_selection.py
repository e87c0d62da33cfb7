"""Cutoff sweeps and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalpanel.operators import cutoffs as C
from evalpanel.operators import ensembles as E
from evalpanel.plans import panels as P
from evalpanel.plans.queries_resample import u_sql
from evalpanel.plans.interval_sql import bca_ctes, poisson_weights_sql
from evalpanel.plans.registry import D, N, query
from evalpanel.session import cut_lineage

PANEL = P.with_sql(P.PANEL_SQL)


def sweep_sql(keep: bool) -> str:
    cond = "p.conf IS NULL OR p.conf>=k.cutoff" if keep else "p.conf>=k.cutoff OR k.cutoff IS NULL"
    rows = "panel" if keep else "(SELECT * FROM panel WHERE conf IS NOT NULL)"
    cuts = "SELECT DISTINCT config, conf AS cutoff FROM panel WHERE conf IS NOT NULL"
    if not keep:
        cuts += " UNION ALL SELECT DISTINCT config, NULL FROM panel WHERE conf IS NOT NULL"
    return f"""{PANEL}, k AS ({cuts}), r AS (SELECT k.config, k.cutoff, p.bin, count(*) AS n, sum(abs_e) AS s FROM k JOIN {rows} p ON k.config=p.config AND ({cond}) GROUP BY ALL),
 t AS (SELECT config, count(*) AS nt FROM {rows} GROUP BY config), u AS (SELECT config, count(*) FILTER (conf IS NULL) AS nu FROM panel GROUP BY config)
SELECT r.config, {D('cutoff', 'cutoff')}, {N('sum(n)', 'n_retained')}, {D('sum(s)/sum(n)', 'mae')}, {D('CASE WHEN count(*)=5 THEN avg(s/n) END', 'balanced_mae')},
 {N('CASE WHEN count(*)=5 THEN min(n) ELSE 0 END', 'smallest_bin')}, {D('sum(CASE WHEN bin=0 THEN n ELSE 0 END)/sum(n)', 'bottom_share')}, {N('max(nt)', 'n_total')}, {N('max(nu)', 'n_unusable')}, {D('sum(n)/max(nt)', 'retained_fraction')}
FROM r JOIN t ON r.config=t.config JOIN u ON r.config=u.config GROUP BY r.config, cutoff"""


@query("cutoff_sweep_keep_missing", sweep_sql(True))
def cutoff_sweep_keep_missing(spark, sf_dir):
    return C.cutoff_sweep(P.base_panel(spark, sf_dir, scores=True), ["config"], "conf", "keep")


@query("cutoff_sweep_drop_missing", sweep_sql(False))
def cutoff_sweep_drop_missing(spark, sf_dir):
    return C.cutoff_sweep(P.base_panel(spark, sf_dir, scores=True), ["config"], "conf", "drop")


REPRESENTATIVE = f"""{PANEL}, s AS (SELECT config, conf, abs_e, bin FROM panel WHERE conf IS NOT NULL),
 k AS (SELECT a.config, a.cutoff, count(*) FILTER (s.conf>=a.cutoff)/count(*) AS f FROM (SELECT DISTINCT config, conf AS cutoff FROM s) a JOIN s ON a.config=s.config GROUP BY ALL),
 c AS (SELECT config, cutoff, f FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY round(abs(f-0.5),9), cutoff DESC) AS rn FROM k) WHERE rn=1)"""


@query("representative_cutoff", f"{REPRESENTATIVE} SELECT config, {D('cutoff', 'cutoff')}, {D('f', 'retained_fraction')} FROM c")
def representative_cutoff(spark, sf_dir):
    return C.representative_cutoff(C.cutoff_sweep(P.base_panel(spark, sf_dir, scores=True), ["config"], "conf", "drop"), ["config"])


@query(
    "error_before_and_after_cutoff",
    f"""{REPRESENTATIVE} SELECT s.config, bin, {N('count(*)', 'n_before')}, {D('avg(abs_e)', 'mae_before')}, {N('count(*) FILTER (conf>=cutoff)', 'n_after')},
 {D('avg(CASE WHEN conf>=cutoff THEN abs_e END)', 'mae_after')} FROM s JOIN c ON s.config=c.config GROUP BY s.config, bin""",
)
def error_before_and_after_cutoff(spark, sf_dir):
    panel = cut_lineage(P.base_panel(spark, sf_dir, scores=True))
    chosen = C.representative_cutoff(C.cutoff_sweep(panel, ["config"], "conf", "drop"), ["config"])
    return C.before_and_after(panel, chosen, ["config"], "conf")


def sweep_bca_sql(keep: bool, seed: int, reps: int) -> str:
    """Every cutoff in every replicate, and every unit left out at every cutoff, by plain joins."""
    stay = "(conf>=cutoff OR conf IS NULL)" if keep else "(conf>=cutoff OR (cutoff IS NULL AND conf IS NOT NULL))"
    retain_all = "" if keep else " UNION ALL SELECT DISTINCT config, NULL FROM panel WHERE conf IS NOT NULL"
    fallback = "EXISTS (SELECT 1 FROM pt WHERE pt.config=n14.config AND pt.cutoff IS NOT DISTINCT FROM n14.cutoff AND pt.n_retained=1)"
    low, high = (f"quantile_cont(CASE WHEN bins=5 THEN balanced END, {q})" for q in (0.025, 0.975))
    return f"""{PANEL}, un AS (SELECT DISTINCT unit FROM panel), {poisson_weights_sql(u_sql(seed, 'unit', 'rep'), reps)},
 g AS (SELECT DISTINCT config, conf AS cutoff FROM panel WHERE conf IS NOT NULL{retain_all}),
 kr AS (SELECT g.config, g.cutoff, p.unit, p.bin, p.abs_e FROM g JOIN panel p ON p.config=g.config AND {stay}),
 pt AS (SELECT config, cutoff, count(*) AS n_retained, sum(abs_e) AS s, avg(abs_e) AS theta_hat FROM kr GROUP BY ALL),
 al AS (SELECT pt.*, p.unit FROM pt JOIN (SELECT DISTINCT config, unit FROM panel) p ON p.config=pt.config),
 jk AS (SELECT al.config, al.cutoff, (al.s-coalesce(kr.abs_e, 0))/nullif(al.n_retained-(kr.unit IS NOT NULL)::INT, 0) AS j
  FROM al LEFT JOIN kr ON kr.config=al.config AND kr.cutoff IS NOT DISTINCT FROM al.cutoff AND kr.unit=al.unit),
 jm AS (SELECT config, cutoff, avg(j) AS m FROM jk GROUP BY ALL),
 ac AS (SELECT a.config, a.cutoff, CASE WHEN count(*)=count(j) AND sum(power(m-j,2))>1e-27 THEN sum(power(m-j,3))/(6*power(sum(power(m-j,2)),1.5)) END AS accel
  FROM jk a JOIN jm b ON a.config=b.config AND a.cutoff IS NOT DISTINCT FROM b.cutoff GROUP BY ALL),
 tb AS (SELECT config, cutoff, rep, bin, sum(w) AS n, sum(w*abs_e) AS s FROM kr JOIN pw USING (unit) WHERE w>0 GROUP BY ALL),
 tr AS (SELECT config, cutoff, rep, sum(s)/sum(n) AS theta, avg(s/n) AS balanced, count(*) AS bins FROM tb GROUP BY ALL),
 th AS (SELECT g.config, g.cutoff, r.rep, theta, balanced, bins FROM g CROSS JOIN range(1,{reps + 1}) r(rep) LEFT JOIN tr ON tr.config=g.config AND tr.cutoff IS NOT DISTINCT FROM g.cutoff AND tr.rep=r.rep),
 bl AS (SELECT config, cutoff, {low} AS lo, {high} AS hi, 1-count(*) FILTER (bins=5)/count(*) AS miss FROM th GROUP BY ALL),
 {bca_ctes('config, cutoff', fallback=fallback)}
SELECT bc.config, {D('bc.cutoff', 'cutoff')}, {N('pt.n_retained', 'n_retained')}, {D('bc.theta_hat', 'theta_hat')}, {D('bc.accel', 'accel')}, {D('ci_lo', 'ci_lo')}, {D('ci_hi', 'ci_hi')},
 CASE WHEN is_bca THEN 'BCa' ELSE 'percentile (BCa fallback)' END || CASE WHEN pt.n_retained<30 THEN ', degenerate: n < 30' ELSE '' END AS ci_method, {N('bc.n', 'n_defined')}, {D('1-bc.n/bc.reps', 'undefined_share')},
 {D('bl.lo', 'balanced_lo')}, {D('bl.hi', 'balanced_hi')}, {D('bl.miss', 'balanced_undefined_share')}
FROM bc JOIN pt ON pt.config=bc.config AND pt.cutoff IS NOT DISTINCT FROM bc.cutoff JOIN bl ON bl.config=bc.config AND bl.cutoff IS NOT DISTINCT FROM bc.cutoff"""


@query("cutoff_sweep_intervals", sweep_bca_sql(False, 61, 60))
def cutoff_sweep_intervals(spark, sf_dir):
    return C.sweep_intervals(P.base_panel(spark, sf_dir, scores=True), ["config"], "conf", "drop", 60, 61, hasher="md5")


@query("cutoff_sweep_intervals_keep_missing", sweep_bca_sql(True, 62, 60))
def cutoff_sweep_intervals_keep_missing(spark, sf_dir):
    return C.sweep_intervals(P.base_panel(spark, sf_dir, scores=True), ["config"], "conf", "keep", 60, 62, hasher="md5")


# ---- ensembles ----

FOLDS_SQL = f"""{PANEL}, un AS (SELECT DISTINCT unit, bin FROM panel), rp AS (SELECT CAST(rep AS INTEGER) AS rep FROM range(1,4) t(rep)),
 fo AS (SELECT rep, unit, bin, (row_number() OVER (PARTITION BY rep, bin ORDER BY {u_sql(71, 'rep', 'unit')})-1)%5 AS fold FROM un, rp)"""

SELECT_SQL = f"""{FOLDS_SQL}, tr AS (SELECT f.rep, f.fold, p.rater, p.cond, p.bin, p.e, p.abs_e FROM panel p JOIN
  (SELECT g.rep, g.unit, x.fold FROM fo g, (SELECT unnest(range(5)) AS fold) x WHERE g.fold<>x.fold) f ON p.unit=f.unit),
 rb AS (SELECT rep, fold, rater, bin, count(*) AS n, sum(abs_e) AS a, sum(e) AS b FROM tr GROUP BY ALL),
 rm AS (SELECT rep, fold, rater, avg(a/n) AS bal, sum(a)/sum(n) AS ov, abs(sum(b)/sum(n)) AS bi FROM rb GROUP BY ALL),
 ra AS (SELECT *, 'overall' AS arm, ov AS m1, bal AS m2 FROM rm UNION ALL SELECT *, 'balanced', bal, ov FROM rm),
 rr AS (SELECT rep, fold, arm, rater, row_number() OVER (PARTITION BY rep, fold, arm ORDER BY round(m1,12), round(m2,12), round(bi,12), rater) AS place FROM ra),
 cb AS (SELECT rep, fold, rater, cond, bin, count(*) AS n, sum(abs_e) AS a, sum(e) AS b FROM tr GROUP BY ALL),
 cm AS (SELECT rep, fold, rater, cond, avg(a/n) AS bal, sum(a)/sum(n) AS ov, abs(sum(b)/sum(n)) AS bi FROM cb GROUP BY ALL),
 ca AS (SELECT *, 'overall' AS arm, ov AS m1, bal AS m2 FROM cm UNION ALL SELECT *, 'balanced', bal, ov FROM cm),
 co AS (SELECT rep, fold, arm, rater, cond, row_number() OVER (PARTITION BY rep, fold, arm, rater ORDER BY round(m1,12), round(m2,12), round(bi,12), cond) AS place FROM ca),
 cfg AS (SELECT DISTINCT rater, cond, config FROM panel),
 mem AS (
  SELECT rep, fold, rater||' x '||cond AS name, 'none' AS selection, config FROM (SELECT DISTINCT rep, fold FROM fo), cfg
  UNION ALL SELECT rep, fold, rater||' x all2C', arm, config FROM (SELECT DISTINCT rep, fold, arm FROM rr), cfg
  UNION ALL SELECT r.rep, r.fold, 'top2R x '||cond, arm, config FROM rr r JOIN cfg ON r.rater=cfg.rater WHERE place<=2
  UNION ALL SELECT r.rep, r.fold, 'top2R x all2C', arm, config FROM rr r JOIN cfg ON r.rater=cfg.rater WHERE place<=2
  UNION ALL SELECT rep, fold, 'all3R x '||cond, arm, config FROM (SELECT DISTINCT rep, fold, arm FROM rr), cfg
  UNION ALL SELECT rep, fold, 'all3R x all2C', arm, config FROM (SELECT DISTINCT rep, fold, arm FROM rr), cfg
  UNION ALL SELECT r.rep, r.fold, 'top2R@own', r.arm, r.rater||'|'||c.cond FROM rr r JOIN co c ON r.rep=c.rep AND r.fold=c.fold AND r.arm=c.arm AND r.rater=c.rater AND c.place=1 WHERE r.place<=2
  UNION ALL SELECT rep, fold, 'all3R@own', arm, rater||'|'||cond FROM co WHERE place=1)"""


def ensemble_inputs(spark, sf_dir, repeats: int = 3):
    panel = cut_lineage(P.base_panel(spark, sf_dir))
    folds = E.stratified_folds(panel.select("unit", "bin").distinct(), 5, repeats, 71, hasher="md5")
    picks = E.selections(E.fold_sums(panel, folds))
    members = E.membership(picks, P.RATERS, P.CONDITIONS)
    return panel, folds, picks, members


@query("stratified_folds", f"{FOLDS_SQL} SELECT {N('rep', 'rep')}, unit, bin, {N('fold', 'fold')} FROM fo")
def stratified_folds(spark, sf_dir):
    return ensemble_inputs(spark, sf_dir)[1].select("rep", "unit", "bin", "fold")


@query("training_bin_sizes", f"{FOLDS_SQL}, c AS (SELECT rep, fold, bin, count(*) AS n FROM fo GROUP BY ALL) SELECT {N('rep', 'rep')}, {N('fold', 'fold')}, bin, {N('sum(n) OVER (PARTITION BY rep, bin)-n', 'n_train')} FROM c")
def training_bin_sizes(spark, sf_dir):
    return E.training_bin_sizes(ensemble_inputs(spark, sf_dir)[1])


@query("in_fold_rater_ranking", f"{SELECT_SQL} SELECT {N('rep', 'rep')}, {N('fold', 'fold')}, arm, rater, {N('place', 'place')} FROM rr")
def in_fold_rater_ranking(spark, sf_dir):
    panel, folds, _, _ = ensemble_inputs(spark, sf_dir)
    return E.rank_levels(E.fold_sums(panel, folds), ["rater"]).drop("tied")


@query("ensemble_membership", f"{SELECT_SQL} SELECT {N('rep', 'rep')}, {N('fold', 'fold')}, name, selection, string_agg(config, ',' ORDER BY config) AS members FROM mem GROUP BY rep, fold, name, selection")
def ensemble_membership(spark, sf_dir):
    members = ensemble_inputs(spark, sf_dir)[3]
    return members.select("rep", "fold", "name", "selection", F.concat_ws(",", "members").alias("members"))


@query(
    "ensemble_out_of_fold",
    f"""{SELECT_SQL} SELECT {N('f.rep', 'rep')}, f.unit, name, selection, {D('avg(pred)', 'pred')} FROM fo f JOIN mem m ON f.rep=m.rep AND f.fold=m.fold JOIN panel p ON p.unit=f.unit AND p.config=m.config
GROUP BY f.rep, f.unit, name, selection""",
)
def ensemble_out_of_fold(spark, sf_dir):
    panel, folds, _, members = ensemble_inputs(spark, sf_dir)
    return E.out_of_fold(panel, folds, members).select("rep", "unit", "name", "selection", "pred")


ENSEMBLE_METRICS_SQL = f"""{SELECT_SQL}, oo AS (SELECT f.rep, f.unit, f.bin, name, selection, avg(pred)-min(reference) AS e FROM fo f JOIN mem m ON f.rep=m.rep AND f.fold=m.fold
  JOIN panel p ON p.unit=f.unit AND p.config=m.config GROUP BY ALL),
 ob AS (SELECT rep, name, selection, bin, count(*) AS n, sum(abs(e)) AS a, sum(e) AS b FROM oo GROUP BY ALL),
 om AS (SELECT rep, name, selection, sum(n) AS n, sum(a)/sum(n) AS overall, avg(a/n) AS balanced, sum(b)/sum(n) AS bias FROM ob GROUP BY ALL)"""


@query("ensemble_metrics", f"{ENSEMBLE_METRICS_SQL} SELECT {N('rep', 'rep')}, name, selection, {N('n', 'n')}, {D('overall', 'overall')}, {D('balanced', 'balanced')}, {D('bias', 'bias')} FROM om")
def ensemble_metrics(spark, sf_dir):
    panel, folds, _, members = ensemble_inputs(spark, sf_dir)
    return E.ensemble_metrics(panel, folds, members)


@query(
    "ensemble_over_repeats",
    f"""{ENSEMBLE_METRICS_SQL} SELECT name, selection, {', '.join(D(f'{f}({c})', f'{n}_{c}') for c in ('overall', 'balanced') for n, f in (('mean', 'avg'), ('median', 'median'), ('min', 'min'), ('max', 'max')))},
 {D('avg(bias)', 'mean_bias')}, {N('count(*)', 'repeats')} FROM om GROUP BY name, selection""",
)
def ensemble_over_repeats(spark, sf_dir):
    panel, folds, _, members = ensemble_inputs(spark, sf_dir)
    return E.over_repeats(E.ensemble_metrics(panel, folds, members))


@query(
    "ensemble_rank_distribution",
    f"""{ENSEMBLE_METRICS_SQL}, ar AS (SELECT rep, name, 'overall' AS arm, round(overall,9) AS v FROM om WHERE selection IN ('none','overall') UNION ALL SELECT rep, name, 'balanced', round(balanced,9) FROM om WHERE selection IN ('none','balanced')),
 rk AS (SELECT arm, name, rank() OVER (PARTITION BY rep, arm ORDER BY v)+(count(*) OVER (PARTITION BY rep, arm, v)-1)/2.0 AS r FROM ar)
SELECT arm, name, {D('median(r)', 'median_rank')}, {D('min(r)', 'best_rank')}, {D('max(r)', 'worst_rank')}, {D('avg(CASE WHEN r=1 THEN 1.0 ELSE 0 END)', 'share_first')} FROM rk GROUP BY arm, name""",
)
def ensemble_rank_distribution(spark, sf_dir):
    panel, folds, _, members = ensemble_inputs(spark, sf_dir)
    return E.rank_distribution(E.ensemble_metrics(panel, folds, members))


@query(
    "selection_stability",
    f"""{SELECT_SQL}, nf AS (SELECT count(*) AS k FROM (SELECT DISTINCT rep, fold FROM fo)), cx AS (SELECT rep, fold, cond, bin, sum(n) AS n, sum(a) AS a, sum(b) AS b FROM cb GROUP BY ALL),
 cy AS (SELECT rep, fold, cond, avg(a/n) AS bal, sum(a)/sum(n) AS ov, abs(sum(b)/sum(n)) AS bi FROM cx GROUP BY ALL),
 cz AS (SELECT *, 'overall' AS arm, ov AS m1, bal AS m2 FROM cy UNION ALL SELECT *, 'balanced', bal, ov FROM cy),
 cr AS (SELECT rep, fold, arm, cond, row_number() OVER (PARTITION BY rep, fold, arm ORDER BY round(m1,12), round(m2,12), round(bi,12), cond) AS place FROM cz)
SELECT arm, 'cond' AS axis, cond AS level, {N('count(*)', 'n_folds')}, {D('avg(CASE WHEN place<=2 THEN 1.0 ELSE 0 END)', 'in_top2')}, {D('avg(CASE WHEN place<=1 THEN 1.0 ELSE 0 END)', 'in_top1')} FROM cr GROUP BY arm, cond
UNION ALL SELECT arm, 'rater' AS axis, rater AS level, {N('count(*)', 'n_folds')}, {D('avg(CASE WHEN place<=2 THEN 1.0 ELSE 0 END)', 'in_top2')}, {D('avg(CASE WHEN place<=1 THEN 1.0 ELSE 0 END)', 'in_top1')} FROM rr GROUP BY arm, rater
UNION ALL SELECT arm, 'own', rater||' -> '||cond, {N('max(k)', 'n_folds')}, {D('count(*)/max(k)', 'in_top2')}, {D('count(*)/max(k)', 'in_top1')} FROM co, nf WHERE place=1 GROUP BY arm, rater, cond""",
)
def selection_stability(spark, sf_dir):
    return E.selection_stability(ensemble_inputs(spark, sf_dir)[2], (2, 1))


@query(
    "selection_ties",
    f"""{SELECT_SQL}, rt AS (SELECT rep, fold, arm, count(DISTINCT round(m1,12))<count(*) AS t FROM ra GROUP BY ALL),
 cx AS (SELECT rep, fold, cond, bin, sum(n) AS n, sum(a) AS a FROM cb GROUP BY ALL), cy AS (SELECT rep, fold, cond, avg(a/n) AS bal, sum(a)/sum(n) AS ov FROM cx GROUP BY ALL),
 cz AS (SELECT rep, fold, 'overall' AS arm, count(DISTINCT round(ov,12))<count(*) AS t FROM cy GROUP BY rep, fold UNION ALL SELECT rep, fold, 'balanced', count(DISTINCT round(bal,12))<count(*) FROM cy GROUP BY rep, fold),
 ot AS (SELECT rep, fold, arm, rater, count(DISTINCT round(m1,12))<count(*) AS t FROM ca GROUP BY ALL)
SELECT a.arm, {N("(SELECT count(*) FROM rt WHERE t AND rt.arm=a.arm)", 'rater_ties')}, {N("(SELECT count(*) FROM cz WHERE t AND cz.arm=a.arm)", 'cond_ties')}, {N("(SELECT count(*) FROM ot WHERE t AND ot.arm=a.arm)", 'own_ties')}
FROM (SELECT DISTINCT arm FROM rr) a""",
)
def selection_ties(spark, sf_dir):
    return E.selection_ties(ensemble_inputs(spark, sf_dir)[2])


@query(
    "ensemble_confounded_share",
    f"""{SELECT_SQL}, c AS (SELECT rep, fold, name, selection, min(CASE WHEN config LIKE 'R|%' THEN 'x' ELSE 'y' END)<>max(CASE WHEN config LIKE 'R|%' THEN 'x' ELSE 'y' END) AS c FROM mem GROUP BY ALL)
SELECT name, selection, {D('avg(CASE WHEN c THEN 1.0 ELSE 0 END)', 'confounded_share')} FROM c GROUP BY name, selection""",
)
def ensemble_confounded_share(spark, sf_dir):
    family = F.when(F.col("rater") == "R", "x").otherwise("y")
    return E.confounded_share(ensemble_inputs(spark, sf_dir)[3], family)
