"""Resampling, intervals, clusters and top-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalpanel.functions.columns import EIGHT_EDGES, with_bins
from evalpanel.functions.hashing import poisson_steps
from evalpanel.functions.levels import quantiles_of
from evalpanel.operators import cluster as K
from evalpanel.operators import intervals as I
from evalpanel.operators import metrics as M
from evalpanel.operators import paired as Q
from evalpanel.operators import rank_replicates as RR
from evalpanel.operators import resample as B
from evalpanel.operators import topset as TS
from evalpanel.operators.bootstrap import bootstrap
from evalpanel.plans import panels as P
from evalpanel.plans.interval_sql import acceleration, bca_ctes, bca_select, poisson_weights_sql
from evalpanel.plans.queries_paired import pair_sql
from evalpanel.plans.registry import D, N, query
from evalpanel.session import cut_lineage

PANEL = P.with_sql(P.PANEL_SQL)
BALANCED = B.mean_of("abs_e", balanced=True)


def u_sql(seed: int, *keys: str) -> str:
    text = "||':'||".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x'||substr(md5({text}),1,13)) AS BIGINT)/4503599627370496.0)"


def index_sql(strata: str = "") -> str:
    """Positions in (slot, unit) order per stratum, from the table ``un``."""
    s = f"{strata}, " if strata else ""
    by = f"PARTITION BY {strata} " if strata else ""
    return f"""un AS (SELECT DISTINCT {s}unit FROM panel),
ix AS (SELECT {s}unit, row_number() OVER ({by}ORDER BY floor({u_sql(0, 'unit')}*1024), unit)-1 AS idx, count(*) OVER ({by}) AS n FROM un)"""


def draw_sql(seed: int, reps: int, strata: str = "") -> str:
    s = f"{strata}, " if strata else ""
    keys = [strata, "rep", "idx"] if strata else ["rep", "idx"]
    return f"dr AS (SELECT {s}rep, CAST(floor({u_sql(seed, *keys)}*n) AS BIGINT) AS idx FROM ix, range(1,{reps + 1}) t(rep))"


def boot_balanced_sql(seed: int, reps: int, strata: str = "") -> str:
    on = "d.idx=i.idx" + (f" AND d.{strata}=i.{strata}" if strata else "")
    return f"""{PANEL}, {index_sql(strata)}, {draw_sql(seed, reps, strata)},
 rw AS (SELECT d.rep, i.unit FROM dr d JOIN ix i ON {on}),
 rb AS (SELECT rep, config, bin, avg(abs_e) AS m FROM rw JOIN panel p ON rw.unit=p.unit GROUP BY ALL),
 th AS (SELECT config, rep, avg(m) AS theta, count(*) AS k FROM rb GROUP BY ALL)"""


@query("draw_weights", f"""{PANEL}, {index_sql()}, {draw_sql(5, 10)}
SELECT {N('d.rep', 'rep')}, i.unit, {N('count(*)', 'w')} FROM dr d JOIN ix i ON d.idx=i.idx GROUP BY d.rep, i.unit""")
def draw_weights(spark, sf_dir):
    ids = P.base_panel(spark, sf_dir).select("unit").distinct()
    return B.draws(B.unit_index(ids, hasher="md5"), 5, 10, hasher="md5")


@query("stratified_draw_weights", f"""{PANEL}, {index_sql('bin')}, {draw_sql(6, 5, 'bin')}
SELECT i.bin, {N('d.rep', 'rep')}, i.unit, {N('count(*)', 'w')} FROM dr d JOIN ix i ON d.idx=i.idx AND d.bin=i.bin GROUP BY i.bin, d.rep, i.unit""")
def stratified_draw_weights(spark, sf_dir):
    ids = P.base_panel(spark, sf_dir).select("bin", "unit").distinct()
    return B.draws(B.unit_index(ids, strata=["bin"], hasher="md5"), 6, 5, ["bin"], hasher="md5")


_STEPS = poisson_steps()


@query(
    "poisson_weights",
    f"""{PANEL}, un AS (SELECT DISTINCT unit FROM panel), u AS (SELECT rep, unit, {u_sql(9, 'unit', 'rep')} AS u FROM un, range(1,6) t(rep)),
 w AS (SELECT rep, unit, {'+'.join(f'CASE WHEN u>=CAST({s!r} AS DOUBLE) THEN 1 ELSE 0 END' for s in _STEPS)} AS w FROM u)
SELECT {N('rep', 'rep')}, unit, {N('w', 'w')} FROM w WHERE w>0""",
)
def poisson_weights(spark, sf_dir):
    ids = P.base_panel(spark, sf_dir).select("unit").distinct()
    return B.poisson_draws(ids, 9, 5, hasher="md5").select("rep", "unit", "w")


@query(
    "bootstrap_balanced_percentile",
    f"""{boot_balanced_sql(21, 60)} SELECT config, {D('quantile_cont(theta,0.025)', 'ci_lo')}, {D('quantile_cont(theta,0.975)', 'ci_hi')}, {D('stddev_samp(theta)', 'se')} FROM th GROUP BY config""",
)
def bootstrap_balanced_percentile(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["config"], BALANCED, 60, 21, hasher="md5")
    return I.percentile_interval(reps, ["config"]).select("config", "ci_lo", "ci_hi", "se")


@query(
    "bootstrap_stratified_percentile",
    f"""{boot_balanced_sql(22, 60, 'bin')} SELECT config, {D('quantile_cont(theta,0.025)', 'ci_lo')}, {D('quantile_cont(theta,0.975)', 'ci_hi')}, {D('stddev_samp(theta)', 'se')} FROM th GROUP BY config""",
)
def bootstrap_stratified_percentile(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["config"], BALANCED, 60, 22, strata=["bin"], hasher="md5")
    return I.percentile_interval(reps, ["config"]).select("config", "ci_lo", "ci_hi", "se")


@query(
    "bootstrap_within_bin",
    f"""{PANEL}, {index_sql('bin')}, {draw_sql(23, 60, 'bin')}, rw AS (SELECT d.rep, i.bin, i.unit FROM dr d JOIN ix i ON d.idx=i.idx AND d.bin=i.bin),
 th AS (SELECT rater, rw.bin, rep, avg(abs_e) AS theta FROM rw JOIN panel p ON rw.unit=p.unit GROUP BY ALL)
SELECT rater, bin, {D('quantile_cont(theta,0.025)', 'ci_lo')}, {D('quantile_cont(theta,0.975)', 'ci_hi')} FROM th GROUP BY rater, bin""",
)
def bootstrap_within_bin(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["rater", "bin"], B.mean_of("abs_e"), 60, 23, strata=["bin"], hasher="md5")
    return I.percentile_interval(reps, ["rater", "bin"]).select("rater", "bin", "ci_lo", "ci_hi")


@query(
    "bootstrap_paired_difference",
    f"""{boot_balanced_sql(24, 60)}, df AS (SELECT a.config AS a, b.config AS b, a.theta-b.theta AS d FROM th a JOIN th b ON a.rep=b.rep AND a.config<b.config)
SELECT a, b, {D('quantile_cont(d,0.025)', 'ci_lo')}, {D('quantile_cont(d,0.975)', 'ci_hi')},
 {D('greatest(2*least(avg(CASE WHEN d<=0 THEN 1.0 ELSE 0 END), avg(CASE WHEN d>=0 THEN 1.0 ELSE 0 END)), 1/61.0)', 'p_two_sided')} FROM df GROUP BY a, b""",
)
def bootstrap_paired_difference(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["config"], BALANCED, 60, 24, hasher="md5")
    diffs = B.paired_replicates(reps, "config")
    return I.percentile_interval(diffs, ["a", "b"]).select("a", "b", "ci_lo", "ci_hi", "p_two_sided")


@query(
    "bootstrap_rmse",
    f"""{PANEL}, {index_sql()}, {draw_sql(25, 60)}, rw AS (SELECT d.rep, i.unit FROM dr d JOIN ix i ON d.idx=i.idx),
 th AS (SELECT rater, rep, sqrt(avg(e*e)) AS theta FROM rw JOIN panel p ON rw.unit=p.unit GROUP BY ALL)
SELECT rater, {D('quantile_cont(theta,0.00415)', 'ci_lo')}, {D('quantile_cont(theta,0.99585)', 'ci_hi')} FROM th GROUP BY rater""",
)
def bootstrap_rmse(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["rater"], B.rms_of("e"), 60, 25, hasher="md5")
    return I.percentile_interval(reps, ["rater"], alpha=1 - 0.9917).select("rater", "ci_lo", "ci_hi")


@query(
    "empty_bin_replicates",
    f"""{boot_balanced_sql(21, 60)} SELECT config, {N('count(*) FILTER (k<5)', 'n_violations')}, {D('avg(CASE WHEN k<5 THEN 1.0 ELSE 0 END)', 'violation_share')},
 avg(CASE WHEN k<5 THEN 1.0 ELSE 0 END)>0.01 AS use_stratified FROM th GROUP BY config""",
)
def empty_bin_replicates(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["config"], BALANCED, 60, 21, hasher="md5")
    return B.empty_bin_share(reps, ["config"])


@query(
    "jackknife_balanced",
    f"""{PANEL}, b AS (SELECT config, bin, sum(abs_e) AS s, count(*) AS n FROM panel GROUP BY ALL),
 t AS (SELECT config, sum(s/n) AS t, count(*) AS k FROM b GROUP BY config)
SELECT p.config, unit, {D('CASE WHEN b.n>1 THEN (t.t - b.s/b.n + (b.s-p.abs_e)/(b.n-1))/t.k ELSE (t.t - b.s/b.n)/(t.k-1) END', 'theta_out')}
FROM panel p JOIN b ON p.config=b.config AND p.bin=b.bin JOIN t ON p.config=t.config""",
)
def jackknife_balanced(spark, sf_dir):
    stats = cut_lineage(B.unit_stats(P.base_panel(spark, sf_dir), ["config"], BALANCED))
    return B.jackknife(stats, ["config"], BALANCED, per_unit=True)


@query(
    "jackknife_acceleration",
    f"""{PANEL}, b AS (SELECT config, bin, sum(abs_e) AS s, count(*) AS n FROM panel GROUP BY ALL),
 t AS (SELECT config, sum(s/n) AS t, count(*) AS k FROM b GROUP BY config),
 j AS (SELECT p.config, (t.t - b.s/b.n + (b.s-p.abs_e)/(b.n-1))/t.k AS j FROM panel p JOIN b ON p.config=b.config AND p.bin=b.bin JOIN t ON p.config=t.config),
 m AS (SELECT config, avg(j) AS m FROM j GROUP BY config)
SELECT m.config, {D('sum(power(m-j,3))/(6*power(sum(power(m-j,2)),1.5))', 'accel')} FROM j JOIN m ON j.config=m.config GROUP BY m.config""",
)
def jackknife_acceleration(spark, sf_dir):
    return B.jackknife(cut_lineage(B.unit_stats(P.base_panel(spark, sf_dir), ["config"], BALANCED)), ["config"], BALANCED)


def bca(rows, keys, stat, reps, seed, method="multinomial"):
    return bootstrap(rows, keys, stat, reps, seed, method, hasher="md5").drop("se")


UNITS = "un AS (SELECT DISTINCT unit FROM panel)"
#: Leave-one-out values of the balanced error: a unit has one row per configuration.
BALANCED_JACKKNIFE = """jb AS (SELECT config, bin, sum(abs_e) AS s, count(*) AS n FROM panel GROUP BY ALL), jt AS (SELECT config, sum(s/n) AS t, count(*) AS k FROM jb GROUP BY config),
 pt AS (SELECT config, t/k AS theta_hat FROM jt),
 jk AS (SELECT p.config, CASE WHEN jb.n>1 THEN (jt.t - jb.s/jb.n + (jb.s-p.abs_e)/(jb.n-1))/jt.k ELSE (jt.t - jb.s/jb.n)/(jt.k-1) END AS j
  FROM panel p JOIN jb ON p.config=jb.config AND p.bin=jb.bin JOIN jt ON p.config=jt.config)"""


def ratio_bca_sql(ctes: str, rows: str, keys: str, top: str, bottom: str, value: str, seed: int, reps: int) -> str:
    """BCa of ``value`` over the sums a and b of ``top`` and ``bottom``, with Poisson weights per unit, from table ``rows``."""
    ks = keys.split(", ")
    on = " AND ".join(f"x.{k}=y.{k}" for k in ks)
    named = ", ".join(f"x.{k}" for k in ks)
    return f"""{ctes}, {poisson_weights_sql(u_sql(seed, 'unit', 'rep'), reps)},
 us AS (SELECT {keys}, unit, sum({top}) AS a, sum({bottom}) AS b FROM {rows} GROUP BY ALL), ut AS (SELECT {keys}, sum(a) AS ta, sum(b) AS tb FROM us GROUP BY ALL),
 pt AS (SELECT {keys}, {value.format(a='ta', b='tb')} AS theta_hat FROM ut),
 jk AS (SELECT {named}, {value.format(a='(ta-a)', b='(tb-b)')} AS j FROM us x JOIN ut y ON {on}), {acceleration(keys)},
 th AS (SELECT {keys}, rep, {value.format(a='sum(w*a)', b='sum(w*b)')} AS theta FROM us JOIN pw USING (unit) WHERE w>0 GROUP BY ALL), {bca_ctes(keys)}
{bca_select(keys)}"""


@query("bca_balanced_by_config", f"{boot_balanced_sql(31, 200)}, {BALANCED_JACKKNIFE}, {acceleration('config')}, {bca_ctes('config')} {bca_select('config')}")
def bca_balanced_by_config(spark, sf_dir):
    return bca(P.base_panel(spark, sf_dir), ["config"], BALANCED, 200, 31)


@query(
    "bca_balanced_poisson",
    f"""{PANEL}, {UNITS}, {poisson_weights_sql(u_sql(31, 'unit', 'rep'), 200)}, rb AS (SELECT rep, config, bin, sum(w*abs_e)/sum(w) AS m FROM panel JOIN pw USING (unit) WHERE w>0 GROUP BY ALL),
 th AS (SELECT config, rep, avg(m) AS theta FROM rb GROUP BY ALL), {BALANCED_JACKKNIFE}, {acceleration('config')}, {bca_ctes('config')} {bca_select('config')}""",
)
def bca_balanced_poisson(spark, sf_dir):
    return bca(P.base_panel(spark, sf_dir), ["config"], BALANCED, 200, 31, "poisson")


EIGHT_SQL = "SELECT * EXCLUDE (bin), " + "+".join(f"CASE WHEN reference>{e} THEN 1 ELSE 0 END" for e in EIGHT_EDGES[1:-1]) + " AS bin FROM panel"


@query("bca_bias_by_fine_bin", ratio_bca_sql(f"{PANEL}, {UNITS}, fine AS ({EIGHT_SQL})", "fine", "rater, bin", "e", "1.0", "{a}/{b}", 32, 200))
def bca_bias_by_fine_bin(spark, sf_dir):
    fine = with_bins(P.base_panel(spark, sf_dir).drop("bin"), EIGHT_EDGES)
    return bca(fine, ["rater", "bin"], B.mean_of("e"), 200, 32, "poisson")


RUNS_SQL = """WITH r AS (SELECT l_partkey AS unit, l_returnflag AS rater, avg(l_quantity) FILTER (l_linenumber%2=1) AS run1, avg(l_quantity) FILTER (l_linenumber%2=0) AS run2 FROM lineitem GROUP BY ALL),
 dd AS (SELECT unit, rater, abs(run1-run2) AS d FROM r WHERE run1 IS NOT NULL AND run2 IS NOT NULL), un AS (SELECT DISTINCT unit FROM dd)"""


@query("bca_floor_by_rater", ratio_bca_sql(RUNS_SQL, "dd", "rater", "d", "1.0", "{a}/{b}", 33, 200))
def bca_floor_by_rater(spark, sf_dir):
    runs = P.repeat_runs(spark, sf_dir).groupBy("rater", "unit").pivot("run", ["run1", "run2"]).agg(F.min("pred"))
    d = runs.dropna().withColumn("d", F.abs(F.col("run1") - F.col("run2")))
    return bca(d, ["rater"], B.mean_of("d"), 200, 33, "poisson")


@query("skill_ratio_intervals", ratio_bca_sql(f"{PANEL}, {UNITS}", "panel", "rater, bin", "abs_e", "abs(reference-50.0)", "CASE WHEN {b}>0 THEN 1-{a}/{b} END", 34, 200))
def skill_ratio_intervals(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir).withColumn("base_e", F.abs(F.col("reference") - 50.0))
    return bca(rows, ["rater", "bin"], B.skill_of("abs_e", "base_e"), 200, 34, "poisson")


# ---- rank statistics of all replicates ----


def spearman_sql(keys: str, rows: str, x: str, weight: str = "w") -> str:
    """Weighted mid-rank correlation per key from ``rows`` (keys, x, reference, weight)."""
    by = f"PARTITION BY {keys}"
    rank = lambda v: f"(SUM({weight}) OVER ({by} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - SUM({weight}) OVER ({by}, {v})/2.0 - SUM({weight}) OVER ({by})/2.0)"
    return f"SELECT {keys}, sum({weight}*a*b)/sqrt(sum({weight}*a*a)*sum({weight}*b*b)) AS theta FROM (SELECT {keys}, {weight}, {rank(x)} AS a, {rank('reference')} AS b FROM {rows}) GROUP BY ALL"


def percentile_select(keys: str, source: str = "th") -> str:
    return f"SELECT {keys}, {D('quantile_cont(theta,0.025)', 'ci_lo')}, {D('quantile_cont(theta,0.975)', 'ci_hi')}, {D('stddev_samp(theta)', 'se')} FROM {source} GROUP BY ALL"


def drawn(seed: int, reps: int) -> str:
    return f"{PANEL}, {UNITS}, {poisson_weights_sql(u_sql(seed, 'unit', 'rep'), reps)}, wr AS (SELECT * FROM panel JOIN pw USING (unit) WHERE w>0)"


@query("bootstrap_spearman", f"{drawn(41, 60)}, th AS ({spearman_sql('rater, rep', 'wr', 'pred')}) {percentile_select('rater')}")
def bootstrap_spearman(spark, sf_dir):
    reps = RR.spearman_replicates(P.base_panel(spark, sf_dir), ["rater"], "pred", "reference", 60, 41, hasher="md5")
    return I.percentile_interval(reps, ["rater"]).select("rater", "ci_lo", "ci_hi", "se")


@query(
    "bootstrap_spearman_difference",
    f"""{PANEL}, {UNITS}, {poisson_weights_sql(u_sql(45, 'unit', 'rep'), 60)}, wr AS (SELECT * FROM panel JOIN pw USING (unit) WHERE w>0),
 ta AS ({spearman_sql('rater, rep', 'wr', 'pred')}), tb AS ({spearman_sql('rater, rep', 'wr', 'pred_mid')}), th AS (SELECT rater, rep, ta.theta-tb.theta AS theta FROM ta JOIN tb USING (rater, rep)) {percentile_select('rater')}""",
)
def bootstrap_spearman_difference(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, variants=True)
    reps = RR.spearman_difference_replicates(panel, ["rater"], "pred", "pred_mid", "reference", 60, 45, hasher="md5")
    return I.percentile_interval(reps, ["rater"]).select("rater", "ci_lo", "ci_hi", "se")


@query(
    "bootstrap_auc",
    f"""{drawn(42, 60)}, lv AS (SELECT rater, cond, rep, conf, sum(CASE WHEN abs_e>20 THEN w ELSE 0 END) AS p, sum(CASE WHEN abs_e>20 THEN 0 ELSE w END) AS q FROM wr WHERE conf IS NOT NULL GROUP BY ALL),
 au AS (SELECT rater, cond, rep, sum(q*(below+p/2.0))/nullif(sum(p)*sum(q), 0) AS a FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY rater, cond, rep ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM lv) GROUP BY ALL),
 th AS (SELECT rater, rep, avg(a)-0.5 AS theta FROM au GROUP BY ALL) {percentile_select('rater')}""",
)
def bootstrap_auc(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, scores=True).withColumn("bad", F.col("abs_e") > 20)
    cells = RR.auc_replicates(panel, ["rater", "cond"], "conf", "bad", 60, 42, hasher="md5")
    reps = cells.groupBy("rater", "rep").agg((F.avg("theta") - 0.5).alias("theta"))
    return I.percentile_interval(reps, ["rater"]).select("rater", "ci_lo", "ci_hi", "se")


@query(
    "bootstrap_axis_spread",
    f"""{boot_balanced_sql(43, 60)}, tw AS (SELECT split_part(config,'|',1) AS rater, split_part(config,'|',2) AS cond, rep, theta FROM th),
 r AS (SELECT rep, avg(s) AS s FROM (SELECT rep, cond, max(theta)-min(theta) AS s FROM tw GROUP BY ALL) GROUP BY rep),
 c AS (SELECT rep, avg(s) AS s FROM (SELECT rep, rater, max(theta)-min(theta) AS s FROM tw GROUP BY ALL) GROUP BY rep),
 l AS (SELECT 'rater' AS axis, s FROM r UNION ALL SELECT 'cond', s FROM c UNION ALL SELECT 'difference', r.s-c.s FROM r JOIN c ON r.rep=c.rep)
SELECT axis, {D('quantile_cont(s,0.025)', 'ci_lo')}, {D('quantile_cont(s,0.975)', 'ci_hi')} FROM l GROUP BY axis""",
)
def bootstrap_axis_spread(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["rater", "cond"], BALANCED, 60, 43, hasher="md5")
    across_r = reps.groupBy("rep", "cond").agg((F.max("theta") - F.min("theta")).alias("s")).groupBy("rep").agg(F.avg("s").alias("r"))
    across_c = reps.groupBy("rep", "rater").agg((F.max("theta") - F.min("theta")).alias("s")).groupBy("rep").agg(F.avg("s").alias("c"))
    both = across_r.join(across_c, "rep")
    long = both.select("rep", F.expr("stack(3, 'rater', r, 'cond', c, 'difference', r - c) AS (axis, theta)"))
    return I.percentile_interval(long, ["axis"]).select("axis", "ci_lo", "ci_hi")


# ---- clusters ----

CONTRIB_SQL = f"""{P.with_sql(P.PANEL_SQL, pair_sql('rater'))}, cb AS (SELECT s.a, s.b, c.clus, s.d, 1.0/(5*count(*) OVER (PARTITION BY s.a, s.b, s.bin)) AS w
 FROM prs s JOIN (SELECT DISTINCT unit, clus FROM panel) c ON s.unit=c.unit),
 cs AS (SELECT a, b, clus, sum(w*d) AS s, sum(w) AS w FROM cb GROUP BY ALL),
 ct AS (SELECT a, b, sum(s) AS st, sum(w) AS wt, count(*) AS g FROM cs GROUP BY ALL),
 cv AS (SELECT ct.a, ct.b, ct.g, st/wt AS est, sqrt((ct.g-1.0)/ct.g*sum(power((st-s)/(wt-w)-st/wt,2))) AS se FROM cs JOIN ct ON cs.a=ct.a AND cs.b=ct.b GROUP BY ct.a, ct.b, ct.g, st, wt)"""


def contributions(spark, sf_dir):
    pooled = M.unit_means(P.base_panel(spark, sf_dir), ["rater"], ["abs_e"], ["bin", "clus"])
    return K.bin_weights(cut_lineage(Q.level_pairs(pooled, "rater", carry=("bin", "clus"))), ["a", "b"])


@query("cluster_jackknife", f"{CONTRIB_SQL} SELECT a, b, {D('est', 'estimate')}, {N('g', 'n_clusters')}, {D('se', 'se')}, {D('est/se', 't_obs')}, {D('est-4.302652729911275*se', 'ci_lo')}, {D('est+4.302652729911275*se', 'ci_hi')} FROM cv")
def cluster_jackknife(spark, sf_dir):
    return K.clustered_interval(K.cluster_sums(contributions(spark, sf_dir), ["a", "b"], "clus", weight="weight"), ["a", "b"], "clus")


@query(
    "wild_cluster_enumerated",
    f"""{CONTRIB_SQL}, v AS (SELECT i, [-sqrt(1.5),-1.0,-0.5,0.5,1.0,sqrt(1.5)][i+1] AS v FROM range(6) t(i)),
 e AS (SELECT x.i+6*y.i+36*z.i AS rep, [x.v,y.v,z.v] AS v FROM v x, v y, v z),
 k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY clus) AS pos FROM cs),
 st AS (SELECT k.a, k.b, rep, clus, v[pos]*s AS s, w FROM k, e),
 tt AS (SELECT a, b, rep, sum(s) AS t, sum(w) AS w FROM st GROUP BY ALL),
 sr AS (SELECT st.a, st.b, st.rep, t/tt.w/sqrt(2.0/3*sum(power((t-s)/(tt.w-st.w)-t/tt.w,2))) AS ts FROM st JOIN tt ON st.a=tt.a AND st.b=tt.b AND st.rep=tt.rep GROUP BY st.a, st.b, st.rep, t, tt.w)
SELECT cv.a, cv.b, {D('est/se', 't_obs')}, {N('count(ts)', 'n_valid')}, {N('count(*) FILTER (round(abs(ts),10)>=round(abs(est/se),10))', 'n_beyond')},
 {D('greatest((1+count(*) FILTER (round(abs(ts),10)>=round(abs(est/se),10)))/(count(ts)+1.0), 2/216.0)', 'p_webb')} FROM sr JOIN cv ON sr.a=cv.a AND sr.b=cv.b GROUP BY cv.a, cv.b, est, se""",
)
def wild_cluster_enumerated(spark, sf_dir):
    sums = K.cluster_sums(contributions(spark, sf_dir), ["a", "b"], "clus", weight="weight")
    stars = K.wild_replicates(sums, ["a", "b"], "clus", 216, enumerate_all=True)
    out = K.wild_test(K.clustered_interval(sums, ["a", "b"], "clus", interval=False), stars, ["a", "b"])
    return out.drop("n_distinct_abs_t", "below_resolution_floor")


@query(
    "wild_cluster_drawn",
    f"""{CONTRIB_SQL}, st AS (SELECT a, b, rep, clus, [-sqrt(1.5),-1.0,-0.5,0.5,1.0,sqrt(1.5)][CAST(floor({u_sql(3, 'rep', 'clus')}*6) AS BIGINT)+1]*s AS s, w FROM cs, range(1,1000) r(rep)),
 tt AS (SELECT a, b, rep, sum(s) AS t, sum(w) AS w, count(*) AS g FROM st GROUP BY ALL),
 sr AS (SELECT st.a, st.b, st.rep, g, t/tt.w/sqrt((g-1.0)/g*sum(power((t-s)/(tt.w-st.w)-t/tt.w,2))) AS ts FROM st JOIN tt ON st.a=tt.a AND st.b=tt.b AND st.rep=tt.rep GROUP BY st.a, st.b, st.rep, t, tt.w, g),
 wt AS (SELECT cv.a, cv.b, est/se AS t_obs, count(ts) AS n, count(*) FILTER (round(abs(ts),10)>=round(abs(est/se),10)) AS k, count(DISTINCT round(abs(ts),10)) AS n_abs, 2/power(6.0,max(sr.g)) AS least FROM sr JOIN cv ON sr.a=cv.a AND sr.b=cv.b GROUP BY cv.a, cv.b, est, se)
SELECT a, b, {D('t_obs', 't_obs')}, {N('n', 'n_valid')}, {N('k', 'n_beyond')}, {N('n_abs', 'n_distinct_abs_t')}, {D('greatest((1+k)/(n+1.0), least)', 'p_webb')}, (1+k)/(n+1.0)<least AS below_resolution_floor FROM wt""",
)
def wild_cluster_drawn(spark, sf_dir):
    sums = K.cluster_sums(contributions(spark, sf_dir), ["a", "b"], "clus", weight="weight")
    stars = K.wild_replicates(sums, ["a", "b"], "clus", 999, seed=3, hasher="md5")
    return K.wild_test(K.clustered_interval(sums, ["a", "b"], "clus", interval=False), stars, ["a", "b"])


@query(
    "leave_one_cluster_out",
    f"""{PANEL}, d AS (SELECT DISTINCT clus AS dropped FROM panel), b AS (SELECT rater, dropped, bin, avg(abs_e) AS m, count(DISTINCT unit) AS u FROM panel, d WHERE clus<>dropped GROUP BY ALL)
SELECT rater, dropped, {N('sum(u)', 'n_units')}, {D('CASE WHEN count(*)=5 AND min(u)>=10 THEN avg(m) END', 'balanced_mae')}, CASE WHEN NOT(count(*)=5 AND min(u)>=10) THEN 'not computed (bin n < 10)' END AS reason FROM b GROUP BY rater, dropped""",
)
def leave_one_cluster_out(spark, sf_dir):
    return K.leave_one_out_balanced(P.base_panel(spark, sf_dir), ["rater"], "clus")


@query(
    "leave_one_cluster_out_range",
    f"""{PANEL}, d AS (SELECT DISTINCT clus AS dropped FROM panel), b AS (SELECT rater, dropped, avg(e) AS v FROM panel, d WHERE clus<>dropped GROUP BY ALL)
SELECT rater, {D('min(v)', 'lo')}, {D('max(v)', 'hi')}, {N('count(v)', 'n_usable')}, '' AS note FROM b GROUP BY rater""",
)
def leave_one_cluster_out_range(spark, sf_dir):
    left = K.complements(P.base_panel(spark, sf_dir), ["rater"], "clus", {"s": ("sum", F.col("e")), "n": ("count", F.col("e"))})
    return K.refit_range(left.withColumn("v", F.col("s") / F.col("n")), ["rater"], "v")


@query(
    "leave_one_cluster_out_extremes",
    f"""{PANEL}, d AS (SELECT DISTINCT clus AS dropped FROM panel)
SELECT config, dropped, {N('count(*)', 'n')}, {D('sum(e)', 'total')}, {D('min(e)', 'least')}, {D('max(e)', 'most')} FROM panel, d WHERE clus<>dropped GROUP BY config, dropped""",
)
def leave_one_cluster_out_extremes(spark, sf_dir):
    e = F.col("e")
    return K.complements(P.base_panel(spark, sf_dir), ["config"], "clus", {"n": ("count", e), "total": ("sum", e), "least": ("min", e), "most": ("max", e)})


@query(
    "leave_one_cluster_out_median",
    f"""{PANEL}, d AS (SELECT DISTINCT clus AS dropped FROM panel) SELECT rater, dropped, {D('median(abs_e)', 'median_abs_e')} FROM panel, d WHERE clus<>dropped GROUP BY rater, dropped""",
)
def leave_one_cluster_out_median(spark, sf_dir):
    levels = K.complements(P.base_panel(spark, sf_dir), ["rater", "abs_e"], "clus", {"n": ("count", F.col("abs_e"))})
    return quantiles_of(levels.filter("n > 0"), ["rater", "dropped"], "abs_e", {"median_abs_e": 0.5})


@query(
    "clustered_to_headline_width",
    f"""{CONTRIB_SQL}, un AS (SELECT DISTINCT unit FROM panel), {poisson_weights_sql(u_sql(44, 'unit', 'rep'), 100)},
 th AS MATERIALIZED (SELECT rater, rep, avg(m) AS theta FROM (SELECT rep, rater, bin, sum(w*abs_e)/sum(w) AS m FROM panel JOIN pw USING (unit) WHERE w>0 GROUP BY ALL) GROUP BY ALL),
 hw AS (SELECT x.rater AS a, y.rater AS b, quantile_cont(x.theta-y.theta,0.975)-quantile_cont(x.theta-y.theta,0.025) AS h FROM th x JOIN th y ON x.rep=y.rep AND x.rater<y.rater GROUP BY ALL)
SELECT cv.a, cv.b, {D('est', 'estimate')}, {N('cv.g', 'n_clusters')}, {D('se', 'se')}, {D('est/se', 't_obs')}, {D('est-4.302652729911275*se', 'ci_lo')}, {D('est+4.302652729911275*se', 'ci_hi')}, {D('2*4.302652729911275*se/h', 'width_ratio')} FROM cv JOIN hw ON cv.a=hw.a AND cv.b=hw.b""",
)
def clustered_to_headline_width(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["rater"], BALANCED, 100, 44, "poisson", hasher="md5")
    head = I.percentile_interval(B.paired_replicates(reps, "rater"), ["a", "b"])
    sums = K.cluster_sums(contributions(spark, sf_dir), ["a", "b"], "clus", weight="weight")
    return K.width_ratio(K.clustered_interval(sums, ["a", "b"], "clus"), head, ["a", "b"])


# ---- top sets ----

@query(
    "top_set_best_share",
    f"""{boot_balanced_sql(51, 60)}, r AS (SELECT config, row_number() OVER (PARTITION BY rep ORDER BY theta, config) AS rk FROM th)
SELECT config, {N('count(*)', 'n_reps')}, {D('avg(CASE WHEN rk=1 THEN 1.0 ELSE 0 END)', 'prob_best')} FROM r GROUP BY config""",
)
def top_set_best_share(spark, sf_dir):
    reps = B.replicates(P.base_panel(spark, sf_dir), ["config"], BALANCED, 60, 51, hasher="md5")
    return TS.best_probability(reps)


@query(
    "top_set_comparison",
    f"""{boot_balanced_sql(51, 60)}, pt AS (SELECT config, avg(m) AS theta FROM (SELECT config, bin, avg(abs_e) AS m FROM panel GROUP BY ALL) GROUP BY config),
 dh AS (SELECT a.config, a.theta, a.theta-min(b.theta) AS d FROM pt a JOIN pt b ON a.config<>b.config GROUP BY a.config, a.theta),
 ds AS (SELECT a.config, a.rep, a.theta-min(b.theta) AS d FROM th a JOIN th b ON a.rep=b.rep AND a.config<>b.config GROUP BY a.config, a.rep, a.theta),
 se AS (SELECT config, stddev_samp(d) AS se FROM ds GROUP BY config),
 mx AS (SELECT rep, max((ds.d-dh.d)/se) AS m FROM ds JOIN dh ON ds.config=dh.config JOIN se ON ds.config=se.config GROUP BY rep),
 c AS (SELECT quantile_cont(m,0.95) AS c FROM mx)
SELECT dh.config, {D('theta', 'theta_hat')}, {D('d', 'd_hat')}, {D('se', 'se_hat')}, {D('c', 'critical')}, {D('d-c*se', 'lower_bound')}, d-c*se<=0 AS in_mcb FROM dh JOIN se ON dh.config=se.config, c""",
)
def top_set_comparison(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    reps = B.replicates(panel, ["config"], BALANCED, 60, 51, hasher="md5")
    points = B.point(B.unit_stats(panel, ["config"], BALANCED), ["config"], BALANCED)
    return TS.comparison_set(reps, points)


def studentised_sql(left: str, i: int) -> str:
    """CTEs of round ``i`` over the configurations in ``left``: their excess ``dh``, its spread ``se`` and the critical value ``c``."""
    return f"""dh{i} AS MATERIALIZED (SELECT a.config, a.theta, a.theta-min(b.theta) AS d FROM pt a JOIN pt b ON a.config<>b.config WHERE a.config IN (FROM {left}) AND b.config IN (FROM {left}) GROUP BY a.config, a.theta),
 ds{i} AS MATERIALIZED (SELECT a.config, a.rep, a.theta-min(b.theta) AS d FROM th a JOIN th b ON a.rep=b.rep AND a.config<>b.config WHERE a.config IN (FROM {left}) AND b.config IN (FROM {left}) GROUP BY a.config, a.rep, a.theta),
 se{i} AS MATERIALIZED (SELECT config, stddev_samp(d) AS se FROM ds{i} GROUP BY config),
 c{i} AS MATERIALIZED (SELECT quantile_cont(m,0.95) AS c FROM (SELECT rep, max((ds.d-dh.d)/se) AS m FROM ds{i} ds JOIN dh{i} dh ON ds.config=dh.config JOIN se{i} se ON ds.config=se.config GROUP BY rep))"""


def elimination_sql(rounds: int) -> str:
    """CTEs ``s0`` (all) to ``s<rounds>``: each drops the configuration with the largest excess if that is beyond the critical value."""
    steps = ["s0 AS MATERIALIZED (SELECT DISTINCT config FROM th)"]
    for i in range(rounds):
        worst = f"SELECT dh.config FROM dh{i} dh JOIN se{i} se ON dh.config=se.config, c{i} WHERE d/se>c ORDER BY d/se DESC LIMIT 1"
        steps += [studentised_sql(f"s{i}", i), f"s{i + 1} AS MATERIALIZED (SELECT config FROM s{i} WHERE config NOT IN ({worst}))"]
    return ",\n ".join(steps)


@query(
    "top_set_both",
    f"""{PANEL}, un AS (SELECT DISTINCT unit FROM panel), {poisson_weights_sql(u_sql(52, 'unit', 'rep'), 200)},
 th AS MATERIALIZED (SELECT config, rep, avg(m) AS theta FROM (SELECT rep, config, bin, sum(w*abs_e)/sum(w) AS m FROM panel JOIN pw USING (unit) WHERE w>0 GROUP BY ALL) GROUP BY ALL),
 pt AS MATERIALIZED (SELECT config, avg(m) AS theta FROM (SELECT config, bin, avg(abs_e) AS m FROM panel GROUP BY ALL) GROUP BY config), {elimination_sql(6)},
 bp AS (SELECT config, count(*) AS n, avg(CASE WHEN rk=1 THEN 1.0 ELSE 0 END) AS p FROM (SELECT config, row_number() OVER (PARTITION BY rep ORDER BY theta, config) AS rk FROM th) GROUP BY config),
 al AS (SELECT dh0.config, theta, d, se, c, d-c*se<=0 AS b, dh0.config IN (FROM s6) AS s, n, p FROM dh0 JOIN se0 ON dh0.config=se0.config JOIN bp ON dh0.config=bp.config, c0)
SELECT config, {D('theta', 'theta_hat')}, {D('d', 'd_hat')}, {D('se', 'se_hat')}, {D('c', 'critical')}, {D('d-c*se', 'lower_bound')}, b AS in_mcb, {N('n', 'n_reps')}, {D('p', 'prob_best')}, s AS in_mcs, b OR s AS in_union,
 (SELECT count(*) FILTER (b<>s)>0 FROM al) AS sets_disagree FROM al""",
)
def top_set_both(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    stats = cut_lineage(B.unit_stats(panel, ["config"], BALANCED))
    reps = B.replicates(stats, ["config"], BALANCED, 200, 52, "poisson", hasher="md5")
    return TS.top_set(reps, B.point(stats, ["config"], BALANCED))
