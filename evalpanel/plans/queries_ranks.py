"""Rank association, discrimination, agreement and trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalpanel.functions import distributions as Dist
from evalpanel.functions.bijection import PRIME, STEPS
from evalpanel.functions.levels import attach_totals, join_bounded, quantiles
from evalpanel.operators import agreement as A
from evalpanel.operators import metrics as M
from evalpanel.operators import ranks as R
from evalpanel.operators import trend as T
from evalpanel.plans import panels as P
from evalpanel.plans.registry import D, N, query
from evalpanel.session import cut_lineage

PANEL = P.with_sql(P.PANEL_SQL)
SCORES = P.with_sql(P.SCORE_SQL)
PATHS = P.with_sql(P.PANEL_SQL, P.PATH_SQL)


def mid(col: str, keys: str, source_alias: str = "") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    also = f"{keys}, " if keys else ""
    return f"(rank() OVER ({by}ORDER BY {col}) + (count(*) OVER (PARTITION BY {also}{col}) - 1)/2.0)"


def auc_cte(name: str, source: str, keys: str, score: str, label: str) -> str:
    """AUC by rank sums, in the orientation negative above positive."""
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f"""{name}_r AS (SELECT {k}{label} AS lab, {mid(score, keys)} AS r FROM {source} WHERE {score} IS NOT NULL),
{name} AS (SELECT {k}count(*) FILTER (lab) AS np, count(*) FILTER (NOT lab) AS nn,
 1-(sum(CASE WHEN lab THEN r END)-count(*) FILTER (lab)*(count(*) FILTER (lab)+1)/2.0)/(count(*) FILTER (lab)*count(*) FILTER (NOT lab)) AS auc FROM {name}_r{g})"""


@query(
    "spearman_by_config",
    f"""{PANEL}, r AS (SELECT rater, cond, {mid('pred', 'rater, cond')} AS a, {mid('reference', 'rater, cond')} AS b FROM panel)
SELECT rater, cond, {N('count(*)', 'n')}, {D('corr(a,b)', 'rho')} FROM r GROUP BY rater, cond""",
)
def spearman_by_config(spark, sf_dir):
    return R.spearman(P.base_panel(spark, sf_dir), ["rater", "cond"], "pred", "reference")


@query(
    "spearman_score_vs_error",
    f"""{PANEL}, u AS (SELECT rater, unit, round(avg(conf),9) AS c, round(avg(abs_e),9) AS a FROM panel WHERE conf IS NOT NULL GROUP BY ALL),
 r AS (SELECT rater, {mid('c', 'rater')} AS x, {mid('a', 'rater')} AS y FROM u)
SELECT rater, {N('count(*)', 'n')}, {D('corr(x,y)', 'rho')}, {D('corr(x,y)*sqrt((count(*)-2)/(1-corr(x,y)*corr(x,y)))', 't')} FROM r GROUP BY rater""",
)
def spearman_score_vs_error(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, scores=True).filter(F.col("conf").isNotNull())
    per_unit = M.unit_means(panel, ["rater"], ["conf", "abs_e"], digits=9)
    out = R.spearman(per_unit, ["rater"], "conf", "abs_e")
    return out.withColumn("t", R.spearman_t(F.col("rho"), F.col("n")))


@query(
    "rho_in_bottom_bin",
    f"""{PANEL}, r AS (SELECT cond, {mid('pred', 'cond')} AS a, {mid('abs_e', 'cond')} AS b FROM panel WHERE bin=0)
SELECT cond, {N('count(*)', 'n')}, {D('corr(a,b)', 'rho')} FROM r GROUP BY cond""",
)
def rho_in_bottom_bin(spark, sf_dir):
    return R.spearman(P.base_panel(spark, sf_dir).filter(F.col("bin") == 0), ["cond"], "pred", "abs_e")


@query(
    "auc_by_language",
    f"""{SCORES}, {auc_cte('x', 'scores', 'lang', 'score', 'positive')},
 ti AS (SELECT lang, sum(p*q) AS t FROM (SELECT lang, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM scores GROUP BY ALL) GROUP BY lang)
SELECT x.lang, {N('np', 'n_pos')}, {N('nn', 'n_neg')}, {N('t', 'n_tied_pairs')}, {D('auc', 'auc')}, np<20 AS unstable FROM x JOIN ti ON x.lang=ti.lang""",
)
def auc_by_language(spark, sf_dir):
    return R.auc(P.scored_documents(spark, sf_dir), ["lang"], "score", "positive")


@query(
    "auc_of_score_for_large_error",
    f"""{PANEL}, s AS (SELECT rater, cond, conf, abs_e>20 AS bad FROM panel WHERE conf IS NOT NULL), {auc_cte('x', 's', 'rater, cond', 'conf', 'bad')}
SELECT rater, {D('avg(auc)', 'mean_auc')}, {N('count(auc)', 'n_cells')}, bool_or(np<20) AS any_unstable FROM x GROUP BY rater""",
)
def auc_of_score_for_large_error(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir, scores=True).withColumn("bad", F.col("abs_e") > 20)
    return R.mean_auc(R.auc(rows, ["rater", "cond"], "conf", "bad"), ["rater"])


@query(
    "auc_label_robustness",
    f"""{PANEL}, q AS (SELECT config, bin, quantile_cont(abs_e,0.9) AS q FROM panel GROUP BY ALL),
 s AS (SELECT p.config, p.bin, conf, abs_e>20 AS fixed, abs_e>q AS rel FROM panel p JOIN q ON p.config=q.config AND p.bin=q.bin WHERE conf IS NOT NULL),
 s0 AS (SELECT * FROM s WHERE bin=0), {auc_cte('x', 's', 'config', 'conf', 'fixed')}, {auc_cte('y', 's', 'config', 'conf', 'rel')}, {auc_cte('w', 's0', 'config', 'conf', 'fixed')}
SELECT x.config, {D('x.auc', 'auc_fixed')}, {D('y.auc', 'auc_relative')}, {D('w.auc', 'auc_bottom')}, {D('y.auc-x.auc', 'delta')},
 sign(x.auc-0.5)<>sign(y.auc-0.5) AS collapsed FROM x JOIN y ON x.config=y.config JOIN w ON x.config=w.config""",
)
def auc_label_robustness(spark, sf_dir):
    panel = cut_lineage(P.base_panel(spark, sf_dir, scores=True))
    q = quantiles(panel, ["config", "bin"], "abs_e", {"q": 0.9})
    rows = join_bounded(panel, q, ["config", "bin"]).withColumns(
        {"fixed": F.col("abs_e") > 20, "rel": F.col("abs_e") > F.col("q")}
    )
    fixed = R.auc(rows, ["config"], "conf", "fixed").select("config", F.col("auc").alias("auc_fixed"))
    rel = R.auc(rows, ["config"], "conf", "rel").select("config", F.col("auc").alias("auc_relative"))
    low = R.auc(rows.filter(F.col("bin") == 0), ["config"], "conf", "fixed").select(
        "config", F.col("auc").alias("auc_bottom")
    )
    out = fixed.join(rel, "config").join(low, "config")
    return out.withColumns(
        {
            "delta": F.col("auc_relative") - F.col("auc_fixed"),
            "collapsed": F.signum(F.col("auc_fixed") - 0.5) != F.signum(F.col("auc_relative") - 0.5),
        }
    )


def roc_sql(denominator: str) -> str:
    return f"""{PANEL}, s AS (SELECT config, conf, abs_e>20 AS bad FROM panel),
 t AS (SELECT config, count(*) FILTER (bad{denominator}) AS p, count(*) FILTER (NOT bad{denominator}) AS q FROM s GROUP BY config),
 l AS (SELECT config, conf, count(*) AS n, count(*) FILTER (bad) AS a, count(*) FILTER (NOT bad) AS b FROM s WHERE conf IS NOT NULL GROUP BY ALL)
SELECT l.config, {D('conf', 'level')}, {N('n', 'n_at_level')}, {D('sum(a) OVER w/p', 'tpr')}, {D('sum(b) OVER w/q', 'fpr')}
FROM l JOIN t ON l.config=t.config WINDOW w AS (PARTITION BY l.config ORDER BY conf)"""


@query("roc_points_complete", roc_sql(" AND conf IS NOT NULL"))
def roc_points_complete(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir, scores=True).withColumn("bad", F.col("abs_e") > 20)
    return R.roc_points(rows, ["config"], "conf", "bad", "drop")


@query("roc_points_all_rows", roc_sql(""))
def roc_points_all_rows(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir, scores=True).withColumn("bad", F.col("abs_e") > 20)
    return R.roc_points(rows, ["config"], "conf", "bad", "keep")


@query(
    "missing_score_bounds",
    f"""{PANEL}, m AS (SELECT rater, min(conf)-1 AS lo, max(conf)+1 AS hi FROM panel GROUP BY rater),
 f AS (SELECT p.rater, abs_e, abs_e>20 AS bad, coalesce(conf,lo) AS low, coalesce(conf,hi) AS high,
  CASE WHEN abs_e>20 THEN coalesce(conf,lo) ELSE coalesce(conf,hi) END AS fav, CASE WHEN abs_e>20 THEN coalesce(conf,hi) ELSE coalesce(conf,lo) END AS adv
  FROM panel p JOIN m ON p.rater=m.rater), {auc_cte('x', 'f', 'rater', 'fav', 'bad')}, {auc_cte('y', 'f', 'rater', 'adv', 'bad')},
 r AS (SELECT rater, {mid('low', 'rater')} AS a, {mid('high', 'rater')} AS b, {mid('abs_e', 'rater')} AS c FROM f),
 s AS (SELECT rater, corr(a,c) AS rl, corr(b,c) AS rh FROM r GROUP BY rater)
SELECT s.rater, {D('rl', 'rho_low')}, {D('rh', 'rho_high')}, {D('x.auc', 'auc_favourable')}, {D('y.auc', 'auc_adverse')} FROM s JOIN x ON s.rater=x.rater JOIN y ON s.rater=y.rater""",
)
def missing_score_bounds(spark, sf_dir):
    panel = cut_lineage(P.base_panel(spark, sf_dir, scores=True).withColumn("bad", F.col("abs_e") > 20))
    filled = R.fill_by_label(R.fill_extremes(panel, ["rater"], "conf"), "bad")
    parts = [
        R.spearman(filled, ["rater"], "low", "abs_e").select("rater", F.col("rho").alias("rho_low")),
        R.spearman(filled, ["rater"], "high", "abs_e").select("rater", F.col("rho").alias("rho_high")),
        R.auc(filled, ["rater"], "favourable", "bad").select("rater", F.col("auc").alias("auc_favourable")),
        R.auc(filled, ["rater"], "adverse", "bad").select("rater", F.col("auc").alias("auc_adverse")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "rater")
    return out


@query(
    "missing_score_by_outlier",
    f"""{PANEL} SELECT rater, {N('count(*) FILTER (conf IS NULL AND abs_e>20)', 'missing_pos')}, {N('count(*) FILTER (conf IS NULL AND abs_e<=20)', 'missing_neg')},
 {N('count(*) FILTER (conf IS NOT NULL AND abs_e>20)', 'present_pos')}, {N('count(*) FILTER (conf IS NOT NULL AND abs_e<=20)', 'present_neg')} FROM panel GROUP BY rater""",
)
def missing_score_by_outlier(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir, scores=True).withColumn("bad", F.col("abs_e") > 20)
    return R.missing_by_label(rows, ["rater"], F.col("conf").isNull(), "bad", p_value=False)


@query(
    "missing_score_exact_test",
    f"""{PANEL}, c AS (SELECT rater, count(*) FILTER (conf IS NULL AND abs_e>20) AS a, count(*) FILTER (conf IS NULL AND abs_e<=20) AS b,
  count(*) FILTER (conf IS NOT NULL AND abs_e>20) AS c, count(*) FILTER (conf IS NOT NULL AND abs_e<=20) AS d FROM panel GROUP BY rater),
 x AS (SELECT *, unnest(range(greatest(0, a-d), least(a+b, a+c)+1)) AS x FROM c),
 p AS (SELECT rater, a, b, c, d, x, lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(x+1)-lgamma(a+b-x+1)-lgamma(a+c-x+1)-lgamma(d-a+x+1) AS lp FROM x),
 o AS (SELECT rater, lp AS seen FROM p WHERE x=a)
SELECT p.rater, {N('max(a)', 'missing_pos')}, {N('max(b)', 'missing_neg')}, {N('max(c)', 'present_pos')}, {N('max(d)', 'present_neg')}, {D('least(1, sum(CASE WHEN lp<=seen+1e-7 THEN exp(lp) ELSE 0 END))', 'fisher_p')}
FROM p JOIN o ON p.rater=o.rater GROUP BY p.rater""",
)
def missing_score_exact_test(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir, scores=True).withColumn("bad", F.col("abs_e") > 20)
    return R.missing_by_label(rows, ["rater"], F.col("conf").isNull(), "bad")


@query(
    "pair_percentage_by_source",
    f"""{SCORES}, l AS (SELECT source, score, count(*) FILTER (quality=0) AS a, count(*) FILTER (quality<>0) AS b FROM scores GROUP BY ALL)
SELECT f.source, {N('max(na)', 'n_feature')}, {N('max(nb)', 'n_reference')},
 {D('100*sum(CASE WHEN f.score<g.score THEN f.a*g.b WHEN f.score=g.score THEN f.a*g.b/2.0 ELSE 0 END)/(max(na)*max(nb))', 'pct_lower')}
FROM (SELECT *, sum(a) OVER (PARTITION BY source) AS na FROM l) f JOIN (SELECT *, sum(b) OVER (PARTITION BY source) AS nb FROM l) g ON f.source=g.source GROUP BY f.source""",
)
def pair_percentage_by_source(spark, sf_dir):
    rows = P.scored_documents(spark, sf_dir).withColumn("low_quality", F.col("quality") == 0)
    return R.pair_percentage(rows, ["source"], "score", "low_quality")


@query(
    "pair_percentage_along_covariate",
    f"""WITH c AS (SELECT p_brand AS k, p_retailprice AS v, CAST(p_size%5 AS BIGINT) AS s FROM part),
 x AS (SELECT l.k, count(*) AS n, sum(CASE WHEN r.s<l.s THEN 1.0 WHEN r.s=l.s THEN 0.5 ELSE 0 END) AS w FROM c l JOIN c r ON l.k=r.k AND l.v<r.v GROUP BY l.k)
SELECT k AS brand, {N('n', 'n_pairs')}, {D('100*w/n', 'pct_lower')} FROM x""",
)
def pair_percentage_along_covariate(spark, sf_dir):
    rows = P.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("v"), (F.col("p_size") % 5).alias("s")
    )
    return R.pair_percentage_along(rows, ["brand"], "v", "s", [0, 1, 2, 3, 4])


@query(
    "path_agreement",
    f"""{PATHS}, d AS (SELECT rater, cond, pred, pred2, pred-pred2 AS d FROM paths),
 r AS (SELECT rater, cond, {mid('pred', 'rater, cond')} AS a, {mid('pred2', 'rater, cond')} AS b FROM paths), s AS (SELECT rater, cond, corr(a,b) AS rho FROM r GROUP BY ALL),
 q AS (SELECT rater, cond, count(*) AS n, avg(CASE WHEN d=0 THEN 1.0 ELSE 0 END) AS ex, avg(d) AS md, median(abs(d)) AS m, quantile_cont(abs(d),0.75)-quantile_cont(abs(d),0.25) AS iq,
  quantile_cont(d,0.025) AS lo, quantile_cont(d,0.975) AS hi FROM d GROUP BY ALL)
SELECT q.rater, q.cond, {N('n', 'n')}, {D('ex', 'exact_rate')}, {D('md', 'mean_diff')}, {D('m', 'median_abs')}, {D('iq', 'iqr_abs')}, {D('lo', 'limit_lo')}, {D('hi', 'limit_hi')}, {D('rho', 'rho')}
FROM q JOIN s ON q.rater=s.rater AND q.cond=s.cond""",
)
def path_agreement(spark, sf_dir):
    return A.path_agreement(cut_lineage(P.path_panel(spark, sf_dir)), ["rater", "cond"])


def path_table(spark, sf_dir, item: str):
    per = P.path_panel(spark, sf_dir).groupBy(item, "bin").agg(F.avg("abs_e").alias("m"), F.avg("abs_e2").alias("m2"))
    return per.groupBy(item).agg(F.avg("m").alias("local"), F.avg("m2").alias("other"))


def path_table_sql(item: str) -> str:
    return f"""{PATHS}, pb AS (SELECT {item}, bin, avg(abs_e) AS m, avg(abs_e2) AS m2 FROM paths GROUP BY ALL),
 t AS (SELECT {item} AS k, avg(m) AS x, avg(m2) AS y FROM pb GROUP BY {item}),
 pr AS (SELECT a.k AS a, b.k AS b, a.x-b.x AS dx, a.y-b.y AS dy FROM t a JOIN t b ON a.k<b.k)"""


@query(
    "ranking_agreement",
    f"""{path_table_sql('config')}, w AS (SELECT (SELECT k FROM t ORDER BY x, k LIMIT 1) AS wx, (SELECT k FROM t ORDER BY y, k LIMIT 1) AS wy),
 s AS (SELECT count(*) AS n, count(*) FILTER (sign(dx)*sign(dy)>0) AS c, count(*) FILTER (sign(dx)*sign(dy)<0) AS d, sum(sign(dx)*sign(dy))/sqrt(count(*) FILTER (dx<>0)*count(*) FILTER (dy<>0)) AS tau FROM pr)
SELECT {N('n', 'n_pairs')}, {N('c', 'concordant')}, {N('d', 'discordant')}, {D('tau', 'tau_b')}, {D('(tau+1)/2', 'concordant_share')}, wx AS winner_x, wy AS winner_y, wx=wy AS same_winner FROM s, w""",
)
def ranking_agreement(spark, sf_dir):
    return A.ranking_agreement(path_table(spark, sf_dir, "config"), "config", "local", "other")


@query(
    "rank_reversals",
    f"""{path_table_sql('config')} SELECT a, b, {D('dx', 'delta_x')}, {D('dy', 'delta_y')}, sign(dx)*sign(dy)<0 AS reversed FROM pr""",
)
def rank_reversals(spark, sf_dir):
    return R.rank_reversals(path_table(spark, sf_dir, "config"), "config", "local", "other")


def trend_sql(source: str, value: str, group: str, groups: list, keys: str = "") -> str:
    """J by its pairwise definition on value-compressed counts, and the three-term tied variance."""
    k = f"{keys}, " if keys else ""
    on = "".join(f" AND a.{c.strip()}=b.{c.strip()}" for c in keys.split(",") if keys)
    sel = "".join(f"a.{c.strip()}, " for c in keys.split(",") if keys)
    cross = "".join(f" AND s.{c.strip()}=j.{c.strip()} AND t.{c.strip()}=j.{c.strip()}" for c in keys.split(",") if keys)
    per = ", ".join(f"sum(CASE WHEN {group}={g!r} THEN 1 ELSE 0 END) AS n_{i}" for i, g in enumerate(groups))
    ns = [f"n_{i}" for i in range(len(groups))]
    tot = "+".join(ns)
    f3 = "+".join(f"{n}*({n}-1.0)*(2*{n}+5)" for n in ns)
    f2 = "+".join(f"{n}*({n}-1.0)*({n}-2)" for n in ns)
    f1 = "+".join(f"{n}*({n}-1.0)" for n in ns)
    sq = "+".join(f"{n}*{n}" for n in ns)
    mx = "+".join(f"{ns[i]}*{ns[j]}" for i in range(len(ns)) for j in range(i + 1, len(ns)))
    gb = f" GROUP BY {keys}" if keys else ""
    return f"""lv AS (SELECT {k}{group} AS g, {value} AS v, count(*) AS n FROM {source} GROUP BY ALL),
 jj AS (SELECT {sel}sum(CASE WHEN b.v>a.v THEN a.n*b.n WHEN b.v=a.v THEN a.n*b.n/2.0 ELSE 0 END) AS j FROM lv a JOIN lv b ON a.g<b.g{on}{gb.replace(keys, ', '.join('a.' + c.strip() for c in keys.split(','))) if keys else ''}),
 sz AS (SELECT {k}{per} FROM {source}{gb}),
 ti AS (SELECT {k}sum(t*(t-1.0)*(2*t+5)) AS ta, sum(t*(t-1.0)*(t-2)) AS tb, sum(t*(t-1.0)) AS tc FROM (SELECT {k}{value}, CAST(count(*) AS DOUBLE) AS t FROM {source} GROUP BY ALL){gb}),
 jt AS (SELECT {''.join('j.' + c.strip() + ', ' for c in keys.split(',') if keys)}{', '.join('s.' + n for n in ns)}, j, (({tot})*({tot})-({sq}))/4.0 AS mean_j, ({mx}) AS max_j,
  (({tot})*(({tot})-1.0)*(2*({tot})+5)-({f3})-ta)/72.0+({f2})*tb/(36.0*({tot})*(({tot})-1)*(({tot})-2))+({f1})*tc/(8.0*({tot})*(({tot})-1)) AS var_j
  FROM jj j, sz s, ti t WHERE true{cross})"""


TREND_COLUMNS = f"""{', '.join(N(f'n_{i}', f'n_{i}') for i in range(5))}, {D('j', 'j')}, {D('mean_j', 'mean_j')}, {D('max_j', 'max_j')}, {D('var_j/1e6', 'var_j_millions')},
 {D('(j-mean_j)/sqrt(var_j)', 'z')}, {D('2*(j-mean_j)/max_j', 'j_bar')}"""


@query(
    "trend_over_bins",
    f"""{PANEL}, u AS (SELECT unit, bin, round(avg(abs_e),9) AS a FROM panel GROUP BY ALL), {trend_sql('u', 'a', 'bin', [0, 1, 2, 3, 4])}
SELECT {TREND_COLUMNS} FROM jt""",
)
def trend_over_bins(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], ["abs_e"], ["bin"], digits=9)
    out = T.trend(per_unit, [], "abs_e", "bin", [0, 1, 2, 3, 4])
    return out.withColumn("var_j_millions", F.col("var_j") / 1e6).drop("var_j")


@query(
    "trend_by_rater_stratified",
    f"""{PANEL}, {trend_sql('panel', 'abs_e', 'bin', [0, 1, 2, 3, 4], 'rater, cond')}
SELECT rater, {D('sum(j)', 'j')}, {D('sum(mean_j)', 'mean_j')}, {D('(sum(j)-sum(mean_j))/sqrt(sum(var_j))', 'z')} FROM jt GROUP BY rater""",
)
def trend_by_rater_stratified(spark, sf_dir):
    per = T.trend(P.base_panel(spark, sf_dir), ["rater", "cond"], "abs_e", "bin", [0, 1, 2, 3, 4])
    return T.stratified_trend(per, ["rater"]).drop("var_j")


@query(
    "permuted_labels",
    f"""{PANEL}, u AS (SELECT DISTINCT unit, bin FROM panel), s AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) AS top FROM u GROUP BY bin),
 p AS (SELECT rep, unit, row_number() OVER (PARTITION BY rep ORDER BY CAST(('0x'||substr(md5('7:'||rep||':'||unit),1,13)) AS BIGINT)) AS rn FROM u, range(1,6) t(rep))
SELECT {N('rep', 'rep')}, unit, (SELECT min(bin) FROM s WHERE top>=rn) AS bin FROM p""",
)
def permuted_labels(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], ["abs_e"], ["bin"], digits=9)
    return T.permuted_groups(per_unit, "unit", "abs_e", "bin", [0, 1, 2, 3, 4], 5, 7, "md5").select("rep", "unit", "bin")


def permuted_places_sql(source: str, label: str, seed: int, reps: int) -> str:
    """``placed`` (rep, unit, place): the keyed bijection of ``source``'s dense places, a row per step; needs WITH RECURSIVE."""
    x = "(CASE WHEN t%2=0 THEN r ELSE l END)"
    once = f"((({x}+k1)*({x}+k1))%{PRIME}+k2)"
    mixed = f"(({once}*{once})%{PRIME})"
    return f"""ix AS (SELECT unit, row_number() OVER (ORDER BY floor(CAST(('0x'||substr(md5('0:'||unit),1,13)) AS BIGINT)/4503599627370496.0*1024), unit)-1 AS idx FROM {source}),
 rx AS (SELECT n, a, (n+a-1)//a AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM {source})),
 ks AS (SELECT rep, s, CAST(('0x'||substr(h,1,7)) AS BIGINT) AS k1, CAST(('0x'||substr(h,8,7)) AS BIGINT) AS k2 FROM (SELECT rep, s, md5('{seed}:{label}:'||rep||':'||s) AS h FROM range(1,{reps + 1}) a(rep), range({STEPS}) b(s))),
 walk AS (SELECT rep, unit, 0 AS t, idx//b AS l, idx%b AS r, a, b, n FROM ix, rx, range(1,{reps + 1}) q(rep) UNION ALL
  SELECT w.rep, unit, t+1, CASE WHEN t%2=0 THEN (l+{mixed})%a ELSE l END, CASE WHEN t%2=1 THEN (r+{mixed})%b ELSE r END, a, b, n
  FROM walk w JOIN ks ON ks.rep=w.rep AND ks.s=t%{STEPS} WHERE t=0 OR t%{STEPS}<>0 OR l*b+r>=n),
 placed AS (SELECT rep, unit, l*b+r AS place FROM walk WHERE t>0 AND t%{STEPS}=0 AND l*b+r<n)"""


def permutation_sql(reps: int, seed: int, alpha: float) -> str:
    counts = ", ".join(f"count(*) FILTER (g={i}) AS m{i}" for i in range(5))
    below = ", ".join(f"sum(m{i}) OVER (PARTITION BY rep ORDER BY a)-m{i}/2.0 AS s{i}" for i in range(5))
    pairs = "+".join(f"m{h}*s{g}" for h in range(5) for g in range(h))
    base = f"""{PANEL}, u AS (SELECT unit, bin, round(avg(abs_e),9) AS a FROM panel GROUP BY ALL), {trend_sql('u', 'a', 'bin', [0, 1, 2, 3, 4])},
 {permuted_places_sql('u', 'trend', seed, reps)},
 top AS (SELECT bin AS g, sum(count(*)) OVER (ORDER BY bin) AS top FROM u GROUP BY bin),
 dealt AS (SELECT rep, a, (SELECT min(g) FROM top WHERE top>place) AS g FROM placed p JOIN u ON p.unit=u.unit),
 rc AS (SELECT rep, a, {counts} FROM dealt GROUP BY ALL), rb AS (SELECT *, {below} FROM rc), rj AS (SELECT rep, sum({pairs}) AS js FROM rb GROUP BY rep),
 ex AS (SELECT count(*) FILTER (abs(js-mean_j)>=abs(j-mean_j)) AS e FROM rj, jt), pv AS (SELECT *, (1+e)/{reps + 1}.0 AS p FROM ex)
SELECT {TREND_COLUMNS}, {N('e', 'exceedances')}, {D('p', 'p_perm')}, e=0 AS at_floor, {D(f'1.0/{reps + 1}', 'floor')},
 CASE WHEN p>={alpha} THEN 'null' WHEN j>mean_j THEN 'increasing' ELSE 'decreasing' END AS direction FROM jt, pv"""
    return base.replace("WITH ", "WITH RECURSIVE ", 1)


@query("permutation_trend", permutation_sql(199, 11, 0.05))
def permutation_trend(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], ["abs_e"], ["bin"], digits=9)
    out = T.permutation_trend(per_unit, "unit", "abs_e", "bin", [0, 1, 2, 3, 4], 199, 11, 0.05, "md5")
    return out.withColumn("var_j_millions", F.col("var_j") / 1e6).drop("var_j")


@query(
    "permuted_trend_statistics",
    permutation_sql(49, 12, 0.05).split("\nSELECT")[0] + f" SELECT {N('rep', 'rep')}, {D('js', 'j')} FROM rj",
)
def permuted_trend_statistics(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], ["abs_e"], ["bin"], digits=9)
    return T.permuted_statistics(per_unit, "unit", "abs_e", "bin", [0, 1, 2, 3, 4], 49, 12, "md5")


@query(
    "kruskal_wallis_by_rater",
    f"""{PANEL}, r AS (SELECT rater, bin, {mid('e', 'rater')} AS r, count(*) OVER (PARTITION BY rater, e) AS t FROM panel),
 g AS (SELECT rater, bin, sum(r) AS s, count(*) AS n, sum(CAST(t AS DOUBLE)*t-1) AS tt FROM r GROUP BY ALL)
SELECT rater, {N('sum(n)', 'n')}, {N('count(*)-1', 'df')},
 {D('(12.0/(sum(n)*(sum(n)+1.0))*sum(s*s/n)-3*(sum(n)+1))/(1-sum(tt)/(CAST(sum(n) AS DOUBLE)*sum(n)*sum(n)-sum(n)))', 'h')} FROM g GROUP BY rater""",
)
def kruskal_wallis_by_rater(spark, sf_dir):
    return R.kruskal_wallis(P.base_panel(spark, sf_dir), ["rater"], "e", "bin")


@query(
    "mann_whitney_conditions",
    f"""{PANEL}, r AS (SELECT rater, cond, {mid('abs_e', 'rater')} AS r, count(*) OVER (PARTITION BY rater, abs_e) AS t FROM panel),
 g AS (SELECT rater, CAST(count(*) FILTER (cond='F') AS DOUBLE) AS a, CAST(count(*) FILTER (cond='O') AS DOUBLE) AS b, sum(CASE WHEN cond='F' THEN r END)-count(*) FILTER (cond='F')*(count(*) FILTER (cond='F')+1)/2.0 AS u,
  sum(CAST(t AS DOUBLE)*t-1) AS tt FROM r GROUP BY rater)
SELECT rater, {N('a', 'n_first')}, {N('b', 'n_second')}, {D('u', 'u')}, {D('(greatest(u,a*b-u)-a*b/2-0.5)/sqrt(a*b/12*(a+b+1-tt/((a+b)*(a+b-1))))', 'z')} FROM g""",
)
def mann_whitney_conditions(spark, sf_dir):
    return R.mann_whitney(P.base_panel(spark, sf_dir), ["rater"], "abs_e", "cond", "F", "O")


@query(
    "chi_square_cluster_by_bin",
    f"""{PANEL}, u AS (SELECT DISTINCT unit, clus, bin FROM panel), c AS (SELECT clus, bin, count(*) AS n FROM u GROUP BY ALL),
 e AS (SELECT n, sum(n) OVER (PARTITION BY clus)*sum(n) OVER (PARTITION BY bin)/sum(n) OVER () AS e, sum(n) OVER () AS t FROM c)
SELECT {D('sum((n-e)*(n-e)/e)', 'chi2')}, {N('8', 'df')}, {N('max(t)', 'n')} FROM e""",
)
def chi_square_cluster_by_bin(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], [], ["clus", "bin"])
    return R.chi_square(M.crosstab(per_unit, "clus", "bin"), "clus", "bin")


NORMALITY_SQL = f"""{PANEL}, m AS (SELECT config, CAST(count(*) AS DOUBLE) AS n, avg(e) AS a, avg(e*e) AS b, avg(e*e*e) AS c, avg(e*e*e*e) AS d FROM panel GROUP BY config),
 z AS (SELECT config, n, b-a*a AS v, c-3*a*b+2*a*a*a AS t, d-4*a*c+6*a*a*b-3*a*a*a*a AS q FROM m),
 s AS (SELECT config, n, t/power(v,1.5) AS skew, q/(v*v) AS kurt FROM z),
 y AS (SELECT *, skew*sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS be,
  (kurt-3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS sb FROM s),
 w AS (SELECT *, sqrt(2*(be-1))-1 AS w2, 6+8/sb*(2/sb+sqrt(1+4/(sb*sb))) AS aa FROM y),
 k AS (SELECT config, n, skew, kurt, asinh(y/sqrt(2/(w2-1)))/sqrt(ln(sqrt(w2))) AS z1, (1-2/(9*aa)-cbrt((1-2/aa)/(1+x*sqrt(2/(aa-4)))))/sqrt(2/(9*aa)) AS z2 FROM w)
SELECT config, {D('n', 'n')}, {D('skew', 'skew')}, {D('kurt', 'kurt')}, {D('z1*z1+z2*z2', 'k2')}, {D('exp(-(z1*z1+z2*z2)/2)', 'p')} FROM k"""


@query("normality_of_errors", NORMALITY_SQL)
def normality_of_errors(spark, sf_dir):
    return R.normality(P.base_panel(spark, sf_dir), ["config"], "e")


@query("rank_test_p_values")
def rank_test_p_values(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir)
    kw = R.kruskal_wallis(panel, ["rater"], "e", "bin")
    mw = R.mann_whitney(panel, ["rater"], "abs_e", "cond", "F", "O").select("rater", "z")
    return kw.join(mw, "rater").withColumns(
        {"kruskal_p": Dist.chi2_p("h", F.col("df").cast("double")), "mann_whitney_p": Dist.normal_p("z")}
    )
