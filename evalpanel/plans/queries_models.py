"""Covariate models, response extraction, streams, rasters and contracts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalpanel.functions.columns import with_bins, EIGHT_EDGES, FIVE_EDGES
from evalpanel.functions.levels import join_null_safe, quantiles
from evalpanel.operators import contracts as K
from evalpanel.operators import extract as X
from evalpanel.operators import intervals as I
from evalpanel.operators import metrics as M
from evalpanel.operators import raster as RA
from evalpanel.operators import regress as L
from evalpanel.operators import resample as B
from evalpanel.plans import panels as P
from evalpanel.plans.queries_metrics import with_quartiles
from evalpanel.plans.queries_resample import draw_sql, index_sql, u_sql
from evalpanel.plans.registry import D, N, query
from evalpanel.session import cut_lineage
from evalpanel.streaming import responses as ST

PANEL = P.with_sql(P.PANEL_SQL)
PANEL_COV = P.with_sql(P.PANEL_SQL, P.COVARIATE_SQL)


# ---- covariate models ----

def model_units(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], ["abs_e"], ["bin", "reference"])
    return L.design(per_unit.join(P.covariates(spark, sf_dir), "unit"), "cont", 5, ["ord_a", "ord_b"])


@query(
    "simple_regression_by_config",
    f"""{PANEL} SELECT rater, cond, {D('regr_intercept(pred, reference)', 'intercept')}, {D('regr_slope(pred, reference)', 'slope')}, {D('regr_r2(pred, reference)', 'r2')} FROM panel GROUP BY rater, cond""",
)
def simple_regression_by_config(spark, sf_dir):
    keys = ["rater", "cond"]
    fitted = L.fit(L.cross_products(P.base_panel(spark, sf_dir), ["reference"], "pred", keys), ["reference"], keys)
    return fitted.select(*keys, F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope"), "r2")


@query(
    "two_covariate_regression",
    f"""{PANEL_COV}, d AS (SELECT p.rater, p.abs_e AS y, p.reference AS u, c.cont AS v FROM panel p JOIN covs c ON p.unit=c.unit),
 s AS (SELECT rater, covar_pop(u,y) AS uy, covar_pop(v,y) AS vy, covar_pop(u,v) AS uv, var_pop(u) AS uu, var_pop(v) AS vv, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM d GROUP BY rater),
 b AS (SELECT *, (uy*vv-vy*uv)/(uu*vv-uv*uv) AS bu, (vy*uu-uy*uv)/(uu*vv-uv*uv) AS bv FROM s)
SELECT rater, 'const' AS term, {D('my-bu*mu-bv*mv', 'coef')} FROM b UNION ALL SELECT rater, 'reference', {D('bu', 'coef')} FROM b UNION ALL SELECT rater, 'cont', {D('bv', 'coef')} FROM b""",
)
def two_covariate_regression(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir).join(P.covariates(spark, sf_dir).select("unit", "cont"), "unit")
    xs = ["reference", "cont"]
    return L.coefficients(L.fit(L.cross_products(rows, xs, "abs_e", ["rater"]), xs, ["rater"]), xs, ["rater"])


@query("covariate_model")
def covariate_model(spark, sf_dir):
    units, xs = model_units(spark, sf_dir)
    return L.coefficients(L.fit(L.cross_products(units, xs, "abs_e"), xs), xs)


@query("covariate_model_by_level")
def covariate_model_by_level(spark, sf_dir):
    covs = P.covariates(spark, sf_dir)
    long = P.base_panel(spark, sf_dir).select(
        "unit", "bin", "abs_e", F.expr("stack(2, 'rater', rater, 'cond', cond) AS (axis, level)")
    )
    per_unit = M.unit_means(long, ["axis", "level"], ["abs_e"], ["bin"])
    units, xs = L.design(per_unit.join(covs, "unit"), "cont", 5, ["ord_a", "ord_b"])
    return L.coefficients(L.fit(L.cross_products(units, xs, "abs_e", ["axis", "level"]), xs, ["axis", "level"]), xs, ["axis", "level"])


@query("covariate_model_intervals")
def covariate_model_intervals(spark, sf_dir):
    units, xs = model_units(spark, sf_dir)
    weighted = B.poisson_draws(units, 81, 100)
    fits = L.fit(L.cross_products(weighted, xs, "abs_e", ["rep"], "w"), xs, ["rep"])
    return I.percentile_interval(L.coefficients(fits, xs, ["rep"]).withColumnRenamed("coef", "theta"), ["term"])


@query("covariate_block_test")
def covariate_block_test(spark, sf_dir):
    units, xs = model_units(spark, sf_dir)
    return L.block_permutation_test(cut_lineage(units), xs, "abs_e", ["ord_a_1", "ord_a_2"], "bin", 99, 82)


@query("median_regression")
def median_regression(spark, sf_dir):
    units, xs = model_units(spark, sf_dir)
    found = L.median_regression(units, xs, "abs_e")
    return spark.createDataFrame([(k, v) for k, v in found.items()], "term string, coef double")


@query(
    "variance_inflation",
    f"""WITH {P.COVARIATE_SQL}, r AS (SELECT corr(p_size, p_retailprice) AS r FROM part)
SELECT 'p_size' AS term, {D('1/(1-r*r)', 'vif')} FROM r UNION ALL SELECT 'p_retailprice', {D('1/(1-r*r)', 'vif')} FROM r""",
)
def variance_inflation(spark, sf_dir):
    part = P.table(spark, sf_dir, "part").withColumn("y", F.lit(0.0))
    xs = ["p_size", "p_retailprice"]
    return L.variance_inflation(L.cross_products(part, xs, "y"), xs)


@query("collinearity_flags")
def collinearity_flags(spark, sf_dir):
    units, xs = model_units(spark, sf_dir)
    vifs = L.variance_inflation(L.cross_products(units, xs, "abs_e"), xs)
    blocks = {"bin": [x for x in xs if x.startswith("bin")], "a": ["ord_a_1", "ord_a_2"], "b": ["ord_b_1", "ord_b_2"], "cont": ["cont_z"]}
    return L.block_flags(vifs, blocks)


@query("linearity_check")
def linearity_check(spark, sf_dir):
    units, xs = model_units(spark, sf_dir)
    return L.linearity_check(with_quartiles(units, "cont"), xs[:-1], "cont_z", "quartile", "abs_e")


@query(
    "aliased_design",
    f"""SELECT {N('count(DISTINCT n_regionkey)', 'rank')}, {N('10', 'columns')}, {N('10-count(DISTINCT n_regionkey)', 'aliased')} FROM nation""",
)
def aliased_design(spark, sf_dir):
    # Region indicators next to a copy of each: the copies add nothing to the rank.
    nation = P.table(spark, sf_dir, "nation").withColumn("y", F.lit(0.0))
    cols = {f"r_{i}": (F.col("n_regionkey") == i).cast("double") for i in range(1, 5)}
    cols |= {f"s_{i}": F.col("n_regionkey").eqNullSafe(F.lit(i)).cast("double") for i in range(0, 5)}
    return L.design_rank(L.cross_products(nation.withColumns(cols), list(cols), "y"), list(cols))


@query(
    "level_error_table",
    f"""{PANEL_COV}, d AS (SELECT p.cond, p.abs_e, p.e, c.ord_a FROM panel p JOIN covs c ON p.unit=c.unit)
SELECT 'pooled' AS scope, {N('ord_a', 'ord_a')}, {N('count(*)', 'n')}, {D('avg(abs_e)', 'mae')}, {D('avg(e)', 'bias')} FROM d GROUP BY ord_a
UNION ALL SELECT cond, {N('ord_a', 'ord_a')}, {N('count(*)', 'n')}, {D('avg(abs_e)', 'mae')}, {D('avg(e)', 'bias')} FROM d GROUP BY cond, ord_a""",
)
def level_error_table(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir).join(P.covariates(spark, sf_dir), "unit")
    return L.level_table_of(rows, ["cond"], "ord_a")


@query(
    "level_error_intervals",
    f"""{PANEL_COV}, {index_sql()}, {draw_sql(83, 60)}, rw AS (SELECT d.rep, i.unit FROM dr d JOIN ix i ON d.idx=i.idx),
 th AS (SELECT cond, ord_a, rep, avg(abs_e) AS theta FROM rw JOIN panel p ON rw.unit=p.unit JOIN covs c ON c.unit=p.unit GROUP BY ALL)
SELECT cond, {N('ord_a', 'ord_a')}, {D('quantile_cont(theta,0.025)', 'ci_lo')}, {D('quantile_cont(theta,0.975)', 'ci_hi')} FROM th GROUP BY cond, ord_a""",
)
def level_error_intervals(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir).join(P.covariates(spark, sf_dir).select("unit", "ord_a"), "unit")
    reps = B.replicates(rows, ["cond", "ord_a"], B.mean_of("abs_e"), 60, 83, hasher="md5")
    return I.percentile_interval(reps, ["cond", "ord_a"]).select("cond", "ord_a", "ci_lo", "ci_hi")


@query(
    "covariate_by_bin",
    f"""{PANEL_COV}, u AS (SELECT DISTINCT unit, bin FROM panel) SELECT bin, {N('count(*)', 'n')}, {D('avg(cont)', 'mean')}, {D('stddev_samp(cont)', 'sd')}, {D('quantile_cont(cont,0.25)', 'q1')},
 {D('median(cont)', 'median')}, {D('quantile_cont(cont,0.75)', 'q3')}, {D('quantile_cont(cont,0.75)-quantile_cont(cont,0.25)', 'iqr')} FROM u JOIN covs c ON u.unit=c.unit GROUP BY bin""",
)
def covariate_by_bin(spark, sf_dir):
    per_unit = M.unit_means(P.base_panel(spark, sf_dir), [], [], ["bin"])
    return M.bin_spread(per_unit.join(P.covariates(spark, sf_dir), "unit"), [], "cont", 10.0)


@query(
    "difference_by_covariate_quartile",
    f"""{PANEL_COV}, u AS (SELECT unit, avg(abs(pred_mid-reference)-abs_e) AS d FROM panel GROUP BY unit), j AS (SELECT u.d, c.cont FROM u JOIN covs c ON u.unit=c.unit),
 q AS (SELECT quantile_cont(cont,0.25) AS a, quantile_cont(cont,0.5) AS b, quantile_cont(cont,0.75) AS c FROM j)
SELECT {N('CASE WHEN cont<=a THEN 0 WHEN cont<=b THEN 1 WHEN cont<=c THEN 2 ELSE 3 END', 'quartile')}, {N('count(*)', 'n')}, {D('min(cont)', 'lo')}, {D('max(cont)', 'hi')}, {D('avg(d)', 'mean_d')}, {D('median(d)', 'median_d')} FROM j, q GROUP BY 1""",
)
def difference_by_covariate_quartile(spark, sf_dir):
    panel = P.base_panel(spark, sf_dir, variants=True).withColumn("d", F.abs(F.col("pred_mid") - F.col("reference")) - F.col("abs_e"))
    per_unit = M.unit_means(panel, [], ["d"]).join(P.covariates(spark, sf_dir), "unit")
    binned = with_quartiles(per_unit, "cont")
    agg = binned.groupBy("quartile").agg(F.count("*").alias("n"), F.min("cont").alias("lo"), F.max("cont").alias("hi"), F.avg("d").alias("mean_d"))
    return join_null_safe(agg, quantiles(binned, ["quartile"], "d", {"median_d": 0.5}), ["quartile"])


@query(
    "identical_split_contrast",
    f"""{PANEL_COV}, d AS (SELECT c.ord_a=2 AS g, p.reference%6=4 AS h, p.abs_e FROM panel p JOIN covs c ON p.unit=c.unit)
SELECT {D('avg(CASE WHEN g THEN abs_e END)-avg(CASE WHEN NOT g THEN abs_e END)', 'difference')}, bool_and(g=h) AS identical FROM d""",
)
def identical_split_contrast(spark, sf_dir):
    rows = P.base_panel(spark, sf_dir).join(P.covariates(spark, sf_dir), "unit").withColumns(
        {"g": F.col("ord_a") == 2, "h": F.col("reference") % 6 == 4}
    )
    diff = rows.agg((F.avg(F.when(F.col("g"), F.col("abs_e"))) - F.avg(F.when(~F.col("g"), F.col("abs_e")))).alias("difference"))
    return diff.join(F.broadcast(L.identical_columns(rows, "g", "h").select("identical")))


# ---- responses ----

def responses(events: DataFrame) -> DataFrame:
    """Raw texts of every kind from the events table: plain, fenced, narrated, torn, boolean, nested, revised, listed."""
    kind = F.col("event_id") % 8
    score = F.get_json_object("props", "$.k").cast("double") / 100
    v, c = F.col("value").cast("string"), score.cast("string")
    obj = lambda key, a, b: F.concat(F.lit('{"' + key + '": '), a, F.lit(', "confidence": '), b, F.lit("}"))
    plain = obj("vegetation_percent", v, c)
    text = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit('I answer as {"vegetation_percent": <number>, "confidence": <number>} since "a { b" is open. '), plain))
        .when(kind == 3, F.concat(F.lit('{"vegetation_percent": '), v, F.lit(', "confidence": ')))
        .when(kind == 4, obj("vegetation_percent", F.lit("true"), c))
        .when(kind == 5, F.concat(F.lit('{"answer": '), plain, F.lit(', "note": "}{"}')))
        .when(kind == 6, F.concat(obj("vegetation_percent", F.lit("1.5"), F.lit("0.1")), F.lit(" revised: "), obj("vegetation_cover", v, c)))
        .otherwise(F.concat(F.lit("["), plain, F.lit("]")))
    )
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("unit"),
        F.col("event_type").alias("rater"),
        F.when(F.col("value") % 2 < 1, "p1").otherwise("p2").alias("cond"),
        F.when(F.col("value") <= 99, text).alias("raw_text"),
        F.col("value").alias("latency_ms"),
    )


RESPONSES_SQL = """
resp AS (SELECT event_id, ts, user_id AS unit, event_type AS rater, CASE WHEN value % 2 < 1 THEN 'p1' ELSE 'p2' END AS cond, value AS latency_ms,
  CASE WHEN value<=99 AND event_id%8 NOT IN (3,4) THEN value END AS v, CASE WHEN value<=99 AND event_id%8 NOT IN (3,4) THEN CAST(json_extract_string(props,'$.k') AS DOUBLE)/100 END AS c,
  CASE WHEN value>99 THEN 'INFERENCE_FAILURE' WHEN event_id%8 IN (3,4) THEN 'JSON_PARSE_FAILURE' ELSE '' END AS outcome FROM events)
"""
RESP = P.with_sql(RESPONSES_SQL)


def parsed(spark, sf_dir):
    return ST.answered(responses(P.table(spark, sf_dir, "events")))


@query("parsed_responses", f"{RESP} SELECT event_id, {D('v', 'value')}, {D('c', 'score')}, outcome FROM resp")
def parsed_responses(spark, sf_dir):
    return parsed(spark, sf_dir).select("event_id", "value", "score", "outcome")


@query(
    "parse_outcomes",
    f"""{RESP} SELECT rater, cond, {N('count(*)', 'n')}, {N("count(*) FILTER (outcome='')", 'n_ok')}, {N("count(*) FILTER (outcome='JSON_PARSE_FAILURE')", 'n_parse_failure')}, {N("count(*) FILTER (outcome='INFERENCE_FAILURE')", 'n_inference_failure')} FROM resp GROUP BY rater, cond""",
)
def parse_outcomes(spark, sf_dir):
    return X.outcome_counts(parsed(spark, sf_dir), ["rater", "cond"])


AXES = {"rater": ["click", "error", "purchase", "signup", "view"], "cond": ["p1", "p2"]}


@query(
    "pending_grid",
    f"""{RESP}, u AS (SELECT DISTINCT user_id AS unit FROM events), g AS (SELECT unit, rater, cond FROM u, (SELECT unnest(['click','error','purchase','signup','view']) AS rater), (SELECT unnest(['p1','p2']) AS cond)),
 d AS (SELECT DISTINCT unit, rater, cond FROM resp WHERE outcome IN ('','JSON_PARSE_FAILURE'))
SELECT g.unit, g.rater, g.cond FROM g ANTI JOIN d ON g.unit=d.unit AND g.rater=d.rater AND g.cond=d.cond""",
)
def pending_grid(spark, sf_dir):
    ids = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("unit")).distinct()
    return X.pending(ids, AXES, parsed(spark, sf_dir))


@query(
    "phase_completeness",
    f"""{RESP}, u AS (SELECT DISTINCT unit FROM resp), g AS (SELECT unit, rater, cond FROM u, (SELECT unnest(['click','error','purchase','signup','view']) AS rater), (SELECT unnest(['p1','p2']) AS cond)),
 d AS (SELECT DISTINCT unit, rater, cond FROM resp WHERE outcome IN ('','JSON_PARSE_FAILURE'))
SELECT {N('count(*)', 'n_pending')}, count(*)=0 AS complete FROM g ANTI JOIN d ON g.unit=d.unit AND g.rater=d.rater AND g.cond=d.cond""",
)
def phase_completeness(spark, sf_dir):
    log = parsed(spark, sf_dir)
    return X.is_complete(log.select("unit").distinct(), AXES, log)


@query(
    "first_answers",
    f"""{RESP}, f AS (SELECT *, row_number() OVER (PARTITION BY unit, rater, cond ORDER BY ts, event_id) AS rn FROM resp WHERE outcome='')
SELECT unit, rater, cond, event_id, {D('v', 'value')} FROM f WHERE rn=1""",
)
def first_answers(spark, sf_dir):
    good = parsed(spark, sf_dir).filter(F.col("outcome") == X.OK)
    return X.first_by(good, ["unit", "rater", "cond"], ["ts", "event_id"]).select("unit", "rater", "cond", "event_id", "value")


@query(
    "merged_success_metrics",
    f"""{RESP}, m AS (SELECT * FROM resp WHERE cond='p1' AND outcome='' UNION ALL SELECT * FROM resp WHERE cond='p2')
SELECT rater, {N('count(*)', 'n')}, {N('count(v)', 'n_valid')}, {D('avg(v)', 'mean_value')} FROM m GROUP BY rater""",
)
def merged_success_metrics(spark, sf_dir):
    log = parsed(spark, sf_dir)
    both = X.merge_successes(log.filter(F.col("cond") == "p1"), log.filter(F.col("cond") == "p2"))
    return both.groupBy("rater").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"), F.avg("value").alias("mean_value"))


@query(
    "latency_summary",
    f"""{RESP} SELECT rater, {N('count(*)', 'n')}, {D('avg(latency_ms)', 'mean')}, {D('max(latency_ms)', 'max')}, {D('median(latency_ms)', 'p50')}, {D('quantile_cont(latency_ms,0.95)', 'p95')} FROM resp GROUP BY rater""",
)
def latency_summary(spark, sf_dir):
    return X.latency_summary(responses(P.table(spark, sf_dir, "events")), ["rater"])


# ---- streams ----

def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder in shared storage; only a local session without it gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") if shared is None else f"{shared}/{name}-{uuid.uuid4()}"


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Drain the stream into Parquet files, each result once: state ends with the watermark."""
    spark = stream.sparkSession
    folder = stream_folder(spark, name)
    ST.append_sink(stream, f"{folder}/out", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_latest(stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Drain the stream, writing the results that each batch changes, and read the last one of every key."""
    folder = stream_folder(stream.sparkSession, name)
    ST.update_sink(stream, f"{folder}/out", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return ST.latest(stream.sparkSession, f"{folder}/out", stream.schema, key)


@query(
    "stream_running_metrics",
    f"""{RESP}, r AS (SELECT p_partkey AS unit, CAST(2.0*p_size AS DOUBLE) AS reference FROM part), j AS (SELECT rater, v-reference AS e, CAST(CASE WHEN reference<=20 THEN 0 WHEN reference<=40 THEN 1 WHEN reference<=60 THEN 2 WHEN reference<=80 THEN 3 ELSE 4 END AS BIGINT) AS bin
  FROM resp JOIN r ON resp.unit=r.unit WHERE outcome='')
SELECT rater, bin, {N('count(*)', 'n')}, {D('sum(abs(e))', 'sum_abs_e')}, {D('sum(e)', 'sum_e')}, {D('sum(e*e)', 'sum_sq_e')} FROM j GROUP BY rater, bin""",
)
def stream_running_metrics(spark, sf_dir):
    log = ST.answered(responses(event_stream(spark, sf_dir)))
    reference = P.units(spark, sf_dir).select("unit", "reference")
    return run_to_latest(ST.running_metrics(log, reference, ["rater"]), "stream_running_metrics_out", ["rater", "bin"])


@query(
    "stream_window_health",
    f"""{RESP} SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, {N('count(*)', 'n')}, {D("avg(CASE WHEN outcome<>'' THEN 1.0 ELSE 0 END)", 'failure_rate')}, {D('avg(latency_ms)', 'mean_latency')}
FROM resp GROUP BY 1 HAVING time_bucket(INTERVAL '1 day', min(ts)) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '2 hours' FROM resp)""",
)
def stream_window_health(spark, sf_dir):
    log = ST.answered(responses(event_stream(spark, sf_dir)))
    # Windows appear once the watermark has passed their end.
    out = run_to_files(ST.window_health(log, "ts", "1 day", "2 hours", "latency_ms"), "stream_window_health_out")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_first_success",
    f"""{RESP} SELECT unit, rater, cond, arg_min(event_id, (ts, event_id)) AS event_id, {D('arg_min(v, (ts, event_id))', 'value')} FROM resp WHERE outcome='' GROUP BY ALL""",
)
def stream_first_success(spark, sf_dir):
    log = ST.answered(responses(event_stream(spark, sf_dir)))
    key = ["unit", "rater", "cond"]
    return run_to_latest(ST.first_by_time(log, key, ["ts", "event_id"]), "stream_first_success_out", key).select(*key, "event_id", "value")


@query(
    "stream_pending_grid",
    f"""{RESP}, u AS (SELECT DISTINCT user_id AS unit FROM events), g AS (SELECT unit, rater, cond FROM u, (SELECT unnest(['click','error','purchase','signup','view']) AS rater), (SELECT unnest(['p1','p2']) AS cond)),
 d AS (SELECT DISTINCT unit, rater, cond FROM resp WHERE outcome IN ('','JSON_PARSE_FAILURE'))
SELECT g.unit, g.rater, g.cond FROM g ANTI JOIN d ON g.unit=d.unit AND g.rater=d.rater AND g.cond=d.cond""",
)
def stream_pending_grid(spark, sf_dir):
    folder = stream_folder(spark, "stream_pending_grid_out")
    log = ST.answered(responses(event_stream(spark, sf_dir)))
    ST.write_progress(log, AXES, f"{folder}/log", f"{folder}/done", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    ids = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("unit")).distinct()
    return ST.still_pending(ids, AXES, f"{folder}/done")


# ---- rasters ----

def pixel_table(spark, sf_dir):
    """Embedding positions as an 8 x 8 grid with three derived channels."""
    e = P.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    a = F.floor(F.abs(F.col("v").cast("double")) * 1000)
    return e.select(
        F.col("vec_id").alias("unit"),
        "label",
        (F.col("pos") % 8).alias("x"),
        F.floor(F.col("pos") / 8).cast("int").alias("y"),
        (a % 256).cast("double").alias("r"),
        ((a * 7 + 11) % 256).cast("double").alias("g"),
        ((a * 3 + 5) % 256).cast("double").alias("b"),
    )


PIXEL_SQL = """
px0 AS (SELECT vec_id AS unit, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings),
px1 AS (SELECT unit, label, pos%8 AS x, CAST(floor(pos/8) AS BIGINT) AS y, CAST(floor(abs(CAST(v AS DOUBLE))*1000) AS BIGINT) AS a FROM px0),
px AS (SELECT unit, label, x, y, a%256 AS r, (a*7+11)%256 AS g, (a*3+5)%256 AS b FROM px1),
idx AS (SELECT unit, label, x, y, CASE WHEN r+g+b=0 THEN 0 ELSE CAST(3.0 AS DOUBLE)*(g/(r+g+b))+CAST(-2.4 AS DOUBLE)*(r/(r+g+b))+CAST(-1.0 AS DOUBLE)*(b/(r+g+b)) END AS i FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6)
"""


def indexed_pixels(spark, sf_dir):
    return RA.inside_border(RA.vegetation_index(pixel_table(spark, sf_dir)), 8, 8, 1)


@query("pixel_index", f"""WITH {PIXEL_SQL} SELECT unit, {N('x', 'x')}, {N('y', 'y')}, {D('i', 'index')} FROM idx""")
def pixel_index(spark, sf_dir):
    return indexed_pixels(spark, sf_dir).select("unit", "x", "y", "index")


@query(
    "pixel_cover",
    f"""WITH {PIXEL_SQL}, ch AS (SELECT unit FROM (SELECT vec_id AS unit FROM embeddings WHERE label<=1) ORDER BY {u_sql(91, 'unit')}, unit LIMIT 50),
 pp AS (SELECT i, row_number() OVER (PARTITION BY unit ORDER BY {u_sql(91, 'unit', 'x', 'y')}, x, y) AS rn FROM idx WHERE unit IN (SELECT unit FROM ch)),
 th AS (SELECT quantile_cont(i, 0.99) AS t FROM pp WHERE rn<=20)
SELECT unit, {D('100*avg(CASE WHEN i>t THEN 1.0 ELSE 0 END)', 'pred')}, {N('count(*)', 'n_pixels')}, {D('max(label)', 'reference')} FROM idx, th GROUP BY unit""",
)
def pixel_cover(spark, sf_dir):
    indexed = indexed_pixels(spark, sf_dir)
    reference = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit"), F.col("label").cast("double").alias("reference"))
    pool = RA.exemplar_pool(indexed, reference, 91, 1.0, 50, 20, "md5")
    return RA.cover(indexed, RA.threshold(pool), reference)


# ---- contracts ----

@query(
    "panel_contract",
    f"""{PANEL}, u AS (SELECT unit, min(reference) AS r, count(*) AS n FROM panel GROUP BY unit)
SELECT 'balance' AS check_id, 'gate' AS severity, (SELECT bool_and(n=6) FROM u) AS passed
UNION ALL SELECT 'rows_per_rater', 'gate', (SELECT bool_and(n=2) FROM (SELECT count(*) AS n FROM panel GROUP BY rater, unit))
UNION ALL SELECT 'cell_key', 'gate', (SELECT max(n)=1 FROM (SELECT count(*) AS n FROM panel GROUP BY unit, rater, cond))
UNION ALL SELECT 'raters', 'gate', (SELECT string_agg(r, '' ORDER BY r)='ANR' FROM (SELECT DISTINCT rater AS r FROM panel))
UNION ALL SELECT 'conditions', 'gate', (SELECT string_agg(r, '' ORDER BY r)='FO' FROM (SELECT DISTINCT cond AS r FROM panel))
UNION ALL SELECT 'no_nulls', 'gate', (SELECT count(*)=0 FROM panel WHERE reference IS NULL OR pred IS NULL OR bin IS NULL)
UNION ALL SELECT 'zero_reference', 'report', (SELECT count(*) FILTER (r=0) IS NOT NULL FROM u)
UNION ALL SELECT 'reference_mean', 'report', (SELECT avg(r) IS NOT NULL FROM u)
UNION ALL SELECT 'fan_out', 'gate', (SELECT count(*)=count(DISTINCT unit) FROM u)""",
)
def panel_contract(spark, sf_dir):
    panel = cut_lineage(P.base_panel(spark, sf_dir))
    return K.panel_contract(panel, P.RATERS, P.CONDITIONS).run().select("check_id", "severity", "passed")


@query(
    "table_contracts",
    f"""WITH e AS (SELECT count(*) AS n FROM (SELECT p_partkey FROM part) a FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem) b ON p_partkey=l_partkey WHERE p_partkey IS NULL OR l_partkey IS NULL),
 d AS (SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*)>1)), l AS (SELECT count(*) AS n FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*)>1))
SELECT 'parts_in_use' AS check_id, (SELECT n FROM e)=0 AS passed UNION ALL SELECT 'line_key', (SELECT n FROM d)=0 UNION ALL SELECT 'label_key', (SELECT n FROM l)=0
UNION ALL SELECT 'regions', (SELECT list_sort(list(DISTINCT r_name)) FROM region)=['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']
UNION ALL SELECT 'nested_bins', (SELECT count(*)=0 FROM (SELECT fine FROM (SELECT
  CASE WHEN r<=1 THEN 0 WHEN r<=5 THEN 1 WHEN r<=10 THEN 2 WHEN r<=20 THEN 3 WHEN r<=40 THEN 4 WHEN r<=60 THEN 5 WHEN r<=80 THEN 6 ELSE 7 END AS fine,
  CASE WHEN r<=20 THEN 0 WHEN r<=40 THEN 1 WHEN r<=60 THEN 2 WHEN r<=80 THEN 3 ELSE 4 END AS coarse FROM (SELECT 2.0*p_size AS r FROM part)) GROUP BY fine HAVING count(DISTINCT coarse)<>1))
UNION ALL SELECT 'char_counts', (SELECT count(*)=0 FROM documents WHERE n_chars IS DISTINCT FROM length(text))""",
)
def table_contracts(spark, sf_dir):
    part, line = P.table(spark, sf_dir, "part"), P.table(spark, sf_dir, "lineitem")
    fine = with_bins(with_bins(P.units(spark, sf_dir), FIVE_EDGES), EIGHT_EDGES, name="fine")
    # A stored count against one taken anew.
    counts = P.table(spark, sf_dir, "documents").select("n_chars", F.length("text").cast("long").alias("counted"))
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    runs = K.Expectations().add(
        K.one_to_one(part.select("p_partkey"), line.select(F.col("l_partkey").alias("p_partkey")).distinct(), "parts_in_use", "p_partkey"),
        K.unique_key(line, "line_key", ["l_orderkey", "l_linenumber"]),
        K.unique_key(P.table(spark, sf_dir, "labels"), "label_key", ["doc_id"]),
        K.vocabulary(P.table(spark, sf_dir, "region"), "regions", "r_name", names),
        K.nested_bins(fine, "nested_bins", "fine", "bin"),
        K.equal_columns(counts, "char_counts", "n_chars", "counted"),
    )
    return runs.run().select("check_id", "passed")


@query(
    "joined_panel_rows",
    f"""{PANEL} SELECT clus, {N('count(*)', 'n')}, {D('avg(abs_e)', 'mae')} FROM panel GROUP BY clus""",
)
def joined_panel_rows(spark, sf_dir):
    facts = P.base_panel(spark, sf_dir).drop("clus", "reference")
    out = K.joined_without_loss(facts, P.units(spark, sf_dir), "unit")
    return out.groupBy("clus").agg(F.count("*").alias("n"), F.avg("abs_e").alias("mae"))
