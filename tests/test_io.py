import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.columns import FIVE_EDGES, right_closed_bin
from evalpanel.operators import contracts as K
from evalpanel.operators import extract as X
from evalpanel.sources import deposit, readers, sinks
from evalpanel.streaming import responses as ST


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


OBJ = '{"vegetation_percent": 12, "confidence": 0.8}'
TEXTS = {
    OBJ: (12.0, 0.8),
    f"```json\n{OBJ}\n```": (12.0, 0.8),
    f"  ```\n{OBJ}\n``` ": (12.0, 0.8),
    'draft {"vegetation_percent": 1, "confidence": 2} then ' + OBJ: (12.0, 0.8),
    OBJ + ' trailing {"vegetation_percent": "x", "confidence": 1}': (12.0, 0.8),
    '{"a": {"vegetation_percent": 3, "confidence": 4}, "vegetation_percent": 5, "confidence": 6}': (5.0, 6.0),
    'see {"a": {"vegetation_percent": 3, "confidence": 4}, "vegetation_percent": 5, "confidence": 6}': (3.0, 4.0),
    'format {"vegetation_percent": <number>, "confidence": <number>} answer ' + OBJ: (12.0, 0.8),
    '{"vegetation_cover": 7, "confidence": 1}': (7.0, 1.0),
    '{"vegetation_percent": null, "vegetation_cover": 7, "confidence": 1}': None,
    '{"vegetation_percent": true, "confidence": 1}': None,
    '{"vegetation_percent": "12", "confidence": 1}': None,
    '{"vegetation_percent": 12}': None,
    f"[{OBJ}]": (12.0, 0.8),
    '{"vegetation_percent": 1, "confidence": 2, "vegetation_percent": 9}': (9.0, 2.0),
    '{"note": "a } brace", "vegetation_percent": 4, "confidence": 5}': (4.0, 5.0),
    '{"vegetation_percent": 12, "confidence": ': None,
    "about 12 percent": None,
    "": None,
}


def test_parser_job_agrees_with_the_decoder_on_lax_and_extreme_json(spark):
    odd = [
        "{'vegetation_percent': 10, 'confidence': 5}",
        '{"vegetation_percent": "NaN", "confidence": 5}',
        '{"vegetation_percent": "Infinity", "confidence": 5}',
        '{"vegetation_percent": NaN, "confidence": 5}',
        '{"vegetation_percent": %s, "confidence": 5}' % ("9" * 400),
        '{"vegetation_percent": 01, "confidence": 5}',
    ]
    found = X.parse_response(spark.createDataFrame([(t,) for t in odd], "raw_text string")).collect()
    got = {r["raw_text"]: (r["value"], r["score"]) for r in found}
    for t in odd:
        want = X.decode(t)
        assert got[t] == ((None, None) if want is None else pytest.approx(want, nan_ok=True)), t


def test_parser_job_on_every_kind_of_response(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "raw_text string")
    got = {r["raw_text"]: (r["value"], r["score"]) for r in X.parse_response(df).collect()}
    for text, want in TEXTS.items():
        assert got[text] == (want or (None, None)), text
    assert got[None] == (None, None)


def test_very_deep_nesting_is_a_missing_answer():
    assert X.decode('{"a":' * 50_000) is None


def test_outcomes_pending_and_completeness(spark):
    log = spark.createDataFrame([(1, "p", OBJ), (1, "q", "none"), (2, "p", None)], "unit int, cond string, raw_text string")
    done = X.with_outcome(X.parse_response(log))
    assert [r["outcome"] for r in done.orderBy("unit", "cond").collect()] == ["", "JSON_PARSE_FAILURE", "INFERENCE_FAILURE"]
    units = spark.createDataFrame([(1,), (2,)], "unit int")
    left = X.pending(units, {"cond": ["p", "q"]}, done).collect()
    assert sorted((r["unit"], r["cond"]) for r in left) == [(2, "p"), (2, "q")]
    assert X.is_complete(units, {"cond": ["p", "q"]}, done).collect()[0]["complete"] is False
    assert X.merge_successes(done, done.filter("unit = 2")).count() == 2


# ---- readers and sinks ----

def test_rater_from_file_name_prefers_the_longest(spark, folder):
    for name in ("Model-1_local.csv", "Model-12_local.csv"):
        (folder / name).write_text("image,prompt,variant,vegetation_percent,confidence,confidence_parse_method\ni,Short,base,5,,ok\n")
    got = readers.read_predictions(spark, f"{folder}/*.csv", ["Model-1", "Model-12"]).collect()
    assert sorted(r["rater"] for r in got) == ["Model-1", "Model-12"] and got[0]["conf"] is None
    with pytest.raises(Exception, match="no rater"):
        readers.read_predictions(spark, f"{folder}/*.csv", ["Other"]).collect()


def test_csv_scan_with_rename_and_header_check(spark, folder):
    (folder / "f.csv").write_text("Campaign,Date,Time,Filename,Veg %\nc1,d,t,a.jpg,20.0\nc1,d,t,b.jpg,NaN\n")
    got = {r["unit"]: r["reference"] for r in readers.read_csv(spark, str(folder / "f.csv"), readers.REFERENCE, readers.REFERENCE_NAMES).collect()}
    assert got == {"a.jpg": 20.0, "b.jpg": None}
    with pytest.raises(Exception):
        readers.read_csv(spark, str(folder / "f.csv"), readers.DEVICE).collect()


def test_torn_lines_are_dropped_and_counted(spark, folder):
    rows = [json.dumps({"image": f"i{k}", "raw_text": "x", "latency_ms": 5}) for k in range(3)]
    (folder / "log.jsonl").write_text("\n".join(rows) + '\n{"image": "torn", "raw_')
    assert readers.read_jsonl(spark, str(folder)).select("image", "latency_ms").count() == 3
    r = readers.count_torn_lines(spark, str(folder)).collect()[0]
    assert (r["lines"], r["torn"]) == (4, 1)


def test_catalog_refuses_tables_off_the_list(spark, sf):
    catalog = readers.Catalog(spark, sf, ["nation"])
    assert catalog.table("nation").count() == 25
    with pytest.raises(PermissionError):
        catalog.table("region")


def test_sinks_round_trip(spark, folder):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0)], "rater string, unit int, pred double")
    sinks.write_panel(df, str(folder / "panel"))
    one = spark.read.parquet(str(folder / "panel")).filter("rater = 'a'")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(rater" in one._jdf.queryExecution().toString()
    sinks.append_log(df, str(folder / "log"))
    sinks.append_log(df, str(folder / "log"))
    assert spark.read.json(str(folder / "log")).count() == 4
    sinks.write_result(df, str(folder / "out"), ["rater"], "csv")
    with pytest.raises(ValueError):
        sinks.write_result(df, str(folder / "bad"), ["missing"])
    assert not (folder / "bad").exists()


def test_image_scan_is_limited_to_wanted_names(spark, folder):
    # A 1 x 1 bitmap, which the image source can decode.
    bmp = bytes.fromhex("424d3a0000000000000036000000280000000100000001000000010018000000000004000000130b0000130b000000000000000000000102" "0300")
    for name in ("a.bmp", "b.bmp"):
        (folder / name).write_bytes(bmp)
    from evalpanel.operators import raster

    wanted = spark.createDataFrame([("a.bmp",)], "unit string")
    got = raster.pixels(raster.read_images(spark, str(folder), wanted, "*.bmp")).collect()
    assert [(r["unit"], r["r"], r["g"], r["b"]) for r in got] == [("a.bmp", 3.0, 2.0, 1.0)]


def test_deposit_reshape_and_contract(spark):
    units = spark.createDataFrame(
        [(f"i{k}", "old", float(k * 10), "d", 1.0, 0, 1) for k in range(10)],
        "image string, campaign string, reference double, device string, obliquity double, rooted_dead_alike_plants int, non_rooted_plant_material int",
    )
    resp = spark.createDataFrame(
        [(f"i{k}", "m", "Short", "base", 5.0, 1.0) for k in range(10)], "image string, model string, prompt string, variant string, vegetation_percent double, confidence double"
    )
    tables = deposit.reshape(units, resp, resp.drop("variant"), {"old": "c1"})
    assert tables["predictions"].groupBy("path").count().count() == 2
    bins = {0: 3, 1: 2, 2: 2, 3: 2, 4: 1}
    args = (tables, 10, {"local": 10, "api": 10}, ["m"], bins, right_closed_bin("reference", FIVE_EDGES))
    K.enforce(deposit.deposit_contract(*args).run())
    with pytest.raises(K.ContractError, match="units"):
        K.enforce(deposit.deposit_contract(tables, 11, *args[2:]).run())


# ---- contracts ----

def passed(check):
    return check.collect()[0]["passed"]


def test_every_check_passes_and_fails(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "b", 2.0, 2.0)], "unit int, rater string, x double, y double")
    dup = df.unionByName(df)
    off = df.withColumn("y", F.col("y") + 1)
    cases = [
        (K.row_count(df, "c", 2), K.row_count(df, "c", 3)),
        (K.unique_key(df, "c", ["unit"], 2), K.unique_key(dup, "c", ["unit"])),
        (K.one_to_one(df, df, "c", "unit"), K.one_to_one(df, df.filter("unit = 1"), "c", "unit")),
        (K.one_to_one(df, df, "c", "unit"), K.one_to_one(df, dup, "c", "unit")),
        (K.rows_per_unit(dup, "c", [], "unit", 2), K.rows_per_unit(df, "c", [], "unit", 2)),
        (K.vocabulary(df, "c", "rater", ["a", "b"]), K.vocabulary(df, "c", "rater", ["a"])),
        (K.vocabulary(df, "c", "rater", ["b", "a"]), K.vocabulary(df, "c", "rater", ["a", "b", "z"])),
        (K.equal_columns(df, "c", "x", "y"), K.equal_columns(off, "c", "x", "y")),
        (K.histogram(df, "c", "rater", {"a": 1, "b": 1}), K.histogram(df, "c", "rater", {"a": 1})),
        (K.two_way(df, "c", "unit", "rater", {(1, "a"): 1, (1, "b"): 0, (2, "b"): 1}), K.two_way(df, "c", "unit", "rater", {(1, "a"): 1, (1, "b"): 1})),
        (K.measured(df, "c", "mean", F.avg("x"), 1.5), K.measured(df, "c", "mean", F.avg("x"), 1.4)),
        (K.no_nulls(df, "c", ["x"]), K.no_nulls(df.withColumn("x", F.lit(None).cast("double")), "c", ["x"])),
        (K.nested_bins(df, "c", "unit", "rater"), K.nested_bins(df.withColumn("f", F.lit(1)), "c", "f", "rater")),
        (K.repeat_design(df, "c", ["unit"], 1), K.repeat_design(dup, "c", ["unit"], 1)),
        (K.counts_under(dup, "c", "rater", 2), K.counts_under(df, "c", "rater", 2)),
        (K.degenerate(spark.range(3), "c", "id"), K.degenerate(df, "c", "rater")),
        (K.compare_tables(df, df, ["unit"], "x", "c"), K.compare_tables(df, off.select("unit", F.col("y").alias("x")), ["unit"], "x", "c")),
    ]
    for good, bad in cases:
        assert passed(good) and not passed(bad)


def test_reports_never_stop_a_run_but_gates_do(spark):
    df = spark.range(2)
    report = K.row_count(df, "r", 3, K.REPORT)
    assert K.enforce(report).count() == 1
    with pytest.raises(K.ContractError, match="g: 3 rows"):
        K.enforce(report.unionByName(K.row_count(df, "g", 3)))


def test_join_refuses_repeated_or_missing_dimension_keys(spark):
    fact = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "unit int, v string")
    dim = spark.createDataFrame([(1, 10.0), (2, 20.0)], "unit int, reference double")
    assert K.joined_without_loss(fact, dim, "unit").count() == 3
    with pytest.raises(Exception, match="repeated"):
        K.joined_without_loss(fact, dim.unionByName(dim), "unit").collect()
    with pytest.raises(Exception, match="no match"):
        K.joined_without_loss(fact, dim.filter("unit = 1"), "unit").collect()


# ---- streams ----

LOG = T.StructType(
    [T.StructField(n, T.IntegerType() if n == "unit" else T.StringType()) for n in ("unit", "cond", "rater", "raw_text")]
    + [T.StructField("latency_ms", T.DoubleType()), T.StructField("ts", T.TimestampType())]
)


def write_batch(folder, name, rows):
    lines = [json.dumps(dict(zip(LOG.names, r))) for r in rows]
    (folder / name).write_text("\n".join(lines))


def test_stream_keeps_the_first_answer_per_key(spark, folder):
    src = folder / "in"
    src.mkdir()
    two = OBJ.replace("12", "13")
    write_batch(src, "a.json", [(1, "p", "m", OBJ, 1.0, "2024-01-01T00:00:00"), (1, "q", "m", "none", 1.0, "2024-01-01T00:01:00")])
    write_batch(src, "b.json", [(1, "p", "m", two, 1.0, "2024-01-01T00:02:00"), (1, "q", "m", two, 1.0, "2024-01-01T00:03:00")])
    log = ST.answered(ST.read_log(spark, str(src), LOG, files_per_batch=1))
    first = ST.first_success(log, ["unit", "cond", "rater"], "ts", "1 hour")
    run = ST.append_sink(first, str(folder / "out"), str(folder / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["cond"]: r["value"] for r in spark.read.parquet(str(folder / "out")).collect()}
    assert set(got) == {"p", "q"} and got["q"] == 13.0


def test_stream_progress_over_batches_and_a_restart(spark, folder):
    src = folder / "in"
    src.mkdir()
    units = spark.createDataFrame([(1, "x"), (2, "y")], "unit int, extra string")
    axes = {"cond": ["p", "q"]}

    def drain():
        log = ST.answered(ST.read_log(spark, str(src), LOG, files_per_batch=1))
        ST.write_progress(log, axes, str(folder / "log"), str(folder / "done"), str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["unit"], r["cond"]) for r in ST.still_pending(units, axes, str(folder / "done")).collect())

    write_batch(src, "a.json", [(1, "p", "m", OBJ, 1.0, "2024-01-01T00:00:00")])
    write_batch(src, "b.json", [(1, "q", "m", None, 1.0, "2024-01-01T00:01:00"), (2, "q", "m", "none", 1.0, "2024-01-01T00:02:00")])
    assert drain() == [(1, "q"), (2, "p")]  # a failed call stays pending, a text without number does not
    write_batch(src, "c.json", [(1, "q", "m", OBJ, 1.0, "2024-01-01T00:03:00"), (1, "p", "m", OBJ, 1.0, "2024-01-01T00:04:00")])
    assert drain() == [(2, "p")]  # a new query from the same checkpoint
    assert drain() == [(2, "p")]
    sizes = spark.read.parquet(str(folder / "done")).groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in sizes) == [(0, 1), (1, 1), (2, 2)]
    assert spark.read.parquet(str(folder / "log")).count() == 5


def test_stream_first_answer_by_time_arrives_late(spark, folder):
    src = folder / "in"
    src.mkdir()
    write_batch(src, "a.json", [(1, "p", "m", OBJ, 1.0, "2024-01-01T02:00:00"), (2, "p", "m", OBJ, 1.0, "2024-01-01T00:00:00")])
    write_batch(src, "b.json", [(1, "p", "m", OBJ.replace("12", "13"), 1.0, "2024-01-01T00:00:00"), (2, "p", "m", "none", 1.0, "2023-01-01T00:00:00")])
    log = ST.answered(ST.read_log(spark, str(src), LOG, files_per_batch=1))
    first = ST.first_by_time(log, ["unit", "cond"], ["ts"])
    ST.update_sink(first, str(folder / "out"), str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["unit"]: r["value"] for r in ST.latest(spark, str(folder / "out"), first.schema, ["unit", "cond"]).collect()}
    assert got == {1: 13.0, 2: 12.0}
    sizes = spark.read.parquet(str(folder / "out")).groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in sizes) == [(0, 2), (1, 1)]  # changes only


def test_losses_count_each_row_under_its_first_reason(spark):
    from pyspark.sql import functions as F

    from evalpanel.operators.contracts import losses

    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 2, False), ("b", None, None)], "k string, x int, ok boolean")
    got = {r["k"]: tuple(r)[1:] for r in losses(df, ["k"], {"two": F.col("x") == 2, "bad": ~F.col("ok")}).collect()}
    assert got == {"a": (3, 1, 2, 0), "b": (1, 1, 0, 0)}
    assert losses(df.limit(0), [], {"two": F.col("x") == 2}).collect()[0]["n"] == 0


def test_responses_of_one_file_are_parsed_in_many_tasks(spark, folder):
    from evalpanel.operators.extract import parse_response

    spark.range(40).select(F.concat(F.lit('{"vegetation_percent": '), F.col("id"), F.lit(', "confidence": 1}')).alias("raw_text")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/one")
    read = spark.read.parquet(f"{folder}/one")
    parsed = parse_response(read)
    assert read.rdd.getNumPartitions() == 1
    assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert sorted(r["value"] for r in parsed.collect()) == [float(x) for x in range(40)]
