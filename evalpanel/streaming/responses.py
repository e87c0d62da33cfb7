"""The append-only response log as a stream."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.functions.columns import FIVE_EDGES, right_closed_bin
from evalpanel.operators.extract import OK, finished, parse_response, pending, with_outcome


def read_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines arriving as files; torn lines are dropped by the reader."""
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def answered(log: DataFrame, text: str = "raw_text") -> DataFrame:
    """Parsed rows with their outcome."""
    return with_outcome(parse_response(log, text), text)


def first_success(parsed: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first answer per key; state older than the watermark is released."""
    return parsed.filter(F.col("outcome") == OK).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def running_metrics(parsed: DataFrame, reference: DataFrame, keys: Sequence[str], unit: str = "unit") -> DataFrame:
    """Counts and error sums per key and bin against the static reference; state is keys x bins."""
    joined = parsed.filter(F.col("outcome") == OK).join(reference, unit)
    e = F.col("value") - F.col("reference")
    return joined.groupBy(*keys, right_closed_bin("reference", FIVE_EDGES).alias("bin")).agg(
        F.count("*").alias("n"),
        F.sum(F.abs(e)).alias("sum_abs_e"),
        F.sum(e).alias("sum_e"),
        F.sum(e * e).alias("sum_sq_e"),
    )


def window_health(parsed: DataFrame, time: str, width: str, delay: str, latency: str, keys: Sequence[str] = ()) -> DataFrame:
    """Failure rate and latency per tumbling window."""
    return (
        parsed.withWatermark(time, delay)
        .groupBy(F.window(time, width), *keys)
        .agg(
            F.count("*").alias("n"),
            F.avg((F.col("outcome") != OK).cast("double")).alias("failure_rate"),
            F.avg(latency).alias("mean_latency"),
        )
        .select(F.col("window.start").alias("window_start"), *keys, "n", "failure_rate", "mean_latency")
    )


def first_by_time(parsed: DataFrame, key: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """The earliest answer per key, whatever order the rows arrive in; state is a row per key.

    For ``update`` mode: a key is given again when an earlier answer arrives late.
    """
    ok = parsed.filter(F.col("outcome") == OK)
    return ok.groupBy(*key).agg(F.min_by(F.struct(*order, value), F.struct(*order)).alias("_f")).select(*key, *[F.col(f"_f.{c}").alias(c) for c in (*order, value)])


def update_sink(results: DataFrame, path: str, checkpoint: str):
    """Changed results of each batch as files in a folder of the batch, which a repeated batch overwrites; nothing passes the driver."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return results.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]) -> DataFrame:
    """The last result of every key written by ``update_sink``."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [f.name for f in schema.fields if f.name not in key]
    last = found.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_l"))
    return last.select(*key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def write_progress(parsed: DataFrame, axes: dict[str, Sequence[str]], log_path: str, done_path: str, checkpoint: str, unit: str = "unit"):
    """After each batch: append its outcomes to the log table, and the keys that it finished to ``done_path``.

    A batch writes what it changes and reads nothing written before, so its cost does not grow with the grid or the log. Both
    writes are keyed by the batch id, so a batch repeated after a failure overwrites itself. ``still_pending`` reads the keys.
    """
    key = [unit, *axes]

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.select(*key, "outcome").write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        finished(batch, key).write.mode("overwrite").parquet(f"{done_path}/batch={batch_id}")

    return parsed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def still_pending(units: DataFrame, axes: dict[str, Sequence[str]], done_path: str, unit: str = "unit") -> DataFrame:
    """The grid of units x declared axis values without the keys that any batch finished; other columns of ``units`` are left out."""
    key = [unit, *axes]
    done = units.sparkSession.read.parquet(done_path).select(*key).withColumn("outcome", F.lit(OK))
    return pending(units, axes, done, unit)


def append_sink(parsed: DataFrame, path: str, checkpoint: str):
    """Append-only table of parsed responses."""
    return parsed.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
