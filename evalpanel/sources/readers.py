"""Scans: CSV tables with fixed schemas, per-rater files, JSON-lines logs, and a guarded catalog."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Column names and types of the analysis layout.
REFERENCE = T.StructType([T.StructField(n, t) for n, t in (("Campaign", _S), ("Date", _S), ("Time", _S), ("Filename", _S), ("Veg %", _D))])
ANNOTATIONS = _schema(image=_S, reference=_D, rooted_dead_alike_plants=_I, non_rooted_plant_material=_I)
DEVICE = _schema(image=_S, device=_S)
OBLIQUITY = _schema(image=_S, obliquity=_D)
PREDICTIONS = _schema(image=_S, prompt=_S, variant=_S, vegetation_percent=_D, confidence=_D, confidence_parse_method=_S)
PREDICTIONS_SECOND_PATH = _schema(image=_S, prompt=_S, vegetation_percent=_D, confidence=_D, confidence_parse_method=_S)
REPEAT_RUNS = _schema(model=_S, image=_S, run=_S, prompt=_S, vegetation_percent=_D, latency_ms=_D)
FAILURES = _schema(image=_S, model=_S, prompt=_S, variant=_S, stack=_S, run_type=_S, error=_S, in_scope=_B)
BASELINE = _schema(image=_S, vegetation_percent=_D, reference=_D)
RESPONSES = _schema(
    image=_S, prompt_id=_S, model=_S, run_type=_S, raw_text=_S, error=_S, vegetation_percent=_D, confidence=_D,
    reference=_D, latency_ms=_D, peak_gpu_mem_mb=_D, gpu_power_draw_w_mean=_D, batch_size=_I, seed=_I,
)

# Names in the analysis layout and in a panel.
REFERENCE_NAMES = {"Filename": "unit", "Campaign": "clus", "Veg %": "reference"}
PANEL_NAMES = {"image": "unit", "model": "rater", "prompt": "cond", "vegetation_percent": "pred", "confidence": "conf", "confidence_parse_method": "conf_method"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, names: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a header and a fixed schema (columns are matched to the header, none is inferred)."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, nullValue="")
    nulls = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast("double")) for f in schema.fields if f.dataType == _D}
    df = df.withColumns(nulls) if nulls else df
    return df.withColumnsRenamed(dict(names)) if names else df


def rater_from_name(file_name: Column, stems: Sequence[str]) -> Column:
    """The rater whose name starts the file name; the longest name is tried first."""
    out = F.raise_error(F.concat(F.lit("no rater in file name "), file_name)).cast("string")
    for stem in sorted(stems, key=len):
        out = F.when(F.startswith(file_name, F.lit(stem)), F.lit(stem)).otherwise(out)
    return out


def read_predictions(spark: SparkSession, path: str, raters: Sequence[str], schema: T.StructType = PREDICTIONS, path_name: str = "local") -> DataFrame:
    """All per-rater files of one serving path as one panel; the rater comes from the file name."""
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, nullValue="")
    named = raw.select("*", rater_from_name(F.col("_metadata.file_name"), raters).alias("rater"), F.lit(path_name).alias("path"))
    return named.withColumnsRenamed(PANEL_NAMES)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RESPONSES) -> DataFrame:
    """JSON lines; a torn line is dropped, not fatal."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def count_torn_lines(spark: SparkSession, path: str, schema: T.StructType = RESPONSES) -> DataFrame:
    kept = T.StructType(schema.fields + [T.StructField("_corrupt_record", _S)])
    text = spark.read.text(path)
    parsed = text.select(F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.agg(F.count("*").alias("lines"), F.count_if(F.col("r._corrupt_record").isNotNull()).alias("torn"))


class Catalog:
    """Tables by name from an allow-list; any other name is refused."""

    def __init__(self, spark: SparkSession, root: str, allowed: Sequence[str], format: str = "parquet") -> None:
        self.spark, self.root, self.allowed, self.format = spark, root, frozenset(allowed), format

    def table(self, name: str) -> DataFrame:
        if name not in self.allowed:
            raise PermissionError(f"table {name} is not on the allow-list")
        suffix = "" if self.format == "parquet-dir" else f".{self.format}"
        kind = "parquet" if self.format == "parquet-dir" else self.format
        return self.spark.read.format(kind).load(f"{self.root}/{name}{suffix}")

    def result(self, name: str) -> DataFrame:
        """Another analysis's result; missing is an error when it is read."""
        return self.table(name)
