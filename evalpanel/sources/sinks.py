"""Result tables and logs."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from evalpanel.operators.multiplicity import require_columns


def write_result(df: DataFrame, path: str, columns: Sequence[str] = (), format: str = "parquet") -> None:
    """One table per result, refused without its declared columns. CSV gets a header."""
    checked = require_columns(df, columns)
    writer = checked.write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(format).save(path)


def append_log(df: DataFrame, path: str, format: str = "json") -> None:
    df.write.mode("append").format(format).save(path)


def write_panel(df: DataFrame, path: str, rater: str = "rater") -> None:
    """Panel partitioned by rater: a scan of one rater prunes the rest, and each task writes few files."""
    df.write.mode("overwrite").partitionBy(rater).parquet(path)


def write_bucketed(df: DataFrame, table: str, unit: str = "unit", buckets: int = 64) -> None:
    """Panel bucketed by unit: pooling, pairing and unit joins then need no shuffle on the unit."""
    df.write.mode("overwrite").bucketBy(buckets, unit).sortBy(unit).saveAsTable(table)
