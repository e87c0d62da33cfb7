"""A pixel-index baseline over pixel tables (unit, x, y, r, g, b)."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.functions.hashing import uniform
from evalpanel.functions.levels import attach_totals

# Index weights on chromatic coordinates, border width, exemplar rule.
INDEX_WEIGHTS = {"g": 3.0, "r": -2.4, "b": -1.0}
BORDER = 40
EXEMPLAR_MAX_REFERENCE = 1.0
EXEMPLAR_UNITS = 200
EXEMPLAR_PIXELS = 3000
EXEMPLAR_QUANTILE = 0.99


def read_images(spark: SparkSession, path: str, names: DataFrame, glob: str = "*.jpg") -> DataFrame:
    """Images of the wanted units only; the file listing is filtered before any image is decoded."""
    files = spark.read.format("image").option("pathGlobFilter", glob).load(path)
    unit = F.regexp_extract("image.origin", r"([^/]+)$", 1)
    return files.withColumn("unit", unit).join(names.select("unit"), "unit", "left_semi")


def pixels(images: DataFrame, rows_per_chunk: int = 64) -> DataFrame:
    """Explode decoded images to pixel rows, a few image lines at a time."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit, height, width, channels, data in batch.itertuples(index=False):
                grid = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                for top in range(0, height, rows_per_chunk):
                    part = grid[top : top + rows_per_chunk]
                    ys, xs = np.mgrid[top : top + part.shape[0], 0:width]
                    # The decoder stores colour images as blue, green, red.
                    b, g, r = (part[..., min(i, channels - 1)].ravel().astype(float) for i in range(3))
                    yield pd.DataFrame({"unit": unit, "x": xs.ravel(), "y": ys.ravel(), "r": r, "g": g, "b": b})

    cols = images.select("unit", "image.height", "image.width", "image.nChannels", "image.data")
    return cols.mapInPandas(explode, "unit string, x int, y int, r double, g double, b double")


def chromatic(df: DataFrame) -> DataFrame:
    """Channel shares of r + g + b; a black pixel divides by 1."""
    total = F.col("r") + F.col("g") + F.col("b")
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return df.withColumns({c: F.col(c) / total for c in ("r", "g", "b")})


def vegetation_index(df: DataFrame) -> DataFrame:
    shares = chromatic(df)
    return shares.withColumn("index", sum((F.lit(w) * F.col(c) for c, w in INDEX_WEIGHTS.items()), F.lit(0.0)))


def inside_border(df: DataFrame, width: int, height: int, border: int = BORDER) -> DataFrame:
    return df.filter(F.col("x").between(border, width - 1 - border) & F.col("y").between(border, height - 1 - border))


def exemplar_pool(
    indexed: DataFrame,
    reference: DataFrame,
    seed: int,
    max_reference: float = EXEMPLAR_MAX_REFERENCE,
    n_units: int = EXEMPLAR_UNITS,
    n_pixels: int = EXEMPLAR_PIXELS,
    hasher: str = "xx",
) -> DataFrame:
    """A bounded pool of bare-ground pixels: so many units, so many pixels each, without replacement."""
    bare = reference.filter(F.col("reference") <= max_reference).select("unit")
    chosen = bare.withColumn("_u", uniform(seed, ["unit"], hasher)).orderBy("_u", "unit").limit(n_units).select("unit")
    keyed = indexed.join(chosen, "unit", "left_semi").withColumn("_p", uniform(seed, ["unit", "x", "y"], hasher))
    rn = F.row_number().over(W.partitionBy("unit").orderBy("_p", "x", "y"))
    return keyed.withColumn("_rn", rn).filter(F.col("_rn") <= n_pixels).drop("_rn", "_p")


def threshold(pool: DataFrame, q: float = EXEMPLAR_QUANTILE) -> DataFrame:
    """Quantile of the pool, whose size is bounded by construction."""
    return pool.agg(F.percentile("index", q).alias("threshold"))


def cover(indexed: DataFrame, limit: DataFrame, reference: DataFrame) -> DataFrame:
    """Percent of a unit's pixels above the threshold, with its reference."""
    share = attach_totals(indexed, limit).groupBy("unit").agg(
        (100 * F.avg((F.col("index") > F.col("threshold")).cast("double"))).alias("pred"),
        F.count("*").alias("n_pixels"),
    )
    return share.join(reference.select("unit", "reference"), "unit")


def drift_by_bin(table: DataFrame, expected: dict[int, float], tolerance: float = 0.5) -> DataFrame:
    """Per-bin error against stored values."""
    want = F.lit(None).cast("double")
    for b, v in expected.items():
        want = F.when(F.col("bin") == b, F.lit(v)).otherwise(want)
    out = table.groupBy("bin").agg(F.avg("abs_e").alias("mae"), F.count("*").alias("n")).withColumn("expected", want)
    return out.withColumn("within", F.abs(F.col("mae") - F.col("expected")) <= tolerance)
