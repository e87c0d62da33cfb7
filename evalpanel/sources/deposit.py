"""From a normalised deposit (one row per unit, responses in two files) to the analysis tables."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalpanel.functions.columns import mapped
from evalpanel.operators import contracts as K


def reshape(units: DataFrame, responses: DataFrame, second_path: DataFrame | None, clusters: Mapping[str, str]) -> dict[str, DataFrame]:
    """Split the unit table into its parts, and stack the responses of both serving paths.

    Row order carries no meaning afterwards; every table has an explicit key.
    """
    base = units.withColumn("clus", mapped("campaign", clusters))
    first = responses.withColumn("path", F.lit("local"))
    stacked = first
    if second_path is not None:
        stacked = first.unionByName(second_path.withColumn("path", F.lit("api")), allowMissingColumns=True)
    names = {"image": "unit", "model": "rater", "prompt": "cond", "vegetation_percent": "pred", "confidence": "conf"}
    return {
        "reference": base.select(F.col("image").alias("unit"), "clus", F.col("reference")),
        "covariates": base.select(
            F.col("image").alias("unit"), "device", "obliquity", "rooted_dead_alike_plants", "non_rooted_plant_material"
        ),
        "predictions": stacked.withColumnsRenamed(names),
    }


def deposit_contract(tables: Mapping[str, DataFrame], n_units: int, rows_per_path: Mapping[str, int], raters: Sequence[str], bins: Mapping[int, int], bin_of) -> K.Expectations:
    """Row counts, rater set and bin composition, checked before anything is written."""
    ref, pred = tables["reference"], tables["predictions"]
    out = K.Expectations().add(
        K.unique_key(ref, "units", ["unit"], n_units),
        K.vocabulary(pred, "raters", "rater", raters),
        K.histogram(ref.withColumn("bin", bin_of), "bins", "bin", bins),
        K.no_nulls(ref, "clusters", ["clus"]),
    )
    for path, n in rows_per_path.items():
        out.add(K.row_count(pred.filter(F.col("path") == path), f"rows_{path}", n))
    return out
