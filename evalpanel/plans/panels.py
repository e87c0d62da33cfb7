"""Panels derived from the relational test tables, and the same derivation as SQL text.

The derivation is one shuffle of the fact table: cells are aggregated with map-side combine, then the
handful of cells of a unit meet once for the completeness test, and the unit dimension joins on the
same key. Nothing is broadcast by hint: the unit dimension grows with the data, so the optimizer
decides from its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.functions.columns import FIVE_EDGES, right_closed_bin, with_bins, with_errors
from evalpanel.operators.contracts import losses

RATERS = ("A", "N", "R")
CONDITIONS = ("F", "O")
CELLS = len(RATERS) * len(CONDITIONS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, variants: bool = False, scores: bool = False, second: bool = False) -> DataFrame:
    """One row per (unit, rater, cond) with the prediction(s) and, on request, a score and a second serving of the cell.

    The second path is made of the low-discount rows alone; ``seen2`` tells whether the cell has any.
    """
    cols = [(F.lit(2.0) * F.avg("l_quantity")).alias("pred")]
    if variants:
        # l_quantity has 50 levels, so the exact median keeps a bounded state per cell.
        cols += [
            (F.min("l_quantity") + F.max("l_quantity")).alias("pred_mid"),
            (F.lit(2.0) * F.median("l_quantity")).alias("pred_med"),
        ]
    if scores:
        cols.append(
            F.when(F.count("*") > 1, F.round(F.lit(10.0) * (F.lit(1.0) - F.round(F.avg("l_discount"), 6) * F.lit(5.0))) / F.lit(10.0)).alias("conf")
        )
    if second:
        low = F.col("l_discount") <= 0.05
        cols += [(F.lit(2.0) * F.avg(F.when(low, F.col("l_quantity")))).alias("pred2"), (F.count_if(low) > 0).alias("seen2")]
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_partkey").alias("unit"),
            F.col("l_returnflag").alias("rater"),
            F.col("l_linestatus").alias("cond"),
        )
        .agg(*cols)
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("unit"),
        (F.lit(2.0) * F.col("p_size")).alias("reference"),
        F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")).alias("clus"),
    )


def base_panel(spark: SparkSession, sf_dir: str, variants: bool = False, scores: bool = False, second: bool = False) -> DataFrame:
    """Complete panel: every unit carries all rater x condition cells."""
    complete = cells(spark, sf_dir, variants, scores, second).withColumn(
        "_n", F.count("*").over(W.partitionBy("unit"))
    )
    joined = complete.filter(F.col("_n") == CELLS).drop("_n").join(units(spark, sf_dir), "unit")
    return with_bins(with_errors(joined), FIVE_EDGES).withColumn("config", F.concat_ws("|", "rater", "cond"))


def variant_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long over the three variants of a prediction."""
    wide = base_panel(spark, sf_dir, variants=True)
    long = wide.unpivot(
        ["unit", "rater", "cond", "config", "clus", "reference", "bin"],
        ["pred", "pred_mid", "pred_med"],
        "variant",
        "pred",
    )
    names = F.when(F.col("variant") == "pred", "base").when(F.col("variant") == "pred_mid", "mid").otherwise("med")
    return with_errors(long.withColumn("variant", names))


def path_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells seen on both paths, with the error on each; one scan and one aggregation serve both. ``panel_losses`` counts the rest."""
    both = base_panel(spark, sf_dir, second=True).filter("seen2").drop("seen2")
    return both.withColumns(
        {"e2": F.col("pred2") - F.col("reference"), "abs_e2": F.abs(F.col("pred2") - F.col("reference"))}
    )


def panel_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per configuration, the cells that do not reach the panel of both paths, by the first reason that holds."""
    rows = cells(spark, sf_dir, second=True).withColumn("_n", F.count("*").over(W.partitionBy("unit")))
    known = rows.join(units(spark, sf_dir).select("unit", F.lit(True).alias("_known")), "unit", "left")
    return losses(
        known, ["rater", "cond"], {"incomplete_unit": F.col("_n") != CELLS, "no_reference": F.col("_known").isNull(), "not_on_second_path": ~F.col("seen2")}
    )


def repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs per (unit, rater): odd and even line numbers."""
    run = F.when(F.col("l_linenumber") % 2 == 1, "run1").otherwise("run2")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("unit"), F.col("l_returnflag").alias("rater"), run.alias("run"))
        .agg(F.avg("l_quantity").alias("pred"))
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: a length score in steps of 500 characters, toxicity as the positive label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("unit"),
        "lang",
        "source",
        F.floor(F.col("n_chars") / F.lit(500.0)).cast("double").alias("score"),
        (F.col("toxic") == 1).alias("positive"),
        F.col("toxic"),
        F.col("quality"),
    )


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-unit covariates: two three-level ordinals and one continuous column."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("unit"),
        (F.col("p_size") % 3).alias("ord_a"),
        (F.substring("p_brand", 7, 4).cast("int") % 3).alias("ord_b"),
        F.col("p_retailprice").alias("cont"),
    )


# ---- the same derivations as SQL ----

PANEL_SQL = """
cells AS (
  SELECT l_partkey AS unit, l_returnflag AS rater, l_linestatus AS cond, 2*avg(l_quantity) AS pred,
         min(l_quantity)+max(l_quantity) AS pred_mid, 2*median(l_quantity) AS pred_med,
         CASE WHEN count(*)>1 THEN round(10*(1-round(avg(l_discount),6)*5))/10 END AS conf
  FROM lineitem GROUP BY 1,2,3),
complete AS (SELECT unit FROM cells GROUP BY unit HAVING count(*)=6),
panel AS (
  SELECT c.unit, c.rater, c.cond, c.pred, c.pred_mid, c.pred_med, c.conf, c.rater||'|'||c.cond AS config,
         CAST(2.0*p.p_size AS DOUBLE) AS reference, 'c'||CAST(p.p_partkey % 3 AS VARCHAR) AS clus,
         c.pred-CAST(2.0*p.p_size AS DOUBLE) AS e, abs(c.pred-CAST(2.0*p.p_size AS DOUBLE)) AS abs_e,
         CAST(CASE WHEN 2.0*p.p_size<=20 THEN 0 WHEN 2.0*p.p_size<=40 THEN 1 WHEN 2.0*p.p_size<=60 THEN 2
              WHEN 2.0*p.p_size<=80 THEN 3 ELSE 4 END AS BIGINT) AS bin
  FROM cells c JOIN complete f ON c.unit=f.unit JOIN part p ON p.p_partkey=c.unit)
"""

VARIANT_SQL = """
variants AS (
  SELECT unit, rater, cond, config, clus, reference, bin, v.variant, v.pred, v.pred-reference AS e, abs(v.pred-reference) AS abs_e
  FROM panel, LATERAL (SELECT 'base' AS variant, panel.pred AS pred UNION ALL SELECT 'mid', panel.pred_mid UNION ALL SELECT 'med', panel.pred_med) v)
"""

PATH_SQL = """
path2 AS (
  SELECT l_partkey AS unit, l_returnflag AS rater, l_linestatus AS cond, 2*avg(l_quantity) AS pred2
  FROM lineitem WHERE l_discount <= 0.05 GROUP BY 1,2,3),
paths AS (
  SELECT a.*, b.pred2, b.pred2-a.reference AS e2, abs(b.pred2-a.reference) AS abs_e2
  FROM panel a JOIN path2 b ON a.unit=b.unit AND a.rater=b.rater AND a.cond=b.cond)
"""

SCORE_SQL = """
scores AS (
  SELECT d.doc_id AS unit, d.lang, d.source, CAST(floor(d.n_chars/500.0) AS DOUBLE) AS score,
         l.toxic=1 AS positive, l.toxic, l.quality
  FROM documents d JOIN labels l ON d.doc_id=l.doc_id)
"""

COVARIATE_SQL = """
covs AS (
  SELECT p_partkey AS unit, p_size % 3 AS ord_a, CAST(substr(p_brand,7,4) AS INTEGER) % 3 AS ord_b, p_retailprice AS cont
  FROM part)
"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)
