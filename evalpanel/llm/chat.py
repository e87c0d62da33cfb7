"""Chat formatting: logged snapshots that another conversation continues are collapsed, the rest are rendered.

The hash of a prefix is the sum of the hashes of its turns, each taken with its position, so prefixes come from running sums.
These are taken within stretches of turn numbers first and over the stretches of a conversation then, so a conversation of any
length is not sorted in one task. A conversation whose full hash is a proper prefix of another one goes, by an anti-join; of equal
ones the smallest id stays.

Defined results: rows without conv_id are left out; rows repeated in all four columns count once; turns are ordered by number,
role and text, nulls first; a null role renders as ``unknown`` and a null text as empty, but neither equals that text in hashes;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.llm.common import table, written
from evalpanel.llm.registry import query

#: Turn numbers in a stretch, and turns in a rendered part.
STRETCH = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, pos, n, h1, h2): turns in order, the length of their conversation, and the prefix that ends there."""
    rows = turns.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL").distinct()
    rows = rows.withColumn("stretch", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / STRETCH))
    inside = W.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")
    before = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    rows = written(rows.withColumn("at", F.row_number().over(inside)))
    sizes = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("size"))
    offsets = sizes.select("conv_id", "stretch", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(W.partitionBy("conv_id")).alias("n"))
    rows = rows.join(offsets, ["conv_id", "stretch"]).withColumn("pos", F.col("offset") + F.col("at"))
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"), F.col("pos")]
    hashes = [F.xxhash64(F.lit(k), *parts).cast("decimal(20,0)").alias(f"e{k}") for k in (1, 2)]
    rows = rows.select("conv_id", "stretch", "role", "text", "pos", "n", *hashes)
    sums = rows.groupBy("conv_id", "stretch").agg(F.sum("e1").alias("s1"), F.sum("e2").alias("s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    earlier = sums.select("conv_id", "stretch", *[F.coalesce(F.sum(f"s{k}").over(before), zero).cast("decimal(38,0)").alias(f"b{k}") for k in (1, 2)])
    running = W.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    upto = [F.sum(f"e{k}").over(running).alias(f"u{k}") for k in (1, 2)]
    rows = rows.select("conv_id", "stretch", "role", "text", "pos", "n", *upto).join(earlier, ["conv_id", "stretch"])
    return rows.select("conv_id", "role", "text", "pos", "n", *[(F.col(f"b{k}") + F.col(f"u{k}")).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, copies): conversations that no other one continues, with the number of equal ones."""
    key = ["pos", "h1", "h2"]
    whole = prefixes.filter("pos = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    continued = prefixes.filter("pos < n").select(*key).distinct()
    return whole.join(continued, key, "left_anti").select("conv_id", "copies")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, text): maximal conversations in a chat template, ``STRETCH`` turns a part."""
    prefixes = written(numbered(turns))
    segment = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    kept = prefixes.join(maximal(prefixes), "conv_id").withColumn("part", F.floor((F.col("pos") - 1) / STRETCH))
    lines = F.array_sort(F.collect_list(F.struct("pos", segment.alias("segment"))))
    parts = kept.groupBy("conv_id", "part").agg(F.first("n").alias("n_turns"), F.first("copies").alias("copies"), F.array_join(F.transform(lines, lambda s: s["segment"]), "").alias("text"))
    return parts.select("conv_id", F.col("part").cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), "text")


SQL = f"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows),
prefixes AS (
  SELECT *, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix
  FROM numbered),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE pos = n GROUP BY prefix),
kept AS (SELECT conv_id, copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE pos < n))
SELECT conv_id, CAST((pos - 1) // {STRETCH} AS BIGINT) AS part, CAST(max(n) AS BIGINT) AS n_turns, CAST(max(copies) AS BIGINT) AS copies,
       string_agg('{OPEN}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10), '' ORDER BY pos) AS text
FROM numbered JOIN kept USING (conv_id) GROUP BY conv_id, (pos - 1) // {STRETCH}
"""


@query("op9_chat", SQL)
def op9(spark, sf_dir):
    return rendered(table(spark, sf_dir, "conversations"))
