"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, per language, and quantiles as fences.

The n-grams are of unfolded UTF-8 bytes, so every script keeps its letters and the model grows with the trusted text. They are counted,
smoothed and joined with those of the documents as sharded tables (``kneser_ney``); no task and no driver holds a model.

A document is rejected if its bits per byte lie above a fence, a quantile over the trusted documents of its
language, or if its share of words that repeat the word before them does: perplexity can't see copies of a likely word.

Defined results: null and empty texts have null bits and are kept; so are documents of a language (null counts as one) without
trusted text; a language with trusted documents of which none is set aside has no fence, and they are kept; a document is trusted if any
of its labels says so and none says otherwise; repeated rows are judged alike; without labels everything is kept; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalpanel.llm import kneser_ney
from evalpanel.llm.common import fresh, table
from evalpanel.llm.folded import classes, gram_counts, grams, repeats, scored, train  # noqa: F401  the folded model as a value
from evalpanel.llm.registry import query


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id, aside): the trusted ids as strings; a fifth is set aside."""
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    return good.select(F.col("doc_id").cast("string").alias("id"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("aside"))


def judged(docs: DataFrame, labels: DataFrame, kept: list[str], added: tuple[str, str, str] = ("bits", "repeats", "kept"), order: int = kneser_ney.ORDER, quantile: float = 0.99) -> DataFrame:
    """The columns ``kept`` of ``docs`` with bits per UTF-8 byte, repeats, and whether a document stays, under the names ``added``.

    The fence of a language is the quantile of its trusted documents. Text fits a model better that has counted it, so the quantile
    is that of a fifth of the trusted documents under a model of the others; of very few, it is their highest.
    """
    bits, again, stays = added
    held, doc_id, lang, most, most_again, key = fresh([*docs.columns, *added], "_held", "_doc_id", "_lang", "_most", "_most_again", "_key")
    good = trusted_ids(labels)
    all_docs = docs.withColumns({doc_id: F.col("doc_id").cast("string"), lang: F.coalesce("lang", F.lit(""))})
    found = kneser_ney.bits(all_docs, good, [*kept, doc_id, lang], repeats, (bits, held, again), order)
    marks = found.filter(F.col(held).isNotNull()).select(lang, doc_id, held, again).join(good.filter("aside").select(F.col("id").alias(doc_id)), doc_id, "left_semi").groupBy(F.col(lang).alias(key))
    fence = lambda c: F.percentile_approx(c, F.lit(quantile), 10_000)
    fences = marks.agg(fence(held).alias(most), F.greatest(fence(again), F.lit(0.3)).alias(most_again))
    within = F.col(bits).isNull() | F.col(most).isNull() | ((F.col(bits) <= F.col(most)) & (F.col(again) <= F.col(most_again)))
    return found.join(F.broadcast(fences), F.col(lang) == F.col(key), "left").select(*kept, bits, again, within.alias(stays))  # a row a language is broadcast


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected ones."""
    names = docs.columns
    added = fresh(names, "_bits", "_repeats", "_kept")
    return judged(docs, labels, names, added, **options).filter(F.col(added[-1])).select(*names)


@query("op4_quality")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = judged(docs, table(spark, sf_dir, "labels"), ["doc_id", "lang"])
    return found.select("doc_id", "lang", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "repeats", "kept")
