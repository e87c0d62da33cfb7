"""The corpus pipeline over ``documents``: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents; the last returns the pieces of the documents with their ids and places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalpanel.llm import packing, passages, quality, similar, toxicity
from evalpanel.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose perplexity under the model of trusted text, or whose repetition, is too high."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents."""
    return toxicity.harmless_documents(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a verified similarity of 0.8 or more.

    SimHash fingerprints by multi-index hashing and MinHash bands propose the pairs.
    """
    return similar.one_of_each(docs, words=5, least=0.8)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that stand in an earlier document."""
    return passages.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.packed_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good), ("toxicity", harmless), ("simhash", distinct), ("passages", unrepeated), ("packing", packed)]

#: Trained models, hash links, chains and packings are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
