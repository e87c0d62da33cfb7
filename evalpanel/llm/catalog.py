"""Imports every operator module so that all queries are registered."""

from evalpanel.llm import ann, audit, bpe, chat, embedding_dedup, packing, pages, passages, pii, quality, search, simhash, toxicity  # noqa: F401
from evalpanel.llm.registry import QUERIES, SQL  # noqa: F401
