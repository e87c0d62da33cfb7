"""Imports every query module so that all queries are registered."""

from evalpanel.plans import (  # noqa: F401
    queries_extra,
    queries_metrics,
    queries_models,
    queries_paired,
    queries_ranks,
    queries_resample,
    queries_selection,
)
from evalpanel.plans.registry import QUERIES, SQL  # noqa: F401
