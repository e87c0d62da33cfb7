"""What the vector operators share: which vectors count, and their form for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_usable(vector: str) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    x = F.col(vector).cast("array<double>")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce(~F.exists(x, odd) & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as rows of a float64 matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
