"""Column expressions: bins, errors, skills, labels. All stay inside code generation."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIVE_EDGES = (0, 20, 40, 60, 80, 100)
EIGHT_EDGES = (0, 1, 5, 10, 20, 40, 60, 80, 100)
TEN_EDGES = tuple(range(0, 101, 10))

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def right_closed_bin(value: Col, edges: Sequence[float]) -> Column:
    """Index of the bin holding ``value``; bins are (lo, hi], the first one also holds its lower edge.

    Values outside the edges, and NULL, give NULL.
    """
    v = _c(value)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when(v <= F.lit(float(edges[i + 1])), F.lit(i)).otherwise(out)
    return F.when(v >= F.lit(float(edges[0])), out)


def bin_label(idx: Col, edges: Sequence[float]) -> Column:
    labels = [f"{edges[i]:g}-{edges[i + 1]:g}" for i in range(len(edges) - 1)]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), _c(idx) + F.lit(1))


def bin_midpoint(idx: Col, edges: Sequence[float]) -> Column:
    mids = [(edges[i] + edges[i + 1]) / 2.0 for i in range(len(edges) - 1)]
    return F.element_at(F.array(*[F.lit(x) for x in mids]), _c(idx) + F.lit(1))


def with_errors(df: DataFrame, pred: str = "pred", reference: str = "reference") -> DataFrame:
    """Signed and absolute error; NaN inputs become NULL first."""
    p = F.nanvl(F.col(pred), F.lit(None).cast("double"))
    e = p - F.nanvl(F.col(reference), F.lit(None).cast("double"))
    return df.withColumns({"e": e, "abs_e": F.abs(e)})


def with_bins(df: DataFrame, edges: Sequence[float], reference: str = "reference", name: str = "bin") -> DataFrame:
    """Bin the reference; an in-range value without a bin fails the job."""
    idx = right_closed_bin(reference, edges)
    lost = F.col(reference).between(float(edges[0]), float(edges[-1])) & idx.isNull()
    return df.withColumn(name, F.when(lost, F.raise_error(F.lit("in-range reference without a bin")).cast("int")).otherwise(idx))


def within(abs_e: Col, limit: float) -> Column:
    return F.avg((_c(abs_e) <= F.lit(float(limit))).cast("double"))


def symmetric_ape(pred: Col, reference: Col) -> Column:
    """|p - r| over the mean magnitude of both; 0 when both are 0."""
    p, r = _c(pred), _c(reference)
    den = (F.abs(p) + F.abs(r)) / F.lit(2.0)
    return F.when(den > 0, F.abs(p - r) / den).otherwise(F.when(den.isNotNull(), F.lit(0.0)))


def relative_skill(model_error: Col, base_error: Col) -> Column:
    """(base - model) / (base + model); positive when the model is better, 0 when both are 0."""
    m, b = _c(model_error), _c(base_error)
    return F.when((m + b) > 0, (b - m) / (b + m)).otherwise(F.when((m + b).isNotNull(), F.lit(0.0)))


def skill_ratio(model_error: Col, base_error: Col) -> Column:
    m, b = _c(model_error), _c(base_error)
    return F.when(b != 0, F.lit(1.0) - m / b)


def unusable_score(score: Col, method: Col | None = None, bad: str = "ambiguous_unresolved") -> Column:
    s = F.nanvl(_c(score), F.lit(None).cast("double")).isNull()
    if method is None:
        return s
    return s | F.coalesce(_c(method) == F.lit(bad), F.lit(False))


def indicators(column: str, levels: Sequence, prefix: str) -> dict[str, Column]:
    """0/1 columns for every level but the first; NULL counts as 0."""
    return {
        f"{prefix}_{lvl}": F.coalesce((F.col(column) == F.lit(lvl)).cast("double"), F.lit(0.0))
        for lvl in list(levels)[1:]
    }


def numeric_or_null(column: Col) -> Column:
    return F.nanvl(_c(column).try_cast("double"), F.lit(None).cast("double"))


def normal_name(column: Col) -> Column:
    return F.lower(F.trim(_c(column)))


def mapped(column: Col, vocabulary: Mapping[str, str]) -> Column:
    """Vocabulary lookup that is its own fixpoint: a mapped value maps to itself, an unknown one to NULL."""
    v = _c(column)
    out = F.lit(None).cast("string")
    for new in sorted(set(vocabulary.values())):
        out = F.when(v == F.lit(new), F.lit(new)).otherwise(out)
    for old, new in vocabulary.items():
        out = F.when(v == F.lit(old), F.lit(new)).otherwise(out)
    return out


def pair_confounded(family_a: Col, family_b: Col) -> Column:
    return _c(family_a) != _c(family_b)


def members_confounded(families: Col) -> Column:
    """Over a group of members: do they come from more than one family?"""
    return F.min(_c(families)) != F.max(_c(families))
