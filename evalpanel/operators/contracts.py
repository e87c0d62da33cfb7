"""Expectations: every check is a one-row aggregate; all of them run as one union."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



GATE, REPORT = "gate", "report"


class ContractError(RuntimeError):
    """A gate check failed."""


def _check(one_row: DataFrame, check_id: str, description: str, passed: Column, detail: Column, severity: str) -> DataFrame:
    return one_row.select(
        F.lit(check_id).alias("check_id"),
        F.lit(description).alias("description"),
        F.lit(severity).alias("severity"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        detail.cast("string").alias("detail"),
    )


def _text(**cols: Column) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("null"))) for k, c in cols.items()])


def row_count(df: DataFrame, check_id: str, expected: int, severity: str = GATE) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    return _check(n, check_id, f"{expected} rows", F.col("n") == expected, _text(rows=F.col("n")), severity)


def unique_key(df: DataFrame, check_id: str, key: Sequence[str], expected: int | None = None, severity: str = GATE) -> DataFrame:
    """Rows equal distinct keys (and the expected number, if given); also the guard before a 1:1 join."""
    per = df.groupBy(*key).agg(F.count("*").alias("k")).agg(
        F.count("*").alias("keys"), F.sum("k").alias("n"), F.count_if(F.col("k") > 1).alias("dup")
    )
    ok = F.coalesce(F.col("dup"), F.lit(0)) == 0
    if expected is not None:
        ok = ok & (F.coalesce("n", F.lit(0)) == expected)
    return _check(per, check_id, f"unique {','.join(key)}", ok, _text(rows=F.col("n"), keys=F.col("keys"), duplicated=F.col("dup")), severity)


def one_to_one(left: DataFrame, right: DataFrame, check_id: str, key: str, severity: str = GATE) -> DataFrame:
    """Every key once on either side and none unmatched."""
    a = left.groupBy(key).agg(F.count("*").alias("_l"))
    b = right.groupBy(key).agg(F.count("*").alias("_r"))
    both = a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if((F.col("_l") > 1) | (F.col("_r") > 1)).alias("repeated"),
    )
    ok = (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("repeated") == 0)
    return _check(both, check_id, f"one to one on {key}", ok, _text(left_only=F.col("left_only"), right_only=F.col("right_only"), repeated=F.col("repeated")), severity)


def rows_per_unit(df: DataFrame, check_id: str, keys: Sequence[str], unit: str, expected: int, severity: str = GATE) -> DataFrame:
    """Every unit carries the same number of rows within each key."""
    per = df.groupBy(*keys, unit).agg(F.count("*").alias("k")).agg(
        F.count("*").alias("units"), F.count_if(F.col("k") != expected).alias("wrong")
    )
    return _check(per, check_id, f"{expected} rows per {unit}", (F.col("wrong") == 0) & (F.col("units") > 0), _text(units=F.col("units"), wrong=F.col("wrong")), severity)


def vocabulary(df: DataFrame, check_id: str, column: str, expected: Sequence[str], severity: str = GATE) -> DataFrame:
    """The distinct values are exactly the declared ones; unmapped NULLs count as unexpected."""
    want = F.array(*[F.lit(e) for e in expected])
    seen = df.groupBy(column).agg(F.count("*").alias("k")).agg(
        F.count_if(F.col(column).isNull() | ~F.col(column).isin(list(expected))).alias("extra"),
        F.collect_set(F.when(F.col(column).isin(list(expected)), F.col(column))).alias("got"),
    )
    missing = F.size(F.array_except(want, F.col("got")))
    return _check(seen, check_id, f"{column} has the declared values", (F.col("extra") == 0) & (missing == 0), _text(missing=missing, unexpected=F.col("extra")), severity)


def equal_columns(df: DataFrame, check_id: str, a: str, b: str, atol: float = 1e-8, rtol: float = 1e-5, severity: str = GATE) -> DataFrame:
    close = F.abs(F.col(a) - F.col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col(b))
    agg = df.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(close, F.lit(False))).alias("bad"), F.max(F.abs(F.col(a) - F.col(b))).alias("gap"))
    return _check(agg, check_id, f"{a} equals {b}", F.col("bad") == 0, _text(rows=F.col("n"), different=F.col("bad"), largest=F.col("gap")), severity)


def histogram(df: DataFrame, check_id: str, column: str, expected: Mapping, severity: str = GATE) -> DataFrame:
    """Counts per value equal the declared counts; other values must not occur."""
    agg = df.agg(
        *[F.count_if(F.col(column) == F.lit(v)).alias(f"n{i}") for i, v in enumerate(expected)],
        F.count_if(~F.coalesce(F.col(column).isin(list(expected)), F.lit(False))).alias("other"),
    )
    ok = F.col("other") == 0
    for i, n in enumerate(expected.values()):
        ok = ok & (F.col(f"n{i}") == n)
    shown = {str(v): F.col(f"n{i}") for i, v in enumerate(expected)}
    return _check(agg, check_id, f"counts of {column}", ok, _text(**shown, other=F.col("other")), severity)


def two_way(df: DataFrame, check_id: str, a: str, b: str, expected: Mapping[tuple, int], severity: str = GATE) -> DataFrame:
    """A two-way table cell by cell, structural zeros and shape included."""
    agg = df.agg(
        *[F.count_if((F.col(a) == F.lit(x)) & (F.col(b) == F.lit(y))).alias(f"c{i}") for i, (x, y) in enumerate(expected)],
        F.count("*").alias("n"),
    )
    ok, inside = F.lit(True), F.lit(0)
    for i, n in enumerate(expected.values()):
        ok = ok & (F.col(f"c{i}") == n)
        inside = inside + F.col(f"c{i}")
    shown = {f"{x}/{y}": F.col(f"c{i}") for i, (x, y) in enumerate(expected)}
    return _check(agg, check_id, f"{a} by {b}", ok & (inside == F.col("n")), _text(**shown, rows=F.col("n")), severity)


def measured(df: DataFrame, check_id: str, description: str, value: Column, expected: float | None = None, atol: float = 1e-6, severity: str | None = None) -> DataFrame:
    """An aggregate compared with a declared value (relative tolerance 0), or only reported."""
    one = df.agg(value.cast("double").alias("v"))
    kind = severity or (REPORT if expected is None else GATE)
    ok = F.col("v").isNotNull() if expected is None else F.abs(F.col("v") - F.lit(float(expected))) <= F.lit(atol)
    return _check(one, check_id, description, ok, _text(value=F.col("v"), expected=F.lit(expected)), kind)


def no_nulls(df: DataFrame, check_id: str, columns: Sequence[str], severity: str = GATE) -> DataFrame:
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0))
    return _check(agg, check_id, f"no NULL in {','.join(columns)}", total == 0, _text(**{c: F.col(c) for c in columns}), severity)


def counts_under(df: DataFrame, check_id: str, column: str, floor: int) -> DataFrame:
    per = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("k")).agg(
        F.count("*").alias("levels"), F.count_if(F.col("k") < floor).alias("thin")
    )
    return _check(per, check_id, f"levels of {column} with at least {floor} rows", F.col("thin") == 0, _text(levels=F.col("levels"), thin=F.col("thin")), REPORT)


def degenerate(df: DataFrame, check_id: str, column: str, max_share: float = 0.90, min_levels: int = 3) -> DataFrame:
    """A score with at most two levels, or one level holding more than ``max_share``."""
    per = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("k")).agg(
        F.count("*").alias("levels"), (F.max("k") / F.sum("k")).alias("share")
    )
    ok = (F.col("levels") >= min_levels) & (F.col("share") <= max_share)
    return _check(per, check_id, f"{column} is not degenerate", ok, _text(levels=F.col("levels"), largest=F.col("share")), REPORT)


def nested_bins(df: DataFrame, check_id: str, fine: str, coarse: str, expected: int | None = None, severity: str = GATE) -> DataFrame:
    """Each fine bin lies in one coarse bin; no row is without a bin; counts add up."""
    per = df.groupBy(fine).agg(F.countDistinct(coarse).alias("c"), F.count("*").alias("k")).agg(
        F.count_if((F.col("c") != 1) | F.col(fine).isNull()).alias("bad"), F.sum("k").alias("n")
    )
    ok = F.col("bad") == 0
    if expected is not None:
        ok = ok & (F.col("n") == expected)
    return _check(per, check_id, f"{fine} nests in {coarse}", ok, _text(bad=F.col("bad"), rows=F.col("n")), severity)


def repeat_design(df: DataFrame, check_id: str, cell: Sequence[str], per_cell: int, severity: str = GATE) -> DataFrame:
    per = df.groupBy(*cell).agg(F.count("*").alias("k")).agg(F.count("*").alias("cells"), F.count_if(F.col("k") != per_cell).alias("wrong"))
    return _check(per, check_id, f"{per_cell} rows per {','.join(cell)}", F.col("wrong") == 0, _text(cells=F.col("cells"), wrong=F.col("wrong")), severity)


def computed(one_row: DataFrame, check_id: str, description: str, passed: Column, detail: Column, severity: str = GATE) -> DataFrame:
    """A check on a result that is already one row."""
    return _check(one_row, check_id, description, passed, detail, severity)


@dataclass
class Expectations:
    """Checks collected for one run."""

    checks: list[DataFrame] = field(default_factory=list)

    def add(self, *checks: DataFrame) -> "Expectations":
        self.checks.extend(checks)
        return self

    def run(self) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), self.checks)


def enforce(results: DataFrame) -> DataFrame:
    """Raise if any gate failed. The results are one row per check."""
    failed = results.filter((F.col("severity") == GATE) & ~F.col("passed")).collect()
    if failed:
        raise ContractError("; ".join(f"{r['check_id']}: {r['description']} ({r['detail']})" for r in failed))
    return results


def joined_without_loss(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Many-to-one join that refuses a repeated dimension key or a fact row without a match.

    The refusal is raised by the rows themselves while the job runs; no extra pass is made.
    """
    guarded = dim.groupBy(key).agg(F.count("*").alias("_k"), *[F.min(c).alias(c) for c in dim.columns if c != key])
    stop = F.raise_error(F.lit(f"key {key} is repeated in the dimension")).cast("bigint")
    once = guarded.withColumn("_k", F.when(F.col("_k") > 1, stop).otherwise(F.col("_k")))
    out = fact.join(once, key, "left")
    lost = F.raise_error(F.lit(f"no match for {key} in the dimension")).cast("bigint")
    checked = out.withColumn("_k", F.when(F.col("_k").isNull(), lost if how == "inner" else F.lit(0).cast("bigint")).otherwise(F.col("_k")))
    # Filtering on the guard keeps it in the plan.
    return checked.filter(F.col("_k") >= 0).drop("_k")


def panel_contract(panel: DataFrame, raters: Sequence[str], conds: Sequence[str], unit: str = "unit") -> Expectations:
    """The standing checks of a complete panel."""
    cells = len(raters) * len(conds)
    per_unit = panel.groupBy(unit).agg(F.min("bin").alias("bin"), F.min("reference").alias("reference"))
    med = F.expr("avg(reference)")
    return Expectations().add(
        rows_per_unit(panel, "balance", [], unit, cells),
        rows_per_unit(panel, "rows_per_rater", ["rater"], unit, len(conds)),
        unique_key(panel, "cell_key", [unit, "rater", "cond"]),
        vocabulary(panel, "raters", "rater", raters),
        vocabulary(panel, "conditions", "cond", conds),
        no_nulls(panel, "no_nulls", ["reference", "pred", "bin"]),
        measured(per_unit, "zero_reference", "units with zero reference", F.count_if(F.col("reference") == 0)),
        measured(per_unit, "reference_mean", "mean reference", med),
        unique_key(per_unit, "fan_out", [unit]),
    )


def compare_tables(got: DataFrame, want: DataFrame, keys: Sequence[str], value: str, check_id: str, atol: float = 1e-6) -> DataFrame:
    """A computed table against declared values, row by row."""
    w = want.select(*keys, F.col(value).alias("_want"))
    both = got.select(*keys, F.col(value).alias("_got")).join(w, list(keys), "full_outer")
    bad = ~F.coalesce(F.abs(F.col("_got") - F.col("_want")) <= atol, F.lit(False))
    agg = both.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return _check(agg, check_id, f"{value} as declared", F.col("bad") == 0, _text(rows=F.col("n"), different=F.col("bad")), GATE)


def losses(rows: DataFrame, keys: Sequence[str], reasons: Mapping[str, Column]) -> DataFrame:
    """Per key: rows, rows kept, and rows lost for each reason, each counted under the first reason that is true; one aggregation."""
    first = F.lit(None).cast("string")
    for name, lost in reversed(list(reasons.items())):
        first = F.when(lost, F.lit(name)).otherwise(first)
    named = rows.select(*keys, first.alias("_reason"))
    grouped = named.groupBy(*keys) if keys else named.groupBy()
    return grouped.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_reason").isNull()).alias("kept"),
        *[F.count_if(F.col("_reason") == F.lit(r)).alias(r) for r in reasons],
    )
