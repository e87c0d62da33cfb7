"""How filters of a corpus interact: what every order of them removes, step by step.

Each document fails or passes every filter on its own, whatever the order, so the counts of documents by failure pattern hold all
orders. One aggregation gives a tensor per part with an axis of two (pass, fail) for each filter; a step of an order is that
tensor contracted with one selector per axis: pass for earlier filters, fail for its own, all for later ones.

Defined results: a null text is the empty text; a null part is the empty string, together with parts that are empty; rows with a null
id are never repetitions and make none; rows with equal ids and texts are no repetitions of each other, as no id is smaller;
an id that stands several times in ``labels`` is good or toxic if one of its rows says so, ids that it lacks are neither;
an empty table has no parts and so no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalpanel.llm.common import table
from evalpanel.llm.registry import query

SPACES = r"[\x20\x09-\x0D]+"
#: Rows of the selector product made at a time.
PARTS = 256


def text_filters(text: Column) -> dict[str, Column]:
    """Failure of the filters that read the text alone: too short, repetitive, too many capitals, odd signs."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E): the failures of every document; E is a text that a smaller id has too.

    Texts are compared by their 256-bit digests. The first id of a digest is a map-side minimum, and documents meet it by digest and
    id together, so a text with very many copies is no hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    given = given.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *[c.alias(k) for k, c in text_filters(F.col("text")).items()])
    first = given.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    found = given.join(first, ["digest", "doc_id"], "left")
    return found.withColumn("E", F.col("doc_id").isNotNull() & F.col("is_first").isNull()).select("doc_id", "part", *"ABCDE")


def pattern_counts(failed: DataFrame, filters: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """(part, cells): for each part its non-empty cells (pattern, one sum per entry of ``counts``), at most 2 to the number of filters.

    The first filter is the highest bit of a pattern; a set bit is a failure.
    """
    bit = lambda k, name: F.col(name).cast("int") * (1 << (len(filters) - 1 - k))
    pattern = sum((bit(k, name) for k, name in enumerate(filters)), F.lit(0))
    cells = failed.groupBy("part", pattern.alias("pattern")).agg(*[F.sum(c.cast("long")).alias(n) for n, c in counts.items()])
    return cells.groupBy("part").agg(F.collect_list(F.struct("pattern", *counts)).alias("cells"))


def selectors(filters: Sequence[str]) -> tuple[list[tuple[str, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Every (order, step, filter) and its selectors, steps x axes x (pass, fail), of what is removed, kept and redundant.

    Redundant are the failures of the filter among all, less those removed by it.
    """
    passes, fails, every = (1, 0), (0, 1), (1, 1)
    steps, removed, kept, failing = [], [], [], []
    for order in permutations(range(len(filters))):
        for at, own in enumerate(order):
            earlier = order[:at]
            steps.append(("".join(filters[k] for k in order), at + 1, own))
            removed.append([passes if k in earlier else fails if k == own else every for k in range(len(filters))])
            kept.append([passes if k in earlier or k == own else every for k in range(len(filters))])
            failing.append([fails if k == own else every for k in range(len(filters))])
    return steps, *(np.array(x, np.int64) for x in (removed, kept, failing))


def contracted(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """parts x steps: the tensor, parts x 2 x 2 ..., contracted with every step's selector along each axis."""
    axes = [chosen[:, k] for k in range(chosen.shape[1])]
    letters = "abcdefghijklm"[: len(axes)]
    return np.einsum(f"p{letters},{','.join('s' + x for x in letters)}->ps", tensor, *axes)


def interaction(patterns: DataFrame, filters: Sequence[str], weights: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """From ``pattern_counts`` with "n" and ``weights``: a row for each part, order of filters and step.

    Removed is counted once more for each of ``weights`` as <weight>_lost. ``shapley`` is what the step's filter removes, summed over all orders.
    """
    names, size = ["n", *weights], len(filters)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long"
    schema += "".join(f", {w}_lost long" for w in weights) + ", shapley long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, removes, keeps, fails = selectors(filters)
        owns = np.array([own for _, _, own in steps])
        alone = np.array([[(0, 1) if k == own else (1, 0) for k in range(size)] for own in range(size)], np.int64)
        for frame in frames:
            for at in range(0, len(frame), PARTS):
                some = frame.iloc[at : at + PARTS]
                tensor = np.zeros((len(names), len(some), 1 << size), np.int64)
                for p, cells in enumerate(some["cells"]):
                    for cell in cells:
                        tensor[:, p, cell["pattern"]] = [cell[n] for n in names]
                tensor = tensor.reshape(len(names), len(some), *[2] * size)
                removed = [contracted(t, removes) for t in tensor]
                total = np.stack([removed[0][:, owns == own].sum(1) for own in range(size)], 1)
                columns = [
                    contracted(tensor[0], keeps),
                    removed[0],
                    contracted(tensor[0], fails) - removed[0],
                    contracted(tensor[0], alone)[:, owns],
                    *removed[1:],
                    total[:, owns],
                ]
                out = {"part": np.repeat(some["part"].to_numpy(), len(steps)), "filter_order": [o for o, _, _ in steps] * len(some), "step": np.tile([s for _, s, _ in steps], len(some)).astype(np.int32)}
                heads = ["kept", "removed", "redundant", "unique_fails", *[f"{w}_lost" for w in weights], "shapley"]
                yield pd.DataFrame(out | {h: c.ravel() for h, c in zip(heads, columns)})

    return patterns.mapInPandas(run, schema)


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The interaction of the filters A to E on ``docs``; good and toxic documents are those that ``labels`` marks."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = marks.agg(is_one("quality"), is_one("toxic"))
    marked = failures(docs, **columns).join(marks, "doc_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return interaction(pattern_counts(marked, "ABCDE", {"n": F.lit(1), "good": yes("quality"), "toxic": yes("toxic")}), "ABCDE")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
f AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > low, false) AS e FROM w
),
m AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT f.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN m ON f.doc_id = m.doc_id),
h AS (
  SELECT part, list_value(a, b, c, d, e) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY ALL
),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) x(letter, pos)),
o AS (
  SELECT k1.letter || k2.letter || k3.letter || k4.letter || k5.letter AS filter_order FROM k k1, k k2, k k3, k k4, k k5
  WHERE len(list_distinct([k1.pos, k2.pos, k3.pos, k4.pos, k5.pos])) = 5
),
s AS (SELECT filter_order, CAST(i AS INT) AS step, substr(filter_order, i, 1) AS own, substr(filter_order, 1, i - 1) AS before FROM o, range(1, 6) r(i)),
v AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[(SELECT pos FROM k WHERE letter = own)] AS fails_own,
    coalesce(list_bool_or(list_transform([1, 2, 3, 4, 5], lambda i: fails[i] AND contains(before, substr('ABCDE', i, 1)))), false) AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AS one FROM h, s
),
r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fails_own THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_own THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails_own THEN n ELSE 0 END) AS redundant, sum(CASE WHEN one AND fails_own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails_own THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_own THEN toxic ELSE 0 END) AS toxic_lost FROM v GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


@query("op13_filter_audit", SQL)
def op13(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
