"""A Kneser-Ney model of trusted text small enough to be sent to every task: UTF-8 bytes folded to 64 classes (letters, one class for
capitals, one for digits, white space, marks, the rest), so at most 64**order entries per language however large the corpus is.

A general function for callers who want a model as a value. ``op4_quality`` and the pipeline don't use it: they score unfolded
n-grams by joins (``kneser_ney``). Counts come from all trusted documents; fences are as in ``quality``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.llm.common import discard, per_worker, schema_with, sliced, written
from evalpanel.llm.kneser_ney import smoothed

CLASSES = 64
ORDER = 4
MARKS = b".,;:!?'\"-()%#$&*|"


def classes() -> np.ndarray:
    """The class of each byte. Zero stands for what lies before a text, and for control characters."""
    of = np.zeros(256, np.uint8)
    of[ord("a") : ord("z") + 1] = np.arange(1, 27)
    of[ord("A") : ord("Z") + 1] = 27
    of[ord("0") : ord("9") + 1] = 28
    of[[32, 9]], of[[10, 13]] = 29, 30
    for k, b in enumerate(MARKS):
        of[b] = 31 + k
    k = 31 + len(MARKS)
    rest = [b for b in range(33, 127) if not of[b]]
    of[rest] = k
    of[128:192] = k + 1 + np.arange(64) % 12
    of[192:256] = k + 13 + np.arange(64) % 2
    return of


def grams(raw: bytes, of: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as a number in base 64."""
    codes = np.concatenate([np.zeros(order - 1, np.int32), of[np.frombuffer(raw, np.uint8)].astype(np.int32)])
    n = len(raw)
    out = codes[:n].copy()
    for j in range(1, order):
        out *= CLASSES
        out += codes[j : j + n]
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int]]]:
    """The rows of each language in a batch."""
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(batch.column("lang").to_pylist()):
        by.setdefault(lang or "", []).append(i)
    yield from by.items()


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, aside, gram, c): counts over all of ``docs`` (lang, aside, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = classes(), {}
        for batch in sliced(batches):
            texts, aside = batch.column("text").to_pylist(), batch.column("aside").to_pylist()
            groups = [((lang, part), [i for i in rows if bool(aside[i]) == part]) for lang, rows in _runs(batch) for part in (False, True)]
            for lang, rows in groups:
                if not rows:
                    continue
                found = np.concatenate([grams((texts[i] or "").encode(), of, order) for i in rows])
                keys, counts = np.unique(found, return_counts=True)
                if lang in total:
                    old_keys, old = total[lang]
                    keys, place = np.unique(np.concatenate([old_keys, keys]), return_inverse=True)
                    counts = np.bincount(place, np.concatenate([old, counts]), len(keys)).astype(np.int64)
                total[lang] = keys, counts
        for (lang, part), (keys, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([part] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "aside", "gram", "c"])

    found = docs.select("lang", "aside", "text").mapInArrow(run, "lang string, aside boolean, gram long, c long")
    return found.groupBy("lang", "aside", "gram").agg(F.sum("c").alias("c"))


class Model:
    """Bits by language and n-gram, from the table of ``smoothed``, and the fences of each language."""

    def __init__(self, values: dict[str, list], order: int, fences: dict[str, tuple[float, float]] | None = None, key: str | None = None):
        self.values, self.order, self.fences, self.key = values, order, fences or {}, key or uuid.uuid4().hex

    def plain(self) -> tuple:
        """What makes an equal model: only such values are broadcast, as executors may lack this package."""
        return self.values, self.order, self.fences, self.key

    def tenths(self, lang: str) -> np.ndarray:
        """-log2 p of every n-gram of ``lang``, in tenths of a bit: 16 MB at order 4, made for one first symbol at a time.

        p is what is seen after discount, plus the rest of the context times the lower order.
        """
        p = np.full(CLASSES, 1 / CLASSES, np.float32)
        for n in range(1, self.order + 1):
            gram, value, context, rest = self.values[lang][n - 1]
            back = np.ones(CLASSES ** (n - 1), np.float32)
            back[context] = rest
            in_order = np.argsort(gram)
            gram, value = gram[in_order], value[in_order]
            out = np.empty(CLASSES**n, np.uint8 if n == self.order else np.float32)
            size = len(p)
            for at in range(0, len(out), size):
                part = p * np.repeat(back[at // CLASSES : (at + size) // CLASSES], CLASSES)
                low, high = np.searchsorted(gram, (at, at + size))
                part[gram[low:high] - at] += value[low:high]
                out[at : at + size] = np.minimum(np.rint(-10 * np.log2(part)), 255) if n == self.order else part
            p = out
        return p

    def score(self, raw: bytes, lang: str, of: np.ndarray) -> float | None:
        if not raw or lang not in self.values:
            return None
        tenths = per_worker("quality", lang, lambda: self.tenths(lang), self.key)
        return float(tenths[grams(raw, of, self.order)].sum(dtype=np.int64) / (10 * len(raw)))


def repeats(text: str) -> float:
    """The share of words that repeat the word before them."""
    words = text.split()
    return sum(map(eq, words, words[1:])) / len(words) if words else 0.0


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select(F.col("doc_id").alias("_good"))
    # The ids grow with the input, so they are never broadcast, and the plan is the same at every size.
    return docs.join(good.hint("merge"), docs["doc_id"] == good["_good"], "left_semi")


def scored(docs: DataFrame, model: Model, added: tuple[str, str, str] = ("bits", "repeats", "kept")) -> DataFrame:
    """``docs`` with bits (per UTF-8 byte), repeats, and kept, under the names ``added``."""
    return _scored(docs, docs.sparkSession.sparkContext.broadcast(model.plain()), added)


def _scored(docs: DataFrame, shared: Broadcast, added: tuple[str, str, str] = ("bits", "repeats", "kept")) -> DataFrame:
    names = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of = Model(*shared.value), classes()
        for batch in sliced(batches):
            bits, again, kept = [], [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                lang = lang or ""
                bits.append(model.score((text or "").encode(), lang, of))
                again.append(repeats(text or ""))
                most, most_again = model.fences.get(lang, (math.inf, math.inf))
                kept.append(bits[-1] is None or bits[-1] <= most and again[-1] <= most_again)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.float64()), pa.array(again, pa.float64()), pa.array(kept, pa.bool_())], [*names, *added])

    given = docs.select(*names)
    return given.mapInArrow(run, schema_with(given, **dict(zip(added, (T.DoubleType(), T.DoubleType(), T.BooleanType())))))


def tables(found: DataFrame, order: int) -> list[dict[str, list]]:
    """The table of ``smoothed`` on the driver, for each model by language and order; bounded by 64**order entries a language and model."""
    part = (2 * F.col("n") + (F.col("kind") == "rest").cast("int")).cast("byte").alias("part")
    held = found.select("model", "lang", part, F.col("code").cast("int").alias("code"), F.col("value").cast("float").alias("value")).toArrow()
    models: list[dict[str, list]] = []
    for model in (0, 1):
        values: dict[str, list] = {}
        rows = held.filter(pc.equal(held["model"], model))
        for lang in pc.unique(rows["lang"]).to_pylist():
            mine = rows.filter(pc.equal(rows["lang"], lang))
            at, code, value = (mine[c].to_numpy() for c in ("part", "code", "value"))
            values[lang] = [tuple(x[at == 2 * n + kind] for kind in (0, 1) for x in (code, value)) for n in range(1, order + 1)]
        models.append(values)
    return models


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = 0.99, spread: float = 4.0) -> Model:
    """The model of all trusted text, with a fence per language: median + spread * (quantile - median) of trusted documents.

    Text fits a model better that has counted it, so the quantiles are those of a fifth of the trusted documents under a
    model of the others.
    """
    good = trusted(docs.select("doc_id", "lang", "text"), labels).withColumn("aside", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    counted = written(gram_counts(good.withColumn("aside", F.coalesce("aside", F.lit(False))), order))
    model, other = (Model(values, order) for values in tables(smoothed(counted, order, 6), order))  # each a few MB
    discard(counted)
    shared = docs.sparkSession.sparkContext.broadcast(other.plain())
    marks = _scored(good.filter("aside").select("lang", "text"), shared).filter("bits IS NOT NULL").groupBy(F.coalesce("lang", F.lit("")).alias("lang"))
    at = F.array(F.lit(0.5), F.lit(quantile))
    for row in marks.agg(F.percentile_approx("bits", at, 10_000).alias("bits"), F.percentile_approx("repeats", at, 10_000).alias("again")).collect():  # a row a language
        fence = lambda q: q[0] + spread * (q[1] - q[0])
        model.fences[row["lang"]] = fence(row["bits"]), max(fence(row["again"]), 0.3)
    shared.destroy()
    return model
