"""Toxicity by cumulative-link ordinal regression: severity grades from sparse text features.

Grades: 0 for documents labelled clean; labelled toxic ones get 1, 2 or 3 by the thirds of their number of telling words. The
log-odds of exceeding a grade are a shared linear score less the threshold of the grade. Features are words and their first
four and five letters, lower-cased, counted as log(1 + n), so that unseen endings of known words count too.

The regression is fitted on a bounded sample of labelled rows (``fit_rows``, half of either label, lowest hash of the id
first); everything is scored, over whole texts.

Defined results: null and empty texts have no features and get the score of the thresholds alone; a document with several
labels is toxic if any says so; null labels and ids teach nothing; without labelled documents of both kinds every severity is zero;
repeated rows get equal scores; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.llm.common import Memo, discard, fresh, schema_with, sliced, small_batches, table, worker_of, written
from evalpanel.llm.registry import query

WORD = re.compile(r"\w+")
#: Longer runs of letters, as in scripts without spaces and terms joined by underscores, are read in pieces.
LONGEST = 24
#: Letters of the pieces.
PIECE = 4
GRADES = 4
#: Features that a task counts before it hands them on.
HELD = 100_000


def words_of(text: str | None) -> list[str]:
    """The words of a text; a run of more than ``LONGEST`` letters gives its parts between underscores, and those too long their ``PIECE``-letter windows."""
    out = []
    for run in WORD.findall(text.lower()) if text else ():
        if len(run) <= LONGEST:
            out.append(run)
            continue
        for part in run.split("_"):
            if len(part) > LONGEST:
                out += [part[i : i + PIECE] for i in range(len(part) - PIECE + 1)]
            elif part:
                out.append(part)
    return out


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in (4, 5) if len(word) >= n)]


@dataclass
class Model:
    """Weights by feature, and the thresholds between grades in ascending order."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def indices(self, words: list[str]) -> list[tuple[int, ...]]:
        return [tuple(self.index[f] for f in features_of(w) if f in self.index) for w in words]

    def above(self, counts: Counter) -> np.ndarray:
        """The probabilities of exceeding each grade but the last."""
        score = sum(self.weights[k] * np.log1p(n) for k, n in counts.items())
        return np.where(np.isinf(self.thresholds), 0.0, 1 / (1 + np.exp(np.clip(self.thresholds - score, -700, 700))))


def counted(words: list[str], known: dict[str, tuple[int, ...]]) -> Counter:
    return Counter(k for w in words for k in known[w])


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic) of at most ``fit_rows`` labelled documents, half of either label."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2) for t in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many toxic and clean documents each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter(), Counter()

        def summed() -> pa.RecordBatch:
            names = list(total[0].keys() | total[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([total[t][f] for f in names], pa.int64()) for t in (1, 0))], ["feature", "toxic", "clean"])

        for batch in sliced(batches, 256):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[bool(toxic)].update({f for w in set(words_of(text)) for f in features_of(w)})
            if len(total[0]) + len(total[1]) > HELD:
                yield summed()
                total = Counter(), Counter()
        yield summed()

    return sample.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def cumulative_link(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, width: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional-odds model by gradient steps on its mean penalised log-likelihood.

    Thresholds are a first one and the logarithms of the gaps above it, so they stay ordered.
    """
    n, k = len(grades), GRADES - 1
    params = np.concatenate([np.zeros(width), [0.0], np.full(k - 1, -1.0)])
    first, second = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        w, t = params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])
        score = np.bincount(rows, vals * w[cols], n)
        upto = np.column_stack([np.zeros(n), sigmoid(t[None, :] - score[:, None]), np.ones(n)])  # P(grade < j)
        high, low = upto[np.arange(n), grades + 1], upto[np.arange(n), grades]
        p = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
        by_score = (slope_high - slope_low) / n  # of minus the log-likelihood
        by_t = np.bincount(grades, -slope_high / n, k + 1)[:k] + np.bincount(grades, slope_low / n, k + 1)[1:]
        gaps = np.exp(params[width + 1 :])
        grad = np.concatenate([np.bincount(cols, vals * by_score[rows], width) + ridge * w, [by_t.sum()], gaps * np.cumsum(by_t[:0:-1])[::-1]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, vocabulary: int = 2_000, least: int = 5, lift: float = 3.0, chi2: float = 30.0, ridge: float = 2e-5, steps: int = 600) -> Model:
    """A model of at most ``vocabulary`` features, those surely and most associated with toxic documents, fitted on at most ``fit_rows``."""
    small_batches(docs.sparkSession)
    sample = written(labelled(docs, labels, fit_rows))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model()
    share, other = F.col("toxic") / bad, (F.col("clean") + 0.5) / (good + 1)
    pooled = (F.col("toxic") + F.col("clean")) / (bad + good)
    counts = feature_counts(sample).filter((F.col("toxic") >= least) & (share > lift * other))
    counts = counts.withColumn("chi2", (share - F.col("clean") / good) ** 2 / (pooled * (1 - pooled) * (1 / bad + 1 / good) + 1e-12)).filter(F.col("chi2") >= chi2)
    top = counts.orderBy(F.desc("chi2"), "feature").limit(vocabulary).collect()
    telling = {r["feature"] for r in top if r["toxic"] / bad > 10 * (r["clean"] + 0.5) / (good + 1)}
    model = Model({r["feature"]: k for k, r in enumerate(top)})
    shared = sample.sparkSession.sparkContext.broadcast((model.index, telling))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, telling = shared.value
        model = Model(index)
        for batch in sliced(batches, 256):
            keys, counts, tellings = [], [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                distinct = list(set(words))
                found = counted(words, dict(zip(distinct, model.indices(distinct))))
                told = {w for w in distinct if any(f in telling for f in features_of(w))}
                keys.append(list(found.keys()))
                counts.append(list(found.values()))
                tellings.append(float(sum(w in told for w in words)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(tellings, pa.float64()), batch.column(1)], ["keys", "counts", "told", "toxic"])

    fit = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "keys array<int>, counts array<int>, told double, toxic int").toPandas()  # at most fit_rows rows
    shared.destroy()
    discard(sample)
    fit = fit.sort_values(["toxic", "told"], kind="stable", ignore_index=True)
    toxic = fit["toxic"].to_numpy() == 1
    cuts = np.quantile(fit["told"][toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + np.searchsorted(cuts, fit["told"].to_numpy(), side="left"), 0)
    rows = np.repeat(np.arange(len(fit)), fit["keys"].map(len))
    flat = lambda column: np.concatenate([np.zeros(0, np.int64), *map(np.asarray, fit[column])]).astype(np.int64)
    model.weights, model.thresholds = cumulative_link(rows, flat("keys"), np.log1p(flat("counts")), grades, len(top), ridge, steps)
    return model


def scored(docs: DataFrame, model: Model, cut: float = 0.35, added: tuple[str, str, str] = ("severity", "p_toxic", "toxic")) -> DataFrame:
    """``docs`` with severity (the expected grade), p_toxic, and toxic (p_toxic at least ``cut``), under the names ``added``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.thresholds))  # plain values: executors may lack this package
    names = [c for c in docs.columns if c not in added]
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("toxicity")
        model, memo = Model(*shared.value), Memo(100_000)
        for batch in sliced(batches, 256):
            words = [words_of(t) for t in batch.column(place).to_pylist()]
            known = memo.fill({w for ws in words for w in ws}, model.indices)
            found = [model.above(counted(ws, known)) for ws in words]
            above = np.array(found).reshape(-1, GRADES - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= cut)], [*names, *added])

    given = docs.select(*names)
    return given.mapInArrow(run, schema_with(given, **dict(zip(added, (T.DoubleType(), T.DoubleType(), T.BooleanType())))))


def harmless_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the toxic ones."""
    names = docs.columns
    added = fresh(names, "_severity", "_p_toxic", "_toxic")
    return scored(docs, train(docs, labels, **options), added=added).filter(~F.col(added[-1])).select(*names)


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", "severity", "p_toxic", "toxic")
