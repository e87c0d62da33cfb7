"""Ranked lexical search by hybrid term-at-a-time, document-at-a-time evaluation.

The documents are read twice. First their terms are counted: one row per document holds the query terms in it (numbers, with
occurrences) and its length. Then every task walks its documents in blocks and evaluates every item on each: the contributions of
short posting lists are summed term at a time into one list of accumulators, which is from then on one more list with a known
greatest score; this list and the long ones are walked document at a time in runs of documents. Lists whose greatest scores
together cannot reach the tenth score so far propose no documents; they are only looked up, by binary search, for documents
that may still reach it. A task keeps its best documents of every item from block to block; a window over the items merges tasks.

The terms of the items are broadcast if they are at most ``BOUND``; more items are searched in as many rounds as that takes.

Defined results: a null text has no terms; documents without terms count neither for N nor as results; an item whose text is null or has no
known terms has no rows; rows with equal doc_ids are documents of their own, rows with equal item_ids are items of their own
whose ranks each start at 1; ties go to the smaller doc_id (null first); empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.llm.common import discard, per_worker, sliced, table, written
from evalpanel.llm.registry import query

#: Terms of items held by one round, and so by one broadcast: some 30 bytes each.
BOUND = 1_000_000
#: Documents evaluated together, documents in a run of the walk, and the share of a block up to which a list is short.
BLOCK, RUN, SHORT = 16_384, 2048, 1 / 32
#: Bytes that stand between terms become spaces, A-Z become a-z; bytes of other characters than ASCII stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERMS).split() if text else []


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term): the distinct terms of every item; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch]):
                found = [list(dict.fromkeys(terms_of(t))) for t in part.column(2).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(x) for x in found])
                flat = pa.array([t.decode() for x in found for t in x], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), flat], ["item", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "item long, item_id long, term string")


def counted(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): documents with terms, their length, and the numbers and occurrences of those in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast("\n".join(vocabulary).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = shared.value
        known = per_worker("search", "terms", lambda: {t: k for k, t in enumerate(blob.split(b"\n"))}, zlib.crc32(blob))
        for part in sliced(batches):
            rows: tuple[list, ...] = ([], [], [], [])
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = terms_of(text)
                if words:
                    tf = Counter(words)
                    here = [t for t in tf if t in known]
                    for column, value in zip(rows, (key, len(words), np.array([known[t] for t in here], np.int32), np.array([tf[t] for t in here], np.int32))):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(postings: DataFrame) -> DataFrame:
    """(term, w, n_docs, n_terms): the weight of every term that a document holds, and N and L."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            here = np.bincount(batch.column(0).flatten().to_numpy())
            if len(here) > len(df):
                here, df = df, here
            df[: len(here)] += here
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["term", "df"])

    parts = postings.select("terms").mapInArrow(run, "term int, df long")
    totals = postings.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"))
    ratio = (2 * F.col("n_docs") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    found = parts.groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(totals))  # one row
    return found.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w"), "n_docs", "n_terms")


class Lists:
    """The posting lists of one block: documents in order, and what each adds to a score."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int):
        doc = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        order = np.argsort(terms, kind="stable")
        terms, self.docs, tf = terms[order], doc[order], tfs[order].astype(np.int64)
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        self.adds = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs]))
        self.names, at = np.unique(terms, return_index=True)
        self.starts = np.append(at, len(terms))
        self.most = np.maximum.reduceat(self.adds, at) if len(at) else np.zeros(0, np.int64)
        self.n_docs = len(n)

    def of(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(documents, additions, greatest addition) of every wanted term in the block, the shortest list first."""
        at = np.searchsorted(self.names, wanted)
        at = at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == wanted)] if len(self.names) else at[:0]
        at = at[np.argsort(self.starts[at + 1] - self.starts[at], kind="stable")]
        return [(self.docs[a:b], self.adds[a:b], int(m)) for a, b, m in zip(self.starts[at], self.starts[at + 1], self.most[at]) if m > 0]


def accumulated(lists: list[tuple], n_docs: int, short: float = SHORT) -> list[tuple]:
    """The short lists summed into one, before the long ones."""
    few = [x for x in lists if len(x[0]) <= short * n_docs]
    if len(few) < 2:
        return lists
    docs, place = np.unique(np.concatenate([d for d, _, _ in few]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, place, np.concatenate([a for _, a, _ in few]))
    return [(docs, sums, int(sums.max())), *lists[len(few) :]]


def best(lists: list[tuple], n_docs: int, top: int, floor: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all that may be among the ``top`` with scores of ``floor`` or more, ties included, by document.

    Lists are held by falling greatest addition. The last ones whose greatest additions sum to less than the bar propose nothing.
    """
    lists = sorted(lists, key=lambda x: -x[2])
    rest = np.append(np.cumsum([m for _, _, m in lists][::-1])[::-1], 0)  # what the lists from here on can add
    bar, kept_docs, kept_scores = max(floor, 1), np.zeros(0, np.int32), np.zeros(0, np.int64)
    at, since = 0, []
    ends = [0] * len(lists)
    while at < n_docs:
        to = min(at + run, n_docs)
        proposing = int(np.searchsorted(-rest, -bar, side="right"))  # the first lists, up to the one from which the rest stays below the bar
        if proposing == 0:
            break
        live = [(k, np.searchsorted(lists[k][0], at), np.searchsorted(lists[k][0], to)) for k in range(min(proposing, len(lists)))]
        filled = [x for x in live if x[2] > x[1]]
        if not filled:  # skip to the next document that a proposing list holds
            nexts = [lists[k][0][a] for k, a, _ in live if a < len(lists[k][0])]
            if not nexts:
                break
            at = int(min(nexts))
            continue
        sums = np.zeros(to - at, np.int64)
        for k, a, b in filled:
            sums[lists[k][0][a:b] - at] += lists[k][1][a:b]
        docs = np.flatnonzero(sums + rest[min(proposing, len(lists))] >= bar)
        docs = docs[sums[docs] > 0]
        scores, docs = sums[docs], docs.astype(np.int32) + np.int32(at)
        for k in range(proposing, len(lists)):
            if not len(docs):
                break
            where = np.searchsorted(lists[k][0], docs)
            there = np.minimum(where, len(lists[k][0]) - 1)
            scores = scores + np.where(lists[k][0][there] == docs, lists[k][1][there], 0)
            able = scores + rest[k + 1] >= bar
            docs, scores = docs[able], scores[able]
        able = scores >= bar
        if able.any():
            kept_docs, kept_scores = np.concatenate([kept_docs, docs[able]]), np.concatenate([kept_scores, scores[able]])
            if len(kept_scores) >= top:
                bar = max(bar, int(np.partition(kept_scores, len(kept_scores) - top)[len(kept_scores) - top]))
                able = kept_scores >= bar
                kept_docs, kept_scores = kept_docs[able], kept_scores[able]
        at = to
    return kept_docs, kept_scores


def ranked(postings: DataFrame, items: list[tuple[int, int | None, np.ndarray]], w: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best ``top`` of each task for every item (number, id, terms)."""
    shared = postings.sparkSession.sparkContext.broadcast((items, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        nothing = np.zeros(0, np.int64)
        held = [(nothing, nothing, nothing)] * len(items)  # id, is there an id, score
        for part in sliced(batches, BLOCK):
            ids = part.column(0)
            there, ids = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            terms, tfs = part.column(2), part.column(3).flatten().to_numpy()
            lists = Lists(part.column(1).to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tfs, w, n_docs, n_terms)
            for k, (_, _, wanted) in enumerate(items):
                _, _, scores = old = held[k]
                found = accumulated(lists.of(wanted), len(ids))
                if not found:
                    continue
                docs, new = best(found, len(ids), top, int(scores[-1]) if len(scores) == top else 0)
                if len(docs):
                    merged = [np.concatenate(x) for x in zip(old, (ids[docs], there[docs], new))]
                    order = np.lexsort((merged[0], merged[1], -merged[2]))[:top]
                    held[k] = tuple(x[order] for x in merged)
        size = [len(s) for _, _, s in held]
        if not sum(size):
            return
        ids, there, scores = (np.concatenate(x) for x in zip(*held))
        at = np.repeat(np.arange(len(items)), size)
        heads = [pa.array([items[k][0] for k in at], pa.int64()), pa.array([items[k][1] for k in at], pa.int64())]
        yield pa.RecordBatch.from_arrays([*heads, pa.array(ids, pa.int64(), mask=there == 0), pa.array(scores, pa.int64())], ["item", "item_id", "doc_id", "score"])

    return postings.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search_round(docs: DataFrame, pairs: pa.Table, top: int, **columns: str) -> DataFrame:
    """``ranked`` for the items of ``pairs``, whose rows have been counted and are few."""
    vocabulary, numbers = np.unique(np.array(pairs.column("term").to_pylist(), object), return_inverse=True)
    postings = written(counted(docs, vocabulary.tolist(), **columns))
    found = weights(postings).toArrow()  # a row for each term of ``vocabulary`` at most
    w = np.zeros(len(vocabulary), np.int64)
    w[found.column("term").to_numpy()] = found.column("w").to_numpy()
    n_docs, n_terms = (found.column(c)[0].as_py() if found.num_rows else 1 for c in ("n_docs", "n_terms"))
    item, item_id = pairs.column("item").to_numpy(), pairs.column("item_id").to_pylist()
    order = np.argsort(item, kind="stable")
    cuts = np.flatnonzero(np.diff(item[order])) + 1
    items = [(int(item[rows[0]]), item_id[rows[0]], numbers[rows].astype(np.int32)) for rows in np.split(order, cuts)]
    return ranked(postings, items, w, n_docs, n_terms, top)


def search(docs: DataFrame, items: DataFrame, top: int = 10, bound: int = BOUND, item_columns: dict[str, str] | None = None, **columns: str) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with scores above zero, best first."""
    spark = docs.sparkSession
    pairs = written(item_terms(items, **(item_columns or {})))
    count = pairs.count()
    rounds = max(1, -(-count // bound))
    turn = F.pmod(F.xxhash64("item"), F.lit(rounds))
    parts = (pairs.filter(turn == r).toArrow() for r in range(rounds))  # one at a time
    found = [search_round(docs, part, top, **columns) for part in parts if part.num_rows]
    discard(pairs)
    every = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for one in found:
        every = one if one is found[0] else every.unionAll(one)
    by_item = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return every.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT doc_id, len(words) AS n, words FROM t WHERE len(words) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM q JOIN f USING (term), c),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN p USING (term), c GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query("op12_ranked_search", SQL)
def op12(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
