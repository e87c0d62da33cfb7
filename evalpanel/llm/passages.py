"""Substring dedup by collinear chaining: passages that repeat across documents, fuzzy ones included.

1. Every document gives winnowed seeds: of each ``window`` consecutive k-mers of words the least hash, so any two documents that
   share ``window + k - 1`` words in a row share a seed there.
2. Occurrences of a seed are joined in a star: each is matched with the smallest document that holds the seed, so that a seed
   in n documents gives n - 1 matches. Of a seed that is common among the documents of a task, all occurrences but those of
   the smallest of these are matched with that one at once, before the shuffle.
3. The matches of a document with an earlier one are chained: a Fenwick tree over places in the earlier one finds the best
   predecessor of each match, by score less the gap.
4. Chains are aligned on the words: along their diagonals, between them by edit distance, and outwards from their ends.
5. Aligned pieces of a document that overlap or touch, whatever their sources, form a region. Regions of ``least`` words or
   more are repeats: every part of them stands in an earlier document.

Defined results: null and empty texts and texts of fewer than k words have no seeds; a null id takes no part; rows with one id
are one document; of equal texts the one with the smallest id is the source; an empty table gives no rows; extra columns are
ignored, and kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalpanel.llm.common import sliced, small_batches, table, worker_of, written
from evalpanel.llm.registry import query

K, WINDOW = 8, 8
LEAST = 50
#: A chain ends where either document goes on for so many words without a match.
MAX_GAP = 48
#: Shorter aligned pieces are chance.
PIECE = 20
IDENTITY = 0.8
TILE, PAD = 128, 24
#: Seeds that a task gathers before it looks for common ones, and occurrences that make a seed common among them.
GATHERED, COMMON = 1_000_000, 64
#: Seeds that leave a task at a time.
SENT = 65_536


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in turn, place of each text's first word and, last, the end)."""
    cut = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    bounds = np.cumsum([0, *map(len, cut)])
    return np.fromiter((crc32(w) for words in cut for w in words), np.uint32, bounds[-1]), bounds


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def seeds_of(words: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the k-mers that are least in some window of one text; ``words`` holds the texts in turn."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    each = mixed(words.astype(np.uint64) + np.uint64(1))
    kmers = each[:n].copy()
    for j in range(1, k):
        kmers *= np.uint64(0x100000001B3)
        kmers += each[j : j + n]
    kmers = mixed(kmers)
    none = np.uint64(2**64 - 1)
    for b in bounds[1:-1].tolist():  # k-mers across two texts
        kmers[max(b - k + 1, 0) : b] = none
    padded = np.concatenate([np.full(window - 1, none), kmers, np.full(window - 1, none)])
    lows = np.lib.stride_tricks.sliding_window_view(padded, window).min(1)
    chosen = np.zeros(len(padded), bool)
    for j in range(window):
        chosen[j : j + len(lows)] |= lows == padded[j : j + len(lows)]
    places = np.flatnonzero(chosen[window - 1 : window - 1 + n] & (kmers != none))
    return places, kmers[places]


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    change[:1] = True
    return np.flatnonzero(change)


def star(seed: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For occurrences sorted by seed, document and place: which are to be matched, and the document and place they match.

    The n-th occurrence in a document meets the n-th in the smallest document of the seed, or its last.
    """
    n, run_at = len(seed), starts(seed)
    size = np.diff(np.r_[run_at, n])
    ref = np.repeat(doc[run_at], size)
    source = doc == ref
    held = np.add.reduceat(source.astype(np.int64), run_at) if n else np.zeros(0, np.int64)
    group_at = starts(seed, doc)
    rank = np.arange(n) - np.repeat(group_at, np.diff(np.r_[group_at, n]))
    return ~source, ref, place[np.repeat(run_at, size) + np.minimum(rank, np.repeat(held, size) - 1)]


def seeds(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(seed, doc, place, ref, y) of ``docs`` (doc, text).

    A seed that occurs ``COMMON`` times in what a task has gathered is matched right there, with the smallest document among
    these, whose occurrences alone go on; so no seed sends more than a few rows of a task through the shuffle. Matches
    have y >= 0 and, instead of the seed, a hash of their document.
    """

    def closed(seed: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(seed, kind="stable")
        run_at = starts(seed[order])
        size = np.diff(np.r_[run_at, len(seed)])
        order = order[np.repeat(size >= COMMON, size)]
        order = order[np.lexsort((place[order], doc[order], seed[order]))]
        ref, y = np.zeros(len(seed), np.int64), np.full(len(seed), -1, np.int32)
        matched, refs, places = star(seed[order], doc[order], place[order])
        at = order[matched]
        ref[at], y[at] = refs[matched], places[matched]
        seed[at] = mixed(doc[at].astype(np.int64).view(np.uint64)).view(np.int64)
        for i in range(0, len(seed), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + SENT]) for c in (seed, doc, place, ref, y)], ["seed", "doc", "place", "ref", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("passages")
        held: tuple[list[np.ndarray], ...] = ([], [], [])
        size = 0

        def joined(column: list[np.ndarray]) -> np.ndarray:
            out = np.concatenate(column)
            column.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                words, bounds = word_hashes(part.column(1).to_pylist())
                places, found = seeds_of(words, bounds, k, window)
                row = np.searchsorted(bounds, places, side="right") - 1
                for column, more in zip(held, (found.view(np.int64), part.column(0).to_numpy()[row], (places - bounds[row]).astype(np.int32))):
                    column.append(more)
                size += len(found)
                if size >= GATHERED:
                    yield from closed(*map(joined, held))
                    size = 0
        if size:
            yield from closed(*map(joined, held))

    return docs.mapInArrow(run, "seed long, doc long, place int, ref long, y int")


def star_matches(found: DataFrame) -> DataFrame:
    """(doc, ref, x, y): each occurrence of a seed with one in the smallest document that holds it, and the matches made before.

    Occurrences stream past in order, so a seed of any number of documents needs the memory of one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]  # of the last seed, its smallest document
        last_doc, last_rank = None, -1
        for batch in batches:
            seed, doc, place, ref, y = (batch.column(c).to_numpy() for c in range(5))
            done = y >= 0
            yield pa.RecordBatch.from_arrays([pa.array(c[done]) for c in (doc, ref, place, y)], ["doc", "ref", "x", "y"])
            seed, doc, place = (c[~done] for c in (seed, doc, place))
            if not len(seed):
                continue
            before = kept if len(kept[0]) and kept[0][0] == seed[0] else [c[:0] for c in kept]
            fresh = len(before[0])
            # Ranks go on where a document was cut by the batch; its earlier occurrences stand in as empty rows.
            again = last_rank + 1 if fresh and doc[0] == last_doc and doc[0] != before[1][0] else 0
            rows = [np.concatenate([b, np.repeat(c[:1], again), c]) for b, c in zip(before, (seed, doc, place))]
            matched, refs, places = star(*rows)
            matched[: fresh + again] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[matched]) for c in (rows[1], refs, rows[2], places)], ["doc", "ref", "x", "y"])
            mine = (rows[0] == rows[0][-1]) & (rows[1] == refs[-1])
            kept = [c[mine] for c in rows]
            last_doc, last_rank = rows[1][-1], int(((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])).sum()) - 1

    return found.repartition("seed").sortWithinPartitions("seed", "doc", "place").mapInArrow(run, "doc long, ref long, x int, y int")


def chains_of(x: np.ndarray, y: np.ndarray, weight: float = 4.0, gap: float = 0.05) -> list[np.ndarray]:
    """Chains of matches, as indices in order; x ascends. A chain scores ``weight`` a match less ``gap`` a word passed over in both.

    The best predecessor of a match maximises score + gap * (x + y) among those with a smaller y, which is a prefix maximum
    in a Fenwick tree over y.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(1, np.int64)]
    rank = (np.unique(y, return_inverse=True)[1] + 1).tolist()
    along = (gap * (x.astype(np.float64) + y)).tolist()
    size = max(rank) + 1
    tree, owner = [-1e18] * size, [-1] * size
    score, parent = [0.0] * n, [-1] * n
    for i in range(n):
        at, best, who = rank[i] - 1, -1e18, -1
        while at:
            if tree[at] > best:
                best, who = tree[at], owner[at]
            at &= at - 1
        best -= along[i]
        if best > 0:
            score[i], parent[i] = weight + best, who
        else:
            score[i] = weight
        value, at = score[i] + along[i], rank[i]
        while at < size:
            if value > tree[at]:
                tree[at], owner[at] = value, i
            at += at & -at
    used, out = bytearray(n), []
    for i in sorted(range(n), key=score.__getitem__, reverse=True):
        if used[i]:
            continue
        links = []
        while i >= 0 and not used[i]:
            used[i] = 1
            links.append(i)
            i = parent[i]
        out.append(np.array(links[::-1]))
    return out


def segments_of(x: np.ndarray, y: np.ndarray, k: int, max_gap: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """A chain, cut at long gaps, as runs on one diagonal: starts in both documents and lengths in words."""
    dx, dy = np.diff(x), np.diff(y)
    for part in np.split(np.arange(len(x)), np.flatnonzero((dx > max_gap) | (dy > max_gap)) + 1):
        at = starts(y[part] - x[part])
        last = np.r_[at[1:], len(part)] - 1
        yield x[part][at].tolist(), y[part][at].tolist(), (x[part][last] - x[part][at] + k).tolist()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches again, cut so that rows with equal ``keys`` come in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            first = starts(*(batch.column(k).to_numpy() for k in keys))
            if len(first) == 1:
                held.append(batch)
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, first[1])])
            batch = batch.slice(first[1])
        elif held:
            yield pa.Table.from_batches(held)
        last = int(starts(*(batch.column(k).to_numpy() for k in keys))[-1])
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def chains(matches: DataFrame, k: int = K, max_gap: int = MAX_GAP, piece: int = PIECE) -> DataFrame:
    """(doc, ref, x0, x1, y0, y1, xs, ys, ns): chains that could grow to ``piece`` words, with their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["doc", "ref"]):
            doc, ref, xs, ys = (rows.column(c).to_numpy() for c in range(4))
            at = starts(doc, ref)
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(doc)]):
                for links in chains_of(xs[i:j], ys[i:j]):
                    for runs in segments_of(xs[i:j][links], ys[i:j][links], k, max_gap):
                        if runs[0][-1] + runs[2][-1] - runs[0][0] + 2 * (WINDOW - 1) >= piece:
                            for column, value in zip(out, (doc[i], ref[i], *runs)):
                                column.append(value)
            kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc", "ref", "xs", "ys", "ns"])

    found = matches.repartition("doc").sortWithinPartitions("doc", "ref", "x", "y").mapInArrow(run, "doc long, ref long, xs array<int>, ys array<int>, ns array<int>")
    last = lambda c: F.element_at(c, -1) + F.element_at("ns", -1)
    return found.select("doc", "ref", F.col("xs")[0].alias("x0"), last("xs").alias("x1"), F.col("ys")[0].alias("y0"), last("ys").alias("y1"), "xs", "ys", "ns")


def tiles(docs: DataFrame) -> DataFrame:
    """(key, tile, words): the words of each document as 16-bit hashes, ``TILE`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, bounds = word_hashes(part.column(1).to_pylist())
                raw = mixed(words.astype(np.uint64) + np.uint64(1)).astype(np.uint16)
                out: tuple[list, list, list] = ([], [], [])
                for key, i, j in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    for tile, p in enumerate(range(i, j, TILE)):
                        out[0].append(key)
                        out[1].append(tile)
                        out[2].append(raw[p : min(p + TILE, j)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary()))], ["key", "tile", "words"])

    return docs.mapInArrow(run, "key long, tile int, words binary")


def edit_matches(a: np.ndarray, b: np.ndarray) -> int:
    """The most words that two short stretches have in common, in order."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        new = np.maximum(row[1:], row[:-1] + (b == w))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def outwards(same: np.ndarray) -> int:
    """How far an end moves along its diagonal: to the best score of matches less twice the mismatches."""
    if not len(same):
        return 0
    score = np.cumsum(np.where(same, 1, -2))
    dead = np.flatnonzero(score < np.maximum.accumulate(np.maximum(score, 0)) - 5)
    score = score[: dead[0]] if len(dead) else score
    return int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0


def aligned(runs: tuple[list[int], list[int], list[int]], left: tuple[int, np.ndarray], right: tuple[int, np.ndarray]) -> tuple[int, int, int, int, float]:
    """(start, end, source start, source end, identity) of a chain, given words of both documents from some place on."""
    (ox, X), (oy, Y) = left, right
    matches, ex, ey, first = 0, None, None, None
    for x, y, n in zip(*runs):
        if ex is not None:
            skip = max(ex - x, ey - y, 0)
            x, y, n = x + skip, y + skip, n - skip
            if n <= 0:
                continue
            matches += edit_matches(X[ex - ox : x - ox], Y[ey - oy : y - oy])
        else:
            first = x, y
        matches += int((X[x - ox : x - ox + n] == Y[y - oy : y - oy + n]).sum())
        ex, ey = x + n, y + n
    x, y = first
    back = min(x - ox, y - oy, PAD)
    back = outwards((X[x - ox - back : x - ox] == Y[y - oy - back : y - oy])[::-1])
    ahead = min(len(X) - (ex - ox), len(Y) - (ey - oy), PAD)
    ahead = outwards(X[ex - ox : ex - ox + ahead] == Y[ey - oy : ey - oy + ahead])
    matches += int((X[x - back - ox : x - ox] == Y[y - back - oy : y - oy]).sum()) + int((X[ex - ox : ex - ox + ahead] == Y[ey - oy : ey - oy + ahead]).sum())
    x, y, ex, ey = x - back, y - back, ex + ahead, ey + ahead
    return x, ex, y, ey, matches / max(ex - x, ey - y)


def regions(pieces: list[tuple], least: int) -> Iterator[tuple]:
    """(region start, region end, *piece) of the pieces in regions of ``least`` words or more; a piece begins with start, end."""
    group: list[tuple] = []
    end = -1
    for piece in [*sorted(pieces), (1 << 60, 1 << 60)]:
        if group and piece[0] > end:
            if end - group[0][0] >= least:
                for p in group:
                    yield group[0][0], end, *p
            group, end = [], -1
        group.append(piece)
        end = max(end, piece[1])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, least: int = LEAST, identity: float = IDENTITY, piece: int = PIECE) -> DataFrame:
    """(doc_id, region_start, region_end, start, end, source_id, source_start, source_end, identity), places in words.

    One row per aligned piece of a region; the words from region_start to region_end repeat earlier documents.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc IS NOT NULL")
    found = written(chains(star_matches(seeds(given, k, window)), k, MAX_GAP, piece))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(F.col(low) - PAD, F.lit(0)) / TILE).cast("int"), F.floor((F.col(high) + PAD) / TILE).cast("int"))).alias("tile")
    sides = [found.select(F.col(key).alias("key"), span(low, high), "doc", "ref", "x0", "y0", F.lit(side).alias("side")) for side, (key, low, high) in enumerate((("doc", "x0", "x1"), ("ref", "y0", "y1")))]
    fetched = sides[0].union(sides[1]).join(tiles(given), ["key", "tile"]).select("doc", "ref", "x0", "y0", "side", "tile", "words", *[F.lit(None).cast("array<int>").alias(c) for c in ("xs", "ys", "ns")])
    heads = found.select("doc", "ref", "x0", "y0", F.lit(-1).alias("side"), F.lit(0).alias("tile"), F.lit(None).cast("binary").alias("words"), "xs", "ys", "ns")
    together = heads.union(fetched).repartition("doc").sortWithinPartitions("doc", "ref", "x0", "y0", "side", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["doc"]):
            doc, ref, x0, y0, side, tile = (rows.column(c).to_numpy() for c in range(6))
            words, runs = rows.column(6).combine_chunks(), [rows.column(c).combine_chunks() for c in (7, 8, 9)]
            at = starts(doc, ref, x0, y0)
            pieces: dict[int, list[tuple]] = {}
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(doc)]):
                texts: list[dict[int, bytes]] = [{}, {}]
                for r in range(i + 1, j):
                    if side[r] >= 0:
                        texts[side[r]][int(tile[r])] = words[r].as_py()
                both = [(min(t) * TILE, np.frombuffer(b"".join(t[p] for p in sorted(t)), np.uint16)) for t in texts]
                got = aligned(tuple(c[i].as_py() for c in runs), *both)
                if got[4] >= identity and got[1] - got[0] >= piece:
                    pieces.setdefault(int(doc[i]), []).append((got[0], got[1], int(ref[i]), *got[2:]))
            out = [(d, *p) for d, ps in pieces.items() for p in regions(ps, least)]
            names = ("doc_id", "region_start", "region_end", "start", "end", "source_id", "source_start", "source_end", "identity")
            kinds = [*[pa.int64()] * 8, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], list(names))

    return together.mapInArrow(
        run, "doc_id long, region_start long, region_end long, start long, end long, source_id long, source_start long, source_end long, identity double"
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and the white space behind them."""
    raw = text.encode("utf-8", "surrogatepass")
    ends, at = [0], 0
    for word in raw.split():
        at = raw.index(word, at)
        ends.append(at)
        at += len(word)
    ends = [*ends[1:], len(raw)]
    kept, last = [], 0
    for start, end in sorted(spans):
        kept.append(raw[last : ends[start]])
        last = ends[end]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated regions cut out of their texts (and ``n_chars`` brought up to date); texts left empty by that go."""
    found = repeats(docs, id_col, text_col, **options)
    spans = found.groupBy(F.col("doc_id").alias("_cut_id")).agg(F.collect_set(F.struct("region_start", "region_end")).alias("_cut"))
    joined = docs.join(spans, docs[id_col] == spans["_cut_id"], "left").drop("_cut_id")
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, cuts = batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()
            new = [t if not c or t is None else cut_words(t, [(s["region_start"], s["region_end"]) for s in c]) for t, c in zip(texts, cuts)]
            keep = pa.array([not c or bool((t or "").strip()) for t, c in zip(new, cuts)])
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(new, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    out = joined.select(*names, "_cut").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast("long")).select(*names) if "n_chars" in names else out


@query("op6_passages")
def op6(spark, sf_dir):
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
