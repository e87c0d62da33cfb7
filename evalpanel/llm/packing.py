"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Defined results: a null or empty text is the end token alone; every row is packed, repeated ids and rows included, each on its
own; ties in length go by id, piece and start, so a recomputed task gives the same places; an empty table gives no rows;
extra columns are ignored by ``pieces`` and kept by ``place``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.llm.common import Memo, per_worker, schema_with, table, written
from evalpanel.llm.registry import query

#: Words whose tokens one worker remembers, in each half of its memo.
REMEMBERED = 400_000
#: Pieces packed together by one task; the tasks grow in number with the input, not in size.
SHARD = 100_000


class WordTokens:
    """Token ids by a tokenizer that drops white space, so that words between spaces are tokenised one by one, and once.

    Unknown words are tokenised many to a text, with a sign between them that none of them holds and that is one token of its own.
    """

    SIGN = "|"

    def __init__(self, spec: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.memo = Memo(REMEMBERED)
        self.folds = '"Lowercase"' in spec.decode().partition('"pre_tokenizer"')[0]  # then capitals of ASCII make no difference
        alone = self._ids([self.SIGN])[0]
        self.sign = alone[0] if len(alone) == 1 else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        plain = [k for k, w in enumerate(words) if self.sign is not None and self.SIGN not in w]
        found: list[bytes] = [b""] * len(words)
        groups = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        for group, ids in zip(groups, self._ids([f" {self.SIGN} ".join([words[k] for k in group]) for group in groups])):
            ends = np.flatnonzero(ids == self.sign).tolist() + [len(ids)]
            raw, start = ids.tobytes(), 0
            for k, end in zip(group, ends, strict=True):
                found[k] = raw[4 * start : 4 * end]
                start = end + 1
        other = sorted(set(range(len(words))) - set(plain))
        for k, ids in zip(other, self._ids([words[k] for k in other])):
            found[k] = ids.tobytes()
        return found

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; the words of all texts are looked up as one array."""
        plain = pc.replace_substring(texts.fill_null(""), "\n", " ")
        lists = pc.split_pattern(pc.ascii_lower(plain) if self.folds else plain, " ")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.memo.fill(distinct, self._encode)
        parts = [known[w] for w in distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, begins = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        after = np.append(0, np.cumsum(each))
        every = pool[np.repeat(begins[codes] - after[:-1], each) + np.arange(after[-1])]
        cuts = after[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [every[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def by_size(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // most, append=-1)) + 1 if len(sizes) else []
    at = 0
    for end in ends:
        yield batch.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the tokens of each document and ``end_id``, cut only where longer than ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit integers. ``tokenizer`` is the path of a tokenizer file on the driver; its
    text, a fixed vocabulary, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = shared.value
        words = per_worker("packing", zlib.crc32(spec), lambda: WordTokens(spec))
        for batch in batches:
            for part in by_size(batch, 1):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for key, found in zip(part.column(0).to_pylist(), words.ids(part.column(1))):
                    found += end
                    for k, start in enumerate(range(0, len(found), 4 * capacity)):
                        ids = found[start : start + 4 * capacity]
                        for column, value in zip(rows, (key, k, start // 4, len(ids) // 4, ids)):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "piece", "start", "length", "ids"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, given longest first: the open bin with the least room that suffices, or a new one.

    The leaves of a segment tree are the capacities from 0 to ``capacity``; an inner node tells whether a bin with such room
    is open. Finding the tightest one climbs until a subtree to the right has any and descends to its leftmost leaf.
    """
    width = 1 << (capacity + 1).bit_length()
    count = [0] * (2 * width)  # open bins below each node
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = [], [], 0
    for length in lengths:
        node = width + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < width:
                    node = 2 * node if count[2 * node] else 2 * node + 1
        if node > 1:
            room = node - width
            at = rooms[room].pop()
            while node:
                count[node] -= 1
                node >>= 1
        else:
            room, at, opened = capacity, opened, opened + 1
        bins.append(at)
        offsets.append(capacity - room)
        room -= length
        if room:
            rooms[room].append(at)
            node = width + room
            while node:
                count[node] += 1
                node >>= 1
    return bins, offsets


def place(found: DataFrame, capacity: int = 4096, shard: int = SHARD) -> DataFrame:
    """``found`` with sequence_id and offset: pieces dealt evenly to as many tasks as they need, each packed by best fit.

    The tightest bin is sought among those of a task; with ``shard`` pieces a task, what the last bins of the tasks
    leave open is a small share. Full pieces are sequences already and are not dealt out.
    """
    stored = written(found)
    names = stored.columns
    short = stored.filter(F.col("length") < capacity)
    tasks = max(1, -(-short.count() // shard))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)  # about ``shard`` rows of numbers
        if not held:
            return
        mine = pd.concat(held, ignore_index=True)
        mine = mine.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit(mine["length"].tolist(), capacity)
        yield mine.assign(sequence_id=(np.int64(TaskContext.get().partitionId()) << 32) + np.array(bins, np.int64), offset=np.array(offsets, np.int64))[[*names, "sequence_id", "offset"]]

    packed = short.repartition(tasks).mapInPandas(run, schema_with(stored, sequence_id=T.LongType(), offset=T.LongType()))
    full = stored.filter(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(full)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): each packed sequence, at most one capacity long; needs ``ids`` among the columns."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, **columns) -> DataFrame:
    """The pieces of ``docs`` with their ids and places."""
    return place(pieces(docs, tokenizer, capacity, end_id, **columns), capacity)


def packed_digest(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """The places of all pieces, with a checksum instead of the ids, so that these need not be stored."""
    return place(pieces(docs, tokenizer, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


@query("op5_packing")
def op5(spark, sf_dir):
    import public_tokenizers

    return packed_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
