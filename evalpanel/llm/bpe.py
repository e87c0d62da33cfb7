"""Byte-level BPE: exact encoding in linear time by backtracking over longest matches, and decoding.

Defined results: null and empty texts encode to no tokens and decode to no bytes; every row is kept, repeated ids included;
lone surrogates cannot occur in Spark strings; extra columns pass through unless they clash with the output names.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalpanel.llm.common import Memo, per_worker, schema_with, table
from evalpanel.llm.registry import query

#: Words whose tokens one worker remembers, in each half of its memo.
REMEMBERED = 250_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The lines of a ranks file: base64 of the token, its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


#: White space beside a space, by any notion of white space.
BESIDE = re.compile(r"[\s\x1c-\x1f\x85] | [\s\x1c-\x1f\x85]")


class Encoder:
    """Encodes the matches of a pattern by ranks: at each step the adjacent pair of lowest rank is merged.

    A token sequence is the result of these merges exactly if each adjacent pair of its tokens is: were the two encoded
    together, the boundary between them would stay. So a search keeps the longest token that fits its predecessor and,
    at a dead end, steps back to a shorter one; a position from which it once stepped back is never entered again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        halves = {rank: self._last_merge(token) for token, rank in ranks.items()}
        size = max(ranks.values()) + 1
        self.left_of = [halves.get(r, (None, None))[0] for r in range(size)]
        self.right_of = [halves.get(r, (None, None))[1] for r in range(size)]
        self.search = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.left_of[rank] is not None:
                self.search.add_word(token.decode("latin-1"), rank)
        self.reachable = {token: rank for token, rank in ranks.items() if self.left_of[rank] is not None}
        self.longest = max(map(len, ranks))
        self.fits: dict[int, bool] = {}
        self.words, self.pieces = Memo(REMEMBERED), Memo(REMEMBERED // 2)

    def _last_merge(self, token: bytes) -> tuple[int | None, int | None]:
        """The two tokens whose merge makes ``token``; itself for a byte; Nones if its bytes do not merge to it."""
        rank = self.ranks[token]
        if len(token) == 1:
            return rank, rank
        parts = [bytes([b]) for b in token]
        ranks = self.ranks
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= rank:
                return None, None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the boundary between two adjacent tokens survives the merges.

        Undoes merges at the boundary, latest first. If two tokens that once stood beside each other could have been
        merged before the merges undone so far happened, the boundary would have gone.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        tokens, merged, left_of, right_of = self.tokens, self.ranks.get, self.left_of, self.right_of
        a, b, limit = left, right, 1 << 60
        while True:
            both = merged(tokens[a] + tokens[b])
            if both is not None and both < limit:
                fits = False
                break
            if a > b:  # the later merge is undone; a left one came before a right one of the same rank
                limit, a = a, right_of[a]
                if a != limit:
                    continue
                limit, b = b + 1, left_of[b]
                if b + 1 == limit:
                    fits = True
                    break
            else:
                limit, b = b + 1, left_of[b]
                if b + 1 != limit:
                    continue
                limit, a = a, right_of[a]
                if a == limit:
                    fits = True
                    break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def piece(self, raw: bytes) -> list[int]:
        """The tokens of one match."""
        whole = self.reachable.get(raw)
        if whole is not None:
            return [whole]
        n, fits, compatible = len(raw), self.fits.get, self.compatible
        prefix, rank_of, longest = self.search.longest_prefix, self.reachable.get, self.longest
        text = raw.decode("latin-1")
        out: list[int] = []
        stack: list[tuple[int, int]] = []  # for each token, its place and the length to try next if it is given up
        dead = bytearray(n + 1)
        at, size, last = 0, prefix(text[:longest]), -1
        while at < n:
            while size:
                rank = rank_of(raw[at : at + size])
                if rank is not None and not dead[at + size]:
                    if last < 0:
                        break
                    fit = fits(last << 32 | rank)
                    if compatible(last, rank) if fit is None else fit:
                        break
                size -= 1
            if size:
                out.append(rank)
                stack.append((at, size - 1))
                last = rank
                at += size
                if at < n:
                    size = prefix(text[at : at + longest])
            else:
                dead[at] = 1
                out.pop()
                at, size = stack.pop()
                last = out[-1] if out else -1
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers; the matches of all texts are encoded once."""
        found = [self.pattern.findall(text) for text in texts]
        known = self.pieces.fill({m for matches in found for m in matches}, lambda new: [array("i", self.piece(m.encode())).tobytes() for m in new])
        return [b"".join(map(known.__getitem__, matches)) for matches in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text as 32-bit integers.

        A single space between two characters that are not white space always begins a match, so a text is cut there and
        words, with the space before them, are encoded once. Other texts are encoded whole.
        """
        heads, tails = [], []
        for text in texts:
            if not text:
                heads.append("")
                tails.append([])
            elif text[0] == " " or text[-1] == " " or BESIDE.search(text):
                heads.append(text)
                tails.append([])
            else:
                head, *tail = text.split(" ")
                heads.append(head)
                tails.append(tail)
        whole = self.encode_all(heads)
        known = self.words.fill({w for tail in tails for w in tail}, lambda new: self.encode_all([" " + w for w in new]))
        return [head + b"".join(map(known.__getitem__, tail)) for head, tail in zip(whole, tails)]


def _encoder(raw: bytes, pattern: str) -> Encoder:
    return per_worker("bpe", (zlib.crc32(raw), pattern), lambda: Encoder(read_ranks(raw), pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>) in place of ``text_col``: the token ids of each whole text.

    ``vocabulary`` is the path of a ranks file on the driver; its bytes, a fixed vocabulary, are broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    given = docs.select(*rest, F.col(text_col).alias(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = coder.encode(part.column(len(rest)).to_pylist())
                offsets = np.cumsum([0, *map(len, flat)]) // 4
                values = pa.array(np.frombuffer(b"".join(flat), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], ids], [*rest, ids_col])

    return given.mapInArrow(run, schema_with(given.select(*rest), **{ids_col: T.ArrayType(T.IntegerType())}))


def _token_bytes(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    ranks = read_ranks(raw)
    of = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        of[rank] = token
    return of, np.array([len(token) for token in of], np.int64)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``out_col`` (binary): the bytes that the ids of each row stand for; null ids give no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    names = [c for c in tokens.columns if c != out_col]
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        of, lengths = per_worker("bpe", zlib.crc32(raw), lambda: _token_bytes(raw))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(place).fill_null([])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lengths[flat])])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
                data = pa.py_buffer(b"".join(map(of.__getitem__, flat.tolist())))
                out = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*names, out_col])

    given = tokens.select(*names)
    return given.mapInArrow(run, schema_with(given, **{out_col: T.BinaryType()}))


@query("op10_bpe")
def op10(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return decode(tokens, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
