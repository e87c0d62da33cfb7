"""Random numbers as pure functions of (seed, keys): reproducible for any partitioning or retry."""

from __future__ import annotations

import hashlib
import math
from typing import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, keys: Sequence[Column | str], hasher: str = "xx") -> Column:
    """A uniform number in [0, 1) per key tuple.

    ``xx`` is a code-generated 64-bit hash; ``md5`` is slower and can be recomputed by any SQL engine.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    if hasher == "xx":
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") * F.lit(2.0**-53)
    if hasher == "md5":
        text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
        digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
        return digits.cast("double") / F.lit(2.0**52)
    raise ValueError(f"unknown hasher {hasher!r}")


def poisson_steps(upper: int = 18) -> list[float]:
    """Cumulative probabilities of a Poisson(1) variable at 0..upper."""
    steps, total, term = [], 0.0, math.exp(-1.0)
    for k in range(upper + 1):
        total += term
        steps.append(total)
        term /= k + 1
    return [s for s in steps if s < 1.0]


def poisson_weight(u: Column) -> Column:
    """Poisson(1) weight by inverting the distribution function at ``u``."""
    weight = F.lit(len(poisson_steps())).cast("bigint")
    for k, step in reversed(list(enumerate(poisson_steps()))):
        weight = F.when(u < F.lit(step), F.lit(k).cast("bigint")).otherwise(weight)
    return weight


# The primes of the 64-bit hash.
_P1, _P2, _P3, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x27D4EB2F165667C5),
)


def continue_hash(base: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The uniform number of ``uniform(seed, [..., key])`` for an int ``key``, given the hash of the rest.

    Lets a task compute many weights of one row without sending the row many times.
    """
    with np.errstate(over="ignore"):
        h = base.view(np.uint64) + (_P5 + np.uint64(4))
        h = h ^ (key.astype(np.uint64) * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: Texts hashed at a time, so that all arrays stay in a core's cache.
_AT_ONCE = 1 << 13


def _md5_start(words: list[np.ndarray | int]) -> np.ndarray:
    """The first 8 bytes, as a big-endian number, of the MD5 of messages of one padded block: 16 words, each an array or one number for all."""
    size = next(len(w) for w in words if not isinstance(w, int))
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(size, x, np.uint32) for x in start)
    f, high = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        part = i // 16
        if part == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif part == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif part == 2:  # b ^ c ^ d
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[part] % 16]
        f += a
        if isinstance(word, int):
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_SINES[i])
        turn = int(_TURNS[part, i % 4])
        np.right_shift(f, np.uint32(32 - turn), out=high)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, high, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b = a + np.uint32(start[0]), b + np.uint32(start[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap().astype(np.uint64)


def md5_uniform(heads: Sequence[str], numbers: np.ndarray) -> np.ndarray:
    """The numbers of ``uniform(.., "md5")`` for the texts head + number, heads x numbers; many texts are hashed by each array operation."""
    out = np.empty((len(heads), len(numbers)))
    raw = [h.encode() for h in heads]
    tails = np.array([str(x).encode() for x in numbers.tolist()])
    long = np.char.str_len(tails) if len(tails) else np.zeros(0, int)
    lengths = np.array([len(h) for h in raw])
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        head = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), n)
        for m in np.unique(long).tolist():
            columns = np.flatnonzero(long == m)
            if n + m > 55:  # more than one block
                for i in rows:
                    out[i, columns] = [int(hashlib.md5(raw[i] + tails[j]).hexdigest()[:13], 16) / 2.0**52 for j in columns]
                continue
            tail = np.frombuffer(b"".join(tails[columns].tolist()), np.uint8).reshape(len(columns), m)
            wide = min(len(columns), _AT_ONCE)
            deep = max(1, _AT_ONCE // wide)
            for top in range(0, len(rows), deep):
                for left in range(0, len(columns), wide):
                    h, t = head[top : top + deep], tail[left : left + wide]
                    text = np.zeros((len(h), len(t), 4 * ((n + m) // 4 + 1)), np.uint8)
                    text[:, :, :n], text[:, :, n : n + m], text[:, :, n + m] = h[:, None], t[None], 0x80
                    words: list = list(np.ascontiguousarray(text.view("<u4").reshape(len(h) * len(t), -1).T))
                    words += [0] * (14 - len(words)) + [8 * (n + m), 0]
                    first = _md5_start(words) >> np.uint64(12)
                    out[np.ix_(rows[top : top + deep], columns[left : left + wide])] = first.reshape(len(h), len(t)) / 2.0**52
    return out
