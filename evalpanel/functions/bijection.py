"""Keyed permutations of 0..n-1: any place can be asked for on its own, so nothing is sorted, listed or shuffled.

A place is written as (l, r) with l < a and r < b, where a and b are about the root of n. Steps add to l a number that
depends on r and the key, then to r one that depends on l, each modulo its radix; every step can be undone, so together they
permute the a x b places. A place beyond n goes through the steps again until it is below n, which permutes 0..n-1.

The keys are hexadecimal digits of an MD5 sum and the steps plain 64-bit arithmetic, so any SQL engine can repeat them.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Steps of one pass, and the prime under which numbers are squared.
STEPS, PRIME = 12, (1 << 31) - 1


def step_keys(seed: int, label: object, rep: int) -> np.ndarray:
    """STEPS x 2 keys of a replicate; ``label`` tells apart what is permuted separately, such as strata."""
    sums = [hashlib.md5(f"{seed}:{label}:{rep}:{s}".encode()).hexdigest() for s in range(STEPS)]
    return np.array([[int(h[:7], 16), int(h[7:14], 16)] for h in sums], dtype=np.int64)


def radices(n: int) -> tuple[int, int]:
    """The smallest a with a * a >= n, and the smallest b with a * b >= n."""
    a = int(np.ceil(np.sqrt(n)))
    while a * a < n:
        a += 1
    while a > 1 and (a - 1) * (a - 1) >= n:
        a -= 1
    return a, -(-n // a)


def _mixed(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    once = (x + first) ** 2 % PRIME
    return (once + second) ** 2 % PRIME


def permuted(places: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """places x replicates: where each permutation, given by its ``step_keys``, sends each place below ``n``."""
    a, b = radices(n)
    out = np.repeat(np.asarray(places, dtype=np.int64), len(keys))
    rep = np.tile(np.arange(len(keys)), len(places))
    todo = np.arange(out.size)
    while todo.size:
        left, right, own = out[todo] // b, out[todo] % b, rep[todo]
        for s in range(STEPS):
            if s % 2 == 0:
                left = (left + _mixed(right, keys[own, s, 0], keys[own, s, 1])) % a
            else:
                right = (right + _mixed(left, keys[own, s, 0], keys[own, s, 1])) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out.reshape(len(places), len(keys))


def all_step_keys(seed: int, label: object, reps: int) -> np.ndarray:
    """Replicates 1 to ``reps``: 192 bytes each."""
    return np.array([step_keys(seed, label, rep) for rep in range(1, reps + 1)])
