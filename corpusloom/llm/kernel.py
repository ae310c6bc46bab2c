"""Vectorised hashing of words and characters over batches of texts.

All hashes are polynomial prefix sums modulo 2**64 (the base is odd, so it has an inverse), finished by a
64-bit mixer: equal runs get equal hashes wherever they stand, in any batch, process or run.
"""

from __future__ import annotations

import functools
import sys

import numpy as np

U = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # both odd
SEP = "\n"
MASK = (1 << 64) - 1


@functools.cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, U)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[base] = got
    return got[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class RunHash:
    """Hash of any run values[i:j] in constant time after one pass."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((values.astype(U) + U(1)) * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.back[i] + (j - i).astype(U))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, bounds): text t has words bounds[t]:bounds[t+1].

    Words are maximal runs of letters and digits (Unicode), in lower case. A null text has none."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    ends = np.cumsum(sizes)
    c = codes(SEP.join(low) + SEP)
    inside = np.zeros(len(c) + 1, np.int8)
    inside[:-1] = _alnum()[c]
    edge = np.diff(inside, prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = RunHash(c)(start, end) if len(start) else np.zeros(0, U)
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values; the caller drops those that cross a bound."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out += values[j : j + n] * U(pow(STEP, j, 1 << 64))
    return mix(out)


def gram_index(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of k values inside one text, its text)."""
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return first + np.arange(count.sum()), text


def batches(texts: list, limit: int = 1 << 20):
    """Slices of texts with about limit characters each, to stay in the processor's caches."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < limit):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
