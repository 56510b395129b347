"""Words of whole texts as 64-bit hashes, and hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .workers import memo

#: An odd multiplier (of the 64-bit golden ratio) for hashes of runs, and those of the finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words remembered by one Python worker; beyond it the memo starts anew.
MEMO_WORDS = 250_000


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()
memo("words", WORDS.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (len(words) - k + 1 of them), by doubling of the run length:
    H(a + b)[i] = H(a)[i] * BASE**b + H(b)[i + a]."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, length = None, 0
    power, span = words, 1  # hashes of runs of `span` words
    factor = BASE
    with np.errstate(over="ignore"):
        while True:
            if k & span:
                out = power if out is None else out[: len(words) - length - span + 1] * factor + power[length : length + len(words) - length - span + 1]
                length += span
            if length == k:
                return mix(out[:n] + np.uint64(k))
            m = len(power) - span
            power = power[:m] * factor + power[span : span + m]
            span *= 2
            factor = factor * factor


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return); null: none."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()
