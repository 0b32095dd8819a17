"""Hashed character n-grams of words, for many words at once, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a letter and the letters and marks that follow it.
WORD = r"\p{L}[\p{L}\p{M}]*"
_FIRST, _LAST = "\x02", "\x03"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # a fixed odd multiplier: 2^64 over the golden ratio


def word_finder():
    find = regex.compile(WORD).findall
    return lambda text: find(text.lower())


def grams(words: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of each n-gram of each word; a word's ends count as characters."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = _FIRST + (_LAST + _FIRST).join(words) + _LAST
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(points))
    owner, hashes = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(orders) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolled = (rolled[:size] + points[n - 1 :] + np.uint64(1)) * _MULTIPLIER
        rolled ^= rolled >> np.uint64(29)
        if n in orders:
            inside = at[:size] + n <= ends[:size]
            owner.append(of[:size][inside])
            hashes.append((rolled[inside] * _MULTIPLIER >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(owner), np.concatenate(hashes)


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """All distinct rows if there are at most ``bound`` rows, else about ``bound`` of the distinct ones by a hash of ``key`` and text.

    Rows that are equal in all columns count once, so no key, however often it is repeated, brings in more than its texts.
    """
    n = rows.count()
    if n <= bound:
        return rows.distinct()
    share = int(bound / n * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.col("text"), F.lit("sample")), F.lit(1 << 30)) < share).distinct()
