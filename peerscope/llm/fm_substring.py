"""Substring deduplication on words with a compressed FM-index for each shard.

A shard's index holds the contested stretches (see ``repeats``): the Burrows-Wheeler transform of their
words in a wavelet matrix of packed bits with block ranks. Documents' windows are streamed through it by
backward search, all of them a word at a time. A window's match is followed while it has another
occurrence; one that loses it has a matching statistic below the threshold. What is left after the
threshold's words is an interval of all equal windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Rule, without_repeats

WINDOW = 20


class Bits:
    """A packed bit vector with the number of ones before each 64-bit block."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.r_[bits, np.zeros(-n % 64 + 64, bool)], bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first i bits."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        n = np.arange(1 << bits)
        self.start = np.zeros(1 << bits, np.int64)  # where a symbol's stretch begins below the last level
        x = symbols
        for level in range(bits - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            b = Bits(bit)
            zeros = int(len(x) - bit.sum())
            one = (n >> level & 1).astype(bool)
            ones = b.ones(self.start)
            self.start = np.where(one, zeros + ones, self.start - ones)
            self.levels.append((level, b))
            self.zeros.append(zeros)
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i."""
        for (level, b), zeros in zip(self.levels, self.zeros, strict=True):
            ones = b.ones(i)
            i = np.where((symbol >> level & 1).astype(bool), zeros + ones, i - ones)
        return i - self.start[symbol]


class FmIndex:
    """Index of a text over symbols 0 .. sigma - 1 for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n, rank, reach = len(text), text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while reach < depth:  # suffixes sorted by twice as many symbols each time, to the depth at least
            ahead = np.zeros(n, np.int64)
            ahead[:max(0, n - reach)] = rank[reach:] + 1
            key = rank * (n + sigma + 2) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            reach *= 2
        self.matrix = WaveletMatrix(text[order - 1], max(1, int(sigma - 1).bit_length()))
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.n = n

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol`` before what the intervals [low, high) stand for."""
        base = self.below[symbol]
        return base + self.matrix.rank(symbol, low), base + self.matrix.rank(symbol, high)


def match_groups(words: np.ndarray, begin: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for each window words[at : at + width], the same for equal ones; -1 for one without an equal."""
    out = np.full(len(at), -1, np.int64)
    if not len(at):
        return out
    names, symbol = np.unique(words, return_inverse=True)
    # a separator, smaller than every word, ends each stretch
    length = np.diff(np.r_[begin, len(words)])
    shift = np.repeat(np.arange(len(begin)), length)
    text = np.zeros(len(words) + len(begin), np.int64)
    text[np.arange(len(words)) + shift] = symbol + 1
    index = FmIndex(text, len(names) + 1, width)
    live = np.arange(len(at))
    place = at + shift[at]
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n)
    for step in range(width):
        low, high = index.extend(text[place[live] + width - 1 - step], low, high)
        more = high - low > 1
        live, low, high = live[more], low[more], high[more]
        if not live.size:
            break
    out[live] = low
    return out


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier.

    Earlier is in a smaller id, or before in the same document. Words are separated by ASCII white space
    and compared as they are. Returns id, n_words, n_removed, n_spans and kept (the other words, joined
    by a space), a row for each input row. Null and empty texts have no words. Null ids count as smaller
    than all others; in rows with one id the same place is not earlier. An empty table gives an empty
    result. A task holds a slice of some MB, or one longer text.
    """
    rows = without_repeats(docs, Rule(True, window, min(8, window), True, 8 << 20), match_groups, id_col, text_col)
    return rows.select(id_col, F.col("n").alias("n_words"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept"))
