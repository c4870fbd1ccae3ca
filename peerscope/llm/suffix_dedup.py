"""Substring deduplication with suffixes sorted only through the threshold.

The suffixes of the contested stretches (see ``repeats``) are ordered by most-significant-digit passes
of eight bytes, never beyond the 50th byte. A pass splits each group by its next digit, and what is alone
in its group leaves the sort; the groups left after the last pass are exactly the repeated windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Rule, without_repeats

WINDOW = 50
DIGIT = 8


def radix_groups(data: np.ndarray, begin: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for each window data[at : at + width], the same for equal ones; -1 for one without an equal."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    live, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, width, DIGIT):
        wide = np.ndarray(len(data), ">u8", padded, 0, (1,))
        digit = wide[at[live] + depth].astype(np.uint64) >> np.uint64(8 * max(0, DIGIT - (width - depth)))
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])] if len(live) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        more = np.bincount(number, minlength=1)[number] > 1
        live, group = live[more], number[more]
    out = np.full(len(at), -1, np.int64)
    out[live] = group
    return out


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts in a document with a smaller id.

    Returns id, n (UTF-8 bytes), n_removed, n_spans (maximal runs removed) and kept (binary: the other
    bytes, which need not be whole characters), a row for each input row. Null and empty texts have no
    bytes. Null ids count as smaller than all others; rows with one id never remove from each other. An
    empty table gives an empty result. A task holds a slice of a few MB, or one longer text; one of more
    than 2**28 bytes raises an error.
    """
    return without_repeats(docs, Rule(False, window, min(20, window), False, 3 << 20), radix_groups, id_col, text_col)
