"""Byte-pair vocabularies in the tokenizers library's JSON format, and the exact merge of one word."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex

# White space of the patterns below (Unicode's White_Space property).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class Unassigned(Exception):
    """A code point that this Python's Unicode tables don't know; the library's own splitter decides."""


@dataclass(frozen=True)
class Vocabulary:
    path: str
    ids: dict[str, int]
    merges: dict[tuple[str, str], int]
    specials: dict[str, int]
    suffix: str

    def special_pattern(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(sorted(map(regex.escape, self.specials), key=len, reverse=True)) + ")")


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    merges = {tuple(m if isinstance(m, list) else m.split(" ")): rank for rank, m in enumerate(model["merges"])}
    specials = {t["content"]: t["id"] for t in data["added_tokens"]}
    return Vocabulary(path, model["vocab"], merges, specials, model.get("end_of_word_suffix") or "")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself where printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def letters(word: str) -> str:
    table = byte_letters()
    return "".join([table[b] for b in word.encode()])


def has_unassigned(word: str) -> bool:
    return not word.isprintable() and any(unicodedata.category(c) == "Cn" for c in set(word))


def heap_merge(symbols: list, merges: dict[tuple[str, str], int]) -> int:
    """Merge the lowest-rank adjacent pair again and again (the leftmost of equals); the number of merges.

    ``symbols`` is changed in place: a symbol taken up by its left neighbour becomes None. Neighbours
    are a linked list, so a word of n symbols takes O(n log n) however long it is.
    """
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank, i, i + 1) for i in range(n - 1) if (rank := merges.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    done = 0
    while heap:
        rank, i, j = heappop(heap)
        left, right = symbols[i], symbols[j]
        if left is None or right is None or after[i] != j or merges.get((left, right)) != rank:
            continue
        symbols[i], symbols[j] = left + right, None
        done += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := merges.get((symbols[i], symbols[k]))) is not None:
                heappush(heap, (r, i, k))
        if (h := before[i]) >= 0 and (r := merges.get((symbols[h], symbols[i]))) is not None:
            heappush(heap, (r, h, i))
    return done


def short_merge(symbols: list[str], merges: dict[tuple[str, str], int]) -> None:
    """What ``heap_merge`` does, for a word of few symbols: the ranks of all pairs are a list of their own."""
    none = len(merges)
    ranks = [merges.get(p, none) for p in zip(symbols, symbols[1:])]  # noqa: B905
    while ranks and (low := min(ranks)) < none:
        i = ranks.index(low)
        symbols[i] += symbols.pop(i + 1)
        del ranks[i]
        if i:
            ranks[i - 1] = merges.get((symbols[i - 1], symbols[i]), none)
        if i < len(ranks):
            ranks[i] = merges.get((symbols[i], symbols[i + 1]), none)
