"""Token counts by heap-and-linked-list byte-pair merging, without making any identifier.

A word's count is its number of bytes less the merges done on it. Words repeat, so a worker remembers
the counts of those it has met, up to a bound; nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .bpe_vocab import SPACE, Unassigned, has_unassigned, heap_merge, letters, load
from .common import each_text

PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SPACES_MEET = re.compile(r" \s|^\s")


class Counter(dict):
    """Tokens of a space and the characters that follow it up to the next space."""

    BOUND = 500_000

    def __init__(self, path: str):
        super().__init__()
        self.vocab = load(path)
        self.special = self.vocab.special_pattern() if self.vocab.specials else None

    def __missing__(self, rest: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[rest] = self.plain(" " + rest)
        return value

    def word(self, word: str) -> int:
        symbols = list(letters(word))
        return len(symbols) - heap_merge(symbols, self.vocab.merges)

    def plain(self, text: str) -> int:
        if has_unassigned(text):
            raise Unassigned
        return sum(map(self.word, PIECES.findall(text)))

    def without_specials(self, text: str) -> int:
        """Splits at spaces: each space followed by another character starts a piece, so the counts add up."""
        try:
            if SPACES_MEET.search(text):
                return self.plain(text)
            first, *rest = text.split(" ")
            return (self.plain(first) if first else 0) + sum(map(self.__getitem__, rest))
        except Unassigned:
            pieces = splitter(self.vocab.path).pre_tokenize_str(text)
            return sum(self.word(text[a:b]) for _, (a, b) in pieces)

    def text(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.vocab.specials):
            return self.without_specials(text) if text else 0
        return sum(1 if s in self.vocab.specials else self.without_specials(s) for s in self.special.split(text) if s)


@lru_cache(maxsize=2)
def splitter(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path``: a byte-level BPE file of the tokenizers library, readable on every executor. One row for
    each input row, repeated ones too; a null or empty text has 0 bytes and 0 tokens; a null id stays
    null. Special strings inside a text are one token each. A text that is one very long word is merged
    in O(n log n). An empty table gives an empty result.
    """

    def work(texts: list[str]) -> list:
        of = counter(path)
        n = [of.text(t) for t in texts]
        return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

    return each_text(docs, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")], work, id_col, text_col)
