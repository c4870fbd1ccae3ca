"""BPE encoding and decoding: speculate by longest match, verify every adjacent pair, merge only what fails.

A list of tokens is what byte-pair merging makes of a word exactly if each token is what merging makes
of its own letters and each adjacent pair is compatible: no merge across the border would have come
before the merges that built its two sides. So the longest matches of all new words are proposed
together by walking a trie, all their borders are tested together, and the words with a bad border are
merged exactly, together too: each round merges every word's best pair.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from .bpe_vocab import SPACE, byte_letters, has_unassigned, heap_merge, load
from .common import each_text
from .piece_codec import PairTable, gathered

WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
BREAKS = regex.compile(rf"[{SPACE}]+")
# str.split() also breaks at these four, which are no white space to the tokenizer.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
LONG = 256  # letters of a word that is merged alone
SYMBOLS = 512  # a byte, or 256 and a byte where it ends a word
NO_MERGE = np.iinfo(np.int64).max


class Places(dict):
    """Numbers of the stretches met, in the order of meeting them."""

    def __missing__(self, stretch: str | tuple[str]) -> int:
        at = self[stretch] = len(self)
        return at


class Codec:
    """Encoder and decoder of one vocabulary whose words end in a suffix. ``merged``: words merged exactly so far."""

    BOUND = 400_000

    def __init__(self, path: str):
        self.vocab = v = load(path)
        self.size = max([*v.ids.values(), *v.specials.values()]) + 1
        self.tokens: list[str] = [""] * self.size
        for table in (v.ids, v.specials):
            for token, i in table.items():
                self.tokens[i] = token
        self.special = v.special_pattern() if v.specials else None
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        pairs = []
        for (a, b), rank in v.merges.items():
            x, y, z = v.ids[a], v.ids[b], v.ids[a + b]
            pairs.append((x * self.size + y, rank, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = rank, x, y
        keys, self.pair_rank, self.made = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.pairs = PairTable(keys)
        self.symbol = np.array([v.ids[c + end] for end in ("", v.suffix) for c in byte_letters()], np.int64)
        self.trie, self.child, self.token = self._trie(self._usable())
        self.seen = Places()  # a special token's stretch is a tuple
        self.starts, self.counts, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, "<u4")
        self.merged = 0

    def _usable(self) -> dict[str, int]:
        """Tokens that merging makes of their own letters."""
        ids = np.array(sorted(self.vocab.ids.values()), np.int64)
        made = ids[self.rank[ids] >= 0]
        good = np.zeros(self.size, bool)
        good[self.symbol] = True
        inside = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in np.argsort(self.rank[made], kind="stable"):  # parts before wholes
            z = made[i]
            good[z] = inside[i] and good[self.left[z]] and good[self.right[z]]
        return {t: i for t, i in self.vocab.ids.items() if good[i]}

    def _trie(self, tokens: dict[str, int]) -> tuple[PairTable, np.ndarray, np.ndarray]:
        """Edges (node and symbol), the node each leads to, and the token that ends at a node (-1: none). Node 0 is the root."""
        code, suffix = {c: i for i, c in enumerate(byte_letters())}, self.vocab.suffix
        edges: dict[int, int] = {}
        token = [-1]
        for t, i in tokens.items():
            body = t.removesuffix(suffix) if suffix else t
            symbols = [code[c] for c in body]
            if body != t:
                symbols[-1] += 256
            node = 0
            for x in symbols:
                node = edges.setdefault(node * SYMBOLS + x, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        return PairTable(np.array([*edges], np.int64)), np.array([*edges.values()], np.int64), np.array(token, np.int64)

    def compatible(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the border of each pair of tokens survives merging (all merges, or those of a rank below ``before``).

        Takes the two sides apart, the later merge first. While it stood open, the two symbols at the
        border were neighbours; a merge of theirs with a lower rank would have closed it. Of two merges
        with equal rank the left one comes first.
        """
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), NO_MERGE) if before is None else before.copy()
        ok, live = np.ones(len(left), bool), np.arange(len(left))
        while live.size:
            a, b = left[live], right[live]
            there, at = self.pairs.find(a * self.size + b)
            bad = there & (self.pair_rank[at] < limit[live])
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            left[live] = np.where(later, self.right[a], a)
            right[live] = np.where(later, b, self.left[b])
            limit[live] = np.where(later, ra, rb + 1)
        return ok

    def longest(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words from the left, in order: where each begins, and the token."""
        at, start, stop, end = first, first, last, first
        node, best = np.zeros(len(first), np.int64), np.full(len(first), -1)
        starts, tokens = [], []
        while at.size:  # a letter of every word at a time
            there, edge = self.trie.find(node * SYMBOLS + codes[at])
            node = np.where(there, self.child[edge], 0)
            at = at + there
            token = self.token[node]
            hit = token >= 0
            best, end = np.where(hit, token, best), np.where(hit, at, end)
            shut = ~there | (at == stop)
            starts.append(start[shut])
            tokens.append(best[shut])
            at, start, node = np.where(shut, end, at), np.where(shut, end, start), np.where(shut, 0, node)
            go = start < stop
            if not go.all():
                at, start, stop, end, node, best = at[go], start[go], stop[go], end[go], node[go], best[go]
        starts, tokens = np.concatenate(starts), np.concatenate(tokens)
        order = np.argsort(starts, kind="stable")
        return starts[order], tokens[order]

    def merged_together(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge in each word (neighbours with equal ``word``) the leftmost pair of lowest rank, again and again.

        Returns the tokens left and their words, in order.
        """
        place = np.arange(len(symbols))
        key, made = np.full(len(symbols), NO_MERGE), np.zeros(len(symbols), np.int64)

        def look(i: np.ndarray) -> None:
            there, at = self.pairs.find(symbols[i] * self.size + symbols[i + 1])
            key[i] = np.where(there, (self.pair_rank[at] << 32) + place[i], NO_MERGE)
            made[i] = self.made[at]

        look(np.flatnonzero(word[1:] == word[:-1]))
        done = []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(symbols)])
            lowest = np.minimum.reduceat(key, first)
            live = lowest < NO_MERGE
            if not live.all():
                go = np.repeat(live, size)
                done.append((place[~go], symbols[~go], word[~go]))
                place, symbols, word, key, made = place[go], symbols[go], word[go], key[go], made[go]
                lowest = lowest[live]
            at = np.searchsorted(place, lowest & 0xFFFFFFFF)
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # where they lie when the gaps are closed
            place, symbols, word, key, made = place[keep], symbols[keep], word[keep], key[keep], made[keep]
            key[at] = NO_MERGE
            near = np.r_[at[at + 1 < len(symbols)], at[at > 0] - 1]
            look(near[word[near] == word[near + 1]])
        place, symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return symbols[order], word[order]

    def alone(self, codes: np.ndarray) -> list[int]:
        """Tokens of one long word: rounds over all its letters would cost too much."""
        table, suffix = byte_letters(), self.vocab.suffix
        symbols = [table[c % 256] + (suffix if c >= 256 else "") for c in codes.tolist()]
        heap_merge(symbols, self.vocab.merges)
        return [self.vocab.ids[s] for s in symbols if s is not None]

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words (without white space), one after the other, and how many each has."""
        raw = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        ends = np.flatnonzero(raw == 10)
        codes = raw.astype(np.int64)
        codes[ends - 1] += 256
        return np.delete(codes, ends), np.diff(np.r_[-1, ends]) - 1

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left."""
        codes, n = self.letters([word])
        return self.longest(codes, np.zeros(1, np.int64), n)[1].tolist()

    def exact(self, word: str) -> list[int]:
        codes, n = self.letters([word])
        return self.merged_together(self.symbol[codes], np.zeros(n[0], np.int64))[0].tolist()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has: proposed together, verified together, what fails merged together."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        codes, n = self.letters(words)
        ends = np.cumsum(n)
        short = np.flatnonzero(n <= LONG)
        starts, flat = self.longest(codes, ends[short] - n[short], ends[short])
        word = np.searchsorted(ends, starts, side="right")
        inner = np.flatnonzero(word[1:] == word[:-1])
        bad = np.zeros(len(words), bool)
        bad[word[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        parts = [(flat, word)]
        if bad.any():
            self.merged += int(bad.sum())
            fail, good = np.flatnonzero(bad), ~bad[word]
            parts = [(flat[good], word[good]),
                     self.merged_together(self.symbol[codes[gathered(ends[fail] - n[fail], n[fail])]], np.repeat(fail, n[fail]))]
        for w in np.flatnonzero(n > LONG).tolist():
            self.merged += 1
            ids = np.array(self.alone(codes[ends[w] - n[w]:ends[w]]), np.int64)
            parts.append((ids, np.full(len(ids), w)))
        flat, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        return flat[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=len(words))

    def learn(self, stretches: list) -> None:
        """Encode new stretches, all at once: where the ids of each begin and how many it has (-1: the library has to split it)."""
        owner, of, at, size = [], {}, [], np.full(len(stretches), -1)
        for i, c in enumerate(stretches):
            if isinstance(c, tuple):
                size[i] = 1
                continue
            if c.isascii() and c.isalpha():
                words = (c,)
            elif c.isascii() and c[:-1].isalpha():
                words = c[:-1], c[-1]
            elif has_unassigned(c):
                continue
            else:
                words = WORDS.findall(c)
            size[i] = 0
            owner += [i] * len(words)
            at += [of.setdefault(w, len(of)) for w in words]
        flat, n = self.encode_words([*of])
        at = np.array(at, np.int64)
        size += np.bincount(owner, n[at], len(stretches)).astype(np.int64)
        flat = flat[gathered((np.cumsum(n) - n)[at], n[at])]
        here = np.maximum(size, 0)
        starts = np.cumsum(here) - here
        special = [i for i, c in enumerate(stretches) if isinstance(c, tuple)]
        if special:
            made = np.zeros(int(here.sum()), "<u4")
            plain = np.ones(len(made), bool)
            plain[starts[special]] = False
            made[plain], made[~plain] = flat, [self.vocab.specials[stretches[i][0]] for i in special]
            flat = made
        self.starts = np.r_[self.starts, len(self.flat) + starts]
        self.flat, self.counts = np.r_[self.flat, flat], np.r_[self.counts, size]

    def forget(self) -> None:
        """A full memory keeps what was met in more than one batch, if that is not too much."""
        kept = np.flatnonzero((self.uses > 1) & (self.counts >= 0))
        if len(kept) > self.BOUND // 2:
            kept = kept[:0]
        names = [*self.seen]
        self.seen = Places(zip((names[i] for i in kept.tolist()), range(len(kept)), strict=True))
        counts = self.counts[kept]
        self.flat = self.flat[gathered(self.starts[kept], counts)]
        self.starts, self.counts, self.uses = np.cumsum(counts) - counts, counts, np.zeros(len(kept), np.int64)

    def known(self, stretches: list) -> np.ndarray:
        """The number of each stretch, new ones encoded."""
        if len(self.seen) > self.BOUND:
            self.forget()
        before = len(self.seen)
        at = np.fromiter(map(self.seen.__getitem__, stretches), np.int64, len(stretches))
        if len(self.seen) > before:
            self.learn([*islice(self.seen, before, None)])
            self.uses = np.r_[self.uses, np.zeros(len(self.seen) - before, np.int64)]
        met = np.zeros(len(self.seen), bool)
        met[at] = True
        self.uses += met
        return at

    @staticmethod
    def plain(text: str) -> str:
        """The text as the vocabulary has it. No letter's form depends on white space beside it."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _split(self, text: str) -> list[str]:
        return [c for c in BREAKS.split(text) if c] if any(c in text for c in NOT_SPACE) else text.split()

    def _by_library(self, text: str) -> np.ndarray:
        """A text with code points unknown here: the library splits, the rest is the same."""
        normal, pieces = splitter(self.vocab.path)
        byte = {c: i for i, c in enumerate(byte_letters())}
        words = [bytes(byte[c] for c in w).decode() for w, _ in pieces.pre_tokenize_str(normal.normalize_str(text))]
        return self.encode_words(words)[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (unsigned 32-bit), one after the other, and how many each has."""
        known = self.vocab.specials
        cut = [self.special.split(t) if self.special is not None and any(s in t for s in known) else [t] for t in texts]
        pieces = [*chain.from_iterable(cut)]
        split = [[(p,)] if p in known else self._split(self.plain(p)) for p in pieces]
        at = self.known([*chain.from_iterable(split)])
        counts = self.counts[at]
        piece = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, split), np.int64, len(split)))
        odd = np.unique(piece[counts < 0])
        plain = ~np.isin(piece, odd)
        ids = self.flat[gathered(self.starts[at[plain]], counts[plain])]
        n = np.bincount(piece[plain], counts[plain], len(pieces)).astype(np.int64)
        if len(odd):
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in odd.tolist():
                parts[i] = self._by_library(pieces[i])
                n[i] = len(parts[i])
            ids = np.concatenate(parts)
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        return ids, np.bincount(text, n, len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_all(texts)
        data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]  # noqa: B905

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, special ones too (the file names no other decoder)."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def splitter(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t.normalizer, t.pre_tokenizer


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded (the text that the ids give).

    ``path``: a BPE file with word ends of the tokenizers library, readable on every executor. One row
    for each input row, repeated ones too; a null or empty text has no ids and decodes to an empty text;
    a null id stays null. Nothing is shuffled; a worker remembers stretches it has met, up to a bound.
    An empty table gives an empty result.
    """

    def work(texts: list[str]) -> list:
        c = codec(path)
        ids = c.encode(texts)
        return [[len(x) // 4 for x in ids], ids, [c.decode(x) for x in ids]]

    return each_text(docs, [("n_tokens", "bigint"), ("ids", "binary"), ("decoded", "string")], work, id_col, text_col)
