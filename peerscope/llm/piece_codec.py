"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The characters of all new words lie in one flat array of symbols. A round finds each word's lowest pair
rank by a segmented minimum, merges its leftmost occurrences in all words at the same time, closes the
gaps and looks up only the pairs that changed. Words without a pair left leave the arrays.

All occurrences of a word's lowest rank may be merged in one round only if no pair with the new piece
has that rank or a lower one; for the other ranks a round merges the leftmost occurrence alone. So a
round does what popping the best pair again and again does.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_vocab
from .bpe_vocab import heap_merge
from .common import SLICE_BYTES, arrow_schema, slices, small_batches, texts_of

MARK = "▁"  # stands for a space in pieces
NONE = np.iinfo(np.int32).max
CODES = 0x110000
LONG = 256
WORDS = 200_000


class Ranks:
    """Rank of a pair by the piece it makes, as ``heap_merge`` asks for it."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def get(self, pair: tuple[str, str]) -> int | None:
        return self.ranks.get(pair[0] + pair[1])


class PairTable:
    """Values of integer keys: an array of slots, the next free one where two keys meet."""

    BITS = 19

    def __init__(self, keys: np.ndarray):
        while len(keys) * 4 > 1 << self.BITS:
            self.BITS += 1
        self.slots = np.full(1 << self.BITS, -1, np.int64)
        self.where = np.zeros(1 << self.BITS, np.int32)
        for i, (k, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.slots[at], self.where[at] = k, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their rows."""
        at = self._slot(keys)
        met = self.slots[at]
        go = np.flatnonzero((met != keys) & (met >= 0))
        while go.size:
            at[go] = (at[go] + 1) & ((1 << self.BITS) - 1)
            met[go] = self.slots[at[go]]
            go = go[(met[go] != keys[go]) & (met[go] >= 0)]
        return met == keys, self.where[at]


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + count), one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class PieceCodec:
    """Encoder and decoder of one model. ``merged_alone``: long stretches merged with a heap so far."""

    BOUND = 400_000

    def __init__(self, path: str):
        p = piece_vocab.load(path)
        self.size = len(p.texts)
        self.dummy = MARK if p.dummy_prefix else ""
        self.wide = self.size + CODES  # a character without a piece is symbol size + code
        ids = {t: i for i, (t, k) in enumerate(zip(p.texts, p.kinds, strict=True)) if k == piece_vocab.NORMAL}
        order = {s: r for r, s in enumerate(sorted({p.scores[i] for i in ids.values()}, reverse=True))}
        rank = {t: order[p.scores[i]] for t, i in ids.items() if len(t) > 1}
        self.ranks = Ranks(rank)
        self.ids = ids
        symbol = lambda t: ids[t] if t in ids else self.size + ord(t) if len(t) == 1 else None
        pairs = sorted((a * self.wide + b, r, ids[t]) for t, r in rank.items() for k in range(1, len(t))
                       if (a := symbol(t[:k])) is not None and (b := symbol(t[k:])) is not None)
        keys, ranks, self.made = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.table, self.pair_rank = PairTable(keys), ranks.astype(np.int32)
        own = np.full(self.wide, -1, np.int32)
        for t, r in rank.items():
            own[ids[t]] = r
        parts = np.r_[keys // self.wide, keys % self.wide]
        early = np.tile(self.pair_rank, 2) <= own[parts]
        self.alone = np.zeros(len(order), bool)  # ranks of which only the leftmost occurrence may be merged
        self.alone[own[parts[early]]] = True
        self.of_code = np.arange(self.size, self.wide, dtype=np.int64)
        for t, i in ids.items():
            if len(t) == 1:
                self.of_code[ord(t)] = i
        met = {c: i for i, c in enumerate(sorted({c for t in rank for c in t}), 1)}
        self.letter = np.zeros(CODES, np.int32)
        self.letter[[ord(c) for c in met]] = [*met.values()]
        self.inside = np.zeros((len(met) + 1, len(met) + 1), bool)  # letters that stand side by side in a piece
        for t in rank:
            for a, b in zip(t, t[1:]):  # noqa: B905
                self.inside[met[a], met[b]] = True
        lone = re.escape("".join(c for c in map(chr, range(128)) if c not in met))
        whole = any(MARK in t.lstrip(MARK) for t in rank)  # a piece goes on after a space: words can't be cut
        self.word = re.compile(r"(?s).+" if whole else f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+|[{lone}]")
        byte = np.zeros(256, np.int64)
        self.bytes: list[bytes] = []
        self.space = MARK.encode()
        for i, (t, k) in enumerate(zip(p.texts, p.kinds, strict=True)):
            if k == piece_vocab.BYTE:
                byte[int(t[1:-1], 16)] = i
                self.bytes.append(bytes([int(t[1:-1], 16)]))
            else:
                self.bytes.append({piece_vocab.CONTROL: b"", piece_vocab.UNKNOWN: " ⁇ ".encode()}.get(k, t.encode()))
        self.byte = byte
        self.merged_alone = 0
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.starts = self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no piece) and the piece it makes."""
        there, at = self.table.find(left * self.wide + right)
        return np.where(there, self.pair_rank[at], NONE), self.made[at]

    def merge_rounds(self, symbols: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge within stretches that begin where ``opens``; the symbols left and where each begins, in order."""
        place = np.arange(len(symbols))
        stretch = np.cumsum(opens)
        done_place, done_symbols = [], []
        rank = np.full(len(symbols), NONE, np.int32)
        made = np.zeros(len(symbols), np.int64)
        near = np.flatnonzero(stretch[1:] == stretch[:-1])
        rank[near], made[near] = self._pairs(symbols[near], symbols[near + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbols)])
            live = lowest < NONE
            if not live.all():
                go = np.repeat(live, size)
                done_place.append(place[~go])
                done_symbols.append(symbols[~go])
                place, symbols, stretch, rank, made = place[go], symbols[go], stretch[go], rank[go], made[go]
                if not len(symbols):
                    break
                lowest, size = lowest[live], size[live]
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            leftmost = np.r_[True, stretch[at[1:]] != stretch[at[:-1]]]
            opened = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])  # of overlapping pairs every second one goes
            turn = np.arange(len(at)) - np.repeat(opened, np.diff(np.r_[opened, len(at)]))
            at = at[leftmost | ((turn % 2 == 0) & ~self.alone[rank[at]])]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # where the merged symbols lie when the gaps are closed
            place, symbols, stretch, rank, made = place[keep], symbols[keep], stretch[keep], rank[keep], made[keep]
            rank[new] = NONE
            touched = np.zeros(len(symbols), bool)
            touched[new] = True
            touched[new[new > 0] - 1] = True
            changed = np.flatnonzero(touched[:-1] & (stretch[1:] == stretch[:-1]))
            rank[changed], made[changed] = self._pairs(symbols[changed], symbols[changed + 1])
        place, symbols = np.concatenate(done_place), np.concatenate(done_symbols)
        order = np.argsort(place, kind="stable")
        return place[order], symbols[order]

    def _by_heap(self, text: str) -> list[int]:
        """Symbols of one long stretch: rounds over all its symbols would cost too much."""
        self.merged_alone += 1
        left = list(text)
        heap_merge(left, self.ranks)
        return [self.ids[s] if s in self.ids else self.size + ord(s) for s in left if s is not None]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has."""
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        opens = np.zeros(len(codes), bool)
        opens[np.r_[0, ends[:-1]]] = True
        letter = self.letter[codes]
        opens[1:] |= ~self.inside[letter[:-1], letter[1:]]  # no piece goes on here
        symbols = self.of_code[codes]
        first = np.flatnonzero(opens)
        size = np.diff(np.r_[first, len(codes)])
        long = size > LONG
        keep = np.repeat(~long, size)
        origin = np.flatnonzero(keep)
        place, left = self.merge_rounds(symbols[origin], opens[origin]) if len(origin) else (origin, origin)
        place = origin[place]
        for a, n in zip(first[long].tolist(), size[long].tolist(), strict=True):
            alone = np.array(self._by_heap(text[a:a + n]), np.int64)
            place, left = np.r_[place, np.full(len(alone), a)], np.r_[left, alone]
        if long.any():
            order = np.argsort(place, kind="stable")
            place, left = place[order], left[order]
        unknown = left >= self.size
        n = np.ones(len(left), np.int64)
        if unknown.any():
            code = left[unknown] - self.size
            n[unknown] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            ids = np.repeat(left, n)
            ids[np.repeat(unknown, n)] = self.byte[raw]
        else:
            ids = left
        word = np.searchsorted(ends, place, side="right")
        return ids.astype(np.int32), np.bincount(word, n, len(words)).astype(np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode the words not met before, all at once; a full memory is emptied first."""
        if len(self.seen) > self.BOUND:
            self._forget()
        new = list(dict.fromkeys(filterfalse(self.seen.__contains__, words)))
        if not new:
            return
        ids, counts = self.encode_words(new)
        at = len(self.seen)
        self.seen.update(zip(new, range(at, at + len(new)), strict=True))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(counts) - counts]
        self.counts = np.r_[self.counts, counts]
        self.flat = np.r_[self.flat, ids]

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.learn(words)
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        counts = self.counts[at]
        return self.flat[gathered(self.starts[at], counts)], counts

    def marked(self, text: str) -> str:
        return self.dummy + text.replace(" ", MARK) if text else ""

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. Words of very long texts come in batches."""
        if sum(map(len, texts)) <= SLICE_BYTES:
            words = [self.word.findall(self.marked(t)) for t in texts]
            of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), np.int64, len(words)))
            ids, counts = self._known(list(chain.from_iterable(words)))
            return ids, np.bincount(of, counts, len(texts)).astype(np.int64)
        out, lengths = [], []
        for t in texts:
            found = (m.group() for m in self.word.finditer(self.marked(t)))
            n = 0
            while part := list(islice(found, WORDS)):
                out.append(self._known(part)[0])
                n += len(out[-1])
            lengths.append(n)
        return np.concatenate([np.zeros(0, np.int32), *out]), np.array(lengths, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: a space for each mark but the one put before the text; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        if self.dummy and data.startswith(self.space):
            data = data[len(self.space):]
        return data.decode("utf-8", "replace").replace(MARK, " ")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array of int) and decoded (the text that the ids give).

    ``path``: a BPE model file of the sentencepiece library, readable on every executor (see
    ``piece_vocab.load`` for what is supported). One row for each input row, repeated ones too; a null or
    empty text has no ids and decodes to an empty text; a null id stays null; the mark U+2581 in a text
    decodes to a space, as with the library. Nothing is shuffled. A worker remembers the words it has
    met, up to a bound; stretches of more than 256 characters without a border that no piece crosses are
    merged with a heap in O(n log n). An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, decoded string"
    arrow = arrow_schema(schema)

    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = c.encode(texts_of(part))
                edges = np.r_[0, np.cumsum(n)]
                text = [c.decode(ids[a:b].tolist()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(n), listed.cast(arrow.field("ids").type), pa.array(text, pa.string())], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
