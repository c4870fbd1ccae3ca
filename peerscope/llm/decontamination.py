"""Benchmark decontamination as a prefix-filtered set join between documents and item windows.

A window is 13 consecutive words of an item. Every shingle (three consecutive words) of a window must
be in a document that contains it, so its rarest shingle over all documents is enough to look for: the
necessary prefix for full containment is one shingle. Documents are joined with these prefixes on the
words' positions, candidates outside the text are cut by the window's length and the prefix's place in
it, and the rest is compared word for word.

The item windows are a stated query set. They are cut into blocks of bounded size; a block is broadcast
and all documents pass it where they are read, so a passage in very many documents gathers nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_schema, bytes_of, merge_spans, mix64, slices, small_batches, written

WINDOW = 13
SHINGLE = 3
BLOCK_PAIRS = 200_000
# A-Z become a-z; every ASCII byte that is no letter or digit becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (words, item): the item's windows, words joined by a space."""
    small_batches(benchmark.sparkSession)
    schema = "words string, item string"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), bytes_of(batch), strict=True):
                w = words_of(text)
                found = {b" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} if w and item is not None else set()
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary()).cast(pa.string()), pa.array([item] * len(found), pa.string())], schema=arrow)

    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, schema).distinct()


@dataclass
class Block:
    """Windows of a block as padded rows of word numbers, and the numbers of their shingles."""

    vocab: dict[bytes, int]
    windows: np.ndarray
    length: np.ndarray
    items: list[tuple[str, ...]]
    shingles: dict[int, np.ndarray]

    @classmethod
    def of(cls, pairs: list[tuple[str, str]], window: int) -> Block:
        items: dict[str, list[str]] = {}
        for words, item in pairs:
            items.setdefault(words, []).append(item)
        names = sorted(items)
        vocab: dict[bytes, int] = {}
        rows = [[vocab.setdefault(x, len(vocab)) for x in w.encode().split(b" ")] for w in names]
        windows = np.full((len(rows), window), -2, np.int64)
        for row, words in zip(windows, rows, strict=True):
            row[:len(words)] = words
        length = np.array([len(r) for r in rows], np.int64)
        shingles = {}
        for k in range(1, SHINGLE + 1):
            use = length >= k if k == SHINGLE else length == k
            if use.any():
                keys = [shingle_keys(r[:n], k) for r, n in zip(windows[use], length[use], strict=True)]
                shingles[k] = np.unique(np.concatenate(keys))
        return cls(vocab, windows, length, [tuple(sorted(items[n])) for n in names], shingles)

    def numbers(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after another (-1: in no window), with a -1 behind each text; where texts start."""
        parts, starts, n = [], [], 0
        for words in docs:
            starts.append(n)
            parts.append(np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words)))
            parts.append(np.array([-1]))
            n += len(words) + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts, np.int64)


def shingle_keys(numbers: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key for each k consecutive numbers; equal keys are only candidates."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out + numbers[i:i + n].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def known_shingles(numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose k words are all in the block's vocabulary, and their keys."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.ones(n, bool)
    for i in range(k):
        ok &= numbers[i:i + n] >= 0
    at = np.flatnonzero(ok)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out + numbers[at + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return at, out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``keys`` are in the sorted ``wanted``, and where."""
    if not len(wanted) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    hit = np.flatnonzero(wanted[at] == keys)
    return hit, at[hit]


def shingle_counts(docs: DataFrame, block) -> dict[int, np.ndarray]:
    """How often each of the block's shingles occurs in all documents (no more rows than the block has shingles)."""
    schema = "k int, i int, n bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        b: Block = block.value
        totals = {k: np.zeros(len(s), np.int64) for k, s in b.shingles.items()}
        for batch in batches:
            for part in slices(batch):
                numbers, _ = b.numbers([words_of(t) for t in bytes_of(part)])
                for k, wanted in b.shingles.items():
                    _, keys = known_shingles(numbers, k)
                    _, at = find(keys, wanted)
                    totals[k] += np.bincount(at, minlength=len(wanted))
        for k, n in totals.items():
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(n[i])], schema=arrow)

    out = {k: np.zeros(len(s), np.int64) for k, s in block.value.shingles.items()}
    for r in docs.select("text").mapInArrow(run, schema).groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        out[r["k"]][r["i"]] = r["n"]
    return out


def prefixes(block: Block, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shingle size: sorted keys of the windows' rarest shingles, and for each a stretch of (window, place in it)."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for w, (row, n) in enumerate(zip(block.windows, block.length, strict=True)):
        k = min(SHINGLE, int(n))
        keys = shingle_keys(row[:n], k)
        often = counts[k][np.searchsorted(block.shingles[k], keys)]
        place = int(np.argmin(often))
        if often[place]:  # a window with a shingle that no document has can't occur
            rows.setdefault(k, []).append((int(keys[place]), w, place))
    out = {}
    for k, found in rows.items():
        found.sort()
        key = np.array([f[0] for f in found], np.uint64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out[k] = (key[first], np.r_[first, len(key)], np.array([f[1] for f in found]), np.array([f[2] for f in found]))
    return out


def occurrences(block: Block, index: dict, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every window in the texts."""
    found_w, found_s = [], []
    ends = np.r_[starts[1:], len(numbers)] - 1
    for k, (wanted, edge, window, place) in index.items():
        where, keys = known_shingles(numbers, k)
        hit, at = find(keys, wanted)
        n = edge[at + 1] - edge[at]
        entry = np.repeat(edge[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        pos = np.repeat(where[hit], n)
        w = window[entry]
        start = pos - place[entry]
        doc = np.searchsorted(starts, pos, side="right") - 1
        fits = (start >= starts[doc]) & (start + block.length[w] <= ends[doc])
        w, start = w[fits], start[fits]
        same = np.ones(len(w), bool)
        for i in range(block.windows.shape[1]):
            inside = i < block.length[w]
            same &= ~inside | (numbers[np.minimum(start + i, len(numbers) - 1)] == block.windows[w, i])
        found_w.append(w[same])
        found_s.append(start[same])
    if not found_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_w), np.concatenate(found_s)


def pass_block(state: DataFrame, block, index) -> DataFrame:
    """The documents with the block's hits added to their spans and items."""
    schema = state.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        b, prefix = block.value, index.value
        for batch in batches:
            for part in slices(batch):
                words = [words_of(t) for t in bytes_of(part)]
                numbers, starts = b.numbers(words)
                w, s = occurrences(b, prefix, numbers, starts)
                doc = np.searchsorted(starts, s, side="right") - 1
                order = np.argsort(doc, kind="stable")
                w, s, doc = w[order], s[order], doc[order]
                old_s, old_e, old_i = (part.column(i).to_pylist() for i in (3, 4, 5))
                cut = np.searchsorted(doc, np.arange(len(words) + 1))
                for d in np.unique(doc):
                    a, z = cut[d], cut[d + 1]
                    from_, to = s[a:z] - starts[d], s[a:z] - starts[d] + b.length[w[a:z]]
                    m_s, m_e = merge_spans(np.r_[np.array(old_s[d], np.int64), from_], np.r_[np.array(old_e[d], np.int64), to])
                    old_s[d], old_e[d] = m_s.tolist(), m_e.tolist()
                    old_i[d] = sorted({*old_i[d], *(i for x in np.unique(w[a:z]) for i in b.items[x])})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in words], pa.int64()),
                                                  *(pa.array(x, f.type) for x, f in zip((old_s, old_e, old_i), list(arrow)[3:6], strict=True)), part.column(6)], schema=arrow)

    return state.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_pairs: int = BLOCK_PAIRS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  carry: Sequence[str] = ()) -> DataFrame:
    """Words of each document inside an occurrence of an item's window.

    Returns id, n_words, n_hit, items (ids as sorted strings), span_starts and span_ends (word positions,
    half open) and contaminated (n_hit > 0 and at least a twentieth of the words), a row for each input
    row. Null or empty texts have no words; an item with fewer than ``window`` words is one window, one
    without words or with a null id none. Repeated item rows are one item. Without items nothing is hit;
    an empty table gives an empty result. Words are compared as bytes, A-Z as a-z.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pairs = written(item_windows(benchmark, window, item_col, item_text_col), "windows")
    blocks = max(1, -(-pairs.count() // block_pairs))
    none = F.array().cast("array<bigint>")
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                        none.alias("span_starts"), none.alias("span_ends"), F.array().cast("array<string>").alias("items"), F.struct(*carry).alias("rest") if carry else F.lit(0).alias("rest"))
    texts = docs.select(F.col(text_col).alias("text"))
    for b in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == b)
        block = Block.of([(r["words"], r["item"]) for r in part.collect()], window)  # about block_pairs rows
        shared = spark.sparkContext.broadcast(block)
        index = spark.sparkContext.broadcast(prefixes(block, shingle_counts(texts, shared)))
        state = pass_block(state, shared, index)
        if b + 1 < blocks:
            state = written(state, "passed")
    spans = F.zip_with("span_ends", "span_starts", lambda e, s: e - s)
    hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = (state.withColumn("n_hit", hit)
           .select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "span_starts", "span_ends",
                   ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "rest"))
    return out if carry else out.drop("rest")
