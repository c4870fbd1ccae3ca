"""What the two substring operators share: finding which windows of a text also start earlier.

Comparing every window with every other would move each text many times over. Instead each window names
an anchor: of the grams (shorter runs of symbols) in it the one with the smallest hash, the leftmost of
equals. Equal windows have equal anchors, so they meet in the shard that the anchor's hash names.
Neighbouring windows mostly share their anchor; such a stretch of windows is a segment, and only its two
hashes and its place are sent.

* In a slice (some MB of whole documents) only the earliest occurrence of equal segments is sent on.
* A shard sees at once that a segment with an earlier equal is a repeat. An anchor with different
  segments is contested: windows may still be equal there. Only these segments' symbols are fetched, and
  the shard's index (the operator's own method) decides for each of their windows.
* An anchor with very many different segments would fill a shard (the words around a passage that many
  documents share). Such anchors are found by their counts, and their segments are cut into single
  windows, each of which is its own anchor.

Slices are a written table bucketed by slice, so decisions come back to the texts without moving them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_schema, bucketed, mix64, partitions, slices, small_batches, written

SEGMENTS_IN_SHARD = 400_000
HEAVY_IN_SLICE = 16
HOT_SHARE = 200_000
BASE = 0x9E3779B97F4A7C15 | 1
PLACE = np.uint64((1 << 28) - 1)
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    """``words`` or bytes as symbols; windows and grams in symbols; whether an earlier start in the same document counts."""

    words: bool
    window: int
    gram: int
    same_doc: bool
    slice_bytes: int


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (BASE, inverse))


@lru_cache(maxsize=1)
def byte_hashes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Symbols:
    """Symbol hashes of a slice's documents one after another, and where each document starts."""

    def __init__(self, texts: list[bytes], rule: Rule, hashes: WordHashes):
        if rule.words:
            split = [t.split() for t in texts]
            self.of = split
            self.hash = hashes.array([w for s in split for w in s])
            length = [len(s) for s in split]
        else:
            self.of = texts
            self.raw = np.frombuffer(b"".join(texts), np.uint8)
            self.hash = byte_hashes()[self.raw]
            length = [len(t) for t in texts]
        self.length = np.array(length, np.int64)
        self.start = np.cumsum(self.length) - self.length

    def content(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Symbols of stretches, as bytes or 64-bit hashes."""
        index = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return (self.raw if hasattr(self, "raw") else self.hash)[index]


@dataclass
class Segments:
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def segments(s: Symbols, rule: Rule, hot: np.ndarray | None = None) -> Segments:
    """Segments of a slice in order of their start. A segment's windows start at start .. start + n - 1."""
    size, w, k = len(s.hash), rule.window, rule.gram
    count = size - w + 1
    none = np.zeros(0, np.int64)
    if size > int(PLACE):
        raise ValueError("a text of more than 2**28 symbols")
    if count <= 0:
        return Segments(none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    up, down = powers(1 << max(20, (size).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(s.hash * up[:size], out=total[1:])
        gram = mix64((total[k:] - total[:-k]) * down[:size - k + 1])
    least = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, reach = w - k + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[:-(width - reach)], least[width - reach:])
    place = (least & PLACE).astype(np.int64)
    whole = np.ones(count, bool)
    for a, z in zip(s.start, s.start + s.length, strict=True):  # windows that would cross a document's end
        whole[max(a, z - w + 1):z] = False
    change = np.r_[True, (place[1:] != place[:-1]) | (whole[1:] != whole[:-1])]
    at = np.flatnonzero(change)
    n = np.diff(np.r_[at, count])
    use = whole[at]
    at, n = at[use], n[use]
    anchor = gram[place[at]]

    def keyed(at, n):
        with np.errstate(over="ignore"):
            return mix64((total[at + n + w - 1] - total[at]) * down[at] + n.astype(np.uint64))

    if hot is not None and len(hot):
        cut = np.isin(anchor, hot)
        if cut.any():
            single = np.repeat(at[cut] - (np.cumsum(n[cut]) - n[cut]), n[cut]) + np.arange(n[cut].sum())
            one = np.ones(len(single), np.int64)
            at, n, anchor = np.r_[at[~cut], single], np.r_[n[~cut], one], np.r_[anchor[~cut], mix64(keyed(single, one) + np.uint64(1))]
            order = np.argsort(at, kind="stable")
            at, n, anchor = at[order], n[order], anchor[order]
    return Segments(at, n, anchor, keyed(at, n), np.searchsorted(s.start, at, side="right") - 1)


@dataclass
class Sent:
    """The slice's different segments: ``group`` of each segment, and the group's earliest one, sorted by shard and place."""

    group: np.ndarray
    first: np.ndarray
    shard: np.ndarray
    local: np.ndarray


def to_send(g: Segments, s: Symbols, ids: np.ndarray, shards: int) -> Sent:
    local = g.start - s.start[g.doc]
    order = np.lexsort((local, ids[g.doc], g.key))
    new = np.r_[True, g.key[order][1:] != g.key[order][:-1]] if len(order) else np.zeros(0, bool)
    first = order[new]
    shard = (g.anchor[first] % np.uint64(shards)).astype(np.int64)
    by = np.lexsort((first, shard))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    group = np.empty(len(order), np.int64)
    group[order] = place[np.cumsum(new) - 1]
    return Sent(group, first[by], shard[by], local)


def shrink(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def grow(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


class Slice:
    """A row of the slices table, opened again."""

    def __init__(self, row: dict, rule: Rule, hashes: WordHashes):
        self.ids = np.frombuffer(row["ids"], "<i8")
        length = np.frombuffer(row["lengths"], "<i8")
        blob = zstandard.ZstdDecompressor().decompress(row["text"])
        ends = np.cumsum(length)
        self.texts = [blob[z - n:z] for z, n in zip(ends.tolist(), length.tolist(), strict=True)]
        self.symbols = Symbols(self.texts, rule, hashes)


SLICES = "slice bigint, ids binary, lengths binary, text binary, segments bigint, heavy array<bigint>, heavy_n array<bigint>"


def make_slices(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    arrow = arrow_schema(SLICES)

    def run(batches):
        hashes, number = WordHashes(), 0
        ids, texts = [], []

        def close():
            nonlocal number
            s = Symbols(texts, rule, hashes)
            g = segments(s, rule)
            anchors, n = np.unique(g.anchor[np.unique(g.key, return_index=True)[1]], return_counts=True)  # different segments of each anchor
            heavy = n >= HEAVY_IN_SLICE
            row = {"slice": [(TaskContext.get().partitionId() << 32) + number],
                   "ids": [np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes()], "lengths": [np.array([len(t) for t in texts], "<i8").tobytes()],
                   "text": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], "segments": [len(g.start)],
                   "heavy": [anchors[heavy].view(np.int64).tolist()], "heavy_n": [n[heavy].tolist()]}
            number += 1
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        held = 0
        for batch in batches:
            for part in slices(batch):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    t = t or b""
                    if texts and held + len(t) > rule.slice_bytes:
                        yield close()
                        held = 0
                    ids.append(i)
                    texts.append(t)
                    held += len(t)
        if texts:
            yield close()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SLICES)
    return bucketed(rows, ["slice"], partitions(spark), "slices", sort=False)


def hot_anchors(table: DataFrame, total: int) -> np.ndarray:
    """Anchors with more than 1 / ``HOT_SHARE`` of all segments (and at least 1,000); there can't be more than ``HOT_SHARE``."""
    heavy = table.select(F.explode(F.arrays_zip("heavy", "heavy_n")).alias("h")).select("h.heavy", "h.heavy_n")
    rows = heavy.groupBy("heavy").agg(F.sum("heavy_n").alias("n")).where(F.col("n") > max(1000, total // HOT_SHARE)).select("heavy").collect()
    return np.sort(np.array([r["heavy"] for r in rows], np.int64).view(np.uint64))


def later(doc: np.ndarray, place: np.ndarray, doc0: np.ndarray, place0: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether (doc, place) is a later start than (doc0, place0), as the rule counts it."""
    return (doc > doc0) | ((doc == doc0) & (place > place0)) if rule.same_doc else doc > doc0


def opened(batches, rule: Rule):
    hashes = WordHashes()
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            yield row, Slice(row, rule, hashes)


def sent_rows(table: DataFrame, rule: Rule, shards: int, hot) -> DataFrame:
    schema = "shard int, slice bigint, anchors binary, keys binary, docs binary, places binary"
    arrow = arrow_schema(schema)

    def run(batches):
        for row, s in opened(batches, rule):
            g = segments(s.symbols, rule, hot.value)
            out = to_send(g, s.symbols, s.ids, shards)
            edge = np.r_[np.flatnonzero(np.r_[True, out.shard[1:] != out.shard[:-1]]), len(out.shard)] if len(out.shard) else []
            cols = [[], [], [], [], [], []]
            for a, z in zip(edge, edge[1:], strict=False):
                f = out.first[a:z]
                doc = s.ids[g.doc[f]]
                for col, x in zip(cols, (int(out.shard[a]), row["slice"], shrink((g.anchor[f] >> np.uint64(32)).astype("<u4")), shrink(g.key[f]),
                                         shrink(np.diff(doc, prepend=doc.dtype.type(0))), shrink(out.local[f].astype("<u4"))), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return table.select("slice", "ids", "lengths", "text").mapInArrow(run, schema)


def resolved(sent: DataFrame, rule: Rule) -> DataFrame:
    """For each (slice, shard): bits of the segments sent that have an earlier equal, and the numbers of contested ones."""
    schema = "slice bigint, shard int, repeated binary, contested binary"
    arrow = arrow_schema(schema)

    def resolve(rows: pa.Table) -> pa.Table:
        part = [[grow(x, kind) for x in rows[c].to_pylist()] for c, kind in (("anchors", "<u4"), ("keys", "<u8"), ("docs", "<i8"), ("places", "<u4"))]
        size = np.array([len(x) for x in part[0]])
        anchor, key, place = (np.concatenate(part[i]) for i in (0, 1, 3))
        doc = np.concatenate([np.cumsum(x) for x in part[2]])
        order = np.lexsort((place, doc, key, anchor))
        a, k, d, p = anchor[order], key[order], doc[order], place[order]
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_k = new_a | np.r_[True, k[1:] != k[:-1]]
        first = np.flatnonzero(new_k)[np.cumsum(new_k) - 1]
        again = later(d, p, d[first], p[first], rule)
        group = np.cumsum(new_a) - 1
        several = np.bincount(group, new_k) > 1
        if not rule.same_doc:  # of one document only: nothing can be earlier
            at = np.flatnonzero(new_a)
            several &= np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)
        repeated, contested = np.zeros(len(a), bool), np.zeros(len(a), bool)
        repeated[order] = again
        contested[order] = ~again & several[group]
        edge = np.r_[0, np.cumsum(size)]
        return pa.table([rows["slice"].combine_chunks(), rows["shard"].combine_chunks(),
                         pa.array([np.packbits(repeated[x:y]).tobytes() for x, y in zip(edge, edge[1:], strict=False)], pa.binary()),
                         pa.array([np.flatnonzero(contested[x:y]).astype("<u4").tobytes() for x, y in zip(edge, edge[1:], strict=False)], pa.binary())], schema=arrow)

    return sent.groupBy("shard").applyInArrow(resolve, schema)


def contested_rows(table: DataFrame, decided: DataFrame, rule: Rule, shards: int, hot) -> DataFrame:
    """The symbols of contested segments, sent to their shards."""
    schema = "shard int, slice bigint, numbers binary, sizes binary, docs binary, places binary, symbols binary"
    arrow = arrow_schema(schema)
    asked = (decided.where(F.length("contested") > 0).groupBy("slice").agg(F.collect_list(F.struct("shard", "contested")).alias("asked")))

    def run(batches):
        for row, s in opened(batches, rule):
            g = segments(s.symbols, rule, hot.value)
            out = to_send(g, s.symbols, s.ids, shards)
            cols = [[], [], [], [], [], [], []]
            for ask in row["asked"]:
                numbers = np.frombuffer(ask["contested"], "<u4")
                f = out.first[np.searchsorted(out.shard, ask["shard"]) + numbers]
                values = (ask["shard"], row["slice"], ask["contested"], shrink(g.n[f].astype("<u2")), shrink(s.ids[g.doc[f]]), shrink(out.local[f].astype("<u4")),
                          shrink(s.symbols.content(g.start[f], g.n[f] + rule.window - 1)))
                for col, x in zip(cols, values, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return table.select("slice", "ids", "lengths", "text").join(asked, "slice").mapInArrow(run, schema)


#: Numbers of equal windows: symbols of all stretches, starts of the windows in them -> a group for each window, equal for equal windows.
Grouping = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def decided_windows(contested: DataFrame, rule: Rule, grouping: Grouping) -> DataFrame:
    """For each (slice, shard): a bit for every window of its contested segments that also starts earlier."""
    schema = "slice bigint, shard int, numbers binary, sizes binary, windows binary"
    arrow = arrow_schema(schema)

    def compare(rows: pa.Table) -> pa.Table:
        kind = "<u8" if rule.words else "u1"
        n = [grow(x, "<u2").astype(np.int64) for x in rows["sizes"].to_pylist()]
        size, doc, place = (np.concatenate(x) for x in (n, [grow(x, "<i8") for x in rows["docs"].to_pylist()], [grow(x, "<u4").astype(np.int64) for x in rows["places"].to_pylist()]))
        symbols = np.concatenate([grow(x, kind) for x in rows["symbols"].to_pylist()])
        length = size + rule.window - 1
        begin = np.cumsum(length) - length
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(begin, size) + inner
        group = grouping(symbols, begin, at, rule.window)
        flags = np.zeros(len(at), bool)
        same = np.flatnonzero(group >= 0)
        if len(same):
            d, p, x = np.repeat(doc, size)[same], (np.repeat(place, size) + inner)[same], group[same]
            order = np.lexsort((p, d, x))
            head = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
            first = order[np.repeat(head, np.diff(np.r_[head, len(order)]))]
            flags[same[order]] = later(d[order], p[order], d[first], p[first], rule)
        edge = np.r_[0, np.cumsum([x.sum() for x in n])].astype(np.int64)
        return pa.table([rows["slice"].combine_chunks(), rows["shard"].combine_chunks(), rows["numbers"].combine_chunks(), rows["sizes"].combine_chunks(),
                         pa.array([np.packbits(flags[x:y]).tobytes() for x, y in zip(edge, edge[1:], strict=False)], pa.binary())], schema=arrow)

    return contested.groupBy("shard").applyInArrow(compare, schema)


def without_repeats(docs: DataFrame, rule: Rule, grouping: Grouping, id_col: str, text_col: str) -> DataFrame:
    """id, n (symbols), n_removed, n_spans and kept (binary: the other symbols), a row for each input row."""
    spark = docs.sparkSession
    table = make_slices(docs, rule, id_col, text_col)
    total = table.agg(F.sum("segments")).first()[0] or 0
    shards = max(partitions(spark), -(-total // SEGMENTS_IN_SHARD))
    hot = spark.sparkContext.broadcast(hot_anchors(table, total))
    decided = written(resolved(sent_rows(table, rule, shards, hot), rule), "decided")
    windows = written(decided_windows(contested_rows(table, decided, rule, shards, hot), rule, grouping), "decided-windows")
    of_slice = decided.groupBy("slice").agg(F.collect_list(F.struct("shard", "repeated")).alias("repeated"))
    in_slice = windows.groupBy("slice").agg(F.collect_list(F.struct("shard", "numbers", "sizes", "windows")).alias("windows"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n bigint, n_removed bigint, n_spans bigint, kept binary"
    arrow = arrow_schema(schema)

    def run(batches):
        for row, s in opened(batches, rule):
            gone = removed(s, row, rule, shards, hot.value)
            out = []
            for i, (a, n, of) in enumerate(zip(s.symbols.start.tolist(), s.symbols.length.tolist(), s.symbols.of, strict=True)):
                x = gone[a:a + n]
                k = int(x.sum())
                if rule.words:
                    kept = b" ".join(of if not k else [of[j] for j in np.flatnonzero(~x)])
                else:
                    kept = of if not k else s.symbols.raw[a:a + n][~x].tobytes()
                spans = int(x[0]) + int((x[1:] & ~x[:-1]).sum()) if k else 0
                out.append((None if s.ids[i] == NULL_ID else int(s.ids[i]), n, k, spans, kept))
            for a in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a:a + 500], strict=True), arrow, strict=True)], schema=arrow)

    opened_up = table.select("slice", "ids", "lengths", "text").join(of_slice, "slice", "left").join(in_slice, "slice", "left")
    return opened_up.mapInArrow(run, schema)


def removed(s: Slice, row: dict, rule: Rule, shards: int, hot: np.ndarray) -> np.ndarray:
    """Which symbols of a slice are covered by a window that also starts earlier."""
    cover = np.zeros(len(s.symbols.hash) + 1, np.int32)
    g = segments(s.symbols, rule, hot)
    out = to_send(g, s.symbols, s.ids, shards)
    if not len(g.start):
        return cover[:-1] > 0
    again = np.zeros(len(out.first), bool)
    for x in row["repeated"] or ():
        a, z = np.searchsorted(out.shard, [x["shard"], x["shard"] + 1])
        again[a:z] = np.unpackbits(np.frombuffer(x["repeated"], np.uint8), count=z - a).astype(bool)
    head = out.first[out.group]
    whole = again[out.group] | later(s.ids[g.doc], out.local, s.ids[g.doc[head]], out.local[head], rule)
    np.add.at(cover, g.start[whole], 1)
    np.add.at(cover, g.start[whole] + g.n[whole] + rule.window - 1, -1)
    flags: dict[int, np.ndarray] = {}
    for x in row["windows"] or ():
        a = int(np.searchsorted(out.shard, x["shard"]))
        sizes = grow(x["sizes"], "<u2").astype(np.int64)
        bits = np.unpackbits(np.frombuffer(x["windows"], np.uint8), count=int(sizes.sum())).astype(bool)
        cut = np.split(bits, np.cumsum(sizes)[:-1])
        flags |= {a + int(i): b for i, b in zip(np.frombuffer(x["numbers"], "<u4"), cut, strict=True) if b.any()}
    if flags:
        for i in np.flatnonzero(~whole & np.isin(out.group, np.fromiter(flags, np.int64, len(flags)))):
            for j in np.flatnonzero(flags[int(out.group[i])]):
                cover[g.start[i] + j] += 1
                cover[g.start[i] + j + rule.window] -= 1
    return np.cumsum(cover)[:-1] > 0
