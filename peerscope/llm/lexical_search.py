"""Ranked lexical search by hashed max-sketches.

A document's index entry is four rows of counters, each as wide as four times its different terms (the
next power of two). Each row hashes the terms anew; a counter holds the largest count of the terms that
fall on it. For one document the impact of a term grows with its count, so these are the coordinatewise
maxima of the impacts, and the smallest of a term's four counters bounds what the term can add.

A batch of items is looked up in all entries at once; the sums are upper bounds of all scores. The
documents of highest bound are scored exactly, which gives each item a threshold; then every document
whose bound reaches it is scored too. The index knows nothing of the items and can be kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import top_per_group
from ..operators.scale import dimension
from .common import WordHashes, arrow_schema, bytes_of, slices, small_batches, written

ROWS, ROOM = 4, 4
FULL = 255  # a counter of 255 stands for this count or more
FIRST = 16  # documents of highest bound that are scored for each item first
CELLS = 8_000_000
PART = 1 << 20
SENT = 2 << 20  # bytes of texts read, or of sketches sent, at once
ROW_GROUP = 8 << 20
ITEM_BYTES, ITEMS = 4 << 20, 5000
# Odd multipliers, one for each row of a sketch.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
# Fixed values of the ranking: saturation and length share.
SCALE, STEP, BASE, SHARE = 1_000_000_000, 1000, 25, 75
TOP_IMPACT = SCALE // STEP
# Letters in lower case; what can be in no term becomes a space.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, at most a MB of it at once."""
    data = text.translate(TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PART) if len(data) - at > PART else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def places(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * MIX[row]) >> np.uint64(65 - width.bit_length())).astype(np.int64)


def sketch(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows of largest counts of a document's different terms."""
    width = 1 << max(4, (ROOM * len(hashes) - 1).bit_length())
    out = np.zeros((ROWS, width), np.uint8)
    order = np.argsort(counts, kind="stable")  # the largest is written last
    hashes, counts = hashes[order], np.minimum(counts[order], FULL).astype(np.uint8)
    for r in range(ROWS):
        out[r, places(hashes, r, width)] = counts
    return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with doc_id, n (terms with repeats) and sketch, a row for each document that has terms.

    Sketches are some times the size of their texts: they leave a task ``SENT`` bytes at a time and are written in
    small row groups without a dictionary, so neither the worker nor the writer holds many of them.
    """
    small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n bigint, sketch binary"
    arrow = arrow_schema(schema)

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", SENT):
                for rows in sent(entry for entry in map(lambda i, text: indexed(i, text, known), part.column(0).to_pylist(), bytes_of(part)) if entry):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return written(rows, "sketches", **{"parquet.block.size": str(ROW_GROUP), "parquet.enable.dictionary": "false"})


def indexed(ident, text: bytes, known: WordHashes) -> tuple | None:
    """A document's entry: id, terms with repeats, sketch; None without terms."""
    terms = [known.array(t) for t in term_lists(text) if t]
    if not terms:
        return None
    terms = np.concatenate(terms)
    return ident, len(terms), sketch(*np.unique(terms, return_counts=True)).tobytes()


def sent(rows: Iterator[tuple], limit: int | None = None) -> Iterator[list[tuple]]:
    """Entries in lists of about ``limit`` bytes of sketches (a larger one stands alone)."""
    limit = limit or SENT
    held, size = [], 0
    for row in rows:
        if held and size + len(row[2]) > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[2])
    if held:
        yield held


class Batch:
    """Items as term numbers, and the terms' weights: what every task needs of a block of items (bounded by ``blocks``)."""

    def __init__(self, texts: list[bytes]):
        counts = [Counter(t for part in term_lists(x) for t in part) for x in texts]
        self.number: dict[bytes, int] = {}
        for c in counts:
            for t in c:
                self.number.setdefault(t, len(self.number))
        self.items = [[(self.number[t], k) for t, k in c.items()] for c in counts]
        by_term = sorted((v, i, k) for i, held in enumerate(self.items) for v, k in held)
        self.term, self.item, self.times = np.array(by_term, np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(self.term, np.arange(len(self.number) + 1))
        self.hashes = WordHashes().array(list(self.number))
        self.weight = np.zeros(len(self.number), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(v, 0) + 1))) for v in range(len(self.number))], np.int64)

    def length_part(self, n: int) -> int:
        return BASE + SHARE * n * self.n_docs // self.n_terms

    def bounds(self, sketches: list[bytes], lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For entries in groups: which ones, and the upper bounds of all items' scores (a row for each entry)."""
        long = np.array([self.length_part(n) for n in lengths], np.int64)
        width = np.array([len(s) // ROWS for s in sketches])
        most = max(1, CELLS // max(1, len(self.number), len(self.items)))
        for w in np.unique(width).tolist():
            same = np.flatnonzero(width == w)
            at = [places(self.hashes, r, w) for r in range(ROWS)]
            step = max(1, min(most, CELLS // w))
            for a in range(0, len(same), step):
                which = same[a:a + step]
                rows = np.frombuffer(b"".join([sketches[i] for i in which]), np.uint8).reshape(len(which), ROWS, w)
                doc, term = np.nonzero(rows[:, 0, at[0]])
                count = rows[doc, 0, at[0][term]]
                for r in range(1, ROWS):
                    count = np.minimum(count, rows[doc, r, at[r][term]])
                    met = np.flatnonzero(count)
                    doc, term, count = doc[met], term[met], count[met]
                c = count.astype(np.int64)
                part = np.where(c == FULL, TOP_IMPACT, SCALE * c // (STEP * c + 8 * long[which][doc])) * self.weight[term]
                n = self.first[term + 1] - self.first[term]
                ends = np.cumsum(n)
                link = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[term] - (ends - n), n)
                total = np.zeros(len(which) * len(self.items), np.int64)
                np.add.at(total, np.repeat(doc, n) * len(self.items) + self.item[link], np.repeat(part, n) * self.times[link])
                yield which, total.reshape(len(which), len(self.items))

    def counts(self, text: bytes) -> tuple[Counter, int]:
        """How often a text holds each term of the items, and all its terms with repeats."""
        found, n = Counter(), 0
        for part in term_lists(text):
            found.update(filter(self.number.__contains__, part))
            n += len(part)
        return found, n

    def scores(self, text: bytes, items: list[int]) -> list[int]:
        found, n = self.counts(text)
        if not n:
            return [0] * len(items)
        m = self.length_part(n)
        worth = {self.number[t]: int(self.weight[self.number[t]]) * (SCALE * k // (STEP * k + 8 * m)) for t, k in found.items()}
        return [sum(worth.get(v, 0) * k for v, k in self.items[i]) for i in items]


def _document_counts(texts: DataFrame, batch: Batch) -> dict[int, int]:
    """Documents that hold each term of the items: counted over all documents, one row a term comes back."""
    schema = "term int, n bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        total = Counter()
        for b in batches:
            for part in slices(b, "text"):
                for text in bytes_of(part):
                    total.update({t for x in term_lists(text) for t in batch.number.keys() & x})
        yield pa.RecordBatch.from_pydict({"term": [batch.number[t] for t in total], "n": list(total.values())}, schema=arrow)

    return {r["term"]: r["n"] for r in texts.select("text").mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n")).collect()}


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (part for b in batches for part in slices(b, "sketch", CELLS))


def _highest(index: DataFrame, batch: Batch, first: int) -> DataFrame:
    """Of each item the ``first`` documents of highest bound: item, doc_id."""
    schema = f"item int, doc_id {index.schema['doc_id'].dataType.simpleString()}, bound bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        n = len(batch.items)
        best = np.zeros((0, n), np.int64)
        names = np.zeros((0, n), object)
        for b in entries(batches):
            ids = np.array(b.column("doc_id").to_pylist(), object)
            for which, bound in batch.bounds(b.column("sketch").to_pylist(), b.column("n").to_pylist()):
                if len(bound) > first:
                    top = np.argpartition(bound, len(bound) - first, axis=0)[-first:]
                    bound, which = np.take_along_axis(bound, top, 0), which[top]
                else:
                    which = np.repeat(which[:, None], n, 1)
                best, names = np.concatenate([best, bound]), np.concatenate([names, ids[which]])
                if len(best) > first:
                    top = np.argpartition(best, len(best) - first, axis=0)[-first:]
                    best, names = np.take_along_axis(best, top, 0), np.take_along_axis(names, top, 0)
        doc, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(names[doc, item].tolist(), arrow.field(1).type), pa.array(best[doc, item])], schema=arrow)

    return top_per_group(index.mapInArrow(run, schema), ["item"], [F.desc("bound"), F.asc("doc_id")], first).select("item", "doc_id")


def _reaching(index: DataFrame, batch: Batch, least: np.ndarray) -> DataFrame:
    """Documents whose bound for an item reaches its ``least``: item, doc_id."""
    schema = f"item int, doc_id {index.schema['doc_id'].dataType.simpleString()}"
    arrow = arrow_schema(schema)

    def run(batches):
        for b in entries(batches):
            ids = b.column("doc_id")
            for which, bound in batch.bounds(b.column("sketch").to_pylist(), b.column("n").to_pylist()):
                doc, item = np.nonzero(bound >= least)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(which[doc]))], schema=arrow)

    return index.mapInArrow(run, schema)


def _scored(texts: DataFrame, wanted: DataFrame, batch: Batch) -> DataFrame:
    """Exact scores above 0 of the wanted (item, doc_id): item, doc_id, score. A repeated doc_id is scored for each of its rows."""
    schema = f"item int, doc_id {texts.schema['doc_id'].dataType.simpleString()}, score bigint"
    arrow = arrow_schema(schema)
    lists = dimension(wanted.groupBy(F.col("doc_id").alias("wanted_id")).agg(F.collect_set("item").alias("items")))  # at most the items of a block

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                rows = [(i, d, s) for d, text, items in zip(part.column(0).to_pylist(), bytes_of(part), part.column(2).to_pylist(), strict=True)
                        for i, s in zip(items, batch.scores(text, items), strict=True) if s > 0]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else ((), (), ()), arrow, strict=True)], schema=arrow)

    return texts.join(lists, texts["doc_id"].eqNullSafe(lists["wanted_id"])).select("doc_id", "text", "items").mapInArrow(run, schema)


def blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[bytes]]]:
    """Items in blocks of bounded size: their ids and texts."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(item_col), F.col(text_col)).toLocalIterator():
        ids.append(row[0])
        texts.append((row[1] or "").encode())
        size += len(texts[-1])
        if size > ITEM_BYTES or len(ids) >= ITEMS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, index: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank, doc_id, score.

    ``index``: what ``build_index`` made of the same documents, built here if not given. Scores are exact
    integers over all documents; equal ones are ranked by ascending doc_id (a null one first). Each row of
    ``items`` is an item of its own, repeated ids and null ids too; each row of ``docs`` is a document. A
    null or empty text has no terms: such a document is no hit, such an item has no rows. Without
    documents or items there is no row. Items come in blocks of 5,000 or 4 MB, each looked up in all
    entries; candidates have no cap. The last round's table is written before it is returned.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = build_index(docs, id_col, text_col) if index is None else index
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    kind = items.schema[item_col].dataType
    result = None
    for ids, item_texts in blocks(items, item_col, item_text):
        batch = Batch(item_texts)
        if not size["n"] or not batch.number:
            continue
        batch.weigh(_document_counts(texts, batch), size["n"], size["terms"])
        tried = written(_highest(index, batch, max(FIRST, k)), "highest")
        known = written(_scored(texts, tried, batch), "scores")
        least = np.ones(len(ids), np.int64)
        for r in top_per_group(known, ["item"], [F.desc("score")], k, "rank").where(F.col("rank") == k).collect():
            least[r["item"]] = r["score"]
        rest = _reaching(index, batch, least).alias("r").join(
            tried.alias("t"), (F.col("r.item") == F.col("t.item")) & F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")), "left_anti")
        both = written(known.unionByName(_scored(texts, rest, batch)), "scores")
        best = top_per_group(both, ["item"], [F.desc("score"), F.asc("doc_id")], k, "rank")
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind.simpleString()}")
        rows = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        result = rows if result is None else result.unionByName(rows)
    if result is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id {texts.schema['doc_id'].dataType.simpleString()}, score bigint")
    return result
