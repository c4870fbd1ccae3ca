"""Token-id files: Simple-8b words in blocks, with a document table and per-block offsets.

A 64-bit word holds a 4-bit selector and 60 bits of ids. The selector says how many ids of which width
follow; the last one is the escape for an id too wide for any other. A block is a fixed number of ids
that starts on a word border, and the file keeps each block's first word, so blocks can be decoded at
the same time or one alone. All coding is done on arrays, over a group of blocks at once; files are
written and read a group at a time, so a task holds a group, its longest text and 25 bytes a document.

File: magic, the words (uint64), then the document ids (int64), which of them are null (uint8, padded
to 8), ids of each document (int64), first word of each block (int64), and at the end counts of
documents, ids, ids a block, blocks and words (int64), all little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scale import dimension
from .bpe_codec import codec
from .common import arrow_schema, new_path, slices, small_batches, texts_of

MAGIC = b"IDS8B\x00\x00\x01"
BLOCK = 2048
GROUP = 256  # blocks coded at once
ROWS = 2000
# Fixed values of the format: ids in a word and bits of each, by selector. Width 0 is a run of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` and the first word of each block. Each word takes as many ids as fit."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<i8")
    reach = int(COUNTS[0])
    padded = np.zeros((blocks, block + reach), np.uint64)
    body = np.zeros(blocks * block, np.uint64)
    body[:n] = ids
    padded[:, :block] = body.reshape(blocks, block)
    width = np.zeros(padded.shape, np.uint8)
    for b in WIDTHS[:-1]:
        width += padded >= np.uint64(1 << int(b))  # number of widths too small for the id
    choice = np.full((blocks, block), len(COUNTS) - 1, np.uint8)
    low = 1  # the first selector with a width of its own; 0 and 1 share width 0
    for s in range(len(COUNTS) - 2, -1, -1):
        k = max(s, low)
        over = np.zeros((blocks, block + reach + 1), np.int32)
        np.cumsum(width > k, axis=1, out=over[:, 1:])
        fits = over[:, int(COUNTS[s]):int(COUNTS[s]) + block] == over[:, :block]
        choice[fits] = s
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    rows, starts = [], []
    while row.size:  # a step for each word of the longest block, on all blocks at once
        rows.append(row)
        starts.append(at)
        at = at + COUNTS[choice[row, at]]
        go = at < block
        row, at = row[go], at[go]
    row, at = np.concatenate(rows), np.concatenate(starts)
    order = np.argsort(row * block + at, kind="stable")
    row, at = row[order], at[order]
    sel = choice[row, at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        if WIDTHS[s]:
            m = np.flatnonzero(sel == s)
            for i in range(int(COUNTS[s])):
                words[m] |= padded[row[m], at[m] + i] << np.uint64(i * int(WIDTHS[s]))
    return words.astype("<u8"), np.searchsorted(row, np.arange(blocks)).astype("<i8")


def unpack(words: np.ndarray, first: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids again; what a block's last word holds beyond the block is padding."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    ends = np.cumsum(count)
    which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(words)]))
    at = ends - count
    inside = at - at[first[which]]
    start = which * block + inside
    stop = np.minimum((which + 1) * block, n)
    for s in np.unique(sel):
        if WIDTHS[s]:
            m = np.flatnonzero(sel == s)
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for i in range(int(COUNTS[s])):
                to = start[m] + i
                ok = to < stop[m]
                out[to[ok]] = (words[m[ok]] >> np.uint64(i * int(WIDTHS[s]))) & mask
    return out


class Writer:
    """Writes a file from documents that come in parts; ids wait only until a group of blocks is full."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.docs, self.null, self.lengths, self.first = [], [], [], []
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = self.n_words = self.n_docs = 0
        out.write(MAGIC)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.array([d or 0 for d in doc_ids], "<i8"))
        self.null.append(np.array([d is None for d in doc_ids], np.uint8))
        self.lengths.append(np.asarray(lengths, "<i8"))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)
        if self.held >= self.block * GROUP:
            self._pack(self.held // self.block * self.block)

    def _pack(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        for a in range(0, n, self.block * GROUP):
            words, first = pack(ids[a:min(n, a + self.block * GROUP)], self.block)
            self.out.write(words.tobytes())
            self.first.append(first + self.n_words)
            self.n_words += len(words)
        self.waiting, self.held = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        if self.held:
            self._pack(self.held)
        none = [np.zeros(0, "<i8")]
        first = np.concatenate(self.first or none)
        null = np.concatenate([*self.null, np.zeros(-self.n_docs % 8, np.uint8)])
        counts = np.array([self.n_docs, self.n_ids, self.block, len(first), self.n_words], "<i8")
        for part in (np.concatenate(self.docs or none), null, np.concatenate(self.lengths or none), first, counts):
            self.out.write(part.astype(part.dtype.newbyteorder("<")).tobytes())


def documents(source) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """From an open file, a group of blocks at a time: document ids, ids of each document and their ids, one after the other."""
    source.seek(0)
    if source.read(8) != MAGIC:
        raise ValueError("not a token-id file")
    source.seek(0, 2)
    source.seek(source.tell() - 40)
    docs, n, block, blocks, words = np.frombuffer(source.read(40), "<i8").tolist()
    source.seek(8 + 8 * words)
    take = lambda kind, k: np.frombuffer(source.read(k * np.dtype(kind).itemsize), kind)
    names, null, lengths = take("<i8", docs), take("u1", docs + -docs % 8)[:docs], take("<i8", docs)
    edges = np.r_[take("<i8", blocks), words]
    ends = np.cumsum(lengths)
    done, reach, held = 0, 0, [np.zeros(0, "<u4")]
    for a in range(0, max(blocks, 1), GROUP):
        b = min(blocks, a + GROUP)
        source.seek(8 + 8 * int(edges[a]))
        size = min(n, b * block) - a * block
        held.append(unpack(take("<u8", int(edges[b] - edges[a])), edges[a:b] - edges[a], size, block).astype("<u4"))
        reach += size
        upto = int(np.searchsorted(ends, reach, side="right"))
        if upto > done:
            ids, size = np.concatenate(held), lengths[done:upto]
            whole = int(size.sum())
            yield [None if z else d for d, z in zip(names[done:upto].tolist(), null[done:upto].tolist(), strict=True)], size, ids[:whole]
            done, held = upto, [ids[whole:].copy()]


def to_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    out = BytesIO()
    writer = Writer(out, block)
    writer.add(doc_ids, lengths, ids)
    writer.close()
    return out.getvalue()


def from_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, ids of each document and all ids of a file."""
    parts = [([], np.zeros(0, "<i8"), np.zeros(0, "<u4")), *documents(BytesIO(content))]
    names, lengths, ids = zip(*parts, strict=True)
    return [d for part in names for d in part], np.concatenate(lengths), np.concatenate(ids)


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts and write their ids to ``folder`` (on storage all executors reach) in ascending id order.

    Returns a written table with a row for each file: part, name, n_docs, n_ids, start (ids in the files
    before). A file is written under a name of its attempt and then moved, so a task that is run again
    replaces its file with the same content. ``end_id`` closes each document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "part int, name string, n_docs bigint, n_ids bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        from pyarrow import fs

        c, writer, task = codec(path), None, TaskContext.get()
        name = f"part-{task.partitionId():06d}.ids"
        store, base = fs.FileSystem.from_uri(folder)
        draft = f"{base}/_draft-{name}-{task.taskAttemptId()}"
        for batch in batches:
            for part in slices(batch):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    writer = Writer(store.open_output_stream(draft))
                ids, lengths = c.encode_all(texts_of(part))
                writer.add(part.column(0).to_pylist(), lengths + 1, np.insert(ids, np.cumsum(lengths), np.uint32(end_id)))
        if writer is None:
            return
        writer.close()
        writer.out.close()
        if store.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:  # of an earlier attempt; some stores don't move onto a file
            store.delete_file(f"{base}/{name}")
        store.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]}, schema=arrow)

    spread = (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
              .repartitionByRange("id").sortWithinPartitions("id", "text"))
    files = new_path(spark, "id-files")
    spread.mapInArrow(run, schema).write.parquet(files)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return spark.read.parquet(files).withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Documents in the files: doc_id, start (ids of all documents before), n_tokens, ids (binary, unsigned 32-bit)."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    arrow = arrow_schema(schema)

    def run(batches):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{place}/{name}") as source:
                    for names, lengths, ids in documents(source):
                        ends, data = np.cumsum(lengths), ids.tobytes()
                        starts = ends - lengths
                        for a in range(0, len(names), ROWS):
                            part = slice(a, a + ROWS)
                            yield pa.RecordBatch.from_pydict({
                                "doc_id": names[part], "start": base + starts[part], "n_tokens": lengths[part],
                                "ids": [data[4 * x:4 * y] for x, y in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]}, schema=arrow)
                        base += int(ends[-1])

    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))  # the content is not read here
    return found.join(dimension(files.select("name", "start")), "name").select("name", "start").mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token-id files of ``docs`` and read them back: doc_id, start, n_tokens, ids.

    One row for each input row. Null ids come first, repeated ids follow each other in the order of
    their texts; a null or empty text has the end id alone. An empty table writes no file and gives no
    row. A text of any length lies in one file. The table is ranged by id, so a file holds about as many
    rows as Spark gives a partition; no task holds more than a group of blocks and its longest text.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    files = write_files(docs, path, folder, end_id, id_col, text_col)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    return read_files(spark, folder, files)
