"""Prefix trie of conversations: double-array tries per shard, shared upper nodes merged over all shards.

A turn is known by a 128-bit hash of role and text, a conversation by the string of its turns' hashes.
Equal strings are one row before anything is sorted, however many conversations they stand for. The
strings are ranged in byte order, so a shard is a stretch of neighbours: only nodes on the paths of its
first and last string can lie in other shards too. Those partial nodes, at most two paths a shard, are
merged globally; all others are complete where they are.

A trie holds 64 turns. Where several conversations share more, the next 64 turns are a further level of
tries under the node they have reached; a conversation that goes on alone is a chain and needs no trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..operators.scale import dimension
from .common import arrow_schema, partitions, written
from .double_array import DoubleArray

BLOCK = 64
CHUNK_BYTES = 4 << 20
PIECE = 1 << 20
TOP = bytes(16)
WIDTH = 16

NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
PART = ("key binary, up binary, path array<binary>, `group` binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string")
NOTHING = hashlib.sha256(b"").hexdigest()


def hashed(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*[p.cast("binary") for p in parts])))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_key (hash of role and text) and size (bytes of the text), in the order of turn.

    A null turn comes first; turns with equal numbers follow in the order of their hashes. Null role or
    text counts as empty. Rows without conv_id are left out. A conversation of any length is numbered in
    ranges of its turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        hashed(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("turn_key"), F.octet_length(text).alias("size"))
    return numbered(rows, ["conv_id"], ["turn", "turn_key"], "_n").select("conv_id", (F.col("_n") - 1).alias("pos"), "turn_key", "size")


def grafted(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of their family's first one: turns, and the members with n_turns.

    The first h turns of conversation c - c % ``family``, then c's own turns after its first h, where
    h = crc32(c) % ``most``. Remainders are as in SQL (the sign of c).
    """
    turns = written(turns, "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % family)
    own = written(own, "members")
    there = own.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    members = own.join(there, "first", "left").withColumn("k", F.least("h", F.coalesce("n_first", F.lit(0))))
    members = written(members.select("conv_id", "h", "k", "first", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "members")
    heads = turns.where(f"conv_id % {family} = 0 AND pos < {most - 1}").withColumnRenamed("conv_id", "first")
    copied = members.join(heads, "first").where("pos < h").select("conv_id", "pos", "turn_key", "size")
    kept = turns.where(F.col("pos") >= h).join(members.select("conv_id", "h", "k"), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_key", "size")
    return copied.unionByName(kept), members.select("conv_id", "n_turns")


def prefix_nodes(turns: DataFrame, members: DataFrame, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES, piece_bytes: int = PIECE) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (0 to n_turns - 1, each once), turn_key, size; ``members``: every conv_id once,
    with n_turns. A node is known by its smallest member and its depth; the root's parent is null. A member
    without turns ends at the root. Without members there is no row. No task holds more than a stretch of
    strings; the digest of a node where very many conversations end is made from sorted pieces of their
    ids, one piece in memory at a time. ``block``: turns a level; ``chunk_bytes``: strings a trie;
    ``piece_bytes``: ids hashed at once. They don't change the result.
    """
    turns, members = written(turns, "turns"), written(members, "members")
    now = members.select("conv_id", "n_turns", F.lit(TOP).alias("group"), F.lit(None).cast("bigint").alias("top"))
    levels, nodes, start = [], [], 0
    while True:  # a level for each 64 turns that several conversations share
        placed = written(_placed(turns, now, start, block), "placed")
        classes = written(placed.groupBy("key").agg(
            *[F.first(c).alias(c) for c in ("group", "seq", "sizes", "top")], F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.sum(F.col("more").cast("bigint")).alias("n_more")), "classes")
        levels.append((placed, classes))
        open_ends = classes.where("n_more > 0").select("key", "n_more", F.col("conv_id").alias("above"))
        if open_ends.isEmpty():
            break
        going = placed.where("more").select("conv_id", "n_turns", "key").join(open_ends, "key")
        nodes.append(_chains(turns, going.where("n_more = 1"), start + block))
        now = written(going.where("n_more > 1").select("conv_id", "n_turns", F.col("key").alias("group"), F.col("above").alias("top")), "members")
        if now.isEmpty():
            break
        start += block
    below = None
    for k in reversed(range(len(levels))):
        placed, classes = levels[k]
        alone = F.when(F.col("n_more") == 1, F.lit(1)).otherwise(0).cast("bigint")  # a chain: one child and one leaf
        rows = classes.join(_digests(placed.where("NOT more").select("key", "conv_id"), piece_bytes), "key", "left")
        if below is None:
            rows = rows.withColumns({"kids": alone, "leaves": alone, "saved": F.lit(0).cast("bigint")})
        else:
            rows = rows.join(below, "key", "left").withColumns({"kids": F.coalesce("kids", alone), "leaves": F.coalesce("leaves", alone), "saved": F.coalesce("saved", F.lit(0))})
        found = _level(rows, chunk_bytes)
        below = found.where("depth = 0").select(F.col("group").alias("key"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        nodes.append((found if k == 0 else found.where("depth > 0")).select(
            "conv_id", (F.col("depth") + block * k).alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def _placed(turns: DataFrame, now: DataFrame, start: int, block: int) -> DataFrame:
    """Members with the string of their next turns (seq, and the turns' sizes) and the key of group and string."""
    near = turns.where((F.col("pos") >= start) & (F.col("pos") < start + block))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.hex("turn_key").alias("h"), "size")))
    strings = near.groupBy("conv_id").agg(ordered.alias("t")).select(  # at most 64 turns of each
        "conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x.h), "")).alias("seq"), F.transform("t", lambda x: x["size"]).cast("array<bigint>").alias("sizes"))
    rows = now.join(strings, "conv_id", "left").withColumns({
        "seq": F.coalesce("seq", F.lit(b"")), "sizes": F.coalesce("sizes", F.array().cast("array<bigint>")), "more": F.col("n_turns") > start + block})
    return rows.withColumn("key", hashed(F.col("group"), F.col("seq")))


def _chains(turns: DataFrame, going: DataFrame, start: int) -> DataFrame:
    """Nodes of conversations that are alone from turn ``start`` on."""
    rows = turns.where(F.col("pos") >= start).join(going.select("conv_id", "n_turns", "above"), "conv_id")
    last = F.col("pos") + 1 == F.col("n_turns")
    return rows.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == start, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("bigint").alias("n_convs"), F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"))


def _digests(ended: DataFrame, piece_bytes: int) -> DataFrame:
    """key, ends_sha256: SHA-256 of each key's conv_ids in ascending order, joined by commas.

    Keys that lie within one sorted partition are finished there. Of the others, which can be as large as
    the table, joined pieces of bounded size travel; their digest is made from one piece after the other.
    """
    schema = "key binary, first bigint, piece string, ends_sha256 string"
    arrow = arrow_schema(schema)

    def batch_of(rows):
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

    def pieces(batches: Iterator[pa.RecordBatch]):
        held_key, held, size, edge, rows = None, [], 0, True, []  # edge: the key may begin in the partition before

        def close(key, ids, open_):
            text = ",".join(map(str, ids))
            rows.append((key, ids[0], text, None) if open_ else (key, ids[0], None, hashlib.sha256(text.encode()).hexdigest()))

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != held_key:
                    if held:
                        close(held_key, held, edge)
                        edge = False
                    held_key, held, size = key, [], 0
                elif size > piece_bytes:
                    edge = True
                    close(key, held, True)
                    held, size = [], 0
                held.append(conv)
                size += 20
            if rows:
                yield batch_of(rows)
                rows = []
        if held:
            close(held_key, held, True)
        if rows:
            yield batch_of(rows)

    def joined(batches: Iterator[pa.RecordBatch]):
        held, digest, rows = None, None, []
        for batch in batches:
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if key != held:
                    if digest is not None:
                        rows.append((held, None, None, digest.hexdigest()))
                    held, digest = key, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if rows:
                yield batch_of(rows)
                rows = []
        if digest is not None:
            yield batch_of([(held, None, None, digest.hexdigest())])

    found = written(ended.repartitionByRange(partitions(ended.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, schema), "pieces")
    open_ = found.where("piece IS NOT NULL").repartition("key").sortWithinPartitions("key", "first").mapInArrow(joined, schema)
    return found.where("piece IS NULL").unionByName(open_).select("key", "ends_sha256")


def _level(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """All nodes of a level, its roots at depth 0: the shards' tries, their shared nodes merged."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "group", "seq").sortWithinPartitions("group", "seq")
    columns = ["group", "seq", "sizes", "top", "n_convs", "conv_id", "kids", "leaves", "saved", "ends_sha256"]
    parts = written(ranged.select(*columns).mapInArrow(partial(_tries, schema=arrow_schema(PART), chunk_bytes=chunk_bytes), PART), "nodes")
    shared = parts.where("key IS NOT NULL").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("up", "path", "group", "depth")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("size").alias("size"), F.max("ends_sha256").alias("ends_sha256"))
    shared = written(shared, "shared")
    kids = shared.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("shared_children"))
    shared = shared.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("shared_children", F.lit(0)))
    leaves = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")
    total = shared.select(F.explode("path").alias("key"), leaves.alias("a"), saved.alias("b")).groupBy("key").agg(F.sum("a").alias("all_leaves"), F.sum("b").alias("all_saved"))
    names = dimension(shared.select(F.col("key").alias("up"), F.col("conv_id").alias("above")))
    shared = shared.join(total, "key").select("up", "group", "depth", "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
                                              "n_children", F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"), "ends_sha256")
    both = parts.where("key IS NULL").select(*shared.columns).unionByName(shared)
    return both.join(names, "up", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id")).drop("above", "up")


def _tries(batches: Iterator[pa.RecordBatch], schema: pa.Schema, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted strings to the nodes of their tries, some MB of strings at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("seq").nbytes + WIDTH * batch.num_rows
        if size > chunk_bytes:
            yield _trie(pa.Table.from_batches(held), schema)
            held, size = [], 0
    if held:
        yield _trie(pa.Table.from_batches(held), schema)


def _trie(rows: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    groups, seqs = rows["group"].to_pylist(), rows["seq"].to_pylist()
    count = {c: rows[c].to_numpy() for c in ("n_convs", "conv_id", "kids", "leaves", "saved")}
    halves = np.frombuffer(b"".join([g + s for g, s in zip(groups, seqs, strict=True)]), "<u8").reshape(-1, 2)
    lengths = np.fromiter(map(len, seqs), np.int64, len(seqs)) // WIDTH + 1  # the group is the first code
    offsets = np.cumsum(lengths) - lengths
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(np.r_[False, (halves[order[1:]] != halves[order[:-1]]).any(1)])
    trie = DoubleArray(codes, offsets, lengths)
    place = trie.walk(codes, offsets, lengths)
    places, node = np.unique(place, return_inverse=True)
    k = len(places)
    above = trie.check[places]
    up = np.where(above > 0, np.searchsorted(places, above), -1)  # the top of all groups is no node
    of, depth = np.repeat(np.arange(len(seqs)), lengths), np.zeros(k, np.int64)
    depth[node] = np.arange(len(node)) - np.repeat(offsets, lengths)
    turn_size, size = np.zeros(len(node), np.int64), np.zeros(k, np.int64)
    turn_size[np.delete(np.arange(len(node)), offsets)] = rows["sizes"].combine_chunks().flatten().to_numpy()
    size[node] = turn_size
    n, conv = np.zeros(k, np.int64), np.full(k, np.iinfo(np.int64).max)
    np.add.at(n, node, count["n_convs"][of])
    np.minimum.at(conv, node, count["conv_id"][of])
    root = node[offsets]
    for r, top in zip(root.tolist(), rows["top"].to_pylist(), strict=True):
        if top is not None:
            conv[r] = top
    shared = np.zeros(k, bool)
    key, parent_key, path = [None] * k, [None] * k, [None] * k
    for i in {0, len(seqs) - 1}:
        line = node[offsets[i]:offsets[i] + lengths[i]].tolist()
        names = [hashlib.md5(groups[i] + seqs[i][:WIDTH * d], usedforsecurity=False).digest() for d in range(len(line))]
        for d, v in enumerate(line):
            shared[v], key[v], path[v] = True, names[d], names[:d + 1]
    last = node[offsets + lengths - 1]
    inner = ~shared
    kids = np.bincount(up[inner & (up >= 0)], minlength=k)
    leaves, saved = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for total, name in ((kids, "kids"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(total, last, count[name])
    leaves += inner & (kids == 0)
    saved += np.where(inner, (n - 1) * size, 0)
    for d in range(int(depth.max()), 0, -1):
        here = np.flatnonzero((depth == d) & inner)
        np.add.at(leaves, up[here], leaves[here])
        np.add.at(saved, up[here], saved[here])
    ends, group, parent = [None] * k, [None] * k, [None] * k
    for v, digest in zip(last.tolist(), rows["ends_sha256"].to_pylist(), strict=True):
        ends[v] = digest
    for r, g in zip(root.tolist(), groups, strict=True):
        group[r] = g
    for v, u in enumerate(up.tolist()):
        if u >= 0 and shared[u]:
            parent_key[v] = key[u]
        elif u >= 0:
            parent[v] = int(conv[u])
    data = [key, parent_key, path, group, depth, conv, parent, n, kids, leaves, saved, size, ends]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, schema, strict=True)], schema=schema)
