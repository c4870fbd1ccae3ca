"""The conversation trie against plain nodes."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import sha
from pyspark.sql import functions as F

from peerscope.llm.double_array import DoubleArray
from peerscope.llm.prefix_trie import grafted, ordered_turns, prefix_nodes
from peerscope.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(sequences):
    """Nodes of {conv: tuple of (role, text)}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sorted(sequences.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, m in members.items())


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    return out


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def sequences_to(spark, sequences):
    rows = [(c, i, r, t) for c, s in sequences.items() for i, (r, t) in enumerate(s)]
    turns = ordered_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    members = spark.createDataFrame([(c, len(s)) for c, s in sequences.items()], "conv_id bigint, n_turns bigint")
    return turns, members


def test_double_array_keeps_all_prefixes_apart():
    r = random.Random(1)
    for _ in range(200):
        seqs = [[r.randrange(r.choice([3, 40])) for _ in range(r.randint(1, 6))] for _ in range(r.randint(1, 60))]
        lengths = np.array([len(s) for s in seqs])
        offsets, codes = np.cumsum(lengths) - lengths, np.array([x for s in seqs for x in s])
        trie = DoubleArray(codes, offsets, lengths)
        at, seen = trie.walk(codes, offsets, lengths), {}
        for s, o in zip(seqs, offsets, strict=True):
            for k in range(len(s)):
                assert seen.setdefault(tuple(s[:k + 1]), at[o + k]) == at[o + k]
        assert len({*seen.values()}) == len(seen) and -1 not in seen.values()
        other = np.array([r.randrange(40) for _ in range(300)])
        walked = trie.walk(other, np.arange(0, 300, 3), np.full(100, 3)).reshape(100, 3)
        for s, w in zip(other.reshape(100, 3).tolist(), walked.tolist(), strict=True):
            for k in range(3):
                assert w[k] == seen.get(tuple(s[:k + 1]), -1)


@pytest.mark.parametrize("block, chunk", [(64, 4 << 20), (5, 1)])
def test_random_trees(spark, block, chunk):
    """Shards of very few strings, levels of very few turns and pieces of few ids give the same nodes."""
    r = random.Random(block)
    base = [("u", "root turn"), ("a", "é" * 5), ("u", ""), ("a", "same"), ("u", "same"), ("a", "x"), ("a", "y")]
    sequences = {}
    for c in range(60):
        k = r.choice([0, 1, 4, 7])
        sequences[c * 3 - 20] = tuple(base[:k] + [(r.choice("ua"), r.choice("pqr")) for _ in range(r.randint(0, 3))])
    sequences |= {500 + c: tuple(base) for c in range(25)}
    sequences |= {600 + c: tuple(base + [("u", str(c))] * (c % 3) + base[:3]) for c in range(4)}
    assert found(prefix_nodes(*sequences_to(spark, sequences), block=block, chunk_bytes=chunk, piece_bytes=60)) == plain_nodes(sequences)


def test_long_conversations(spark):
    """Shared prefixes over several levels, chains alone, and one that ends at the border of a level."""
    long = tuple(("u", f"t{i}") for i in range(200))
    sequences = {1: long, 2: long, 3: long[:150] + (("a", "z"),), 4: long[:128], 5: long[:64], 6: long[:64] + (("q", "w"),) * 90, 7: (("n", "n"),) * 130, 8: (), 9: long[:128]}
    assert found(prefix_nodes(*sequences_to(spark, sequences))) == plain_nodes(sequences)


def test_odd_rows(spark):
    """Nulls anywhere, ties of turn, repeated rows, turnless conversations and columns with clashing names."""
    rows = [(None, 0, "u", "lost"), (0, None, "u", "first"), (0, 1, None, "b"), (0, 2, "a", None), (0, 2, "a", None), (1, 0, "u", "own"), (1, 5, "u", "later"), (3, 0, "u", "x" * 100_000),
            (7, 1, "u", "seven"), (7, 1, "u", "seven"), (-3, 0, "u", "minus")] + [(c, t, "u", f"t{t}") for c in range(10, 30) for t in range(c % 12)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({n: F.lit(1) for n in ("pos", "size", "turn_key", "h", "k", "n", "first", "depth", "key", "group")})
    assert found(prefix_nodes(*grafted(ordered_turns(df)))) == plain_nodes(plain_rebuilt(rows))
    assert prefix_nodes(*grafted(ordered_turns(df.limit(0)))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.001")) == plain_nodes(plain_rebuilt(rows))


def test_a_conversation_with_most_turns_is_numbered_in_ranges(spark, hot):
    rows = [(5, t, "u", f"t{t}") for t in range(100)] + [(6, t, "u", f"t{t}") for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert found(prefix_nodes(*grafted(ordered_turns(df)))) == plain_nodes(plain_rebuilt(rows))
