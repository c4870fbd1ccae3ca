"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A hash turns a unit vector by three rounds of random signs and a Hadamard transform and takes the
nearest of the axes and their opposites. A table joins ``k`` such hashes into a bucket, and a vector is
entered in the ``PROBES`` buckets of a table that lie nearest, so two vectors meet where any of these
agree. k grows with the logarithm of the number of vectors, the number of tables with it (``shape``).

Vectors of a bucket are compared in blocks by their exact cosine. A link found in several buckets counts
in the first alone, so a bucket gives sums and a spanning set of edges, never its pairs.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, mix64, whole_runs, written
from .components import components

COSINE = 0.93
TABLES, PROBES, NEAREST = 6, 4, 3
BLOCK = 500


def shape(n: int, dim: int) -> tuple[int, int]:
    """Hashes in a table and number of tables for n vectors.

    About one in seven pairs at cosine 0.93 misses a table of two hashes, and under a half one of three;
    doubling the tables with each further hash keeps the pairs that miss all below one in 10,000.
    """
    k = max(2, int(math.log(max(n, 2)) / math.log(2 * max(dim, 2))))
    return k, TABLES * 2 ** (k - 2)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def bucket_lists(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Buckets of each row: ``PROBES`` in each table, nearest first."""
    n, dim = unit.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = unit
    near = min(NEAREST, d)
    choices = np.array(list(product(range(near), repeat=k)))
    probes = min(PROBES, len(choices))
    out = np.zeros((n, tables, PROBES), np.uint64)
    for t in range(tables):
        code, loss = [], []
        for i in range(k):
            y, r = x, np.random.default_rng([dim, t, i])
            for _ in range(3):
                y = hadamard(y * r.choice([-1.0, 1.0], d))
            size = np.abs(y)
            axis = np.argsort(-size, axis=1, kind="stable")[:, :near]
            best = np.take_along_axis(size, axis, 1)
            code.append((2 * axis + (np.take_along_axis(y, axis, 1) < 0)).astype(np.uint64))
            loss.append((best[:, :1] - best) ** 2)
        total = sum(loss[i][:, choices[:, i]] for i in range(k))
        pick = np.argsort(total, axis=1, kind="stable")[:, :probes]
        key = np.full((n, probes), t + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(code[i][:, choices[:, i]], pick, 1) + np.uint64(i + 1))
        out[:, t, :probes] = key
        out[:, t, probes:] = key[:, -1:]
    return out.reshape(n, -1)


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, vec, c1, c2) for each row; c1 is null where the vector links with nothing."""
    schema = "id bigint, label bigint, dim int, vec binary, c1 bigint, c2 bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for id_, label, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.array(v, float) if v and all(c is not None for c in v) else None
                if id_ is None or label is None or x is None or not np.isfinite(x).all() or not x.any():
                    out.append((id_, label, None, None, None, None))
                    continue
                raw = x.astype("<f8").tobytes()
                c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(label.to_bytes(8, "little", signed=True) + raw), "<i8").tolist()
                out.append((id_, label, len(x), raw, c1, c2))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, arrow, strict=True)], schema=arrow)

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("v")).mapInArrow(run, schema)


def with_buckets(classes: DataFrame, k: int, tables: int) -> DataFrame:
    schema = "id bigint, m bigint, vec binary, buckets array<bigint>"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            label, dim, vec = np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3).to_pylist()
            lists: list = [None] * batch.num_rows
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.frombuffer(b"".join(vec[i] for i in at), "<f8").reshape(-1, d)
                keys = bucket_lists(unit(x), k, tables)
                with np.errstate(over="ignore"):  # buckets of one label and width only
                    keys = mix64(keys + mix64(label[at].astype(np.uint64) * np.uint64(2654435761) + np.uint64(d))[:, None])
                for i, row in zip(at, keys.view(np.int64), strict=True):
                    lists[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(lists, arrow.field("buckets").type)], schema=arrow)

    return classes.select("id", "label", "dim", "vec", "m").mapInArrow(run, schema)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def first_meeting(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether ``bucket`` is the first that rows a and b (of bucket lists) have in common."""
    ta, tb = a.reshape(len(a), -1, PROBES), b.reshape(len(b), -1, PROBES)
    table = int(np.nonzero((a == bucket).any(0))[0].min()) // PROBES
    same = ta[:, :table + 1, :, None] == tb[:, :table + 1, None, :]
    earlier = same[:, :table].any(axis=(1, 2, 3))
    here = np.where(same[:, table].any(axis=2), ta[:, table], np.iinfo(np.int64).max).min(axis=1)
    return ~earlier & (here == bucket)


def compare_run(bucket: int, p: int, q: int, part: np.ndarray, m: np.ndarray, x: np.ndarray, lists: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of a bucket: rows with links, how many vectors they link with, and a row they are connected to."""
    left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
    links_a, links_b = [], []
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        if p == q:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 20_000):
            u, v = i[s:s + 20_000], j[s:s + 20_000]
            mine = first_meeting(lists[u], lists[v], bucket)
            links_a.append(u[mine])
            links_b.append(v[mine])
    a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (links_a, links_b))
    n = np.bincount(a, m[b], len(x)) + np.bincount(b, m[a], len(x))
    root = np.arange(len(x))
    while True:  # smallest row number that can be reached
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    use = np.flatnonzero(n)
    return use, n[use].astype(np.int64), root[use]


def link_sums(hashed: DataFrame, cosine: float) -> DataFrame:
    """(id, n, to): vectors newly linked with ``id`` in some block, and one that it is connected to."""
    member = hashed.select("id", F.explode(F.array_distinct("buckets")).alias("bucket"))
    open_ = (member.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
             .select("bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")))
    rows = member.join(open_, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = (rows.join(hashed, "id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("bucket", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "part", "id", "m", "vec", "buckets"))
    schema = "id bigint, n bigint, to bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        for rows, edges in whole_runs(batches, ["bucket", "p", "q"]):
            bucket, p, q, part, id_, m = (rows[c].to_numpy() for c in ("bucket", "p", "q", "part", "id", "m"))
            vec = rows["vec"].to_pylist()
            lists = rows["buckets"].combine_chunks().flatten().to_numpy().reshape(len(id_), -1)
            out = []
            for a, z in zip(edges, edges[1:], strict=False):
                if z - a > 1:
                    x = unit(np.frombuffer(b"".join(vec[a:z]), "<f8").reshape(z - a, -1))
                    use, n, to = compare_run(bucket[a], p[a], q[a], part[a:z], m[a:z], x, lists[a:z], cosine)
                    out.append((id_[a:z][use], n, id_[a:z][to]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=arrow)

    keys = ["bucket", "p", "q"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept (id = component_id), a row for each input row.

    Vectors are compared if their labels are equal and not null. A vector that is null, zero or holds a
    null or non-finite number, or whose id is null, links with nothing; so do vectors of different
    lengths with each other. Equal vectors of a label are one class: they are linked with each other and
    with whatever one of them is. Repeated ids count as that many vectors and share their component. An
    empty table gives an empty result. No link below ``cosine`` is made; for those found see ``shape``.
    """
    rows = written(classes_of(vectors, id_col, vector_col, label_col), "vectors")
    classes = written(rows.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min(F.struct("id", "label", "dim", "vec")).alias("r"), F.count(F.lit(1)).alias("m"))
                      .select("c1", "c2", "r.*", "m"), "vector-classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    hashed = written(with_buckets(classes, *shape(n, dim or 2)), "hashed")
    sums = written(link_sums(hashed, cosine), "link-sums")
    found = components(sums, "id", "to")
    per_class = (classes.select("c1", "c2", "id", "m").join(sums.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(found, "id", "left")
                 .select("c1", "c2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    return (rows.select("id", "c1", "c2").join(per_class, ["c1", "c2"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
