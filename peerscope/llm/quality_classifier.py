"""Quality classifier by positive-unlabelled learning with the non-negative risk.

The model sees trusted positives and unlabelled text, never a labelled negative. With the class prior
pi, the risk of calling positives negative is taken out of the unlabelled risk: the negatives' part is
R_u(-) - pi * R_p(-). Where that estimate turns below zero the fit has gone too far, and the step goes
back up on it (non-negative risk). The model is linear in standardised statistics of the whole text and
their squares, with the logistic loss, so its score is a probability.

Inputs are the text's statistics alone. The fit takes at most ``max_positive`` positives and
``max_unlabelled`` unlabelled rows of the labelled training documents, those with the smallest hashes;
scoring reads every whole text where it lies and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bytes_of, slices, small_batches, written

MAX_POSITIVE = 10_000
MAX_UNLABELLED = 15_000
STEPS, RATE, L2 = 600, 0.05, 1e-3
SHOWN = [10, *range(32, 127)]  # newline and the visible ASCII bytes


def statistics(text: bytes) -> np.ndarray:
    """Lengths, variety of words and lines, shares of letter kinds and of each ASCII byte."""
    n = max(1, len(text))
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    words, lines = text.split(), text.split(b"\n")
    upper, lower, some = share[65:91].sum(), share[97:123].sum(), share[share > 0]
    general = [np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / max(1, len(words)), len(set(words)) / max(1, len(words)),
               len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines) / 1000, upper, lower, upper / (upper + lower + 1e-3),
               share[48:58].sum(), share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum(), share[128:].sum(),
               -(some * np.log(some)).sum()]
    return np.r_[general, np.sqrt(share[SHOWN])]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[z, z * z, np.ones(len(z))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Model:
    """Minimise pi R_p(+) + max(0, R_u(-) - pi R_p(-)) by adaptive gradient steps on all rows given."""
    model = Model(unlabelled.mean(0), unlabelled.std(0) + 1e-6, np.zeros(2 * unlabelled.shape[1] + 1), prior)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    w, first, second = model.weights, 0.0, 0.0
    for t in range(1, steps + 1):
        at_p, at_u = p @ w, u @ w
        negative = softplus(at_u).mean() - prior * softplus(at_p).mean()
        of_negative = sigmoid(at_u) @ u / len(u) - prior * (sigmoid(at_p) @ p) / len(p)
        of_positive = -prior * (sigmoid(-at_p) @ p) / len(p)
        g = (of_positive + of_negative if negative >= 0 else -of_negative) + l2 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    model.weights = w
    return model


def with_statistics(df: DataFrame, text_col: str, keep: str) -> DataFrame:
    """Columns of ``keep`` (DDL) and x, the text's statistics as bytes of doubles."""
    small_batches(df.sparkSession)
    schema = f"{keep}, x binary"
    arrow = arrow_schema(schema)
    names = arrow.names[:-1]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = [statistics(t).astype("<f8").tobytes() for t in bytes_of(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(x, arrow.field("x").type)], schema=arrow)

    return df.select(*names, F.col(text_col).alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on the labelled documents that are not held out (crc32 of the id as text, modulo 5, is not 0).

    The class prior is the share of positives among all of those labels. The unlabelled text is of the
    same documents with their labels unread, so that the prior is theirs. Both sets are bounded by the
    parameters and chosen by a hash of the id; the result is the same for any partitioning. Null labels
    are left out; None if there is no positive.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
             .where(~held_out(F.col(id_col))))
    n, positives = known.agg(F.count(F.lit(1)), F.sum((F.col("y") == 1).cast("int"))).first()
    if not positives:
        return None
    order = F.xxhash64(F.lit("fit"), id_col)
    chosen = (known.where("y = 1").orderBy(order, id_col).limit(max_positive).select(id_col, F.lit(1).alias("as_positive"))
              .unionByName(known.orderBy(order, id_col).limit(max_unlabelled).select(id_col, F.lit(0).alias("as_positive"))))
    text = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).withColumn("name", F.col(id_col).cast("bigint"))
    rows = written(with_statistics(text, "text", "name bigint, as_positive int"), "statistics").orderBy("name", "as_positive", "x").collect()  # bounded by the parameters
    if not any(r["as_positive"] for r in rows):
        return None
    x, y = np.frombuffer(b"".join(r["x"] for r in rows), "<f8").reshape(len(rows), -1), np.array([r["as_positive"] for r in rows], bool)
    del rows
    return fit(x[y], x[~y], positives / n)


def held_out(id_):
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5)) == 0


def quality_scores(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted (1 if the score is at least ``threshold``), a row for each input row.

    A null text scores as an empty one; a null id is not held out. Without a model (no positives) every
    score is 1, so that nothing is rejected. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, score double"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                score = np.ones(part.num_rows) if model is None else model.score(np.array([statistics(t) for t in bytes_of(part)]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(score)], schema=arrow)

    scored = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``threshold``; nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                if model is not None:
                    score = model.score(np.array([statistics(t) for t in bytes_of(part, text_col)]))
                    part = part.filter(pa.array(score >= threshold))
                yield part

    return docs.mapInArrow(run, docs.schema)
