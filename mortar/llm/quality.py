"""Quality classifier by positive-unlabelled learning (operator 1).

Trusted positives are documents whose label is 1; all documents outside the held-out
fold are the unlabelled text.  The model is linear on statistics of a whole text
(rates of byte classes and punctuation, repeated neighbours, variety and
length of words and lines) and minimises the non-negative unbiased risk
``pi R_p+ + max(0, R_u- - pi R_p-)`` of the sigmoid loss by full-batch steps.

The class prior pi is estimated: a positives-against-unlabelled model scores every
row, and pi is the least ratio of the unlabelled to the positive score tails, with the
deviation a tail of that many rows allows.  Means, deviations and tails are computed over all
rows.  Trusted positives are a bounded sample, the ``SAMPLE`` (20,000) of least id hash.  As many unlabelled rows
give the scores for the prior and a first model; its last ``PASSES`` (12) steps take the risk's
unlabelled part over all rows, summed on the executors.

Labels are learnt only from rows outside the held-out fold (crc32 of the id as text, mod
5, is 0); id, label, language and source are no inputs of the score.

Cases.  Null and empty texts get statistics of zero and a score.  Repeated rows give
one row each; a label given twice counts once.  A null id is held out.  Without
positives the prior is 1 and the score is the prior.  Empty tables are fine.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, PASSES, FOLDS, BINS, THRESHOLD = 20_000, 12, 5, 1000, 0.3
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def statistics(text: bytes) -> list[float]:
    """The model's inputs for one UTF-8 text."""
    size = max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    rates = [count[c] / size for c in PUNCTUATION]
    rates += [count[65:91].sum() / size, count[97:123].sum() / size, count[48:58].sum() / size, count[128:].sum() / size, count[:32].sum() / size, count[32] / size]
    rates += [sum(map(eq, words, words[1:])) / n, 1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines), sum(w.isupper() for w in words) / n, sum(len(w) > 20 for w in words) / n]
    rates += [sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n, sum(not (w[:1].isalnum() or w[0] > 127) for w in words) / n]
    return [*np.sqrt(rates).tolist(), np.log1p(len(text)) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, min(50, len(text) / n) / 10]


WIDTH = len(statistics(b""))


def matrix(texts: pa.Array) -> np.ndarray:
    out = np.empty((len(texts), WIDTH))
    for k, t in enumerate(texts):
        out[k] = statistics(t.as_py() or b"")
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def apart(theta: np.ndarray) -> tuple[np.ndarray, float]:
    return theta[:-1], float(theta[-1])


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias)

    def score_column(self, text: Column) -> Column:
        """The score of a text column, as an Arrow UDF."""
        model = self

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            return pa.array(model.score(matrix(texts).astype(np.float32).astype(float)))  # as features() stores them

        return scored(text.cast("binary"))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


Risk = Callable[[np.ndarray], tuple[float, np.ndarray]]


def side(x: np.ndarray) -> Risk:
    """Mean score and mean gradient of the sigmoid loss over rows that end in a one."""

    def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        s = sigmoid(x @ theta)
        return float(s.mean()), x.T @ (s * (1 - s)) / len(x)

    return at


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def descend(positive: np.ndarray, unlabelled: np.ndarray | Risk, prior: float | None, start: np.ndarray | None = None, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias.  Without a prior: positives against unlabelled, logistic loss.  With
    one: the non-negative risk of the sigmoid loss, whose negative part gives no step while it is below 0."""
    p = with_one(positive)
    of_p, of_u = side(p), unlabelled if callable(unlabelled) else side(with_one(unlabelled))
    theta, m, v = np.zeros(p.shape[1]) if start is None else start, 0.0, 0.0
    for t in range(1, steps + 1):
        if prior is None:
            u = with_one(unlabelled)
            g = p.T @ (sigmoid(p @ theta) - 1) / len(p) + u.T @ sigmoid(u @ theta) / len(u)
        else:
            (mean_p, toward), (mean_u, away) = of_p(theta), of_u(theta)
            g = -prior * toward
            if mean_u - prior * mean_p >= 0:
                g = g + away - prior * toward
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of upper tails (counts by score bin, low to high) plus its deviation."""
    tail_p, tail_u = (np.cumsum(c[::-1])[::-1] for c in (positive, unlabelled))
    n_p, n_u = max(1, tail_p[0]), max(1, tail_u[0])
    off = np.sqrt(np.log(100) / n_p) + np.sqrt(np.log(100) / n_u)
    ratio = (tail_u / n_u + off * 0.5) / np.maximum(tail_p / n_p, 1e-9)
    return float(np.clip(ratio[tail_p / n_p > 0.2].min(initial=1.0), 0.01, 0.99))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x, held_out)`` of every row, checkpointed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(rows.column(1)).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([rows.column(0), lists], names=["id", "x"])

    found = common.map_rows(docs.select(id_col, F.col(text_col).cast("binary").alias("t")), run, f"id {kind}, x array<float>")
    return common.cut(found.withColumn("held_out", held_out(F.col("id"))))


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(float)


def scores(rows: DataFrame, model: Model) -> DataFrame:
    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(model.score(rows_of(x)))

    return rows.withColumn("score", scored("x"))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, passes: int = PASSES) -> Model:
    """A model from ``features()`` and labels; rows of the held-out fold are not used."""
    open_ = rows.where(~F.col("held_out"))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    positive = open_.join(trusted, "id", "left_semi")

    def moments(batches):
        total = np.zeros((3, WIDTH))
        for b in batches:
            x = rows_of(b.column(0))
            total += [np.full(WIDTH, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH), pa.int32()), *map(pa.array, total)], names=["k", "n", "s", "q"])

    sums = open_.select("x").mapInArrow(moments, "k int, n double, s double, q double").groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("k").collect()
    if not sums or not sums[0][1]:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    n, s, q = np.array([r[1:] for r in sums]).T
    mean = s / n
    scale = np.sqrt(np.maximum(q / n - mean**2, 0)) + 1e-3

    def some(df: DataFrame, rows: int) -> np.ndarray:
        # only hashes low enough to hold the sample, with room, are sorted
        low = int((min(1.0, 1.2 * (sample + 100) / max(1, rows)) - 0.5) * 2**64)
        hashed = df.select("x", F.xxhash64("id").alias("h")).where(F.col("h") <= min(low, 2**63 - 1))
        least = hashed.orderBy("h", "x").limit(sample).select("x").toArrow()
        return np.clip((rows_of(least.column("x")) - mean) / scale, -8, 8)

    p, u = some(positive, positive.count()), some(open_, int(n[0]))
    if not len(p):
        return Model(mean, scale, np.zeros(WIDTH), 6.0, 1.0)
    first = Model(mean, scale, *apart(descend(p, u, None)), 0.5)

    def tails(df: DataFrame) -> np.ndarray:
        out = np.zeros(BINS)
        at = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
        for r in scores(df, first).groupBy(at.alias("b")).count().collect():
            out[r["b"]] = r["count"]
        return out

    prior = prior_of(tails(positive), tails(open_))

    def of_all(theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean score and gradient over all rows: one row a task, then one sum."""

        def part(batches):
            total = np.zeros(WIDTH + 2)
            for b in batches:
                x = with_one(np.clip((rows_of(b.column(0)) - mean) / scale, -8, 8))
                s = sigmoid(x @ theta)
                total += [s.sum(), *(x.T @ (s * (1 - s)))]
            yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH + 2), pa.int32()), pa.array(total)], names=["k", "s"])

        got = open_.select("x").mapInArrow(part, "k int, s double").groupBy("k").agg(F.sum("s")).orderBy("k").collect()
        total = np.array([r[1] for r in got]) / n[0]
        return float(total[0]), total[1:]

    theta = descend(p, u, prior)
    return Model(mean, scale, *apart(descend(p, of_all, prior, theta, passes, 0.005)), prior)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    rows = features(docs, id_col, text_col)
    model = fit(rows, labels, id_col, label_col)
    return scores(rows, model).select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
