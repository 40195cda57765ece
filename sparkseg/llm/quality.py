"""Quality classifier: naive Bayes support vectors.

Features are indicators of a text's byte n-grams of one to three bytes (hashed to 2**16), and of how
often a word follows itself. Each indicator is scaled by its log-count ratio between the classes, a
linear hinge-loss model is fitted by dual coordinate descent, and its margin becomes a score by a
logistic curve fitted to the margins of the training rows.

The fit uses a sample of labelled rows bounded by ``MAX_TRAINING_ROWS``, those with the least hash of
their id; the weights (2**16 + 16 numbers) are sent to the tasks and every text is scored whole.

Defined results: null and empty texts have no indicators and get the score of a zero vector; null
labels and labels of unknown ids aren't learned; of several labels of an id the mean counts, one
half as 1; with no labelled row every score is 0.5, with one class alone 0 or 1; repeated rows give
a row each; an empty table an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseg.llm.base import crc32_of, give_back, in_arrow

BUCKETS = 1 << 16
REPEATS = 16
SIZE = BUCKETS + REPEATS
MAX_TRAINING_ROWS = 12_000
THRESHOLD = 0.3


class Indicators:
    """The sorted features of a text; holds one buffer for all texts."""

    def __init__(self):
        self.seen = np.zeros(SIZE, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        data = text.encode("utf-8", "replace")
        for i in range(0, len(data), 1 << 20):  # long texts go through in parts that share two bytes
            b = np.frombuffer(data[i : i + (1 << 20) + 2], np.uint8).astype(np.uint32)
            with np.errstate(over="ignore"):
                self.seen[b] = True
                if len(b) > 1:
                    self.seen[((b[:-1] << np.uint32(8) | b[1:]) * np.uint32(2654435761)) >> np.uint32(16)] = True
                if len(b) > 2:
                    self.seen[((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)] = True
        words = text.split()
        again = sum(map(str.__eq__, words, words[1:]))  # bigrams of one word twice
        share = again / max(1, len(words) - 1)
        self.seen[BUCKETS : BUCKETS + 1 + int(min(REPEATS - 1, np.ceil(share * 20)))] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


class Model:
    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.ratio2 = (weights * ratio).astype(np.float64), ratio.astype(np.float64) ** 2
        self.bias, self.slope, self.offset = bias, slope, offset

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1e-12, self.ratio2[found].sum())) + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, SIZE))
    for found, label in zip(rows, y):
        counts[label, found] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 0) -> Model:
    """Dual coordinate descent for the squared-norm, hinge-loss model; classes weigh the same in sum."""
    zero = np.zeros(SIZE)
    if len(rows) == 0 or y.min() == y.max():
        return Model(zero, zero, 0.0, 0.0, 0.0 if len(rows) == 0 else 500.0 * (2 * int(y[0]) - 1))
    ratio = log_count_ratio(rows, y)
    norms = [np.sqrt(max(1e-12, (ratio[f] ** 2).sum())) for f in rows]  # values are made anew each time: the driver holds the places alone
    sign, upper = 2.0 * y - 1, cost * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, bias, alpha, rng = np.zeros(SIZE), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f, x = rows[i], ratio[rows[i]] / norms[i]
            gradient = sign[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (2.0 if len(f) else 1.0), 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[f] += step * x
                bias += step
                most, alpha[i] = max(most, abs(step)), new
        if most < 1e-3:
            break
    margins = np.array([w[f] @ (ratio[f] / n) + bias for f, n in zip(rows, norms)])
    slope, offset = logistic(margins, y)
    return Model(w, ratio, bias, slope, offset)


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to chances, by Newton steps with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (target - p) - 1e-6 * theta)
        theta = theta + step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(theta[0])), float(theta[1])


def _features(batches):
    of = Indicators()
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            packed = [of(t).astype("<u4").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(packed, pa.binary())], ["y", "features"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, seed: int = 0) -> Model:
    """``docs(doc_id, text)`` and ``labels(doc_id, y)``: a model from at most ``max_rows`` labelled ids."""
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    joined = docs.join(F.broadcast(sample), "doc_id").select("y", "text").transform(in_arrow, _features, "y int, features binary").toArrow()
    order = pc.sort_indices(joined, [("y", "ascending"), ("features", "ascending")]).to_numpy()  # the same model however the rows arrive
    rows = [np.frombuffer(x.as_buffer(), "<u4") for x in joined.column("features")]  # no copies
    y = np.array(joined.column("y").to_pylist(), dtype=np.int64)
    model = fit([rows[i] for i in order], y[order], seed=seed)
    del rows, joined
    give_back()
    return model


def _score(model):
    def run(batches):
        of = Indicators()
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                scores = [model.value.score(of(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "quality_score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, one of them ``text``, and ``quality_score`` from 0 to 1."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.transform(in_arrow, _score(docs.sparkSession.sparkContext.broadcast(model)), f"{kinds}, quality_score double")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc32_of(key) % 5 == 0, F.lit(False))


def train_on_folds(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality") -> Model:
    """A model from the labelled rows that aren't held out."""
    marks = labels.select(F.col(label_key).alias("doc_id"), F.col(label).alias("y")).where(~held_out())
    return train(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), marks)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    scored = score(rows, train_on_folds(docs, labels))
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    return score(docs, train_on_folds(docs, labels)).where(F.col("quality_score") >= threshold).drop("quality_score")
