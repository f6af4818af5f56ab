"""A quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

A text becomes a set of n-gram indicators: character trigrams, trigrams of
character shapes (letters, capitals, digits, blanks, and every sign as itself),
and 4-grams of whether words repeat the one before; each once it occurs at all,
4, 16 and 64 times. An indicator's value is the log ratio of its smoothed
counts in the two classes. Over these a linear model with hinge loss is fitted
by dual coordinate descent (Hsieh et al., 2008), mixed with its mean weight,
and its margins are turned into probabilities on folds that it did not see.

* Null texts count as empty; an empty text has the indicator of being empty.
* Without labelled rows of both classes every score is the share of label 1
  (0.5 if there is none). Labels other than 0 and 1 are left out.
* Repeated rows get equal scores; an empty table gives no rows; columns other
  than doc_id, text and quality are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.batches import learns_from, map_batches

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
#: Tasks that these rows are dealt out to.
PARTS = 16
BITS = 15
#: Weight of the fitted model against its mean weight, cost of a violated margin, passes.
MIX, COST, PASSES = 0.25, 1.0, 20
THRESHOLD = 0.3
_shapes: np.ndarray | None = None


def _shape_table() -> np.ndarray:
    global _shapes
    if _shapes is None:

        def shape(c: int) -> int:
            x = chr(c)
            return ord("A" if x.isupper() else "a" if x.isalpha() else "0" if x.isdigit() else " " if x.isspace() else x)

        _shapes = np.fromiter(map(shape, range(0x110000)), np.uint32, 0x110000)
    return _shapes


def _hashed(codes: np.ndarray, n: int, salt: int) -> np.ndarray:
    h = np.full(max(0, len(codes) - n + 1), salt * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


def indicators(text: str | None) -> np.ndarray:
    """Sorted numbers of the indicators that hold, below 4 << BITS."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(1, np.int32)
    words = text.split()
    repeats = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), np.uint32, max(0, len(words) - 1))
    grams = np.concatenate([_hashed(codes, 3, 1), _hashed(_shape_table()[codes], 3, 2), _hashed(repeats, 4, 3)])
    counts = np.bincount(grams, minlength=1 << BITS)
    return np.concatenate([np.flatnonzero(counts >= least) + (k << BITS) for k, least in enumerate((1, 4, 16, 64))]).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -40, 40))))


def _support(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Weights (by indicator, times its ratio) and bias of the hinge-loss model."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    norms = np.array([(ratio[r] ** 2).sum() + 1 for r in rows])
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            gradient = y[i] * (w[r] @ ratio[r] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * ratio[r]
                bias += step
                moved = max(moved, abs(step) * norms[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    mixed = (1 - MIX) * np.abs(w[w != 0]).mean() * np.sign(w) + MIX * w if (w != 0).any() else w
    return mixed * ratio, bias


def _ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.ones(4 << BITS), np.ones(4 << BITS)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log((p / ((y > 0).sum() + 2)) / (q / ((y < 0).sum() + 2)))


def train(rows: list[np.ndarray], labels: list[int]) -> Model:
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    if len(set(labels)) < 2:
        share = min(max((float((y > 0).mean()) if len(y) else 0.5), 1e-6), 1 - 1e-6)
        return Model(np.zeros(4 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    # Margins of rows that the model has not seen, from which the probabilities are fitted.
    seen, labels_seen = [], []
    for fold in range(3):
        inside = [k for k in range(len(rows)) if k % 3 != fold]
        if len(set(y[inside])) == 2:
            weights, bias = _support([rows[k] for k in inside], y[inside], _ratio([rows[k] for k in inside], y[inside]), fold)
            seen += [weights[rows[k]].sum() + bias for k in range(len(rows)) if k % 3 == fold]
            labels_seen += [y[k] for k in range(len(rows)) if k % 3 == fold]
    weights, bias = _support(rows, y, _ratio(rows, y), 0)
    slope, shift = _platt(np.array(seen), np.array(labels_seen)) if seen else (1.0, 0.0)
    return Model(weights.astype(np.float32), bias, slope, shift)


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, with Platt's smoothed targets, by Newton steps."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    scale = np.abs(margins).mean() or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0] / scale), 0.0), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows (doc_id, quality); ``sample`` of them, spread by a hash of doc_id.

    No more than ``sample`` labels and ``sample`` rows go to the driver, however often an id repeats.
    """
    ids = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [indicators(x).tobytes() for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], ["doc_id", "quality", "found"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id", "text", "quality").alias("place"), "text")
    chosen = chosen.orderBy("place").limit(sample).drop("place").repartition(PARTS)
    rows = sorted((r.doc_id, r.quality, r.found) for r in map_batches(chosen, run, "doc_id long, quality int, found binary").collect())
    return train([np.frombuffer(x[2], np.int32) for x in rows], [x[1] for x in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(indicators(x)) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned from four fifths of the labelled ids."""
    learns = learns_from("doc_id", 5, 0)
    scored = score(docs, fit(docs, labels.where(learns)))
    return scored.select("doc_id", F.coalesce(~learns, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
