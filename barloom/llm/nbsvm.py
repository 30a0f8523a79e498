"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a linear hinge-loss model.

The symbols of a text are the bytes of its words; a word equal to the one before it and a line equal to an earlier one are each replaced by
a single control byte, so that repetition shows in the n-grams. The n-grams of one to three symbols are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import remainder, texts

BITS = 18
#: Most labelled rows the model is fitted on (those with the smallest hash of the id); a documented bound, not a share.
SAMPLE = 8_192
THRESHOLD = 0.3
_BLOCK = 1 << 20
_SAME_WORD, _SAME_LINE = b"\x01", b"\x02"
_MUL = np.uint32(0x9E3779B1)


def symbols(text: bytes) -> bytes:
    """The text with repeated words and lines replaced by their marks and white space by single spaces."""
    seen, out = set(), []
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            out.append(_SAME_LINE)
            continue
        seen.add(line)
        out.extend(words[:1])
        out.extend([_SAME_WORD if b == a else b for a, b in zip(words, words[1:])])
    return b" ".join(out)


class Indicators:
    """Distinct hashed n-grams of a text, by marks in a table of 2**BITS places that is cleared after each text."""

    def __init__(self):
        self.marks = np.zeros(1 << BITS, bool)

    def of(self, text: bytes) -> np.ndarray:
        s = symbols(text)
        for start in range(0, len(s), _BLOCK):
            b = np.frombuffer(s[start : start + _BLOCK + 2], np.uint8).astype(np.uint32)
            code = b + np.uint32(1)
            for n in (1, 2, 3):
                if n > 1:
                    code = code[:-1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
                if not len(code):
                    break
                self.marks[(code * _MUL) >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(self.marks)
        self.marks[found] = False
        return found


@dataclass(frozen=True)
class Model:
    scale: np.ndarray  # log-count ratio of each hashed n-gram
    weights: np.ndarray  # ratio times weight
    bias: float
    slope: float = 1.0  # of the logistic curve that turns margins into scores
    shift: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        s = self.scale[found]
        return float(self.weights[found].sum()) / max(float(np.sqrt(s @ s)), 1e-12) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -40, 40))))


def ratios(rows: list[np.ndarray], good: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of the n-grams' share among good texts over that among bad ones, counting texts, smoothed by `alpha`."""
    logs = []
    for side in (True, False):
        counts = np.full(1 << BITS, alpha)
        for r, y in zip(rows, good):
            if y == side:
                counts[r] += 1  # a text holds each n-gram once
        logs.append(np.log(counts / counts.sum()))
    return logs[0] - logs[1]


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear L1-loss support vector machine, by dual coordinate descent.

    Each row is its scaled indicators, brought to unit length, and a constant 1. The dual variable of a row stays in [0, c].
    """
    w, bias, alpha, rng = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    x = [(scale[r] / max(np.linalg.norm(scale[r]), 1e-12)).astype(np.float32) for r in rows]
    norms = np.array([float(v @ v) + 1.0 for v in x])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c[i])
            if (step := new - alpha[i]) != 0.0:
                w[rows[i]] += step * y[i] * x[i]
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def calibrated(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, with the usual smoothed targets, by Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * margins * margins).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * margins).sum(), g.sum()])
        size = max(1.0, float(np.abs(step).max()) / 2)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """The model from indicator rows and labels; without both classes every text gets the smoothed share of good ones.

    Every fifth row is left out of the fit and places the logistic curve.
    """
    good = np.asarray(good, bool)
    if not len(rows) or good.all() or not good.any():
        share, none = (good.sum() + 1) / (len(rows) + 2), np.zeros(1 << BITS)
        return Model(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % 5 == 4
    if any(side.all() or not side.any() for side in (good[held], good[~held])):
        held[:] = False
    fit, test = [r for r, h in zip(rows, held) if not h], [r for r, h in zip(rows, held) if h or not held.any()]
    y = np.where(good[~held], 1.0, -1.0)
    scale = ratios(fit, good[~held])
    cost = np.where(y > 0, 1.0, (y > 0).sum() / (y < 0).sum())  # both classes weigh alike
    w, bias = descend(fit, scale, y, cost)
    model = Model(scale, scale * w, bias)
    return replace(model, **dict(zip(("slope", "shift"), calibrated(np.array([model.margin(r) for r in test]), good[held] if held.any() else good))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, held_fold: int = 0) -> Model:
    """Fits on at most `sample` rows of `docs(doc_id, text)` whose label is known and whose id is not in the held-out fold.

    The sample is drawn from the labels by a hash of the id, so only its ids (bounded) are sent to the tasks and no text
    is shuffled. A document with several labels is good only if all say so; other labels than 0 and 1 and null ids are left out.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id", folds) != held_fold))
        .groupBy("doc_id").agg(F.min("quality").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Indicators()
        for batch in batches:
            data = [found.of(t).astype(np.uint32).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(data, pa.binary())], ["doc_id", "good", "found"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(indicators, f"doc_id {kind}, good int, found binary").toArrow()
    # a fixed order: neither the split for the curve nor the descent may depend on which task came first
    order = sorted(range(got.num_rows), key=lambda i: (xxhash.xxh64_intdigest(str(got["doc_id"][i].as_py())), got["found"][i].as_py()))[:sample]
    return train([np.frombuffer(got["found"][i].as_py(), np.uint32) for i in order], np.array([got["good"][i].as_py() for i in order], bool))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, score, predicted` for every row of `docs(doc_id, text)`.

    Null counts as the empty text, whose score is that of no n-grams. Repeated rows are scored one by one, null ids
    too; other columns are not looked at; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Indicators()
        for batch in batches:
            scores = [shared.value.score(found.of(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    source = docs.select("doc_id", "text")
    out = source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the model predicts to be good, with their columns and no others."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Indicators()
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(found.of(t)) >= threshold for t in texts(batch, at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
