"""Document quality by Naive Bayes support vectors.

Indicators of byte n-grams are scaled by the classes' log-count ratios and brought to unit
length; a linear hinge-loss model is fitted to them by dual coordinate descent, and its
weights are blended with their mean magnitude.  A logistic curve, fitted on labelled rows
that the model was not, turns the margin into a probability.

The model is fitted on a bounded sample of the labelled rows (``MAX_LABELLED``); every
document, however long, is scored on its whole text.  A null text is empty; an empty text has no
n-grams and the bias alone as its margin.  Without both classes in the sample the score is the share
of label 1 (1 if there is no label).  Of rows that repeat a doc_id the least text teaches, so the
sample has one text an id.  Repeated rows are scored each; an empty table gives an empty one; extra
columns, whatever they are called, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .ngrams import code_bytes, hashed
from .toxicity import fit_logistic

#: Labelled rows the model is fitted on at most.
MAX_LABELLED = 5_000
BITS = 18
LENGTHS = range(1, 5)
#: Pseudo-count of the log-count ratios, cost of the hinge loss, passes, share of the fitted weights.
ALPHA, COST, PASSES, BLEND = 1.0, 1.0, 15, 0.75


def features(text: str | None, mark: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of a text, each once; ``mark`` is a zeroed scratch array of bool."""
    for _, at in hashed(code_bytes(text or ""), LENGTHS, BITS):
        mark[at] = True
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


@dataclass
class QualityModel:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 20.0

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        norm = float(np.sqrt(r @ r))
        return float(self.weight[found] @ r) / norm + self.bias if norm else self.bias

    def probability(self, margins) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margins, float) + self.shift, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = (np.full(1 << BITS, ALPHA) for _ in range(2))
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    return np.log(p / np.abs(p).sum()) - np.log(q / np.abs(q).sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min 1/2 |w|^2 + C sum max(0, 1 - y (w x + b)); the bias is a constant feature."""
    w, b = np.zeros(1 << BITS), 0.0
    sign = np.where(y > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            g = sign[i] * (w[rows[i]] @ values[i] + b) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * sign[i] * values[i]
                b += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from ``labels`` (doc_id, label), a bounded table, and the texts of ``docs``."""
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    mark = np.zeros(1 << BITS, dtype=bool)
    rows = [features(t, mark).astype(np.int32) for t in sample.column("text").to_pylist()]
    y = np.array(sample.column("label").to_pylist(), dtype=float)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(1 << BITS), np.zeros(1 << BITS), shift=-20.0 if len(y) and y[0] == 0 else 20.0)
    # every fourth row calibrates; a small sample calibrates on what it was fitted on
    kept = np.arange(len(y)) % 4 != 3 if min((y[3::4] == c).sum() for c in (0, 1)) >= 5 else np.ones(len(y), dtype=bool)
    ratio = log_count_ratio([r for r, k in zip(rows, kept, strict=True) if k], y[kept])
    values = []
    for r in rows:
        v = ratio[r]
        n = np.sqrt(v @ v)
        values.append(v / n if n else v)
    w, b = dual_coordinate_descent([rows[i] for i in np.flatnonzero(kept)], [values[i] for i in np.flatnonzero(kept)], y[kept])
    # what came back to nothing is nothing: its sign would be rounding
    used = np.abs(w) > 1e-9
    w = np.where(used, w, 0.0)
    w = BLEND * w + (1 - BLEND) * np.abs(w[used]).mean() * np.sign(w) if used.any() else w
    model = QualityModel(ratio, w, b)
    check = np.flatnonzero(~kept) if not kept.all() else np.arange(len(y))
    model.slope, model.shift = fit_logistic(np.array([model.margin(rows[i]) for i in check]), y[check])
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, margin) of every row of ``docs``."""
    shipped = common.ship(docs.sparkSession, model)
    plain = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mark = shipped(), np.zeros(1 << BITS, dtype=bool)
        for b in batches:
            margins = np.array([m.margin(features(t, mark)) for t in b.column("text").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.probability(margins)), pa.array(margins)], ["doc_id", "score", "margin"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double, margin double")
