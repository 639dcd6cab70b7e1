"""Language identification by averaged hashed subword embeddings and a linear softmax.

The vectors of a text's character n-grams (1 to 4, hashed to buckets) are averaged and go
through a linear softmax; both are trained by stochastic gradient descent in numpy on the whole
texts of a bounded sample and, so that short texts are learnt too, on a few pieces of each.  A temperature, fitted on texts held back, calibrates
the probabilities; texts whose best language is less likely than a threshold are rejected.
The threshold is the lowest that keeps the held-back error of what is accepted within
``MAX_ERROR``.

Texts are read whole, long ones in overlapping runs.  A null text, or one without a letter
(str.isalpha), is "und" with score 0; a rejected text keeps its best language and has rejected =
true.  Without labelled rows every text is "und".  Of rows that repeat a doc_id the least (lang,
text) teaches; null ids teach nothing.  Languages that tie go to the first by name.  Repeated rows
are predicted each; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .ngrams import code_points, hashed

#: Labelled texts the model is fitted on at most.
MAX_LABELLED = 3_000
BITS, DIM = 15, 16
LENGTHS = range(1, 5)
PIECE, PIECES = 300, 4
PASSES, RATE = 4, 0.5
MAX_ERROR = 0.005
UNKNOWN = "und"
#: Characters of a run over which n-grams are summed at a time.
CHUNK = 1 << 20


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # buckets by languages: embeddings times softmax weights
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        x = code_points(text.lower())
        total, n = np.zeros(len(self.langs)), 0
        for a in range(0, len(x), CHUNK):
            for k, at in hashed(x[a : a + CHUNK + LENGTHS.stop - 2], LENGTHS, BITS):
                at = at[:CHUNK]
                total += np.bincount(at, minlength=1 << BITS).astype(np.float32) @ self.table if len(at) > 1 << 14 else self.table[at].sum(axis=0, dtype=np.float64)
                n += len(at)
        return total / max(n, 1) + self.bias

    def probabilities(self, text: str) -> np.ndarray:
        z = self.logits(text) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = [at for _, at in hashed(code_points(text.lower()), LENGTHS, BITS)]
    at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
    return at.astype(np.uint16), (n / max(n.sum(), 1)).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    """A text and a few pieces of it, of several sizes."""
    out = [text]
    for size in (PIECE, PIECE // 4)[: 1 + (len(text) > PIECE // 4)]:
        for _ in range(min(PIECES, 1 + len(text) // size)):
            a = int(rng.integers(0, max(1, len(text) - size + 1)))
            out.append(text[a : a + size])
    return out


def fit(texts: list[str], langs: list[str], seed: int = 11) -> LanguageModel:
    """A model from texts and their languages."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel()
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(names)}
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), dtype=bool)
    train = [(_bag(p), number[g]) for t, g, h in zip(texts, langs, held, strict=True) if not h for p in _pieces(t, rng)]
    emb = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    done, total = 0, PASSES * len(train)
    for _ in range(PASSES):
        for i in rng.permutation(len(train)):
            (at, share), y = train[i]
            rate = RATE * (1 - done / total)
            done += 1
            mean = share @ emb[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            emb[at] -= rate * np.outer(share * len(at) ** 0.5, back)
    model = LanguageModel(names, (emb @ out).astype(np.float32), bias.astype(np.float64))
    check = [(t, number[g]) for t, g, h in zip(texts, langs, held, strict=True) if h and has_letter(t)]
    if check:
        z = np.array([model.logits(t) for t, _ in check])
        y = np.array([g for _, g in check])

        def loss(t: float) -> float:
            s = z / t - (z / t).max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.05, 5, 40), key=loss)
        s = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        best, right = s.max(axis=1), s.argmax(axis=1) == y
        order = np.argsort(-best)
        wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
        fine = np.flatnonzero(wrong <= MAX_ERROR)
        model.threshold = float(best[order][fine[-1]]) if len(fine) else 1.0
        if len(fine) == len(y):
            model.threshold = float(min(best.min(), 0.5))
    return model


def fit_frame(docs: DataFrame, keep: Column, bound: int = MAX_LABELLED) -> LanguageModel:
    """A model from at most ``bound`` rows of ``docs`` (doc_id, text, lang) where ``keep`` holds."""
    labelled = docs.where(keep & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(bound)
    one = labelled.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").select("r.text", "r.lang").toArrow()
    return fit(sample.column("text").to_pylist(), sample.column("lang").to_pylist())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of ``docs``."""
    shipped = common.ship(docs.sparkSession, model)
    plain = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped()
        for b in batches:
            names, scores = [], []
            for t in b.column("text").to_pylist():
                if not t or not m.langs or not has_letter(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = m.probabilities(t)
                i = int(p.argmax())
                names.append(m.langs[i])
                scores.append(float(p[i]))
            low = [s < m.threshold for s in scores]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
