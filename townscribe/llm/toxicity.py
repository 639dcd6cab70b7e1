"""Toxic passages by maximum-scoring segments over token log-odds.

1. Token log-odds: sentences of a bounded labelled sample, each distinct sentence
   once (so copies do not count twice; a sentence that any clean document has is
   clean), give counts of words and word beginnings in toxic and clean text.  Their
   log-odds carry a Dirichlet prior centred on the pooled rate, and are kept where a
   likelihood-ratio test finds them significant, at a level that lets FALSE_TOKENS of all that
   were tested pass by chance.
2. A linear-time scan (Ruzzo and Tompa) finds every maximal scoring segment of a
   document; ordinary words cost a constant drift.
3. Extreme values: clean documents give lambda and K of
   P(max > s) = 1 - exp(-K n exp(-lambda s)); a passage is significant if its expected
   number in clean text of that length is at most ``max_expected``.  The scores of the
   significant passages add up, and their sum, normalised like one score (lambda times it,
   less ln(K n)), is a document's evidence, which a logistic curve turns into a probability.
   Both curves are fitted on scores that each row gets from the log-odds of the other folds'
   sentences (FOLDS folds of rows by their text), so no row calibrates what it taught.

Null or empty texts have no words: no passage and the score of no evidence.  Labels on
repeated ids count once (the largest); null labels and ids teach nothing.  Texts are scanned whole,
however long.  Of tied prefixes of a word the largest log-odds counts.  Repeated rows of documents
are scored each; an empty table gives an empty one; extra columns are ignored by ``score`` and kept by
``keep_clean``.  An untrainable sample (one class only) gives score 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows the model is fitted on at most.
MAX_LABELLED = 12_000
#: Word beginnings of these lengths are tokens beside the whole word.
PREFIXES = range(3, 9)
#: Tokens expected to pass the likelihood-ratio test by chance, and a token's least log-odds.
FALSE_TOKENS, MIN_LOG_ODDS = 10, 1.5
#: Parts of the sample, each scored with the log-odds of the others.
FOLDS = 4
#: Nats that a word without evidence takes from a segment.
DRIFT = 0.3
MAX_EXPECTED = 0.5
TOKEN = re.compile(r"[^\W_]+")


@dataclass
class ToxicModel:
    tokens: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1e-3
    slope: float = 0.0
    bias: float = -20.0

    def word_score(self, word: str) -> float:
        got = self.tokens.get("=" + word, 0.0)
        for n in PREFIXES:
            if len(word) <= n:
                break
            got = max(got, self.tokens.get(word[:n], 0.0))
        return got

    def probability(self, evidence):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.asarray(evidence, float) + self.bias, -30, 30)))


def word_tokens(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, past the last word, score).

    ``scores`` are (position, positive score) in order; every other word costs ``drift``.
    One pass with a stack: amortised linear time.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, past, sum before, sum after
    total, at = 0.0, 0
    for pos, s in scores:
        total -= drift * (pos - at)
        first, before = pos, total
        total += s
        at = pos + 1
        after = total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= after:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, pos + 1, before, after))
    return [(a, b, y - x) for a, b, x, y in stack]


def scan(text: str | None, known: dict[str, float], model: ToxicModel) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words and the maximal scoring segments of a text; ``known`` caches word scores."""
    found, n = [], 0
    for n, w in enumerate(TOKEN.findall((text or "").lower()), 1):
        s = known.get(w)
        if s is None:
            if len(known) > 400_000:
                known.clear()
            s = known[w] = model.word_score(w)
        if s:
            found.append((n - 1, s))
    return n, segments(found)


def evidence(n: int, segs: list[tuple[int, int, float]], model: ToxicModel, most: float = MAX_EXPECTED):
    """Significant passages (first, past, score, expected number in clean text) and the document's evidence."""
    base = math.log(max(model.k * n, 1e-12))
    passages = [(a, b, s, math.exp(min(700.0, base - model.lam * s))) for a, b, s in segs if base - model.lam * s <= math.log(most)]
    return passages, model.lam * sum(s for _, _, s, _ in passages) - base if passages else 0.0


def fit_tail(n: np.ndarray, s: np.ndarray) -> tuple[float, float]:
    """lambda and K by maximum likelihood from clean documents' lengths and largest scores (0: none)."""
    n, s = np.maximum(n.astype(float), 1.0), s.astype(float)
    pos = s > 0
    if pos.sum() < 3:
        return 1.0, 1.0 / max(n.sum(), 1.0)

    def k_of(lam: float) -> float:
        return pos.sum() / np.sum(n * np.exp(-lam * s))

    def slope(lam: float) -> float:
        return pos.sum() / lam - s[pos].sum() + k_of(lam) * np.sum(n * s * np.exp(-lam * s))

    lo, hi = 0.05, 5.0
    if slope(lo) <= 0:
        return lo, k_of(lo)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    return lo, k_of(lo)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton steps with a small ridge."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.array([1e-3, 1e-3])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, fold, toxic, clean): sentences that have the token."""
    counts: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        cols = [*zip(*counts, strict=True)] or [(), ()]
        tallies = [*zip(*counts.values(), strict=True)] or [(), ()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(tallies[1], pa.int64()), pa.array(tallies[0], pa.int64())], ["token", "fold", "toxic", "clean"])

    for b in batches:
        for sentence, label, fold in zip(*(b.column(c).to_pylist() for c in ("sentence", "label", "fold")), strict=True):
            seen = {t for w in set(TOKEN.findall(sentence)) for t in word_tokens(w)}
            seen.add("")  # counts sentences
            at = 1 if label else 0
            for t in seen:
                got = counts.get((t, fold))
                if got is None:
                    got = counts[t, fold] = [0, 0]
                got[at] += 1
        if len(counts) > 300_000:
            yield out()
    yield out()


def _log_odds(y1: Column, y0: Column, n1: float, n0: float, tested: int) -> Column:
    """Log-odds of a token with these counts, null if it is not significant."""
    rate = (y1 + y0) / (n1 + n0)
    xlog = lambda y, e: F.when(y > 0, y * F.log(y / e)).otherwise(0.0)
    g2 = 2 * (xlog(y1, n1 * rate) + xlog(y0, n0 * rate))
    # Dirichlet prior: two sentences at the pooled rate for each class, and half a sentence of any token
    p1, p0 = (y1 + 2 * rate) / (n1 + 2), (y0 + 2 * rate + 0.5) / (n0 + 2)
    odds = F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))
    least = NormalDist().inv_cdf(1 - FALSE_TOKENS / max(tested, 2 * FALSE_TOKENS))
    return F.when((y1 > 0) & (y1 + y0 < n1 + n0) & (F.sqrt(F.greatest(g2, F.lit(0.0))) >= least) & (odds >= MIN_LOG_ODDS), odds)


def token_log_odds(train: DataFrame) -> list[dict[str, float]]:
    """Log-odds of the significant tokens from (text, label, fold) rows: of all folds, then of all but each one.  Counted on the executors."""
    sentences = (
        train.select(F.explode(F.split(F.lower("text"), "[.!?\\n]+")).alias("sentence"), "label", "fold")
        .select(F.trim("sentence").alias("sentence"), "label", "fold")
        .where("sentence <> ''")
        .groupBy("sentence")
        .agg(F.min("label").alias("label"), F.min("fold").alias("fold"))
    )
    counts = sentences.mapInArrow(_count_tokens, "token string, fold int, toxic long, clean long")
    folds = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in ("toxic", "clean") for f in range(FOLDS)]
    counts = common.materialize(counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *folds).where("toxic > 0"), "token-counts")
    all_of = counts.where("token = ''").first()
    none: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    if all_of is None or not all_of["clean"]:
        return none
    tested = counts.count()
    odds = [_log_odds(F.col("toxic").cast("double"), F.col("clean").cast("double"), float(all_of["toxic"]), float(all_of["clean"]), tested).alias("o0")]
    for f in range(FOLDS):
        n1, n0 = (float(all_of[c] - all_of[f"{c}{f}"]) for c in ("toxic", "clean"))
        left = [(F.col(c) - F.col(f"{c}{f}")).cast("double") for c in ("toxic", "clean")]
        odds.append((_log_odds(*left, n1, n0, tested) if n1 and n0 else F.lit(None).cast("double")).alias(f"o{f + 1}"))
    best = counts.where("token <> ''").select("token", *odds)
    # bounded by the sample's words: what passes the test is far less
    for r in best.where(F.coalesce(*(c for c in best.columns if c != "token")).isNotNull()).collect():
        for i in range(FOLDS + 1):
            if r[f"o{i}"] is not None:
                none[i][r["token"]] = r[f"o{i}"]
    return none


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """A model from ``labels`` (doc_id, label), a bounded table, and the texts of ``docs``."""
    spark = docs.sparkSession
    train = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id")
    # copies fall into one fold
    train = common.materialize(train.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")), "toxic-train")
    whole, *others = token_log_odds(train)
    model = ToxicModel(whole)
    if not whole:
        return model
    shipped = common.ship(spark, [ToxicModel(t) for t in others])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shipped()
        known: list[dict[str, float]] = [{} for _ in models]
        for b in batches:
            got = [scan(t, known[f], models[f]) for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"n": pa.array([n for n, _ in got], pa.int64()), "scores": pa.array([[s for _, _, s in segs] for _, segs in got], pa.list_(pa.float64())), "label": b.column("label")})

    rows = train.mapInArrow(measure, "n long, scores array<double>, label int").toPandas()
    n, y = rows["n"].to_numpy(), rows["label"].to_numpy().astype(float)
    top = np.array([max(s, default=0.0) for s in rows["scores"]])
    model.lam, model.k = fit_tail(n[y == 0], top[y == 0])
    x = np.array([evidence(int(k), [(0, 0, v) for v in s], model)[1] for k, s in zip(n, rows["scores"], strict=True)])
    model.slope, model.bias = fit_logistic(x, y)
    return model


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` (doc_id, text, ...) with toxic_score, toxic_evidence, toxic_passages (words from, to, score, expected)."""
    shipped = common.ship(docs.sparkSession, model)
    plain = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shipped(), {}
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("past_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for b in batches:
            got = [evidence(*scan(t, known, m), m) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"),
                "score": pa.array(m.probability([e for _, e in got]) if got else [], pa.float64()),
                "evidence": pa.array([e for _, e in got], pa.float64()),
                "passages": pa.array([[{"first_word": a, "past_word": z, "score": s, "expected": x} for a, z, s, x in p] for p, _ in got], kind),
            })

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, score double, evidence double, passages array<struct<first_word:long,past_word:long,score:double,expected:double>>")


def keep_clean(docs: DataFrame, model: ToxicModel, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose probability of being toxic is under ``at``."""
    shipped = common.ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shipped(), {}
        for b in batches:
            p = m.probability([evidence(*scan(t, known, m), m)[1] for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            yield b.filter(pa.array(p < at))

    return docs.mapInArrow(run, docs.schema)
