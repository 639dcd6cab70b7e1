import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from townscribe.llm import common, language, quality, queries, toxicity

from .tables import DOC, awkward

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=2):
    """Plain, shouting (low quality) and insulting (toxic) texts in two made-up languages."""
    rng = random.Random(seed)
    syllables = {"xx": ["ta", "ri", "mo", "len"], "yy": ["sch", "un", "keit", "ber"]}
    rows, labels = [], []
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        low, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        text = " ".join(f"{w.upper()}!!" for w in words) if low else " ".join(words)
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, 0 if low else 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    at = tmp_path_factory.mktemp("corpus")
    extra = [(10_000 + i, t, None, None, None) for i, (_, t, *_) in enumerate(awkward()[-12:])] + [(None, "no id", None, None, None)]
    spark.createDataFrame(rows + extra, DOC).withColumn("label", F.lit("clash")).withColumn("score", F.lit(2)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (0, 0, 1), (5, None, None), (None, 1, 1)], LABELS).write.parquet(f"{at}/labels.parquet")
    return str(at), rows, {d: (q, t) for d, q, t in labels}


def held(doc, n, k):
    return zlib.crc32(str(doc).encode()) % n == k


def test_quality_held_out(spark, folder):
    at, rows, labels = folder
    got = queries.op2_quality(spark, at).collect()
    assert len(got) == len(rows) + 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in got if r["doc_id"] is not None)
    right = [r["predicted"] == labels[r["doc_id"]][0] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(right) > 100 and np.mean(right) > 0.97


def test_toxicity_held_out(spark, folder):
    at, rows, labels = folder
    got = queries.op8_toxicity(spark, at).collect()
    assert len(got) == len(rows) + 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in got if r["doc_id"] is not None)
    right = [r["predicted"] == labels[r["doc_id"]][1] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(right) > 60 and np.mean(right) > 0.97


def test_language_held_out(spark, folder):
    at, rows, _ = folder
    lang = {d: g for d, _, g, *_ in rows}
    got = queries.op10_language(spark, at).collect()
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in lang]
    assert len(right) > 100 and np.mean(right) > 0.99
    by = {r["doc_id"]: r for r in got}
    for d, t, *_ in awkward()[-12:]:
        pass
    texts = {10_000 + i: t for i, (_, t, *_) in enumerate(awkward()[-12:])}
    for d, t in texts.items():
        unknown = not t or not any(c.isalpha() for c in t)
        assert (by[d]["lang_pred"] == "und") == unknown and 0 <= by[d]["score"] <= 1


def test_nothing_to_learn_from(spark):
    docs, none = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, label int")
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()] == pytest.approx([1, 1])
    assert [round(r["score"], 6) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
    model = language.fit_frame(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} == {"und"}
    empty = spark.createDataFrame([], DOC)
    assert quality.score(empty, quality.fit(empty, none)).collect() == [] and toxicity.score(empty, toxicity.fit(empty, none)).collect() == []


def test_labels_are_bounded_and_unique(spark):
    labels = spark.createDataFrame([(i // 2, i % 2, None) for i in range(100)], LABELS)
    got = common.bounded_labels(labels, "quality", F.lit(True), 20).collect()
    assert len(got) == 20 and all(r["label"] == 1 for r in got)


def brute_segments(scores, drift):
    """Maximal scoring segments by their definition, recursively: the best segment, then both sides of it."""

    def of(a, z):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return [*of(a, i), (i, j, best[0]), *of(j, z)]

    return of(0, len(scores))


def test_segments_as_defined():
    rng = random.Random(9)
    for _ in range(200):
        raw = [(i, rng.choice([1.0, 2.5, 4.0])) for i in range(rng.randrange(0, 30)) if rng.random() < 0.3]
        n = (raw[-1][0] + 1) if raw else 0
        full = [-0.7] * n
        for i, s in raw:
            full[i] = s
        got = toxicity.segments(raw, 0.7)
        want = brute_segments(full, 0.7)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_tail_recovers_its_parameters():
    rng = np.random.default_rng(3)
    n = rng.integers(50, 2000, 20_000)
    lam, k = 0.8, 2e-3
    s = np.maximum(0, (np.log(k * n) - np.log(-np.log(rng.random(len(n))))) / lam)
    got = toxicity.fit_tail(n, s)
    assert got == (pytest.approx(lam, rel=0.05), pytest.approx(k, rel=0.1))


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = (x @ np.array([1, -2, 0.5, 0]) + 0.3 * rng.normal(size=60) > 0).astype(float)
    rows, values = [np.arange(4)] * 60, list(x)
    w, b = quality.dual_coordinate_descent(rows, values, y, cost=0.5, passes=3000)
    sign = np.where(y > 0, 1, -1)

    def primal(w4, b):
        return 0.5 * (w4 @ w4 + b * b) + 0.5 * np.maximum(0, 1 - sign * (x @ w4 + b)).sum()

    best = primal(w[:4], b)
    for _ in range(300):
        assert primal(w[:4] + 0.05 * rng.normal(size=4), b + 0.05 * rng.normal()) >= best - 1e-2
