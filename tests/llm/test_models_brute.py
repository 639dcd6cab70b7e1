"""Plain Python versions of the three classifiers, row by row, against the operators."""

import math
import random
from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from townscribe.llm import language, quality, toxicity

from .tables import DOC, awkward
from .test_classifiers import brute_segments, corpus

M32 = 2**32 - 1


def buckets(units, lengths, bits):
    """All n-gram buckets of a list of numbers, hashed one by one."""
    out = []
    for n in lengths:
        for i in range(len(units) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 & M32) ^ (units[i + k] + k + 1 & M32)
            h = h * 0x9E3779B1 & M32
            out.append(((h ^ (h >> 15)) * 0x9E3779B1 & M32) >> (32 - bits))
    return out


def short_corpus(n=80):
    rows, labels = corpus(n, seed=5)
    return [(d, " ".join(t.split()[:25]), *r) for d, t, *r in rows], labels


def test_quality_as_plain_python(spark):
    rows, labels = short_corpus()
    docs = spark.createDataFrame(rows, DOC)
    given = spark.createDataFrame([(d, q) for d, q, _ in labels], "doc_id long, label int")
    model = quality.fit(docs, given)
    order = [r[0] for r in given.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    text, label = {d: t for d, t, *_ in rows}, {d: q for d, q, _ in labels}
    found = {d: sorted(set(buckets(list((t or "").encode()), range(1, 5), quality.BITS))) for d, t in text.items()}
    calibrate = order[3::4]
    assert min(sum(label[d] == c for d in calibrate) for c in (0, 1)) < 5  # so few rows that all of them teach
    used = order
    count = [defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)]
    for d in used:
        for x in found[d]:
            count[label[d]][x] += 1
    sums = [sum(c.values()) + (1 << quality.BITS) - len(c) for c in count]
    ratio = lambda x: math.log(count[1][x] / sums[1]) - math.log(count[0][x] / sums[0])
    values = {}
    for d in used:
        v = {x: ratio(x) for x in found[d]}
        size = math.sqrt(sum(y * y for y in v.values()))
        values[d] = {x: y / size for x, y in v.items()}
    w, b, alpha, rng = defaultdict(float), 0.0, dict.fromkeys(used, 0.0), np.random.default_rng(5)
    for _ in range(quality.PASSES):
        moved = 0.0
        for i in rng.permutation(len(used)):
            d = used[i]
            sign = 1.0 if label[d] else -1.0
            g = sign * (sum(w[x] * y for x, y in values[d].items()) + b) - 1
            step = min(max(alpha[d] - g / (sum(y * y for y in values[d].values()) + 1), 0.0), quality.COST) - alpha[d]
            if step:
                alpha[d] += step
                b += step * sign
                for x, y in values[d].items():
                    w[x] += step * sign * y
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    w = {x: y for x, y in w.items() if abs(y) > 1e-9}
    mean = sum(abs(y) for y in w.values() if y) / sum(1 for y in w.values() if y)
    final = {x: quality.BLEND * y + (1 - quality.BLEND) * mean * (y > 0) - (1 - quality.BLEND) * mean * (y < 0) for x, y in w.items()}
    extra = [*rows, *((10_000 + i, *r[1:]) for i, r in enumerate(awkward(4)[:12])), (20_000, None, None, None, None), (20_001, "", None, None, None)]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(extra, DOC), model).collect()}
    for d, t, *_ in extra:
        x = {k: math.log(count[1].get(k, 1.0) / sums[1]) - math.log(count[0].get(k, 1.0) / sums[0]) for k in set(buckets(list((t or "").encode()), range(1, 5), quality.BITS))}
        size = math.sqrt(sum(y * y for y in x.values()))
        margin = b + (sum(final.get(k, 0.0) * y for k, y in x.items()) / size if size else 0.0)
        assert got[d]["margin"] == pytest.approx(margin, abs=1e-6)
        assert got[d]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.slope * margin + model.shift)))), abs=1e-6)


def test_logistic_curve_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = (x + rng.normal(size=300) > 0.3).astype(float)
    slope, bias = toxicity.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(slope * x + bias)))
    assert abs(((y - p) * x).sum() - 1e-3 * slope) < 1e-6 and abs((y - p).sum() - 1e-3 * bias) < 1e-6


def test_toxicity_as_plain_python(spark):
    rows, labels = corpus(300, seed=6)
    rows = [(d, t.replace(" ", ". ", 3), *r) for d, t, *r in rows]
    docs = spark.createDataFrame(rows, DOC)
    given = spark.createDataFrame([(d, t) for d, _, t in labels], "doc_id long, label int")
    model = toxicity.fit(docs, given)
    fold = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(toxicity.FOLDS))).collect()}
    toxic = {d: t for d, _, t in labels}
    sentences = {}
    for d, t, *_ in rows:
        for part in t.lower().replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
            if s := part.strip(" "):
                old = sentences.get(s, (2, 9))
                sentences[s] = (min(old[0], toxic[d]), min(old[1], fold[d]))
    tokens = {}
    for s, (label, f) in sentences.items():
        words = {w for w in "".join(c if c.isalnum() else " " for c in s).split()}
        for t in {x for w in words for x in ("=" + w, *(w[:k] for k in range(3, 9) if len(w) > k))}:
            tokens.setdefault(t, []).append((label, f))
    tested = 1 + sum(any(label for label, _ in v) for v in tokens.values())

    def odds_without(gone):
        size = [sum(label == c and f != gone for label, f in sentences.values()) for c in (0, 1)]
        out = {}
        for t, v in tokens.items():
            y0, y1 = (sum(label == c and f != gone for label, f in v) for c in (0, 1))
            if not y1 or y0 + y1 == sum(size):
                continue
            rate = (y0 + y1) / sum(size)
            g2 = 2 * (y1 * math.log(y1 / (size[1] * rate)) + (y0 * math.log(y0 / (size[0] * rate)) if y0 else 0))
            p1, p0 = (y1 + 2 * rate) / (size[1] + 2), (y0 + 2 * rate + 0.5) / (size[0] + 2)
            odds = math.log(p1 / (1 - p1)) - math.log(p0 / (1 - p0))
            if math.sqrt(max(g2, 0)) >= NormalDist().inv_cdf(1 - toxicity.FALSE_TOKENS / max(tested, 2 * toxicity.FALSE_TOKENS)) and odds >= toxicity.MIN_LOG_ODDS:
                out[t] = odds
        return out

    assert model.tokens == pytest.approx(odds_without(-1)) and "=scum" in model.tokens

    def segments(text, known):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        scores = [max([known.get("=" + w, 0.0), *(known.get(w[:k], 0.0) for k in range(3, 9) if len(w) > k)]) or -toxicity.DRIFT for w in words]
        return len(words), brute_segments(scores, toxicity.DRIFT)

    def evidence(n, segs):
        base = math.log(max(model.k * n, 1e-12))
        kept = [s for *_, s in segs if math.exp(min(700, base - model.lam * s)) <= toxicity.MAX_EXPECTED]
        return model.lam * sum(kept) - base if kept else 0.0

    short = [(d, " ".join((t or "").split()[:40]) if t is not None else None, *r) for d, t, *r in [*rows[:60], *((10_000 + i, *r[1:]) for i, r in enumerate(awkward(5)[-14:]))]]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(short, DOC), model).collect()}
    for d, t, *_ in short:
        e = evidence(*segments(t, model.tokens))
        assert got[d]["evidence"] == pytest.approx(e, abs=1e-6)
        assert got[d]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.slope * e + model.bias)))), abs=1e-6)
    # the curves are fitted on rows scored by the other folds
    apart = [odds_without(f) for f in range(toxicity.FOLDS)]
    m = [(len(s := toxicity.scan(t, {}, toxicity.ToxicModel(apart[fold[d]]))), s) for d, t, *_ in rows]
    n, top = np.array([s[0] for _, s in m]), np.array([max((x for *_, x in s[1]), default=0.0) for _, s in m])
    y = np.array([float(toxic[d]) for d, *_ in rows])
    assert toxicity.fit_tail(n[y == 0], top[y == 0]) == pytest.approx((model.lam, model.k))
    x = np.array([evidence(s[0], s[1]) for _, s in m])
    assert toxicity.fit_logistic(x, y) == pytest.approx((model.slope, model.bias))


def test_language_as_plain_python(spark, monkeypatch):
    rows, _ = short_corpus(60)
    texts, langs = [t for _, t, *_ in rows], [g for _, _, g, *_ in rows]
    model = language.fit(texts, langs)
    rng, names = np.random.default_rng(11), sorted(set(langs))
    bags = []
    for i, (t, g) in enumerate(zip(texts, langs)):
        if i % 5 == 4:
            continue
        for p in language._pieces(t, rng):
            count = defaultdict(int)
            for x in buckets([ord(c) for c in p.lower()], range(1, 5), language.BITS):
                count[x] += 1
            total = sum(count.values())
            bags.append(([(x, n / total) for x, n in sorted(count.items())], names.index(g)))
    emb = rng.normal(0, 1 / language.DIM, (1 << language.BITS, language.DIM)).astype(np.float32).astype(float)
    out, bias, done = np.zeros((language.DIM, len(names))), np.zeros(len(names)), 0
    for _ in range(language.PASSES):
        for i in rng.permutation(len(bags)):
            bag, y = bags[i]
            rate = language.RATE * (1 - done / (language.PASSES * len(bags)))
            done += 1
            mean = sum(s * emb[x] for x, s in bag)
            p = np.exp(mean @ out + bias)
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            for x, s in bag:
                emb[x] -= rate * s * math.sqrt(len(bag)) * back
    assert np.allclose(emb @ out, model.table, atol=1e-3) and np.allclose(bias, model.bias, atol=1e-3)
    monkeypatch.setattr(language, "CHUNK", 64)
    short = [(d, t[:3000] if t else t, *r) for d, t, *r in awkward(6)] + [(500, "½ ² Ⅷ 12 —", None, None, None), (501, "½ a", None, None, None)]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(short, DOC), model).collect()}
    for d, t, *_ in short:
        if not t or not any(c.isalpha() for c in t):
            assert (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, model.threshold > 0)
            continue
        found = buckets([ord(c) for c in t.lower()], range(1, 5), language.BITS)
        z = (sum(model.table[x].astype(float) for x in found) / len(found) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[d]["lang_pred"] == names[int(p.argmax())] and got[d]["score"] == pytest.approx(p.max(), abs=1e-4)
    assert language.predict(spark.createDataFrame([], DOC), model).collect() == []


def test_repeated_ids_teach_once(spark):
    rows, labels = short_corpus(40)
    given = spark.createDataFrame([(d, q) for d, q, _ in labels], "doc_id long, label int")
    many = [r for r in rows for _ in range(3)] + [(rows[0][0], rows[0][1] + " zzz", *rows[0][2:])]
    one, again = quality.fit(spark.createDataFrame(rows, DOC), given), quality.fit(spark.createDataFrame(many, DOC), given)
    assert np.array_equal(one.weight, again.weight) and one.slope == again.slope
    first, second = (language.fit_frame(spark.createDataFrame(r, DOC), F.lit(True)) for r in (rows, many))
    assert np.array_equal(first.table, second.table)
