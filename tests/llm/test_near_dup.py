from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from townscribe.llm import near_dup
from townscribe.llm.components import components
from townscribe.llm.shingling import Hasher, windows

from .tables import DOC, awkward, sentence


def shingle_sets(rows):
    out = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    """Component of each document by all pairs that share a shingle."""
    sets, parent = shingle_sets(rows), {}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, v in sets.items():
        for g in v:
            having[g].append(k)
    for k, v in sets.items():
        for other, n in Counter(o for g in v for o in having[g] if o < k).items():
            if 100 * n >= 75 * (len(v) + len(sets[other]) - n):
                a, b = root(k), root(other)
                parent[max(a, b)] = min(a, b)
    return {k: (len(v), root(k)) for k, v in sets.items()}


def test_same_components_as_brute_force(spark):
    rows = awkward()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_group_of_heavily_edited_copies(spark):
    """Members resemble each other at about the threshold: links depend on each pair."""
    import random

    rng = random.Random(3)
    base = sentence(rng, 150, 10_000).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute(rows)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], DOC)
    assert near_dup.near_duplicates(empty).collect() == []
    assert near_dup.keep_one(empty).collect() == []
    rows = [(None, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (4, "a b c d e f", "en", "s", 1), (7, "A b C d e f", "en", "s", 1)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (4, 4, True), (7, 4, False)]


def test_keep_one_with_clashing_columns(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("n", "key", "rep", "node", "component", "a", "b", "count", "kept")})
    got = near_dup.keep_one(df)
    assert got.columns == df.columns
    want = {d for d, (_, c) in brute(rows).items() if d == c}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_pruning_follows_the_posterior():
    assert near_dup.least_matches(20, 0.75, 1e-6) < near_dup.least_matches(20, 0.75, 0.5) <= 20
    # with a uniform prior the posterior of m of n equal lanes is Beta(m + 1, n - m + 1)
    m, n = near_dup.least_matches(40), 40
    draws = np.random.default_rng(0).beta(m + 1, n - m + 1, 200_000)
    assert (draws >= 0.75).mean() < 1e-3


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes_depend_on_words_alone():
    h = Hasher()
    a, at = h.words(["a bb  ccc\n\tDD", None, "", " bb ", "Éa bb"], lower=True)
    b, bt = h.words(["bb", "dd éa"], lower=True)
    assert list(np.diff(at)) == [4, 0, 0, 1, 2] and list(np.diff(bt)) == [1, 2]
    assert a[1] == a[4] == b[0] and a[3] == b[1] and a[5] != b[2]  # only A to Z are lowered
    x = np.arange(1, 200, dtype=np.uint64)
    for width in (1, 2, 3, 5, 25, 50):
        w = windows(x, width)
        assert len(w) == 200 - width
        assert len(set(w.tolist())) == len(w)
        assert (windows(np.concatenate([x[7:90], x[:3]]), width)[: 83 - width + 1] == w[7 : 7 + 83 - width + 1]).all()


def test_buckets_in_blocks(spark, monkeypatch):
    """A bucket's pairs dealt over several tasks are the same pairs."""
    import random

    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = random.Random(4)
    base = sentence(rng, 120, 10_000).split()
    rows = []
    for i in range(90):
        w = base[: rng.randrange(90, 121)]
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute(rows)


def test_hot_classes_stay_where_they_are(spark, monkeypatch):
    from townscribe.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "is_small", lambda df, *a: False)
    monkeypatch.setattr(common, "HOT", 10)
    rows = [(i, "one text that many share, word for word" if i % 3 else f"text number {i} of its own with more words", "en", "s", 0) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute(rows)


def test_text_ids_are_refused(spark):
    import pytest

    df = spark.createDataFrame(awkward()[:5], DOC).withColumn("doc_id", F.lit("a"))
    for f in (near_dup.near_duplicates, near_dup.keep_one):
        with pytest.raises(TypeError):
            f(df)
