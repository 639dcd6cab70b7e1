import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from townscribe.llm import line_dedup, substring_dedup
from townscribe.llm.queries import op7_substring_dedup

from .tables import DOC, awkward, sentence


def brute_spans(rows):
    """Kept words of each row: a word goes if a 50-word window over it starts in a smaller document."""
    first = {}
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in words:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((d, len(w), sum(gone), kept))
    return sorted(out)


def overlapping(seed=5):
    """Passages of about 50 words that overlap, nest, and repeat across and inside documents."""
    import random

    rng = random.Random(seed)
    pool = sentence(rng, 400, 10_000).split()
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(0, 330)
            parts += pool[a : a + rng.randrange(40, 70)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 9))]
        rows.append((i, " ".join(parts), "en", "s", 0))
    return rows


def check(spark, rows, **how):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, DOC)).collect())
    assert got == brute_spans(rows)


def test_spans_as_brute_force(spark):
    check(spark, awkward())
    check(spark, overlapping())


def test_spans_when_minimizers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_MINIMIZERS", 0)
    check(spark, overlapping(6))


def test_spans_of_empty_tables_and_null_ids(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], DOC)).collect() == []
    t = " ".join(f"w{i}" for i in range(80))
    got = substring_dedup.dedup(spark.createDataFrame([(None, t, "en", "s", 1), (3, t, "en", "s", 1), (9, t, "en", "s", 1)], DOC), digest=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (3, 0), (9, 80)]
    assert {r["kept"] for r in got} == {hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()}


def test_spans_over_many_shards_and_tasks(spark, monkeypatch):
    for name, value in (("SHARD", 90), ("PIECE", 64), ("TASK_ROWS", 3)):
        monkeypatch.setattr(substring_dedup, name, value)
    check(spark, overlapping(7))
    check(spark, awkward(8))


def test_spans_of_the_sample_table(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op7_substring_dedup(spark, data.replace("sf0.001", "sf0.01")).collect()}
    assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_spans(rows)}
    assert sum(k for _, k, _ in got.values()) > 1000


def test_spans_with_extra_columns_long_texts_and_text_ids(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "en", "s", 0), (2, f"start {long} end", "en", "s", 0)], DOC)
    df = df.withColumns({c: F.lit(1) for c in ("spans", "_doc", "_key", "shard", "owner", "k1", "text_key", "_copy")})
    assert sorted((r["doc_id"], r["n_removed"], r["kept"][-9:]) for r in substring_dedup.dedup(df).collect()) == [(1, 0, long[-9:]), (2, 60_000, "start end")]
    with pytest.raises(TypeError):
        substring_dedup.dedup(df.withColumn("doc_id", F.lit("a")))


LETTERS = st.lists(st.integers(0, 3), max_size=40)


@settings(max_examples=120, deadline=None)
@given(st.lists(LETTERS, max_size=4), LETTERS, st.integers(1, 5))
def test_matching_statistics(references, query, span):
    auto = substring_dedup.SuffixAutomaton()
    for owner, words in enumerate(references):
        auto.add(words, owner)
    auto.close(span)
    owned = {}
    for owner, r in enumerate(references):
        for i in range(len(r)):
            for j in range(i + 1, len(r) + 1):
                owned.setdefault(tuple(r[i:j]), owner)
    want = [max((n for n in range(i + 2) if n == 0 or tuple(query[i + 1 - n : i + 1]) in owned), default=0) for i in range(len(query))]
    assert [n for n, _ in auto.statistics(query)] == want
    for before in range(len(references) + 1):
        gone = {k for i in range(len(query) - span + 1) if owned.get(tuple(query[i : i + span]), before) < before for k in range(i, i + span)}
        spans = auto.spans(query, before, span)
        assert {k for a, z in spans for k in range(a, z)} == gone and all(z < a for (_, z), (a, _) in zip(spans, spans[1:]))


def brute_lines(rows, ratio, least):
    pages, having = Counter(), defaultdict(Counter)
    for _, text, _, host, _ in rows:
        pages[host] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            having[host][line] += 1
    out = []
    for d, text, _, host, _ in rows:
        if text is None:
            out.append((d, None, 0))
            continue
        kept = [x for x in text.split("\n") if not (having[host][x.strip(" ")] >= least and having[host][x.strip(" ")] > ratio * pages[host])]
        out.append((d, "\n".join(kept), len(text.split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_lines_as_brute_force(spark):
    rows = awkward()
    rows = [(d, t if t is None or i % 2 else f"Menu\n{t}\n  Menu  \nFooter", *r) for i, (d, t, *r) in enumerate(rows)]
    df = spark.createDataFrame(rows, DOC)
    got = sorted(((r["doc_id"], r["kept_text"], r["n_dropped"]) for r in line_dedup.apply(df, ratio=0.3).collect()), key=str)
    assert got == brute_lines(rows, 0.3, line_dedup.MIN_PAGES)
    assert any(n for _, _, n in got)


def test_lines_with_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame(awkward(), DOC).withColumns({c: F.lit(7) for c in ("_host", "_lines", "_key", "_n", "_drop", "_kept", "line")})
    got = line_dedup.apply(df)
    assert set(df.columns) < set(got.columns) and got.count() == df.count() and got.where("_lines <> 7").count() == 0
    assert line_dedup.apply(spark.createDataFrame([], DOC)).collect() == []
