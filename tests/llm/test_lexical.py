import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from townscribe.llm import lexical, queries

from .tables import DOC, awkward, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def own_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """{item place: [(score, doc_id)]}"""
    counts = [(d, Counter(own_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, all_terms = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = {}
    for i, text in enumerate(items):
        scores = []
        for d, c, size in counts:
            m = 50 + 50 * size * n // all_terms
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(own_terms(text)) if t in c)
            if s > 0:
                scores.append((s, d))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out[i] = scores[:k]
    return out


def searched(spark, docs, items, k=5, **more):
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOC).repartition(3)
    got = lexical.search(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), k, **more).collect()
    out = {i: [] for i in range(len(items))}
    for r in sorted(got, key=lambda r: (r["item_id"], r["rank"])):
        out[r["item_id"]].append((r["score"], r["doc_id"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


ITEMS = ["w1 w2 w3 w4", "W7, w7; (w9)", None, "", "...", "nothing here", "Ünïcode ẞtraße 🙂", "two words " * 50, "w1 w2 w3 w4"]


@pytest.mark.parametrize("more", [{}, {"shard_postings": 200}, {"block_bytes": 60}])
def test_awkward_rows_equal_brute_force(spark, more):
    docs = [(r[0], r[1]) for r in awkward()] + [(None, "w1 w2 w3 w4"), (None, "w7")]
    assert searched(spark, docs, ITEMS, **more) == brute(docs, ITEMS, 5)


def test_ties_and_few_documents(spark):
    docs = [(i, "same words here") for i in (9, 3, 7, 1)] + [(None, "same words here"), (5, "other")]
    got = searched(spark, docs, ["same", "other thing", "words here"], 3)
    assert got == brute(docs, ["same", "other thing", "words here"], 3)
    assert [d for _, d in got[0]] == [1, 3, 7]
    assert searched(spark, docs[:1], ["same"], 3) == brute(docs[:1], ["same"], 3)


def test_empty_tables(spark):
    assert searched(spark, [], ["a b"]) == {0: []}
    docs = spark.createDataFrame([(1, "a b", None, None, None)], DOC)
    out = lexical.search(docs, spark.createDataFrame([], "item_id long, text string"))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    clash = docs.withColumn("item_id", docs["doc_id"]).withColumn("terms", docs["doc_id"]).withColumn("score", docs["doc_id"])
    got = lexical.search(clash, spark.createDataFrame([(4, "b"), (4, "b"), (None, "a")], "item_id long, text string")).collect()
    assert sorted(str(r["item_id"]) for r in got) == ["4", "4", "None"]


def test_early_stop_is_exact_and_reads_less(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_WAVE", 64)
    rng = np.random.default_rng(3)
    n_docs, n_terms = 4000, 60
    lists = [np.flatnonzero(rng.random(n_terms) < 0.2 + 0.7 * (d < 80)) for d in range(n_docs)]
    sizes = np.array([len(x) for x in lists])
    term, tf = np.concatenate(lists), rng.integers(1, 5, sizes.sum())
    n = sizes * 3 + rng.integers(1, 50, n_docs)
    shard = lexical.Shard(np.arange(n_docs), n, sizes, term, tf, n_terms, n_docs, int(n.sum()))
    weights, k, less = rng.integers(0, 9000, n_terms), 10, 0
    for i in range(30):
        item = np.sort(rng.choice(n_terms, rng.integers(1, 40), replace=False))
        mine = np.zeros(n_terms, dtype=np.int64)
        mine[item] = weights[item]
        full = np.zeros(n_docs, dtype=np.int64)
        np.add.at(full, np.repeat(np.arange(n_docs), sizes), shard.part * mine[term])
        known, seen = np.sort(full)[-k - 3 :][: i % 4], {}
        left, scores = shard.best(item, weights, k, known, seen)
        assert (scores == full[left]).all()
        want = np.lexsort((np.arange(n_docs), -full))[:k]
        least = lexical._kth(np.concatenate([known, full]), k)
        assert {d for d in want if full[d] > 0 and full[d] >= least} <= set(left)
        less += seen["postings"] < seen["of"]
    assert less >= 5  # of 30 random items


def test_terms():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aZ09_-. \n\x00\x7f\x80é漢🙂[`{@/:") for _ in range(40))
        assert [t.decode() for t in lexical.terms(text) if t] == own_terms(text)
    assert lexical.terms(None) == [] and sentence(rng, 1)


def test_query_equals_sql_and_brute_force(spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_lexical_search"](spark, data).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(con.execute(queries.ORACLES["op11_lexical_search"]).fetchall())
    items = con.execute("select item_id, text from benchmark").fetchall()
    want = brute(con.execute("select doc_id, text from documents").fetchall(), [t for _, t in items], 50)
    assert got == sorted((items[i][0], r + 1, d, s) for i, rows in want.items() for r, (s, d) in enumerate(rows))
