"""The pruned index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from townscribe.operators import vector_index

VECTORS, QUERIES = "vec_id long, partition string, embedding array<double>", "query_id long, partition string, vector array<double>"


def brute(vectors, queries, k, score):
    out = {}
    for q, part, v in queries:
        if part is None or v is None:
            continue
        found = []
        for i, p, e in vectors:
            if p == part and e is not None:
                a, b = np.array(e), np.array(v)
                s = 1 - np.sqrt(((a - b) ** 2).sum()) / 2 if score == "l2" else (a * b).sum() / ((np.sqrt((a * a).sum()) + 1e-10) * (np.sqrt((b * b).sum()) + 1e-10))
                found.append((-round(float(s), 6), i))
        out[q, part] = [(i, round(-s, 6)) for s, i in sorted(found)[:k]]
    return {key: rows for key, rows in out.items() if rows}


def searched(spark, vectors, queries, k, score, **more):
    block, pivots, query_block = more.get("block", 4096), more.get("pivots", 256), more.get("query_block", 1024)
    index = vector_index.build(spark.createDataFrame(vectors, VECTORS).repartition(3), score, block=block, pivots=pivots)
    frame = spark.createDataFrame(queries, QUERIES)
    out = {}
    for r in sorted(vector_index.search(index, frame, k, query_block=query_block).collect(), key=lambda r: r["rank"]):
        out.setdefault((r["query_id"], r["partition"]), []).append((r["vec_id"], round(r["score"], 6)))
    return out, vector_index.skipped(index, frame, k, query_block=query_block)


def clusters(seed, n=900, d=6, norm=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d)) * 4 * norm
    return [(i, "ab"[i % 2], (centers[rng.integers(12)] + rng.normal(size=d) * 0.05 * norm).tolist()) for i in range(n)]


@pytest.mark.parametrize("score", ["cosine", "l2"])
def test_clustered_vectors_skip_cells_and_lose_nothing(spark, score):
    vectors = clusters(1)
    queries = [(i, p, v) for i, p, v in vectors if i % 20 == 0] + [(5000, "a", [0.0] * 6), (5001, "none", [1.0] * 6)]
    got, report = searched(spark, vectors, queries, 5, score, block=25, pivots=40, query_block=7)
    assert got == brute(vectors, queries, 5, score)
    seen = report.agg(F.sum("n_cells"), F.sum("visited")).first()
    assert seen[1] * 3 < seen[0]  # most cells are never read


@pytest.mark.parametrize("score", ["cosine", "l2"])
@pytest.mark.parametrize("norm", [1.0, 1e6])
def test_any_vectors(spark, score, norm):
    rng = np.random.default_rng(2)
    vectors = [(i, "a", (rng.normal(size=8) * norm).tolist()) for i in range(200)]
    vectors += [(1000 + i, "a", vectors[7][2]) for i in range(60)]  # copies
    vectors += [(2000, "a", [0.0] * 8), (2001, "a", None), (2002, None, vectors[0][2]), (2003, "b", vectors[0][2])]
    queries = [(i, "a", vectors[i][2]) for i in range(0, 200, 20)] + [(7, "a", vectors[7][2]), (8, None, vectors[8][2]), (9, "a", None), (10, "b", vectors[1][2])]
    got, _ = searched(spark, vectors, queries, 7, score, block=20, pivots=9, query_block=4)
    assert got == brute(vectors, queries, 7, score)


def test_tables(spark):
    got, report = searched(spark, [], [(1, "a", [1.0])], 3, "l2")
    assert got == {} and report.count() == 0
    got, _ = searched(spark, [(1, "a", [1.0])], [], 3, "l2")
    assert got == {}
    got, report = searched(spark, [(1, "a", [1.0]), (2, "a", [3.0])], [(4, "a", [2.5])], 3, "l2")
    assert got == {(4, "a"): [(2, 0.75), (1, 0.25)]}
    assert [tuple(r) for r in report.collect()] == [(4, "a", 1, 1)]
