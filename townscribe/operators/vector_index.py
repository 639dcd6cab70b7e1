"""Exact nearest neighbours by pivots and blocks.

``build`` deals the vectors of each partition to cells, by the nearest of a few pivots, and writes them once with the distance
to it. A cell's least and greatest distance and greatest norm bound, by the triangle inequality, the score that any
of its vectors can have for a query. ``search`` first looks into each query's own cell; the k-th score found
there rules out most other cells, and only those that could still hold a better vector are read.

Work is done on pairs of blocks, one of vectors and one of queries, each of bounded size at any number of either: a matrix
product finds who may be among the first k, with the error of such products as margin, and these few are scored by the
formula itself. So results don't depend on how rows fall into blocks.

The pivots are a bounded sample (``PIVOTS`` vectors, by a hash of their id); it decides how much is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .batches import narrow, sliced
from .catalog import top_per_group
from .shared import materialize
from .sizes import broadcast_if_small

#: Vectors and queries of a block, and the most cells of a partition.
BLOCK, QUERY_BLOCK, PIVOTS = 4096, 1024, 256


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def mapped(rows: np.ndarray, score: str) -> np.ndarray:
    """Where the triangle inequality holds: the vectors themselves, or for cosine their directions."""
    return rows / (np.sqrt((rows * rows).sum(axis=1)) + 1e-10)[:, None] if score == "cosine" else rows


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def exact(rows: np.ndarray, query: np.ndarray, score: str) -> np.ndarray:
    """Scores of rows for one query, by the formula."""
    if score == "cosine":
        return (rows * query).sum(axis=1) / ((np.sqrt((rows * rows).sum(axis=1)) + 1e-10) * (np.sqrt((query * query).sum()) + 1e-10))
    return 1 - np.sqrt(((rows - query) ** 2).sum(axis=1)) / 2


def bracket(rows: np.ndarray, queries: np.ndarray, score: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above the scores of all pairs, from one matrix product."""
    eps = 4 * (rows.shape[1] + 2) * np.finfo(np.float64).eps
    if score == "cosine":
        dots = mapped(rows, score) @ mapped(queries, score).T
        return dots - eps, dots + eps
    norms = (rows * rows).sum(axis=1)[:, None] + (queries * queries).sum(axis=1)[None, :]
    square = norms - 2 * (rows @ queries.T)
    return 1 - np.sqrt(np.maximum(square + eps * norms, 0)) / 2, 1 - np.sqrt(np.maximum(square - eps * norms, 0)) / 2


def best(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, score: str, digits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best rows for each query; ``least`` is a score that others have reached."""
    low, high = bracket(rows, queries, score)
    n = min(k, len(rows))
    kth = np.partition(low, len(rows) - n, axis=0)[len(rows) - n] if n == k else np.full(len(queries), -np.inf)
    wanted = high >= np.maximum(kth, least)[None, :] - 10.0**-digits  # what rounds alike is a tie
    for j in range(len(queries)):
        at = np.flatnonzero(wanted[:, j])
        if len(at):
            s = np.round(exact(rows[at], queries[j], score), digits)
            order = np.lexsort((ids[at], -s))[:k]
            yield j, at[order], s[order]


def reachable(queries: np.ndarray, pivots: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray, score: str) -> np.ndarray:
    """The highest score that a vector of each cell can have for each query."""
    d = distances(queries, pivots)
    length = np.sqrt((queries * queries).sum(axis=1))[:, None]
    slack = 1e-6 * (1 + length + np.sqrt((pivots * pivots).sum(axis=1))[None, :] + far[None, :])  # more than such distances err
    least = np.maximum(np.maximum(d - far[None, :], near[None, :] - d) - slack, 0)
    return (length**2 + norm[None, :] ** 2 - least**2) / 2 + slack if score == "cosine" else 1 - least / 2


@dataclass
class Index:
    """Vectors by partition and cell, what is known of each cell, and how they are scored."""

    vectors: DataFrame  # partition, cell, id, vector
    cells: DataFrame  # partition, and an array of its cells
    pivots: np.ndarray
    score: str
    block: int


def _assigned(rows: DataFrame, pivots: np.ndarray, score: str) -> DataFrame:
    """(partition, cell, id, vector, distance, norm) of (partition, n_cells, id, vector): the nearest of the partition's first pivots."""
    kinds = {f.name: f.dataType for f in rows.schema}
    points = mapped(pivots, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, n = mapped(matrix(b.column("vector")), score), np.asarray(b.column("n_cells"))
                d = distances(v, points)
                d[np.arange(len(points))[None, :] >= n[:, None]] = np.inf
                cell = d.argmin(axis=1)
                extra = {"cell": pa.array(cell, pa.int32()), "distance": pa.array(d[np.arange(len(v)), cell]), "norm": pa.array(np.sqrt((v * v).sum(axis=1)))}
                yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("partition", "id", "vector")} | extra)

    return rows.select("partition", "n_cells", "id", "vector").mapInArrow(run, f"partition {kinds['partition'].simpleString()}, id {kinds['id'].simpleString()}, vector {kinds['vector'].simpleString()}, cell int, distance double, norm double")


def build(vectors: DataFrame, score: str = "cosine", partition: str = "partition", block: int = BLOCK, pivots: int = PIVOTS) -> Index:
    """The index of (vec_id, partition, embedding); rows without one of the three are in no result."""
    narrow(vectors.sparkSession)
    rows = vectors.select(F.col(partition).alias("partition"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).dropna()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").toArrow()
    points = matrix(sample.column("vector"))
    n_cells = rows.groupBy("partition").agg(F.least(F.lit(max(1, len(points))), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("n_cells"))
    table = materialize(_assigned(rows.join(broadcast_if_small(n_cells), "partition"), points, score), "vectors")
    stats = table.groupBy("partition", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm").alias("norm"))
    # at most one entry a pivot
    cells = materialize(stats.groupBy("partition").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "near", "far", "norm"))).alias("cells")), "cells")
    return Index(table.select("partition", "cell", "id", "vector"), cells, points, score, block)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(partition, cell, ids, vectors, least): rows of (partition, cell, id, vector, least) packed into blocks of about ``size``."""
    counts = rows.groupBy("partition", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("chunks"))
    dealt = rows.join(broadcast_if_small(counts), ["partition", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    kinds = {f.name: f.dataType for f in rows.schema}
    part, ids = to_arrow_type(kinds["partition"]), pa.list_(to_arrow_type(kinds["id"]))

    def run(group: pa.Table) -> pa.Table:
        flat = np.ascontiguousarray(matrix(group.column("vector")))
        one = lambda a, kind: pa.array([a], kind)
        return pa.table({"partition": one(group.column("partition")[0].as_py(), part), "cell": one(group.column("cell")[0].as_py(), pa.int32()), "ids": one(group.column("id").to_pylist(), ids), "vectors": one(flat.tobytes(), pa.binary()), "least": one(group.column("least").to_pylist(), pa.list_(pa.float64()))})

    return dealt.select("partition", "cell", "chunk", "id", "vector", "least").groupBy("partition", "cell", "chunk").applyInArrow(run, f"partition {kinds['partition'].simpleString()}, cell int, ids array<{kinds['id'].simpleString()}>, vectors binary, least array<double>")


def _visit(blocks: DataFrame, queries: DataFrame, k: int, score: str, digits: int) -> DataFrame:
    """(query_id, partition, vec_id, score): the k best of each block for each query of a block of the same cell."""
    q = queries.select("partition", "cell", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), "least")
    met = blocks.select("partition", "cell", F.col("ids").alias("vec_ids"), "vectors").join(q, ["partition", "cell"])
    kinds = {f.name: f.dataType for f in met.schema}
    vec, query, part = kinds["vec_ids"].elementType, kinds["query_ids"].elementType, kinds["partition"]
    types = [to_arrow_type(t) for t in (query, part, vec)] + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for r in b.to_pylist():
                ids, names = np.array(r["vec_ids"]), r["query_ids"]
                rows = np.frombuffer(r["vectors"]).reshape(len(ids), -1)
                asked = np.frombuffer(r["queries"]).reshape(len(names), -1)
                out = [[], [], []]
                for j, at, s in best(ids, rows, asked, np.array(r["least"]), k, score, digits):
                    out[0] += [names[j]] * len(at)
                    out[1] += ids[at].tolist()
                    out[2] += s.tolist()
                n = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((out[0], [r["partition"]] * n, *out[1:]), types, strict=True)], names=["query_id", "partition", "vec_id", "score"])

    return met.select("partition", "query_ids", "vec_ids", "vectors", "queries", "least").mapInArrow(run, f"query_id {query.simpleString()}, partition {part.simpleString()}, vec_id {vec.simpleString()}, score double")


def _cells_of(queries: DataFrame, index: Index, choose: Callable[[np.ndarray, np.ndarray, dict], np.ndarray]) -> DataFrame:
    """(partition, cell, id, vector, least, n_cells): queries (with least and home) at the cells that ``choose`` takes of the bounds."""
    score, pivots = index.score, mapped(index.pivots, index.score)
    kinds = {f.name: f.dataType for f in queries.schema}
    types = {c: to_arrow_type(kinds[c]) for c in ("partition", "id", "vector")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = {c: [] for c in ("partition", "cell", "id", "vector", "least", "n_cells")}
            for r in b.to_pylist():
                cells = r["cells"]
                of = np.array([c["cell"] for c in cells])
                near, far, norm = (np.array([c[x] for c in cells]) for x in ("near", "far", "norm"))
                top = reachable(mapped(np.array([r["vector"]], dtype=np.float64), score), pivots[of], near, far, norm, score)[0]
                for cell in choose(top, of, r):
                    for c, v in zip(out, (r["partition"], int(cell), r["id"], r["vector"], r["least"], len(cells)), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({"partition": pa.array(out["partition"], types["partition"]), "cell": pa.array(out["cell"], pa.int32()), "id": pa.array(out["id"], types["id"]), "vector": pa.array(out["vector"], types["vector"]), "least": pa.array(out["least"], pa.float64()), "n_cells": pa.array(out["n_cells"], pa.int32())})

    return queries.join(broadcast_if_small(index.cells), "partition").mapInArrow(run, f"partition {kinds['partition'].simpleString()}, cell int, id {kinds['id'].simpleString()}, vector {kinds['vector'].simpleString()}, least double, n_cells int")


def _steps(index: Index, queries: DataFrame, k: int, partition: str, digits: int, query_block: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Blocks of vectors, the k best of the queries' own cells, and the queries at the other cells that may hold better (None if there are no others)."""
    asked = queries.select(F.col(partition).alias("partition"), F.col("query_id").alias("id"), F.col("vector").alias("vector")).dropna()
    several = not index.cells.where(F.size("cells") > 1).isEmpty()
    # what is read twice is written; with one cell a partition there is one step, and nothing is
    kept = (lambda df, name: materialize(df, name)) if several else (lambda df, name: df)
    blocks = kept(_blocks(index.vectors.withColumn("least", F.lit(0.0)), index.block), "blocks")
    start = asked.withColumns({"least": F.lit(float("-inf")), "home": F.lit(-1)})
    home = kept(_cells_of(start, index, lambda top, of, r: of[[int(np.argmax(top))]]), "home")
    first = top_per_group(_visit(blocks, _blocks(home, query_block), k, index.score, digits), ["query_id", "partition"], [F.desc("score"), F.asc("vec_id")], k)
    first = kept(first, "first")
    if not several:
        return blocks, first, None
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "partition", F.col("score").alias("reached"))
    again = home.where("n_cells > 1").select("partition", "id", "vector", F.col("cell").alias("home")).join(reached, ["id", "partition"], "left")
    again = again.withColumn("least", F.coalesce("reached", F.lit(float("-inf")))).drop("reached")
    edge = 10.0**-digits
    return blocks, first, _cells_of(again, index, lambda top, of, r: of[(of != r["home"]) & (top >= r["least"] - edge)])


def search(index: Index, queries: DataFrame, k: int, partition: str = "partition", digits: int = 6, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, partition, vec_id, score, rank): the k best vectors of its partition for each query (query_id, vector, partition)."""
    blocks, first, others = _steps(index, queries, k, partition, digits, query_block)
    if others is None:
        return first.withColumnRenamed("partition", partition)
    others = materialize(others, "others")
    more = _visit(blocks, _blocks(others, query_block), k, index.score, digits)
    rows = first.drop("rank").unionByName(more)
    return top_per_group(rows, ["query_id", "partition"], [F.desc("score"), F.asc("vec_id")], k).withColumnRenamed("partition", partition)


def skipped(index: Index, queries: DataFrame, k: int, partition: str = "partition", digits: int = 6, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, partition, n_cells, visited): how many cells a query's partition has and how many were read for it."""
    _, _, others = _steps(index, queries, k, partition, digits, query_block)
    asked = queries.select(F.col(partition).alias("partition"), F.col("query_id").alias("id")).join(broadcast_if_small(index.cells.select("partition", F.size("cells").alias("n_cells"))), "partition")
    if others is None:
        return asked.select(F.col("id").alias("query_id"), "partition", "n_cells", F.lit(1).alias("visited"))
    more = others.groupBy("id", "partition").agg(F.count(F.lit(1)).alias("more"))
    return asked.join(more, ["id", "partition"], "left").select(F.col("id").alias("query_id"), "partition", "n_cells", (F.coalesce("more", F.lit(0)) + 1).cast("int").alias("visited"))
