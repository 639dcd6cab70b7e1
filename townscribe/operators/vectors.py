"""Exact nearest neighbours over array columns, for sets of queries of any size (``vector_index``).

Hidden rows are filtered before k, so k rows come back if there are k.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector_index
from .catalog import top_per_group
from .shared import materialize
from .sizes import broadcast_if_small


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-10 added to each norm, so a zero vector scores 0."""
    return dot(a, b) / ((norm(a) + 1e-10) * (norm(b) + 1e-10))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l2_score(a: Column, b: Column) -> Column:
    """1 - distance / 2."""
    return 1 - l2(a, b) / 2


def visible(rows: DataFrame, reason: str = "hidden_reason", include_hidden: bool = False) -> DataFrame:
    """The rows that are not hidden: those without a reason, an empty one among them."""
    return rows if include_hidden else rows.where(F.coalesce(F.col(reason), F.lit("")) == "")


def knn(vectors: DataFrame, queries: DataFrame, k: int, score: str = "cosine", partition: str = "partition", digits: int = 6) -> DataFrame:
    """The k best vectors (vec_id, partition, embedding) for each query (query_id, vector, partition).

    Scores are rounded before they are compared, so that ties are ties on any engine; the
    least vec_id wins them.
    """
    return vector_index.search(vector_index.build(vectors, score, partition), queries, k, partition, digits)


def knn_multi(vectors: DataFrame, queries: DataFrame, k: int, partition: str = "partition") -> DataFrame:
    """The k best over several partitions a query names (one row of ``queries`` each).

    Of each of its n partitions a query gets max(3, ceil(k / n) + 2) candidates, then the best
    k of all.
    """
    n = queries.groupBy("query_id").agg(F.countDistinct(partition).alias("_n"))
    each = knn(vectors, queries, max(3, k + 2), partition=partition).join(n, "query_id")
    each = each.where(F.col("rank") <= F.greatest(F.lit(3), F.ceil(F.lit(k) / F.col("_n")) + 2)).drop("rank", "_n")
    return top_per_group(each, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def decode(blob: Column) -> Column:
    """A little-endian float32 blob as array<float>, in Arrow batches."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def floats(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))

    return floats(blob)


def context(hits: DataFrame, chunks: DataFrame, most_chars: int = 6000) -> DataFrame:
    """For each query its hits' texts in rank order, each headed by its number, within ``most_chars``.

    The text that would pass the limit is cut there, so a long one leaves no query without a context.
    """
    from pyspark.sql import Window

    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "))
    # hits are few and short, texts are not: these stay where they are if the hits allow it
    hits = broadcast_if_small(materialize(hits.select("query_id", "vec_id", "rank"), "hits"))
    rows = chunks.select("vec_id", "text").join(hits, "vec_id").withColumn("part", F.concat(head, F.col("text")))
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("_left", most_chars - F.sum(F.length("part") + 2).over(w) + F.length("part") + 2)
    rows = rows.where(F.col("_left") > F.length(head)).withColumn("part", F.col("part").substr(F.lit(1), F.col("_left").cast("int")))
    parts = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("context"))
