"""Exact retrieval over the embeddings table; labels are its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..sources.tables import table
from .registry import query

COS = "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-10) * (sqrt(list_dot_product({b}, {b})) + 1e-10))"
L2 = "1 - list_distance({a}, {b}) / 2"
SQL = """
with v as (select vec_id, label as partition, embedding::double[] as e from embeddings),
q as (select vec_id as query_id, label as p, embedding::double[] as qe from embeddings where vec_id % 20 = 0),
s as (select query_id, partition, vec_id, round({score}, 6) as score from q join v on p = partition)
select query_id, partition, vec_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those whose id is divisible by 20 as queries of their own partition."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("partition"), "embedding")
    return v, v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "partition")


@query("knn_cosine", SQL.format(score=COS.format(a="e", b="qe")))
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(*tables(spark, d), 5)


@query("knn_l2", SQL.format(score=L2.format(a="e", b="qe")))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(*tables(spark, d), 5, score="l2")


@query(
    "knn_multi",
    f"""
with v as (select vec_id, label as partition, embedding::double[] as e from embeddings),
q as (select vec_id as query_id, p, embedding::double[] as qe from embeddings, (select distinct label as p from embeddings) where vec_id % 20 = 0),
s as (select query_id, partition, vec_id, round({COS.format(a="e", b="qe")}, 6) as score from q join v on p = partition),
c as (select *, row_number() over (partition by query_id, partition order by score desc, vec_id) as n from s)
select query_id, partition, vec_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from c where n <= (select greatest(3, ceil(8.0 / count(distinct label)) + 2) from embeddings)) where rank <= 8
""",
)
def knn_multi(spark: SparkSession, d: str) -> DataFrame:
    v, q = tables(spark, d)
    # every query names every partition: a join with one row, the list of partitions
    asked = q.drop("partition").crossJoin(F.broadcast(v.agg(F.collect_set("partition").alias("all")))).select("query_id", "vector", F.explode("all").alias("partition"))
    return vectors.knn_multi(v, asked, 8).select("query_id", "partition", "vec_id", "score", "rank")


@query(
    "knn_visible",
    SQL.format(score=COS.format(a="e", b="qe")).replace("from embeddings),", "from embeddings where not (vec_id % 3 = 1 and vec_id % 2 = 1)),", 1),
)
def knn_visible(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours among the rows that are not hidden: a third has a reason, every other one of these an empty one."""
    v, q = tables(spark, d)
    reason = F.when(F.col("vec_id") % 3 == 1, F.when(F.col("vec_id") % 2 == 1, "ocr_failed:x").otherwise(""))
    return vectors.knn(vectors.visible(v.withColumn("hidden_reason", reason)), q, 5)


@query("retrieval_context")
def retrieval_context(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each query's hits, numbered, within a length; documents stand in for chunk texts."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors.context(vectors.knn(*tables(spark, d), 5), texts)
