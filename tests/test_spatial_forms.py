"""Many queries at one point and many places of one form are measured once."""

import time

from pyspark.sql import functions as F

from townscribe.functions import geo
from townscribe.operators import spatial

RING = "array(struct(double(-0.01) as lon, double(-0.01) as lat), struct(double(0.01) as lon, double(-0.01) as lat), struct(double(0.01) as lon, double(0.01) as lat), struct(double(-0.01) as lon, double(0.01) as lat), struct(double(-0.01) as lon, double(-0.01) as lat))"


def crowd(spark, n):
    """n queries at one point; n places, of every three one with the same square around it."""
    queries = spark.range(n).select(F.col("id").alias("query_id"), F.lit(0.001).alias("lat"), F.lit(0.002).alias("lon"))
    shape = F.when(F.col("id") % 3 == 0, F.expr(f"array(array({RING}))")).otherwise(F.array().cast(f"array<array<array<{geo.POINT}>>>"))
    places = spark.range(n).select(F.col("id").alias("place_id"), F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), shape.alias("polygons"))
    return queries, places


def test_nearby_measures_a_form_once(spark):
    queries, places = crowd(spark, 6000)
    began = time.time()
    got = spatial.nearby(queries, places, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "place_id", "kind"))).alias("r")).select("r").distinct().collect()
    assert [[tuple(x) for x in r["r"]] for r in got] == [[(i + 1, 3 * i, "inside_boundary") for i in range(5)]]
    assert time.time() - began < 90  # 12 million pairs of a query and a square


def test_nearby_without_a_limit_ranks_all(spark):
    queries, places = crowd(spark, 30)
    got = spatial.nearby(queries, places)
    assert got.count() == 900
    assert {(r["rank"], r["place_id"]) for r in got.where("query_id = 7").collect()} == set(enumerate([*range(0, 30, 3), *(i for i in range(30) if i % 3)], 1))


def test_containing_tests_a_form_once(spark):
    queries, places = crowd(spark, 3000)
    began = time.time()
    got = spatial.containing(queries, places)
    n, first, last = got.agg(F.count(F.lit(1)), F.countDistinct("query_id"), F.countDistinct("place_id")).first()
    assert (n, first, last) == (3_000_000, 3000, 1000)
    assert time.time() - began < 60
    edge = spark.createDataFrame([(1, 0.01, 0.0), (2, 0.0101, 0.0), (3, None, 0.0)], "query_id long, lat double, lon double")
    assert {r["query_id"] for r in spatial.containing(edge, places).collect()} == {1}
