"""A third of all rows on one key: what a task reads stays a small part of them."""

import pytest
from pyspark.sql import functions as F

from townscribe.operators import catalog, resolve, windows

N = 30_000


def largest_task(spark, df):
    """Most rows that a partition of the result's last step holds before rows are dropped, by running the plan without adaptive coalescing."""
    return df.withColumn("_p", F.spark_partition_id()).groupBy("_p").count().agg(F.max("count")).first()[0]


@pytest.fixture(scope="module")
def rows(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.range(0, N, 1, 12).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_rows_without_a_key_stay_where_they_are(spark, rows):
    out = windows.first_seen(rows, ["k"], "ord", keep_null_keys=True)
    assert out.where("k is null").count() == N // 3 and out.where("k = 'hot'").first()["ord"] == 1
    assert out.count() == 2 * (N // 3) + 1
    assert largest_task(spark, out.where("k is null")) <= N // 12  # as many as a task of the input has
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_stacks_are_counted_not_gathered(spark, rows):
    out = catalog.demote_stacks(rows.withColumn("quality", F.when(F.col("ord") % 2 == 0, "polygon")), [F.col("k"), F.upper("k")])
    assert out.columns == ["ord", "k", "quality"]
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {(r["k"] if r["k"] in (None, "hot") else "other", r["quality"]): r["n"] for r in out.groupBy(F.when(F.col("k").isNull(), None).when(F.col("k") == "hot", "hot").otherwise("other").alias("k"), "quality").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, "polygon"): N // 6, (None, "city_only"): N // 6, ("hot", "polygon"): N // 6, ("hot", "city_only"): N // 6, ("other", "polygon"): N // 6, ("other", None): N // 6}
    assert largest_task(spark, out) <= N // 12


def test_leads_of_one_url(spark, rows):
    leads = rows.withColumn("url", F.concat(F.lit("http://X/"), F.col("k")))
    out = resolve.filter_leads(leads, spark.createDataFrame([("http://x/k2",)], "url string"))
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {r["reason"]: r["count"] for r in out.groupBy("reason").count().collect()}
    assert got == {"kept": N // 3 - 1 + 2, "known_url": 1, "duplicate_in_run": 2 * (N // 3) - 2}
    assert [r["ord"] for r in out.where("reason = 'kept' and (k = 'hot' or k is null)").orderBy("ord").collect()] == [0, 1]
    assert largest_task(spark, out) <= N // 4  # the hot url has a third


def test_copies_of_one_file(spark, rows):
    docs = rows.withColumnRenamed("k", "sha256").withColumns({"category": F.lit("bylaws"), "pages": F.lit(3), "scanned": F.lit(False)})
    out = resolve.reject_reason(docs, spark.createDataFrame([("k5",)], "sha256 string"))
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {r["reason"]: r["count"] for r in out.groupBy("reason").count().collect()}
    assert got == {None: N // 3 - 1 + 2, "duplicate_live": 1, "duplicate_prepared": 2 * (N // 3) - 2}
    assert largest_task(spark, out) <= N // 12 + 1
