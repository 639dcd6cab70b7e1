"""Running totals are SQL's, whatever is sampled for their ranges and whichever rows tie."""

import duckdb
import pytest
from pyspark.sql import functions as F

from townscribe.operators import lookup


@pytest.mark.parametrize("ord", ["id", "id div 7", "case when id % 50 > 0 then id div 3 end"])
def test_cap_pages(spark, tmp_path, ord):
    rows = spark.range(60_000).select(F.expr(ord).alias("ord"), (F.col("id") * 7919 % 11).cast("int").alias("projected"), "id", F.sha2(F.col("id").cast("string"), 256).alias("more"))
    rows.write.parquet(f"{tmp_path}/rows")
    lookup.cap_pages(spark.read.parquet(f"{tmp_path}/rows").repartition(8, "more"), 5000).select("id", "running", "within").write.parquet(f"{tmp_path}/got")
    want = f"select id, cast(sum(projected) over (order by ord nulls last) as bigint) as running, sum(projected) over (order by ord nulls last) <= 5000 as within from '{tmp_path}/rows/*.parquet'"
    got = f"select id, running, within from '{tmp_path}/got/*.parquet'"
    assert duckdb.connect().execute(f"select count(*) from ({got})").fetchone()[0] == 60_000
    assert duckdb.connect().execute(f"({got}) except ({want})").fetchall() == []
