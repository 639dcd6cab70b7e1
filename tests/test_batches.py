"""Python workers are handed and work on parts of bounded size."""

import pyarrow as pa
from pyspark.sql import functions as F

from townscribe.operators import batches, chunker, resolve, vector_index


def sizes(spark, n):
    """The most rows of a batch that a worker is handed."""
    seen = spark.range(n).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
    return max(r["n"] for r in seen.collect())


def test_operators_hand_on_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    pages = spark.createDataFrame([(1, "https://a.example/", "<a href='/b'>b</a>")], "page_id long, url string, html string")
    texts = spark.createDataFrame([(1, "some text")], "document_id long, text string").select("document_id", F.array(F.struct(F.lit(1).alias("number"), "text")).alias("pages"))
    vectors = spark.createDataFrame([(i, "p", [1.0, float(i)]) for i in range(4)], "vec_id long, partition string, embedding array<double>")
    try:
        for operator in (lambda: resolve.harvest_links(pages), lambda: chunker.chunk_documents(texts), lambda: vector_index.build(vectors)):
            spark.conf.set(name, "10000")
            operator()
            assert sizes(spark, 3000) <= batches.ROWS
    finally:
        spark.conf.set(name, before)


def test_parts_are_small_and_whole():
    b = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["x" * 1_000_000] * 20 + ["y"] * 280)], ["i", "t"])
    parts = list(batches.sliced([b]))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(300))
    assert max(p.num_rows for p in parts) <= batches.PART_ROWS
