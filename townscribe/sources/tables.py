"""Tables of a data folder, read with column pruning and pushed-down filters left to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    if name not in TABLES:
        raise ValueError(f"no table is called {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")
