"""Arrow batches of bounded size for Python workers, whatever the tables hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch that a worker is handed, and rows and bytes of the part that it turns into Python objects at once.
ROWS, BYTES, PART_ROWS, PART_BYTES = 512, 8 << 20, 64, 4 << 20


def narrow(spark: SparkSession) -> None:
    """Hand workers batches of at most about ROWS rows and BYTES bytes: one is held in memory whole. Smaller settings stay."""
    for name, most, unit in (("maxRecordsPerBatch", ROWS, ""), ("maxBytesPerBatch", BYTES, "b")):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", f"{most}{unit}")


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, fewer where rows are large, so that the objects made of one are gone before the next."""
    for b in batches:
        step = max(1, min(PART_ROWS, PART_BYTES * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
