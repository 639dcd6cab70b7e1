"""Ordered folds over groups: dealt by group, sorted, and read as a stream, so no group is held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(rows: DataFrame, group: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], Iterable[tuple]], finish: Callable[[Any], Iterable[tuple]], schema: StructType) -> DataFrame:
    """Rows made by ``step(state, row)`` for each row of a group in order, and by ``finish(state)`` after its last.

    What a task holds is one group's state. ``group`` must not be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema)
        state, now = None, None

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                if row[group] != now:
                    if now is not None:
                        out += finish(state)
                    state, now = start(), row[group]
                out += step(state, row)
            if out:
                yield batch(out)
        if now is not None and (out := list(finish(state))):
            yield batch(out)

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
