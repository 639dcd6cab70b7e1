"""Broadcasts behind a check of rows and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A side is broadcast only after a pass over it showed at most so many rows and bytes.
ROWS, BYTES = 1_000_000, 64 << 20


def value_bytes(col: Column, kind: DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.aggregate(F.coalesce(col, F.array().cast(kind.simpleString())), F.lit(16).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType))
        return F.coalesce(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(kind, StructType):
        out = F.lit(16)
        for f in kind.fields:
            out = out + value_bytes(col.getField(f.name), f.dataType)
        return out
    return F.lit(8)


def is_small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes: one distributed pass that returns two sums."""
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        total = total + value_bytes(F.col(f"`{f.name}`"), f.dataType)
    n, found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= rows and found <= size


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint that joins by key shuffle it.

    Without one Spark broadcasts what its estimate puts below the threshold; of a compressed table that is the size of the files, which
    may be a small part of what the driver then gets.
    """
    return df.hint("shuffle_merge")


def broadcast_if_small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and bytes allow it, else a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else shuffled(df)
