"""Helpers shared by the corpus operators: reading, shared storage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegralType, StringType, StructType

#: Words of the contracts: runs of anything but space and the ASCII white space 9 to 13.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

#: Rows of an Arrow batch handed to a Python worker; documents can be long.
ARROW_ROWS = "512"

#: A side is broadcast only after a pass over it showed at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A class is hot if it holds more than one row in so many; there are fewer hot classes than that.
HOT = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch is held in memory whole by the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset it is set here: a folder of the warehouse, which a cluster shares, and in
    local mode, where there is one machine, a temporary one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="townscribe-") if sc.master.startswith("local") else os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "townscribe-shared")
        sc.setCheckpointDir(found)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut,
    and a lost executor costs a re-read instead of a re-run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/townscribe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.townscribe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df.townscribe_path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than needed."""
    return df.limit(rows + 1).count() <= rows


def _bytes(col: Column, kind: DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.aggregate(F.coalesce(col, F.array().cast(kind.simpleString())), F.lit(16).cast("long"), lambda n, x: n + _bytes(x, kind.elementType))
        return F.coalesce(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(kind, StructType):
        out = F.lit(16)
        for f in kind.fields:
            out = out + _bytes(col.getField(f.name), f.dataType)
        return out
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes: one distributed pass that returns two sums."""
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        total = total + _bytes(F.col(f"`{f.name}`"), f.dataType)
    n, found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= rows and found <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and bytes allow it, else unchanged (a shuffled join)."""
    return F.broadcast(df) if is_small(df, rows) else df


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` left-joined with ``classes`` on ``keys``; ``classes`` has one row a key and in ``size`` its number of rows.

    The few classes that hold more than one row in HOT (fewer than HOT of them at any scale) are
    broadcast, so that their rows stay where they are; only the others are shuffled.
    """
    if is_small(classes):
        return rows.join(F.broadcast(classes), keys, "left")
    total = classes.agg(F.sum(size)).first()[0]
    is_hot = F.col(size) * HOT > total
    hot = F.broadcast(classes.where(is_hot))
    kept = [*keys, *(c for c in rows.columns if c not in keys), *(c for c in classes.columns if c not in keys)]
    return rows.join(hot, keys).select(kept).unionAll(rows.join(hot, keys, "left_anti").join(classes.where(~is_hot), keys, "left").select(kept))


def integer_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id as long; the operators that keep the least doc_id need integers and refuse others."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be an integer column here, not {kind.simpleString()}")
    return docs.withColumn("doc_id", F.col("doc_id").cast("long"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SPLIT)
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worker_state(name: str) -> dict:
    """A dictionary that stays with a Python worker from task to task."""
    mod = sys.modules.setdefault("townscribe_worker_state", types.ModuleType("townscribe_worker_state"))
    return mod.__dict__.setdefault(name, {})


def bounded_labels(labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids (a fixed pseudo-random choice), one row an id; conflicting labels give the largest."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
        .limit(bound)
    )


def ship(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a driver-side value of bounded size; the function returned gives it on a worker.

    It travels pickled by value, so a worker needs no import of this package for it.
    """
    raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(raw.value)
