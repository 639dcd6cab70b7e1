"""An event log kept for so many days, as a stream: rows past it are dropped with their day's partition, and not shown until then.

Now is the latest time seen. Each batch is put into partitions of its day and batch number in a versioned table, and the
same commit drops the days that ended before the cutoff, so readers see a batch with its pruning or neither, and a batch
that is run again replaces what it had put. Of the cutoff's own day the older rows stay on disk until the day ends; ``kept``
filters them by true times. What is stored is thus bounded by the rows of ``days`` + 1 days.

With a key, a repeated event is dropped for as long as the first can be kept. Its state is Spark's own, a row an id, and
ends by the watermark twice the retention after the event; rows that come later than the retention are dropped by it.
Rows without a time have no day and are not kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

#: Batches after which the partitions of a day are put together.
SETTLE = 16
#: The batch number of what was put together.
SETTLED = -1


def _days(spark: SparkSession, base: str) -> dict[str, list[str]]:
    """The partitions of every day."""
    out: dict[str, list[str]] = {}
    for part in versions.parts(spark, base):
        out.setdefault(part.split("/")[0].split("=")[1], []).append(part)
    return out


def now_of(spark: SparkSession, base: str, ts: str) -> int | None:
    """The latest time in the log, in microseconds; None if it has no row. Reads the last day alone."""
    days = _days(spark, base)
    if not days:
        return None
    last = set(days[max(days)])
    return versions.read(spark, base, only=lambda p: p in last).agg(F.unix_micros(F.max(ts))).first()[0]


def _cutoff(now: int, days: int) -> Column:
    return F.timestamp_micros(F.lit(now)) - F.expr(f"interval {days} days")


def kept(spark: SparkSession, base: str, ts: str, days: int) -> DataFrame:
    """The rows that are not older than the retention, by true times."""
    now = now_of(spark, base, ts)
    rows = versions.read(spark, base).drop("day", "batch")
    return rows if now is None else rows.where(F.col(ts) >= _cutoff(now, days))


def put(batch: DataFrame, n: int, base: str, ts: str, days: int) -> None:
    """Put the n-th batch into the log and drop the days that ended before the cutoff, in one commit."""
    spark = batch.sparkSession
    fresh, held = batch.agg(F.unix_micros(F.max(ts))).first()[0], now_of(spark, base, ts)
    if fresh is None:
        return
    cutoff = _cutoff(fresh if held is None else max(fresh, held), days)
    first = str(spark.range(1).select(F.to_date(cutoff)).first()[0])
    rows = batch.where(F.col(ts) >= cutoff).withColumn("day", F.to_date(ts).cast("string")).withColumn("batch", F.lit(n).cast("long"))
    gone = [dict(kv.split("=") for kv in p.split("/")) for d, parts in _days(spark, base).items() if d < first for p in parts]
    versions.replace_partitions(rows, base, ["day", "batch"], emptied=gone)


def settle(spark: SparkSession, base: str, ts: str, before: int) -> int:
    """Put each day's partitions of the batches before one together where there are several, so that scans don't grow with batches; returns the days."""
    final = {d: [p for p in parts if int(p.split("=")[-1]) < before] for d, parts in _days(spark, base).items()}
    several = {d: parts for d, parts in final.items() if len(parts) > 1}
    if several:
        old = {p for parts in several.values() for p in parts}
        rows = versions.read(spark, base, only=lambda p: p in old).withColumn("batch", F.lit(SETTLED).cast("long"))
        dealt = rows.repartition("day", F.pmod(F.unix_micros(ts), F.lit(spark.sparkContext.defaultParallelism)))  # a day may be large
        versions.replace_partitions(dealt, base, ["day", "batch"], emptied=[dict(kv.split("=") for kv in p.split("/")) for p in old])
    return len(several)


def retain(log: DataFrame, base: str, checkpoint: str, days: int, ts: str = "ts", key: str | None = None, after: Callable[[int], None] | None = None, every: int = SETTLE):
    """Start a stream that keeps a log's last ``days`` days in the table ``base``; ``after`` is called with each batch's number when it is in.

    One stream writes a table. A batch that may be run again is never settled.
    """
    spark = log.sparkSession
    rows = log.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    if key is not None:
        rows = rows.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([key])

    def step(batch: DataFrame, n: int) -> None:
        if n % every == 0 and n:
            settle(spark, base, ts, n)
        held = batch.persist()
        try:
            put(held, n, base, ts, days)
        finally:
            held.unpersist()
        if after:
            after(n)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
