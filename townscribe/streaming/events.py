"""Streams over an append-only event log (event_id, ts, user_id, event_type, value).

Each transform takes and gives a frame, streaming or not.  Watermarks bound the state where a stream
appends; a replay in complete mode, as the registered queries use to give all windows, keeps them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, table: str = "events", files: int = 8) -> DataFrame:
    """A table of a folder as a stream of its files."""
    path = f"{folder}/{table}.parquet"
    kind = spark.read.parquet(path).schema
    # as a pattern, so that the table may be one file or a folder of files
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(f"{folder}/{table}.parque[t]")


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """With ``ts`` as a timestamp, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    g = timed(df).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "24 hours", step: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    g = timed(df).withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = timed(df).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def weekly(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Weeks that end on Sunday at 18:00 UTC."""
    # the epoch was a Thursday: three days and 18 hours later it is Sunday 18:00
    g = timed(df).withWatermark("ts", late).groupBy(F.window("ts", "7 days", "7 days", "3 days 18 hours")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "n", "total")


def deduplicated(df: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events once each; a repeat is known for as long as the watermark allows."""
    return timed(df).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def request_log(df: DataFrame, skip: tuple[str, ...] = ("/static", "/favicon", "/healthz", "/robots", "/assets"), agent_chars: int = 500) -> DataFrame:
    """Requests less those of skipped paths, user agents cut."""
    keep = F.lit(True)
    for p in skip:
        keep = keep & ~F.col("path").startswith(p)
    return df.where(keep).withColumn("user_agent", F.substring("user_agent", 1, agent_chars))


def limiter(df: DataFrame, limit: int, seconds: int, late: str = "1 minute") -> DataFrame:
    """(user_id, event_id, ts, allowed): at most ``limit`` allowed events of a user in the trailing window.

    State: a user's last allowed times, at most ``limit`` of them; it ends with its window.  A
    decision is made once, when an event arrives: within a batch events are taken by time, a later
    batch does not undo an earlier one.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            held = [h for h in held if t - h < seconds * 1_000_000]
            ok = len(held) < limit
            if ok:
                held.append(int(t))
            allowed.append(ok)
        state.update((held,))
        if held:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, held[-1] // 1000 + seconds * 1000))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "allowed": allowed})

    return timed(df).select("user_id", "event_id", "ts").withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every available batch to ``handle`` once, then stop; the checkpoint remembers how far."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give its result as a frame, through the shared folder."""
    import tempfile
    import uuid

    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:  # the warehouse is shared; in local mode there is one machine
        base = "file://" + tempfile.mkdtemp(prefix="townscribe-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    at = f"{base}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:
        # a complete or updated result is written anew by each batch; the last one stands
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")
