"""A queue worker as a stateful stream: jobs are tried, tried again after a growing pause, and given up.

Jobs are dealt to shards by a hash of their key. A shard's state holds the attempts, status and next try of its
jobs; a timer brings it back when the next is due. With event time a retry falls due when the watermark has passed
it, so the same log gives the same attempts in any number of batches and after any restart. With processing
time retries wait for the clock, as a live worker does.

A shard's state is bounded by the jobs that are pending or were settled lately: raise ``shards`` with the load. A
settled job is remembered for ``remember`` seconds, in which a repeated submission is ignored, and then forgotten.
Results are appended by batch; ``put_batches`` writes each batch to a folder of its own and replaces what an earlier
try of the same batch left there, so a batch that is run again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Tries of a job, and the pause after the n-th failure: base * 2^(n-1) seconds, at most cap.
MAX_ATTEMPTS, BASE_SECONDS, CAP_SECONDS = 3, 5.0, 120.0
#: Groups of jobs that share a row of state.
SHARDS = 64
#: Characters of an error that are kept.
ERROR_CHARS = 2000
ATTEMPT = "attempt int, at timestamp, status string, error string, next_try timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pause_ms(attempt: int, base: float = BASE_SECONDS, cap: float = CAP_SECONDS) -> int:
    """Milliseconds until a job may be tried again after its n-th failed attempt."""
    return int(min(cap, base * 2.0 ** min(attempt - 1, 60)) * 1000)


class Worker(StatefulProcessor):
    """Tries the jobs of a shard; ``process(job, attempt)`` gives None or an error, and may raise one.

    The state of a shard is one value (its jobs that are pending or still remembered) and the timer of the earliest
    of them, so that a batch costs a few calls to the state store a shard, not some a job.
    """

    def __init__(self, process: Callable[[dict[str, Any], int], str | None], key: str, clock: bool, most: int, base: float, cap: float, remember: int) -> None:
        self.process, self.key, self.clock = process, key, clock
        self.most, self.base, self.cap, self.remember = most, base, cap, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "held string")

    def _now(self, timers: Any) -> int:
        return timers.getCurrentProcessingTimeInMs() if self.clock else timers.getCurrentWatermarkInMs()

    def _held(self) -> dict[Any, list]:
        return {k: v for k, *v in json.loads(self.jobs.get()[0])} if self.jobs.exists() else {}

    def _keep(self, held: dict[Any, list]) -> None:
        """Store the jobs (attempts, status, due, payload by key) and come back for the earliest."""
        if held:
            self.jobs.update((json.dumps([[k, *v] for k, v in held.items()]),))
            self.handle.registerTimer(min(v[2] for v in held.values()))
        else:
            self.jobs.clear()

    def _run(self, key: Any, held: dict[Any, list], attempts: int, due: int, payload: str | None, now: int) -> list[tuple]:
        """All attempts of a job that are due by ``now``."""
        out, job = [], json.loads(payload)
        while True:
            attempts += 1
            try:
                error = self.process(job, attempts)
            except Exception as e:  # noqa: BLE001  a failing job is what this is about
                error = f"{type(e).__name__}: {e}"
            status = "done" if error is None else "dead" if attempts >= self.most else "pending"
            at, due = due, due + (pause_ms(attempts, self.base, self.cap) if status == "pending" else self.remember * 1000)
            out.append((key, attempts, at, status, None if error is None else error[:ERROR_CHARS], due if status == "pending" else None))
            if status != "pending" or due > now:
                break
        held[key] = [attempts, status, due, payload if status == "pending" else None]
        return out

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=[self.key, "attempt", "at", "status", "error", "next_try"])
            for c in ("at", "next_try"):
                out[c] = pd.to_datetime(out[c].astype("Int64"), unit="ms")
            yield out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, out, held = self._now(timerValues), [], self._held()
        for t, job, payload in sorted(t for f in rows for t in zip(f["due_ms"].tolist(), f["job"].tolist(), f["payload"].tolist(), strict=True)):
            t = now if self.clock else t
            if job in held:
                attempts, status, due, known = held[job]
                if status == "pending" and due <= t:
                    out += self._run(job, held, attempts, due, known, t)
                    _, status, due, _ = held[job]
                if status == "pending" or due > t:
                    continue  # enqueued before, and not forgotten by then
            out += self._run(job, held, 0, t, payload, now)
        self._keep(held)
        return self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, out, held = self._now(timerValues), [], self._held()
        for job, (attempts, status, due, payload) in list(held.items()):
            if due <= now:
                if status == "pending":
                    out += self._run(job, held, attempts, now if self.clock else due, payload, now)
                else:
                    del held[job]
        self._keep(held)
        return self._frame(out)


def work(jobs: DataFrame, process: Callable[[dict[str, Any], int], str | None], key: str = "job_id", ts: str = "enqueued_at", late: str = "0 seconds", clock: bool = False, most: int = MAX_ATTEMPTS, base: float = BASE_SECONDS, cap: float = CAP_SECONDS, remember: int = 86_400, shards: int = SHARDS) -> DataFrame:
    """(key, attempt, at, status, error, next_try): an appended row for each attempt of each job of a stream.

    ``status`` is done, dead (the last attempt failed) or pending (to be tried at ``next_try``). Times are
    milliseconds. A job that is submitted again before it is forgotten counts once; rows without a key or a time are dropped.
    ``clock`` waits by processing time instead of event time.
    """
    rows = jobs.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    if not clock:
        rows = rows.withWatermark(ts, late)
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard")
    rows = rows.select(shard, F.col(key).alias("job"), ts, F.unix_millis(ts).alias("due_ms"), F.to_json(F.struct(*jobs.columns)).alias("payload"))
    kind = jobs.schema[key].dataType.simpleString()
    made = Worker(process, key, clock, most, base, cap, remember)
    return rows.groupBy("shard").transformWithStateInPandas(made, f"`{key}` {kind}, {ATTEMPT}", "Append", "ProcessingTime" if clock else "EventTime")


def with_rocks(spark: SparkSession) -> Callable[[], None]:
    """Let streams that are started now keep their state in RocksDB, which such processors need; returns what undoes it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    return lambda: spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def put_batches(df: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """Start a stream whose n-th batch is the folder ``batch=n`` of ``path``, written whole each time it is run."""
    undo = with_rocks(df.sparkSession)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    try:
        return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        undo()


def standing(attempts: DataFrame, key: str = "job_id") -> DataFrame:
    """The last attempt of every job: what the queue's table says of it."""
    return attempts.groupBy(key).agg(F.max_by(F.struct("attempt", "at", "status", "error", "next_try"), "attempt").alias("j")).select(key, "j.*")


def heartbeat(attempts: DataFrame, key: str = "job_id", every: str = "1 day") -> DataFrame:
    """Jobs by status at the end of each period in which something changed: (until, status, jobs)."""
    moved = attempts.select(key, "attempt", F.col("status").alias("to"), F.window("at", every)["end"].alias("until"))
    before = F.lag("to").over(Window.partitionBy(key).orderBy("attempt"))  # a job has few attempts
    steps = moved.withColumn("from", before)
    change = steps.select("until", F.col("to").alias("status"), F.lit(1).alias("d")).unionAll(steps.where("`from` is not null").select("until", F.col("from").alias("status"), F.lit(-1).alias("d")))
    summed = change.groupBy("until", "status").agg(F.sum("d").alias("d"))
    # one row a period and status: few, whatever the number of jobs
    w = Window.partitionBy("status").orderBy("until").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select("until", "status", F.sum("d").over(w).alias("jobs"))
