"""Structured Streaming over the event log, replayed to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shared
from ..sources.tables import table
from ..streaming import events as ev
from ..streaming import retention, worker
from .registry import query
from .rollups import stamp


@query("stream_tumbling", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = ev.replay(ev.tumbling(ev.stream(spark, d)), "complete")
    return out.select(stamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sliding",
    """
with w as (select time_bucket(interval 6 hours, ts) - to_hours(6 * k) as start, value from events, (values (0), (1), (2), (3)) as t(k))
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n, round(sum(value), 4) as total from w group by 1
""",
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = ev.replay(ev.sliding(ev.stream(spark, d)), "complete")
    return out.select(stamp("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    "stream_session",
    """
with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as fresh from events),
b as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from a)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, round(sum(value), 4) as total from b group by user_id, s
""",
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    out = ev.replay(ev.sessions(ev.stream(spark, d)), "complete")
    return out.select("user_id", stamp("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("stream_weekly", "select strftime(time_bucket(interval 7 days, ts, timestamp '1970-01-04 18:00:00'), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_weekly(spark: SparkSession, d: str) -> DataFrame:
    out = ev.replay(ev.weekly(ev.stream(spark, d)), "complete")
    return out.select(stamp("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("stream_dedupe", "select distinct event_id, user_id from events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ev.replay(ev.deduplicated(ev.stream(spark, d), late="60 days")).select("event_id", "user_id")


@query("stream_limiter")
def stream_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Stateful limiter: which events of a user pass, refused ones not counted."""
    return ev.replay(ev.limiter(ev.stream(spark, d), 3, 86_400, late="60 days")).select("user_id", "event_id", "allowed")


@query("append_log_filter", "select page_id, url from pages where not starts_with(url, 'http://m.') and not starts_with(url, 'https://m.')")
def append_log_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", "url", F.col("url").alias("path"), F.lit("agent").alias("user_agent"))
    return ev.request_log(rows, skip=("http://m.", "https://m.")).select("page_id", "url")


def _outcome(job: dict, attempt: int) -> str | None:
    """Jobs fail as often as their id modulo five."""
    return f"attempt {attempt} failed" if attempt <= job["job_id"] % 5 else None


@query(
    "queue_worker",
    """
with tries(attempt, offset_s) as (values (1, 0), (2, 5), (3, 15)),
due as (
  select event_id as job_id, attempt, epoch_us(ts) // 1000 + 1000 * offset_s as at_ms, attempt <= event_id % 5 as failed
  from events, tries where attempt <= event_id % 5 + 1)
select job_id, cast(attempt as integer) as attempt, at_ms,
  case when not failed then 'done' when attempt = 3 then 'dead' else 'pending' end as status,
  case when failed then 'attempt ' || attempt || ' failed' end as error,
  case when failed and attempt < 3 then at_ms + 5000 * cast(2 ** (attempt - 1) as bigint) end as next_ms
from due where at_ms <= (select max(epoch_us(ts) // 1000) from events)
""",
)
def queue_worker(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a job of the retrying worker, replayed to the last event's time."""
    jobs = ev.stream(spark, d).select(F.col("event_id").alias("job_id"), F.col("ts").alias("enqueued_at"))
    undo = worker.with_rocks(spark)
    try:
        out = ev.replay(worker.work(jobs, _outcome))
    finally:
        undo()
    return out.select("job_id", "attempt", F.unix_millis("at").alias("at_ms"), "status", "error", F.unix_millis("next_try").alias("next_ms"))


@query("stream_retention", "select event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as seen_at from events where ts >= (select max(ts) from events) - interval 14 days")
def stream_retention(spark: SparkSession, d: str) -> DataFrame:
    """The last 14 days of the log, each event once, kept by day partitions while the stream runs."""
    at = f"{shared.shared_dir(spark)}/retention-{uuid.uuid4().hex}"
    retention.retain(ev.stream(spark, d).select("event_id", "user_id", "ts"), f"{at}/log", f"{at}/state", 14, key="event_id").awaitTermination()
    return retention.kept(spark, f"{at}/log", "ts", 14).select("event_id", "user_id", stamp("ts").alias("seen_at"))
