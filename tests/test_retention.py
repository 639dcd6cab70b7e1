"""Retention as a stream: after every batch the log is what a cut by true times leaves, and no more is stored than its days."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from townscribe.operators import usage
from townscribe.sources import versions
from townscribe.streaming import retention

DAYS, START = 3, dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def batches(seed=5, n=14, size=40):
    """Batches half a day apart with late, early and repeated events."""
    rng, out, seen = random.Random(seed), [], []
    for b in range(n):
        rows = []
        for k in range(size):
            if seen and rng.random() < 0.2:
                rows.append(rng.choice(seen[-60:]))
            else:
                late = rng.choice([0, 0, 0, 1, 2, 3, 4, 9]) * 86_400 + rng.randrange(43_200)
                rows.append((b * size + k, START + dt.timedelta(seconds=43_200 * (b + 20) - late, microseconds=rng.randrange(10**6))))
        seen += rows
        out.append(rows)
    return out


def written(spark, at, rows, n):
    path = f"{at}/b{n:03}.parquet"
    spark.createDataFrame([*rows, (-n, None)], "id long, ts timestamp").coalesce(1).write.parquet(f"{at}-{n}")
    (part,) = [f for f in os.listdir(f"{at}-{n}") if f.endswith(".parquet")]
    os.makedirs(at, exist_ok=True)
    os.rename(f"{at}-{n}/{part}", path)
    os.utime(path, (1_000_000 + n, 1_000_000 + n))


def want(rows):
    now = max(t for _, t in rows)
    return sorted({i for i, t in rows if t >= now - dt.timedelta(days=DAYS)}), now


def test_equals_the_cut_after_every_batch_and_a_crash(spark, tmp_path):
    all_batches, base, at = batches(), str(tmp_path / "log"), str(tmp_path / "in")
    for n, rows in enumerate(all_batches):
        written(spark, at, rows, n)
    log = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(at)
    seen, crashed = {}, []

    def after(n):
        if n == 8 and not crashed:  # settled and put, but not noted
            crashed.append(n)
            raise RuntimeError("lost")
        if n < len(all_batches):
            seen[n] = sorted(r["id"] for r in retention.kept(spark, base, "ts", DAYS).collect())

    def run():
        return retention.retain(log, base, str(tmp_path / "state"), DAYS, key="id", after=after, every=4)

    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    q = run()
    q.awaitTermination()
    so_far = []
    for n, rows in enumerate(all_batches):
        so_far += rows
        ids, now = want(so_far)
        assert seen[n] == ids, n
        plain = usage.kept_after(spark.createDataFrame(so_far, "id long, ts timestamp"), "ts", F.timestamp_micros(F.lit(int(now.timestamp() * 10**6))), DAYS)
        assert sorted({r["id"] for r in plain.collect()}) == ids

    # stored: the rows of the cutoff's day and later, and so are the names of partitions
    first = str((now - dt.timedelta(days=DAYS)).date())
    stored = versions.read(spark, base).collect()
    assert {r["day"] for r in stored} == {str(t.date()) for _, t in so_far if str(t.date()) >= first}
    assert len(stored) <= len({i for i, t in so_far if str(t.date()) >= first})
    by_day = retention._days(spark, base)
    assert all(sum(p.endswith("batch=-1") for p in parts) <= 1 and len(parts) <= 4 + 1 for parts in by_day.values())
    # known ids: those of twice the retention, by the watermark before the last batch
    known = {i for i, t in so_far if t >= max(t for _, t in so_far[: -len(all_batches[-1])]) - dt.timedelta(days=2 * DAYS)}
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= len(known) < len({i for i, _ in so_far})


def test_empty_logs_settling_and_days(spark, tmp_path):
    base = str(tmp_path / "log")
    retention.put(spark.createDataFrame([], "id long, ts timestamp"), 0, base, "ts", DAYS)
    assert retention.now_of(spark, base, "ts") is None and retention.settle(spark, base, "ts", 5) == 0
    rows = spark.sql("select 1L as id, timestamp'2024-03-10 12:00:00' as ts union all select 2L, timestamp'2024-03-07 12:00:00' union all select 3L, timestamp'2024-03-07 11:59:59.999999' union all select 4L, null")
    retention.put(rows, 1, base, "ts", DAYS)
    retention.put(rows.where("id = 2"), 2, base, "ts", DAYS)
    assert sorted(r["id"] for r in retention.kept(spark, base, "ts", DAYS).collect()) == [1, 2, 2]
    assert retention.settle(spark, base, "ts", 2) == 0 and retention.settle(spark, base, "ts", 3) == 1
    assert sorted(r["id"] for r in retention.kept(spark, base, "ts", DAYS).collect()) == [1, 2, 2]
    retention.put(spark.sql("select 5L as id, timestamp'2024-04-01 00:00:00' as ts"), 3, base, "ts", DAYS)
    assert versions.parts(spark, base) == ["day=2024-04-01/batch=3"]
