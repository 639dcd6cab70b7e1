"""Admission by a running budget against a fold over all requests in order."""

import datetime
import random
from collections import defaultdict

import pytest

from townscribe.operators import admission
from townscribe.sources.tables import table

T0 = datetime.datetime(2024, 3, 1)
KIND = "request_id long, service string, ts timestamp, cost double"


def fold(rows, budget, seconds):
    held, out = defaultdict(list), {}
    for rid, service, ts, cost in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        spent = sum(c for t, c in held[service] if (ts - t).total_seconds() < seconds)
        micro = round((cost or 0) * 1_000_000)
        out[rid] = micro <= 0 or spent + micro <= round(budget * 1_000_000)
        if out[rid] and micro > 0:
            held[service].append((ts, micro))
    return out | {r[0]: False for r in rows if r[2] is None}


def decided(spark, rows, budget, seconds, **more):
    got = admission.admit(spark.createDataFrame(rows, KIND).repartition(5), budget, seconds, **more).collect()
    assert len(got) == len(rows)
    return {r["request_id"]: r["admitted"] for r in got}, {r["request_id"]: r["path"] for r in got}


@pytest.mark.parametrize("buckets", [1, 6, 24])
def test_equals_a_fold(spark, buckets):
    rng = random.Random(buckets)
    rows, now = [], T0
    for i in range(900):
        # calm and busy times by turns, one service with most of the requests
        now += datetime.timedelta(seconds=rng.choice([5, 40] if (i // 150) % 2 else [300, 2500]))
        rows.append((i, rng.choice(["ocr", "ocr", "ocr", "search", None]), now, rng.choice([0.5, 1.25, 3.0, 0.0, -2.0, None, 7.5])))
    rows += [(1000 + i, "ocr", rows[200][2], 2.0) for i in range(5)] + [(2000, "ocr", None, 1.0), (2001, None, None, None)]
    got, path = decided(spark, rows, 20.0, 3600, buckets=buckets)
    assert got == fold(rows, 20.0, 3600)
    assert {"free", "folded"} <= set(path.values())
    if buckets == 24:
        assert list(path.values()).count("settled") > 50
        assert not all(got[r] for r in got if path[r] == "folded")


def test_window_is_open_at_its_far_end(spark):
    day = datetime.timedelta(days=1)
    rows = [(1, "a", T0, 5.0), (2, "a", T0 + day - datetime.timedelta(microseconds=1), 6.0), (3, "a", T0 + day, 5.0), (4, "a", T0 + day, 0.1)]
    got, _ = decided(spark, rows, 10.0, 86_400)
    assert got == {1: True, 2: False, 3: True, 4: True} == fold(rows, 10.0, 86_400)


def test_exact_budget_and_tables(spark):
    rows = [(i, "a", T0 + datetime.timedelta(minutes=i), 0.1) for i in range(40)]
    got, _ = decided(spark, rows, 1.0, 3600)
    assert sum(got.values()) == 10 and got == fold(rows, 1.0, 3600)
    assert admission.admit(spark.createDataFrame([], KIND), 1.0).count() == 0


def test_a_busy_service_is_many_stretches(spark):
    """Two thirds of all requests on one service: its contested times are dealt out as stretches, the rest stays where it is."""
    rows = []
    for day in range(30):
        at = T0 + datetime.timedelta(days=4 * day)
        rows += [(1000 * day + i, "hot" if i % 3 else f"s{day}", at + datetime.timedelta(seconds=i), 1.0) for i in range(90)]
        rows += [(1000 * day + 500 + i, "hot", at + datetime.timedelta(days=2, hours=i), 1.0) for i in range(20)]
    got, path = decided(spark, rows, 50.0, 86_400)
    assert got == fold(rows, 50.0, 86_400)
    frame = spark.createDataFrame(rows, KIND)
    from pyspark.sql import functions as F

    timed = frame.withColumn("bucket", F.floor(F.unix_micros("ts") / 3_600_000_000)).withColumn("micro", (F.col("cost") * 1_000_000).cast("long"))
    spots = admission.contested(timed, "service", 50_000_000, 24)
    assert spots.where("service = 'hot'").select("stretch").distinct().count() == 30
    assert list(path.values()).count("settled") > len(rows) / 3


def test_events(spark, data):
    from townscribe.plans import catalog, registry

    catalog.load()
    got = registry.QUERIES["spend_admission"](spark, data).collect()
    events = [(r["event_id"], r["event_type"], r["ts"], r["value"]) for r in table(spark, data, "events").collect()]
    days = {(r[1], r[2].date()) for r in events}
    want = fold(events, round(1.05 * sum(r[3] for r in events) / len(days), 2), 86_400)
    assert {r["request_id"]: r["admitted"] for r in got} == want
    assert 0 < sum(want.values()) < len(want)
