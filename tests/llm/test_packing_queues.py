"""Every source keeps its own queue, whatever the number of sources."""

from collections import Counter, defaultdict

import pytest

from townscribe.llm import packing

from .tables import DOC, awkward


@pytest.mark.parametrize("window", [64, 512, 32_768])
def test_table_of_queues_gives_the_drivers_places(spark, monkeypatch, window):
    docs = spark.createDataFrame([*awkward(), *((1000 + i, "word " * (i % 37), "en", f"s{i % 23}", 0) for i in range(200))], DOC)
    want = Counter(map(tuple, packing.pack(docs, length=64, window=window).collect()))
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    assert Counter(map(tuple, packing.pack(docs, length=64, window=window).collect())) == want and len(want) > 200


def test_windows_hold_the_mixture_of_sources_above_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    rows = [(i, "word " * 400, "en", "hot" if i % 2 else f"s{i % 8}", 0) for i in range(160)]
    rows += [(1000 + i, "word " * 400, "en", f"t{i}", 0) for i in range(12)]
    got = packing.pack(spark.createDataFrame(rows, DOC).repartition(3), length=64, window=1024).collect()
    source = {r[0]: r[3] for r in rows}
    total, per = Counter(), defaultdict(Counter)
    for r in got:
        total[source[r["doc_id"]]] += r["length"]
        per[r["sequence_id"] * 64 // 1024][source[r["doc_id"]]] += r["length"]
    whole = sum(total.values())
    assert len(total) == 17
    for _, window in sorted(per.items())[:-1]:
        for s in total:
            assert abs(window[s] / sum(window.values()) - total[s] / whole) < 0.07 and window[s]
