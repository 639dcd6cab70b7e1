"""Fixed-width records: any end, cut at any place."""

import random

import pytest
from pyspark.sql import functions as F

from townscribe.functions import rules
from townscribe.sources import records

FIELDS = {"id": (0, 4), "name": (4, 9), "status": (13, 1)}


def made(n, end, last=True, seed=1):
    rng = random.Random(seed)
    rows = [(f"{i:04}", "".join(rng.choice("ab é\xa0\n\r") for _ in range(8)) + "x", rng.choice("AI")) for i in range(n)]
    data = b"".join("".join(r).encode("latin-1") + end for r in rows)
    return [(a, b.strip(), c) for a, b, c in rows], data if last or not end else data[: -len(end)]


def got(spark, path, **more):
    return sorted(tuple(r) for r in records.read_records(spark, str(path), 14, FIELDS, **more).collect())


@pytest.mark.parametrize("end", [b"\r\n", b"\n", b"\r", b""])
def test_every_end_and_cut(spark, tmp_path, end):
    for last in (True, False):
        rows, data = made(37, end, last)
        (tmp_path / "f.dat").write_bytes(data)
        reader = records.FixedWidthReader({"path": str(tmp_path / "f.dat"), "length": "14", "fields": '{"id": [0, 4], "name": [4, 9], "status": [13, 1]}'}, list(FIELDS))
        for split in range(1, len(data) + 20, 1):
            reader.split = split
            parts = reader.partitions()
            assert [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()] == rows
        assert got(spark, tmp_path / "f.dat", split=50) == rows == got(spark, f"file://{tmp_path}/f.dat", ends="mixed")


def test_mixed_ends_and_what_is_left(spark, tmp_path):
    rows, data = made(50, b"")
    rng = random.Random(3)
    pieces = [data[i : i + 14] + rng.choice([b"\r\n", b"\n", b"\r"]) for i in range(0, len(data), 14)]
    (tmp_path / "m.dat").write_bytes(b"".join(pieces) + b"short")
    assert got(spark, tmp_path / "m.dat", ends="mixed") == rows
    with pytest.raises(Exception, match="ends with"):
        got(spark, tmp_path / "m.dat")
    (tmp_path / "d").mkdir()
    for name, content in (("a", b""), ("b", b"0001"), ("_c", data), (".d", data), ("e", data + b"rest")):
        (tmp_path / "d" / name).write_bytes(content)
    assert got(spark, tmp_path / "d") == rows
    (tmp_path / "none").mkdir()
    assert got(spark, tmp_path / "none") == []


def test_pieces_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RECORDS", 3)
    rows, data = made(20, b"\n")
    (tmp_path / "f").write_bytes(data)
    for ends in ("even", "mixed"):
        reader = records.FixedWidthReader({"path": str(tmp_path / "f"), "length": "14", "fields": '{"id": [0, 4]}', "ends": ends}, ["id"])
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        assert max(b.num_rows for b in batches) <= 4 and [r["id"] for b in batches for r in b.to_pylist()] == [r[0] for r in rows]


def test_reasons(spark):
    rows = [("Elm Condo", "A"), ("Elm Condo", "I"), ("Plain", "A"), ("Church Condo", "A"), (None, "A")]
    df = spark.createDataFrame(rows, "name string, status string")
    n = F.coalesce("name", F.lit(""))
    out = records.sifted(df, n.rlike("(?i)condo"), n.rlike("(?i)church"))
    assert {r["reason"]: r["rows"] for r in rules.stage_counts(out).collect()} == {"written": 1, "skip_status": 1, "skip_no_keyword": 2, "skip_rejected_pattern": 1}
