"""Files of several versions as one table; broken ones are set aside, reported and moved."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import StructType

from townscribe.sources import contracts
from townscribe.sources.contracts import Contract, Step

CONTRACT = Contract(
    "id int, title string, lat double",
    (
        Step(add={"quality": ("string", "case when lat is null then 'unknown' else 'address' end")}),
        Step(rename={"title": "name"}, drop=("lat",), cast={"id": "bigint"}, add={"status": ("string", "'unknown'")}),
    ),
    required=("id", "name"),
)
V1 = pa.table({"id": pa.array([1, 2, None], pa.int32()), "title": ["a", "b", "c"], "lat": pa.array([1.5, None, 2.0])})
V2 = pa.table({"quality": ["polygon", None], "lat": pa.array([0.5, 0.5]), "title": ["d", None], "id": pa.array([3, 4], pa.int32())})
V3 = pa.table({"id": pa.array([2**40], pa.int64()), "name": ["e"], "quality": ["zip"], "status": ["known"], "more": [7]})
ROWS = [(1, "a", "address", "unknown"), (2, "b", "unknown", "unknown"), (3, "d", "polygon", "unknown"), (2**40, "e", "zip", "known")]


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    (at / "sub [dir] {a}").mkdir(parents=True)
    pq.write_table(V1, at / "one.parquet")
    pq.write_table(V2, at / "sub [dir] {a}" / "two.parquet")
    pq.write_table(V3, at / "three.parquet")
    (at / "corrupt.parquet").write_bytes(b"PAR1 and no more")
    (at / "sub [dir] {a}" / "empty.parquet").write_bytes(b"")
    (at / "cut.parquet").write_bytes((at / "one.parquet").read_bytes()[:-9])
    (at / "_SUCCESS").write_bytes(b"")
    pq.write_table(pa.table({"id": pa.array([1], pa.int32()), "title": [b"x"]}), at / "stranger.parquet")
    return at


def told(opened):
    return {os.path.basename(r["path"]): (r["version"], r["reason"]) for r in opened.files.collect()}


def test_three_versions_and_broken_files(spark, folder, tmp_path):
    got = contracts.open_folder(spark, str(folder), CONTRACT)
    assert got.rows.schema.simpleString() == "struct<id:bigint,name:string,quality:string,status:string>"
    assert sorted(tuple(r) for r in got.rows.collect()) == ROWS
    assert sorted((r["id"] or 0, r["name"] or "") for r in got.refused.collect()) == [(0, "c"), (4, "")]
    files = told(got)
    assert {k: v for k, (v, r) in files.items() if r is None} == {"one.parquet": 1, "two.parquet": 2, "three.parquet": 3}
    assert files["stranger.parquet"] == (0, "no version; nearest is 1: title is binary, not string, lat missing")
    assert all(files[k][1].startswith("unreadable: ") for k in ("corrupt.parquet", "empty.parquet", "cut.parquet"))
    assert len(files) == 7

    with pytest.raises(ValueError):
        contracts.quarantine(spark, got, str(folder), f"{folder}/bad")
    assert contracts.quarantine(spark, got, str(folder), str(tmp_path / "bad")) == 4
    (run,) = os.listdir(tmp_path / "bad")
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path / "bad" / run) for d, _, fs in os.walk(tmp_path / "bad" / run) for f in fs if f.endswith(".parquet")) == ["corrupt.parquet", "cut.parquet", "stranger.parquet", "sub [dir] {a}/empty.parquet"]
    assert spark.read.json(f"{tmp_path}/bad/{run}/_reasons").count() == 4
    again = contracts.open_folder(spark, str(folder), CONTRACT)
    assert again.set_aside().count() == 0 and sorted(tuple(r) for r in again.rows.collect()) == ROWS
    assert contracts.quarantine(spark, again, str(folder), str(tmp_path / "bad")) == 0


def test_filters_and_columns_reach_the_scans(spark, folder):
    plan = contracts.open_folder(spark, str(folder), CONTRACT).rows.where("name = 'a'").select("name")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(title,a)") == 2 and plan.count("EqualTo(name,a)") == 1
    assert "lat:double" not in plan and "quality:string" not in plan


def test_pages_are_checked_if_asked_for(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    pq.write_table(pa.table({"id": pa.array(range(5000), pa.int32()), "title": [str(i) for i in range(5000)], "lat": [0.0] * 5000}), at / "a.parquet", compression="gzip")
    data = bytearray((at / "a.parquet").read_bytes())
    data[400:4000] = bytes(3600)
    (at / "b.parquet").write_bytes(bytes(data))
    assert contracts.open_folder(spark, str(at), CONTRACT).set_aside().count() == 0
    got = contracts.open_folder(spark, str(at), CONTRACT, deep=True)
    assert [os.path.basename(r["path"]) for r in got.set_aside().collect()] == ["b.parquet"] and got.rows.count() == 5000


def test_narrower_types_empty_folders_and_bad_contracts(spark, tmp_path):
    (tmp_path / "none").mkdir()
    got = contracts.open_folder(spark, str(tmp_path / "none"), CONTRACT)
    assert got.rows.count() == got.files.count() == 0 and got.rows.columns == ["id", "name", "quality", "status"]
    at = tmp_path / "in"
    at.mkdir()
    wide = Contract("id bigint, x double, t timestamp")
    times = spark.sql("select cast(3 as int) as id, cast(1.5 as float) as x, timestamp_ntz'2024-01-02 03:04:05' as t")
    times.write.parquet(str(at / "narrow"))
    spark.sql("select 4L as id, 2.5d as x, timestamp'2024-01-02 03:04:05' as t").write.parquet(str(at / "wide"))
    got = contracts.open_folder(spark, str(at), wide)
    assert sorted((r["id"], r["x"], str(r["t"])[:19]) for r in got.rows.selectExpr("id", "x", "cast(t as string) as t").collect()) == [(3, 1.5, "2024-01-02 03:04:05"), (4, 2.5, "2024-01-02 03:04:05")]
    for bad in (Step(drop=("y",)), Step(add={"x": ("int", "1")}), Step(rename={"x": "id"}), Step(cast={"z": "int"})):
        with pytest.raises(ValueError):
            Contract("id bigint, x double", (bad,)).schemas()
    with pytest.raises(ValueError):
        Contract("id bigint", required=("y",)).schemas()
    assert Contract("id bigint", (Step(rename={"id": "key"}, cast={"key": "string"}),)).schemas()[1] == StructType.fromDDL("key string")
