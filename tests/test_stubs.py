"""Stub upserts against insertion one by one into a table."""

import random
import re

import pytest

from townscribe.operators import stubs

ENTITY = "name string, state string, city string, display_name string, location_quality string, source string"
RECORD = "ord long, name string, state string, city string, location_quality string, on_collision string, source string, display_name string"


def one_by_one(entities, records, default):
    table = {e[0]: dict(zip(("state", "city", "display_name", "location_quality", "source"), e[1:], strict=True)) for e in entities}
    out = []
    for ord_, name, state, city, quality, policy, source, display in sorted(records, key=lambda r: r[0]):
        name = (name or "").strip(" ")
        policy = (policy or default).strip().lower()
        if not name:
            out.append((ord_, "skipped", False, "empty_name"))
            continue
        if quality is not None and quality.strip() not in ("polygon", "address", "place_centroid", "zip_centroid", "city_only", "unknown"):
            out.append((ord_, "skipped", False, f"bad_quality:{quality.strip()}"))
            continue
        if policy not in ("skip", "disambiguate"):
            out.append((ord_, "skipped", False, f"bad_on_collision:{policy}"))
            continue
        target, new = name, name not in table
        if not new and state and table[name]["state"] and table[name]["state"].upper() != state.upper():
            if policy == "skip":
                out.append((ord_, "skipped", False, "state_collision"))
                continue
            if not re.search(r"\s\([A-Z]{2}\)\s*$", name) and table[name]["state"] != state.strip().upper() and state.strip():
                target = f"{name} ({state.strip().upper()})"
                new = f"{name} ({state.upper()})" not in table
                display = display or name
        row = table.setdefault(target, dict.fromkeys(("state", "city", "display_name", "location_quality", "source")))
        for c, v in (("state", state), ("city", city), ("display_name", display), ("location_quality", quality and quality.strip()), ("source", source or "registry-stub")):
            if v is not None:
                row[c] = v
        out.append((ord_, "created" if new else "updated", target != name, None))
    return sorted((n, *r.values()) for n, r in table.items()), out


def batch(seed, n=400):
    rng = random.Random(seed)
    names = ["Lakewood", "Lakewood (GA)", "Elm (West)", "Elm", "Oak ", " Oak", "Hot", "Hot", "Hot", "", None, "Pine (CA)", "Pine", "Lakewood (GA) (TX)"]
    return [(i, rng.choice(names), rng.choice(["GA", "TX", "ga", None, "", "CA", " TX"]), rng.choice([None, "A", "B"]), rng.choice([None, None, "address", " polygon ", "bad"] if i % 9 == 0 else [None, "address"]), rng.choice([None, "skip", "disambiguate", " Disambiguate", "other"] if i % 7 == 0 else [None, "disambiguate"]), rng.choice([None, "src"]), rng.choice([None, None, "Shown"])) for i in range(n)]


@pytest.mark.parametrize("default", ["skip", "disambiguate"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_by_one(spark, default, seed):
    entities = [("Lakewood", "GA", None, None, None, "old"), ("Elm", None, "C", None, None, None), ("Other", "TX", None, None, None, "old"), ("Hot (TX)", "TX", None, None, "address", None)]
    records = batch(seed)
    after, outcomes = stubs.upsert(spark.createDataFrame(entities, ENTITY), spark.createDataFrame(random.Random(seed).sample(records, len(records)), RECORD).repartition(5), default)
    table, out = one_by_one(entities, records, default)
    assert sorted((tuple(r) for r in after.select("name", "state", "city", "display_name", "location_quality", "source").collect()), key=str) == sorted(table, key=str)
    assert sorted(tuple(r) for r in outcomes.select("ord", "action", "disambiguated", "reason").collect()) == out
    counted = {(r["action"], r["reason"], r["disambiguated"]): r["records"] for r in stubs.summary(outcomes).collect()}
    assert sum(counted.values()) == len(records) and ("skipped", "state_collision", False) in counted


def test_order_of_a_batch_decides(spark):
    entities = spark.createDataFrame([], ENTITY)
    a = [(1, "New", "GA", None, None, None, None, None), (2, "New", "TX", None, None, None, None, None)]
    b = [(2, *a[0][1:]), (1, *a[1][1:])]
    states = []
    for rows in (a, b):
        after, out = stubs.upsert(entities, spark.createDataFrame(rows, RECORD))
        states.append(after.first()["state"])
        assert [r["action"] for r in out.orderBy("ord").collect()] == ["created", "skipped"]
    assert states == ["GA", "TX"]
    with pytest.raises(ValueError):
        stubs.upsert(entities, spark.createDataFrame(a, RECORD), "merge")


def test_a_third_of_all_records_on_one_name(spark):
    records = [(i, "Hot" if i % 3 == 0 else f"Name {i}", ["GA", "TX"][i % 2], None, None, "disambiguate", None, None) for i in range(900)]
    after, out = stubs.upsert(spark.createDataFrame([], ENTITY), spark.createDataFrame(records, RECORD))
    table, want = one_by_one([], records, "skip")
    assert sorted(tuple(r)[0] for r in after.select("name").collect()) == [t[0] for t in table]
    assert sorted(tuple(r) for r in out.select("ord", "action", "disambiguated", "reason").collect()) == want


def test_query(spark, data):
    from townscribe.plans import catalog, registry, resolution

    catalog.load()
    entities, records = resolution.stub_batch(spark, data)
    held = [tuple(r) for r in entities.select("name", "state", "city", "display_name", "location_quality", "source").collect()]
    asked = [tuple(r) for r in records.select("ord", "name", "state", "city", "location_quality", "on_collision", "source", "display_name").collect()]
    got = registry.QUERIES["stub_upsert"](spark, data).select("ord", "action", "disambiguated", "reason").collect()
    assert sorted(tuple(r) for r in got) == one_by_one(held, asked, "skip")[1]
    assert {r["action"] for r in got} == {"created", "updated", "skipped"}
