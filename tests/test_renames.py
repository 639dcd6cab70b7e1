"""Renames and merges against one after the other, and pointer chains against following them."""

import random

import pytest
from pyspark.sql import functions as F

from townscribe.operators import renames, sizes


def one_by_one(entities, documents, asked):
    names, docs, out = dict(entities), {}, []
    for doc, owner, path in documents:
        docs.setdefault(owner, {}).setdefault(path, doc)
    for ord_, me, new in sorted(asked, key=lambda r: r[0]):
        new = (new or "").strip()
        if not new or len(new) > 200:
            out.append((ord_, me, "error:bad new_name", None))
        elif me not in names:
            out.append((ord_, me, "error:not_found", None))
        elif names[me] == new:
            out.append((ord_, me, "noop", None))
        else:
            target = next((i for i, n in names.items() if n == new), None)
            if target is None:
                names[me] = new
                out.append((ord_, me, "renamed", None))
            else:
                docs[target] = docs.pop(me, {}) | docs.get(target, {})
                del names[me]
                out.append((ord_, me, "merged", target))
    return names, sorted((d, o, p) for o, ps in docs.items() for p, d in ps.items()), out


def check(spark, entities, documents, asked):
    e = spark.createDataFrame(entities, "entity_id long, name string")
    outcomes, names, claims = renames.apply_renames(e, spark.createDataFrame(asked, "ord long, entity_id long, new_name string").repartition(3))
    moved = renames.move(spark.createDataFrame(documents, "document_id long, entity_id long, path string"), claims, ["path"])
    want_names, want_docs, want = one_by_one(entities, documents, asked)
    assert sorted(((r["ord"], r["entity_id"], r["status"], r["target_id"]) for r in outcomes.collect()), key=str) == sorted(want, key=str)
    got = {r["entity_id"]: r["name"] for r in names.collect()}
    assert got.items() <= want_names.items()
    touched = {r["entity_id"] for r in claims.collect()}
    assert {i: n for i, n in want_names.items() if i in touched} == got
    assert sorted(tuple(r) for r in moved.select("document_id", "entity_id", "path").collect()) == want_docs


@pytest.mark.parametrize("backward", [False, True])
def test_chain_of_100(spark, backward):
    entities = [(i, f"n{i:03}") for i in range(102)]
    documents = [(1000 + i, i, f"p{i % 7}") for i in range(102)] + [(2000 + i, i, f"own{i}") for i in range(102)]
    steps = range(100, -1, -1) if backward else range(101)
    check(spark, entities, documents, [(k, i, f"n{i + 1:03}") for k, i in enumerate(steps)])


def test_random_renames(spark):
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        entities = [(i, f"n{i}") for i in range(60)]
        documents = [(i, rng.randrange(60), f"p{i % 23}") for i in range(300)]
        documents = list({(o, p): (d, o, p) for d, o, p in documents}.values())
        asked = [(k, rng.randrange(65), rng.choice([f"n{rng.randrange(70)}", f" n{rng.randrange(60)} ", f"x{rng.randrange(9)}", "", None, "y" * 201])) for k in range(90)]
        check(spark, entities, documents, asked)


def test_swaps_free_names(spark):
    entities = [(1, "a"), (2, "b"), (3, "c")]
    check(spark, entities, [(10, 1, "p"), (11, 2, "p"), (12, 3, "q")], [(1, 1, "t"), (2, 2, "a"), (3, 1, "b"), (4, 3, "a"), (5, 3, "z")])
    check(spark, entities, [], [])


def follow(pointers):
    out = {}
    for s in pointers:
        seen, now = [s], pointers[s]
        while now in pointers and now not in seen:
            seen.append(now)
            now = pointers[now]
        out[s] = min(seen[seen.index(now) :]) if now in seen else now
    return out


def test_pointers(spark):
    rng = random.Random(9)
    for case in range(4):
        pointers = {i: i + 1 for i in range(100)} if case == 0 else {i: rng.randrange(140) for i in range(100)} if case < 3 else {**{i: (i + 1) % 37 for i in range(37)}, **{50 + i: i for i in range(20)}, 90: 91, 91: 90, 95: 96}
        pointers = {s: t for s, t in pointers.items() if s != t}
        got = renames.resolve(spark.createDataFrame(list(pointers.items()), "source long, target long")).collect()
        assert {r["source"]: r["target"] for r in got} == follow(pointers)
        assert len(got) == len(pointers)
    assert renames.resolve(spark.createDataFrame([], "source long, target long")).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    true = renames.materialize
    monkeypatch.setattr(renames, "materialize", lambda df, name: plans.append(plan(df)) or true(df, name))
    names = spark.range(3000).selectExpr("concat('n', id) as a", "concat('n', if(id % 3 = 0, id, id - 1)) as b")
    assert renames.groups(names).select("group").distinct().count() == 1000
    pointers = renames.resolve(spark.range(3000).selectExpr("id as source", "id + 1 as target"))
    plans.append(plan(pointers))
    assert {r["target"] for r in pointers.select("target").distinct().collect()} == {3000}
    assert len(plans) > 15 and not any("Broadcast" in p for p in plans)


def test_what_is_not_small_is_not_broadcast_by_its_files(spark, monkeypatch):
    monkeypatch.setattr(sizes, "is_small", lambda df, *a: False)
    rows = spark.range(100).select(F.col("id").alias("entity_id"), F.lit("p").alias("path"), F.col("id").alias("document_id"))
    claims = spark.range(50).selectExpr("id as entity_id", "id div 2 as final_id", "cast(id % 2 as int) as claim")
    moved = renames.move(rows, claims, ["path"])
    assert "Broadcast" not in plan(moved)
    assert sorted(tuple(r) for r in moved.select("entity_id", "document_id").collect()) == sorted([(i // 2, i) for i in range(0, 50, 2)] + [(i, i) for i in range(50, 100)])
