"""Replacement of tables and partitions: whole or not at all, and no writer loses what another wrote."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from townscribe.sources import versions


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def adding(spark, *new):
    rows = spark.createDataFrame([(i,) for i in new], "id long")
    return lambda old: rows if old is None else old.unionAll(rows)


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    base, meet, out = str(tmp_path / "m"), threading.Barrier(2), {}
    versions.merge(spark, base, adding(spark, 0))

    def write(i):
        # both have seen version 1 before either commits
        out[i] = versions.merge(spark, base, adding(spark, i), pause=lambda k: meet.wait(60) if k == 0 else None)

    both = [threading.Thread(target=write, args=(i,)) for i in (1, 2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert ids(versions.read(spark, base)) == [0, 1, 2]
    assert sorted(out.values()) == [2, 3]
    assert ids(versions.read(spark, base, 1)) == [0]


def test_a_writer_gives_up_after_its_tries(spark, tmp_path):
    base = str(tmp_path / "m")
    versions.merge(spark, base, adding(spark, 0))
    other = lambda k: versions.merge(spark, base, adding(spark, 10 + k))
    with pytest.raises(versions.Stale):
        versions.merge(spark, base, adding(spark, 1), pause=other)
    assert ids(versions.read(spark, base)) == [0, 10, 11, 12]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def test_a_log_file_is_created_once(spark, tmp_path):
    at = f"{tmp_path}/x"
    assert versions._create_once(spark, at, "a") and not versions._create_once(spark, at, "b")
    assert versions._text(spark, at) == "a" and [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["x"]


CHILD = "parent string, kind string, id long"


def test_partitions_are_replaced_and_others_stay(spark, tmp_path):
    base = str(tmp_path / "c")
    rows = lambda *x: spark.createDataFrame(list(x), CHILD)
    versions.replace_partitions(rows(("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b b", "x", 4), ("c/d", "x", 5)), base, ["parent", "kind"])
    versions.replace_partitions(rows(("a", "x", 9), ("b b", "y", 10)), base, ["parent", "kind"], emptied=[{"parent": "a", "kind": "y"}])
    now = versions.read(spark, base)
    assert sorted(map(tuple, now.select("parent", "kind", "id").collect())) == [("a", "x", 9), ("b b", "x", 4), ("b b", "y", 10), ("c/d", "x", 5)]
    assert ids(versions.read(spark, base, 1)) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        versions.replace_partitions(rows(("a", "x", 1)), base, ["kind"])
    assert versions.tidy(spark, base) == 1  # what the refused write left
    assert ids(versions.read(spark, base)) == [4, 5, 9, 10]


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    base = str(tmp_path / "c")
    versions.replace_partitions(spark.createDataFrame([("a", "x", 1)], CHILD), base, ["parent"])
    seen = versions.read(spark, base)
    broken = spark.range(1000).select(F.lit("a").alias("parent"), F.lit("x").alias("kind"), F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("disk full")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="disk full"):
        versions.replace_partitions(broken, base, ["parent"])
    assert ids(versions.read(spark, base)) == [1] == ids(seen)
    versions.replace_partitions(spark.createDataFrame([("a", "x", 2)], CHILD), base, ["parent"])
    assert ids(seen) == [1]  # an open reader still sees what it began with


def test_sections_and_rules(spark):
    rows = [(1, 0, None, " H ", " one "), (1, 1, "k", None, "  "), (1, 2, "", "", "three"), (2, 0, "k2", "x", None)]
    got = versions.numbered_sections(spark.createDataFrame(rows, "source_id long, ordinal int, section_key string, heading string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "section_1", "H", "one"), (1, 2, "section_3", None, "three")]
    kind = "jurisdiction string, community_type string, entity_form string, topic_family string, value_text string, citation string"
    rules = [(" tx ", " HOA", "Unknown ", "Proxy", " v ", " c "), ("TX", "hoa", "x", "y", " ", "c"), ("TX", "hoa", "x", "y", "v", None)]
    assert [tuple(r) for r in versions.scoped_rules(spark.createDataFrame(rules, kind)).collect()] == [("TX", "hoa", "unknown", "proxy", "v", "c")]
