"""Bulk upserts of entities by name, where one name may stand for different entities in different places.

Records are taken in the order of the batch, and what one leaves behind decides about the next: the first of two new records creates
the entity, the second updates it, or, from another place, is refused or gets a row of its own under the name with its
place in brackets. Only names that are equal up to the first bracket can touch each other, so these form conflict groups;
each is folded in order, all groups at once. Entities of other names stay as they are and are not moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .folds import fold
from .shared import materialize
from .sizes import broadcast_if_small

# How well a place is known, and what to do about a name that is taken elsewhere.
QUALITIES = ["polygon", "address", "place_centroid", "zip_centroid", "city_only", "unknown"]
POLICIES = ["skip", "disambiguate"]
SOURCE = "registry-stub"
#: A name that carries a place of two letters itself.
MARKED = re.compile(r"\s\([A-Z]{2}\)\s*$")


def _stripped(name: str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", "")


def _base(name: str) -> Column:
    """The part of a name that decides its conflict group."""
    return F.concat(F.lit("="), F.regexp_replace(_stripped(name), r"(?s) \(.*$", ""))


def place(record: dict, known: dict[str, dict], default: str) -> tuple[str | None, bool, str | None]:
    """Under which name a record is stored, whether that is new, and why not if it is refused."""
    name, quality, state = record["name"] or "", record["location_quality"], record["state"]
    policy = (record["on_collision"] or default).strip().lower()
    if not name:
        return None, False, "empty_name"
    if quality is not None and quality.strip() not in QUALITIES:
        return None, False, f"bad_quality:{quality.strip()}"
    if policy not in POLICIES:
        return None, False, f"bad_on_collision:{policy}"
    if name not in known:
        return name, True, None
    there = known[name]["state"]
    if not state or not there or there.upper() == state.upper():
        return name, False, None
    if policy == "skip":
        return None, False, "state_collision"
    own = state.strip().upper()
    if not own or there == own or MARKED.search(name):
        return name, False, None
    return f"{name} ({own})", f"{name} ({state.upper()})" not in known, None


def upsert(entities: DataFrame, records: DataFrame, on_collision: str = "skip") -> tuple[DataFrame, DataFrame]:
    """The entities (name, state, location_quality, display_name, source, ...) after the records, and what became of each record.

    ``records`` have ord, on_collision and the entities' columns. A value of a record replaces the entity's unless it
    is null. Outcomes: (ord, name, stored_name, action, disambiguated, reason); ``action`` is created, updated or
    skipped. Names are compared as they are, less the white space around a record's. Entity names must be unique; those without a name
    stay untouched. Records of equal ``ord`` are taken by name.
    """
    if on_collision not in POLICIES:
        raise ValueError(f"on_collision must be one of {POLICIES}, not {on_collision}")
    fields = [c for c in entities.columns if c != "name"]
    of = {c: entities.schema[c] for c in fields}
    asked = records.select(F.col("ord").cast("long").alias("ord"), _stripped("name").alias("name"), F.col("on_collision"), *(F.col(c).cast(of[c].dataType).alias(c) if c in records.columns else F.lit(None).cast(of[c].dataType).alias(c) for c in fields))
    asked = asked.withColumn("base", F.coalesce(_base("name"), F.lit("-")))  # records without a name are refused one by one
    asked = asked.withColumn("base", F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("-"), F.coalesce(F.col("ord").cast("string"), F.lit("")))).otherwise(F.col("base")))
    mine = entities.withColumn("base", _base("name"))
    bases = broadcast_if_small(asked.select("base").distinct())
    touched = mine.join(bases, "base", "left_semi").select("base", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), "name", F.lit(None).cast("string").alias("on_collision"), *fields)
    rows = touched.unionByName(asked.withColumn("kind", F.lit(1)))
    schema = StructType([StructField("ord", LongType()), StructField("asked", StringType()), StructField("action", StringType()), StructField("disambiguated", BooleanType()), StructField("reason", StringType()), StructField("name", StringType()), *(StructField(c, of[c].dataType) for c in fields)])
    blank = (None,) * len(fields)

    def step(known: dict[str, dict], row: dict) -> Iterator[tuple]:
        if not row["kind"]:
            known[row["name"]] = {c: row[c] for c in fields}
            return
        stored, new, reason = place(row, known, on_collision)
        apart = stored is not None and stored != row["name"]
        yield (row["ord"], row["name"], "skipped" if stored is None else "created" if new else "updated", apart, reason, stored, *blank)
        if stored is not None:
            given = {c: row[c] for c in fields} | {"source": row["source"] or SOURCE}
            if apart and given.get("display_name") is None:
                given["display_name"] = row["name"]
            if given["location_quality"] is not None:
                given["location_quality"] = given["location_quality"].strip()
            held = known.setdefault(stored, dict.fromkeys(fields))
            held.update({c: v for c, v in given.items() if v is not None and c in held})

    def finish(known: dict[str, dict]) -> Iterator[tuple]:
        for name, held in known.items():
            yield (None, None, None, None, None, name, *(held[c] for c in fields))

    made = materialize(fold(rows, "base", ["kind", "ord", "name"], dict, step, finish, schema), "stubs")
    rest = mine.join(bases, "base", "left_anti").select("name", *fields)
    return rest.unionByName(made.where("action is null").select("name", *fields)), made.where("action is not null").select("ord", F.col("asked").alias("name"), F.col("name").alias("stored_name"), "action", "disambiguated", "reason")


def summary(outcomes: DataFrame) -> DataFrame:
    """(action, reason, disambiguated, records): what became of a batch."""
    return outcomes.groupBy("action", "reason", "disambiguated").agg(F.count(F.lit(1)).alias("records"))
