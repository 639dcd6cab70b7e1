"""Renames taken in order, of which each may depend on those before it; and chains of pointers followed to their ends.

A rename to a free name changes the entity's name and frees its old one; a rename to a taken name merges the entity
into the one that has it, and later renames to or of either see the result. Two renames can only touch each other if
names connect them, so names that renames connect form groups (by pointer jumping: the rounds grow with the
logarithm of the longest chain; each joins by shuffle, so that no table goes through the driver). Each group's renames are folded in order, all groups at once. The fold keeps for each
entity whose documents it has, in the order of their claims: its own first, then those merged into it, in turn; so
the documents of all merged entities move once, straight to the last one, however long the chain.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .folds import fold
from .shared import materialize
from .sizes import broadcast_if_small, shuffled

#: Characters of a name.
LONGEST = 200


def groups(edges: DataFrame) -> DataFrame:
    """(node, group) of (a, b): nodes that edges connect share the least node of all."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("group"))
    labels = materialize(labels, "labels")
    while True:
        # what the neighbours know, told to the node and to the one it points to; then each pointer is followed once
        told = both.join(shuffled(labels.select(F.col("node").alias("b"), F.col("group").alias("g"))), "b").groupBy("a").agg(F.min("g").alias("g"))
        met = told.join(shuffled(labels), F.col("a") == F.col("node")).select("node", "group", F.least("g", "group").alias("least"))
        hooked = met.select("node", "least").unionAll(met.select(F.col("group").alias("node"), "least")).groupBy("node").agg(F.min("least").alias("group"))
        up = hooked.select(F.col("node").alias("group"), F.col("group").alias("above"))
        new = materialize(hooked.join(shuffled(up), "group").select("node", F.col("above").alias("group")), "labels")
        if new.join(shuffled(labels.withColumnRenamed("group", "before")), "node").where("`group` <> `before`").isEmpty():
            return new
        labels = new


def resolve(pointers: DataFrame) -> DataFrame:
    """(source, target) with every target the end of its chain of (source, target); each source points to one target.

    A cycle ends at its least member, which points to itself, as does all that leads into it. Targets that are no
    sources are ends. The rounds grow with the logarithm of the longest chain.
    """
    own = pointers.where("source <> target").groupBy("source").agg(F.min("target").alias("target"))
    # the least node seen on the way tells cycles: after enough doublings everything on one has gone round it
    now = materialize(own.select("source", "target", F.least("source", "target").alias("seen")), "chains")
    rounds, most = 0, now.count()
    while True:
        ahead = now.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("seen").alias("later"))
        new = now.join(shuffled(ahead), "target", "left").select("source", F.coalesce("next", "target").alias("target"), F.least("seen", F.coalesce("later", "seen")).alias("seen"), F.col("next").isNotNull().alias("moved"))
        new = materialize(new, "chains")
        rounds += 1
        if new.where("moved").isEmpty() or 2**rounds > most:
            break
        now = new.drop("moved")
    # what still moves after more steps than there are nodes stands on a cycle; its least member was seen by all of it
    on = new.where("moved").select(F.col("target").alias("node")).distinct()
    least = new.join(shuffled(on), F.col("source") == F.col("node")).select("node", F.col("seen").alias("end"))
    return new.join(shuffled(least), F.col("target") == F.col("node"), "left").select("source", F.coalesce("end", "target").alias("target"))


def apply_renames(entities: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes, final names and claims of ``renames`` (ord, entity_id, new_name) over ``entities`` (entity_id, name).

    * outcomes: (ord, entity_id, status, old_name, new_name, target_id); status is renamed, merged, noop, or error:bad new_name
      (empty or longer than LONGEST) or error:not_found (never there, or merged before)
    * names: (entity_id, name) of the entities that are left and were touched
    * claims: (entity_id, final_id, claim): whose rows each touched entity's rows are now; of rows that exclude each other
      the one of the least claim stays

    Names are unique and compared as they are; ids are longs.
    """
    asked = renames.select(F.col("ord").cast("long").alias("ord"), F.col("entity_id").cast("long").alias("entity_id"), F.regexp_replace("new_name", r"(?U)^\s+|\s+$", "").alias("new_name"))
    known = entities.select(F.col("entity_id").cast("long").alias("entity_id"), "name")
    ids = broadcast_if_small(asked.select("entity_id").distinct())
    mine = known.join(ids, "entity_id", "left_semi")
    named = asked.join(shuffled(mine), "entity_id", "left").withColumn("bad", (F.coalesce("new_name", F.lit("")) == "") | (F.length("new_name") > LONGEST))
    named = materialize(named, "renames")
    refused = named.where("bad or name is null").select("ord", "entity_id", F.when(F.col("bad"), "error:bad new_name").otherwise("error:not_found").alias("status"), F.lit(None).cast("string").alias("old_name"), F.lit(None).cast("string").alias("new_name"), F.lit(None).cast("long").alias("target_id"))
    good = named.where("not bad and name is not null")
    parts = broadcast_if_small(groups(good.select(F.col("name").alias("a"), F.col("new_name").alias("b"))).withColumnRenamed("node", "name"))
    work = good.join(parts, "name").select("group", F.lit(1).alias("kind"), "ord", "entity_id", "name", "new_name")
    held = known.join(parts, "name").select("group", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), "entity_id", "name", F.lit(None).cast("string").alias("new_name"))
    schema = StructType([StructField("what", StringType()), StructField("ord", LongType()), StructField("entity_id", LongType()), StructField("status", StringType()), StructField("old_name", StringType()), StructField("new_name", StringType()), StructField("target_id", LongType())])

    def step(state: dict, row: dict) -> Iterator[tuple]:
        name_of, id_of, members = (state.setdefault(k, {}) for k in ("name_of", "id_of", "members"))
        me = row["entity_id"]
        if not row["kind"]:
            name_of[me], id_of[row["name"]], members[me] = row["name"], me, [me]
            return
        new, old = row["new_name"], name_of.get(me)
        if old is None:
            yield ("outcome", row["ord"], me, "error:not_found", None, None, None)
        elif old == new:
            yield ("outcome", row["ord"], me, "noop", old, new, None)
        elif new not in id_of:
            del id_of[old]
            name_of[me], id_of[new] = new, me
            yield ("outcome", row["ord"], me, "renamed", old, new, None)
        else:
            target = id_of[new]
            members[target] += members.pop(me)
            del id_of[old], name_of[me]
            yield ("outcome", row["ord"], me, "merged", old, new, target)

    def finish(state: dict) -> Iterator[tuple]:
        for me, name in state.get("name_of", {}).items():
            yield ("name", None, me, None, None, name, None)
        for final, members in state.get("members", {}).items():
            for claim, me in enumerate(members):
                yield ("claim", claim, me, None, None, None, final)

    made = materialize(fold(work.unionByName(held), "group", ["kind", "ord", "entity_id"], dict, step, finish, schema), "renamed")
    outcomes = made.where("what = 'outcome'").select("ord", "entity_id", "status", "old_name", "new_name", "target_id").unionByName(refused)
    names = made.where("what = 'name'").select("entity_id", F.col("new_name").alias("name"))
    return outcomes, names, made.where("what = 'claim'").select("entity_id", F.col("target_id").alias("final_id"), F.col("ord").cast("int").alias("claim"))


def move(rows: DataFrame, claims: DataFrame, unique: list[str]) -> DataFrame:
    """``rows`` (entity_id, ...) at their final entities; of several with equal ``unique`` values at one entity the least claim's stays.

    Rows of untouched entities stay where they are. Within one claim the least of the other columns stays.
    """
    to = broadcast_if_small(claims)
    moved = rows.join(to, "entity_id")
    others = [c for c in rows.columns if c not in ("entity_id", *unique)]
    first = F.min(F.struct("claim", *others)).alias("r")
    kept = moved.groupBy("final_id", *unique).agg(first).select(F.col("final_id").alias("entity_id"), *unique, *(F.col(f"r.`{c}`").alias(c) for c in others))
    return rows.join(to, "entity_id", "left_anti").unionByName(kept)
