"""Lookups with optional scopes, rankings of matches and feeds, labels of both sides, caps of prepared documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .sizes import broadcast_if_small


def in_scope(rules: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that have the wanted values; a column asked for None is not asked at all."""
    for column, value in wanted.items():
        if value is not None:
            rows = F.col(column) == value
            rules = rules.where(rows)
    return rules


def in_form(rules: DataFrame, form: str | None, column: str = "entity_form", fallback: str = "unknown") -> DataFrame:
    """Rows of a form or of none in particular; all if no form is asked for."""
    return rules if form is None else rules.where(F.col(column).isin(form, fallback))


def bogus_states(locations: DataFrame, known: list[str], column: str = "state") -> DataFrame:
    """Locations whose state is no known code, whatever its case; a missing state is not bogus."""
    return locations.where(~F.lower(column).isin([k.lower() for k in known]))


def ranked_matches(entities: DataFrame, query: str, most: int | None = None) -> DataFrame:
    """Entities (entity_id, name) whose name has the query: equal names first, then the earliest, the shortest, by name."""
    needle, hay = query.strip().lower(), F.lower("name")
    found = entities.where(hay.contains(needle) & F.lit(needle != ""))
    found = found.select("entity_id", "name", (hay != needle).alias("_other"), F.locate(needle, hay).alias("position"), F.length("name").alias("length"))
    found = found.orderBy("_other", "position", "length", hay, "entity_id").drop("_other")
    return found if most is None else found.limit(most)


def feed(proposals: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Each entity's proposals (entity, proposal_id, upvotes, created_at) with their place: most upvotes, then newest, then the least id."""
    w = Window.partitionBy(entity).orderBy(F.desc("upvotes"), F.desc("created_at"), "proposal_id")
    return proposals.withColumn("place", F.row_number().over(w))


def longest(texts: DataFrame, key: str, most: int, text: str = "text", row: str = "id") -> DataFrame:
    """Each key's longest texts, the least id first among equals; only lengths are ranked, and texts stay where they are."""
    w = Window.partitionBy(key).orderBy(F.desc("n_chars"), row)
    return texts.select(key, row, F.length(text).cast("long").alias("n_chars")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def labelled(assignments: DataFrame, entities: DataFrame, people: DataFrame, side: str) -> DataFrame:
    """Assignments with their entity's name and the name of the other person: of the grantor for a delegate, and the other way round."""
    other = {"delegate_id": "grantor_id", "grantor_id": "delegate_id"}[side]
    names = people.select(F.col("person_id").alias(other), F.col("name").alias("person"))
    return assignments.join(broadcast_if_small(entities.select("entity_id", "entity")), "entity_id").join(broadcast_if_small(names), other)


def projected_pages(estimated: Column, readable: Column, pages: Column) -> Column:
    """Pages a scan service would read: the estimate if there is one above zero, else all pages of a scanned document, never fewer than none."""
    given = F.expr("try_cast(null as int)") if estimated is None else estimated.try_cast("int")
    rest = F.when(~readable, F.greatest(F.lit(0), F.coalesce(pages, F.lit(0)))).otherwise(F.lit(0))
    return F.when(given.isNotNull(), F.greatest(F.lit(0), given)).otherwise(F.coalesce(rest, F.lit(0)))


def cap_pages(rows: DataFrame, most: int) -> DataFrame:
    """Rows (ord, projected) with the running total, and whether it is still within a budget of ``most`` pages.

    Rows of equal ord share a total, and those without one come last, as in SQL. Totals are summed by range of
    ord first, so that no task sorts all rows.
    """
    return _running(rows, "ord", "projected", "running").withColumn("within", F.col("running") <= most)


def _running(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written: its range is read twice, and a second sample could cut elsewhere
    by = F.asc_nulls_last(order)
    ranged = materialize(rows.repartitionByRange(parts, by).withColumn("_range", F.spark_partition_id()), "ranges")
    # a row a range
    before = ranged.groupBy("_range").agg(F.sum(value).alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    here = F.sum(value).over(Window.partitionBy("_range").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("_here", here).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_here")).drop("_range", "_here", "_before")


def iso_date(value: Column) -> Column:
    """The date in front of a time, which a space or a T parts; null for nothing."""
    s = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.nullif(F.split_part(F.split_part(s, F.lit(" "), F.lit(1)), F.lit("T"), F.lit(1)), F.lit(""))
