"""Catalogue rollups: entities in places, their documents, and the documents' chunks.

Column names are parameters, so that any star of tables can be rolled up.  Facts are
aggregated before they are joined: the join moves one row an entity, not one a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import broadcast_if_small


def escaped(q: str) -> str:
    """A search text with the wildcards of LIKE taken literally."""
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def matches(q: str | None, *columns: str) -> Column | None:
    """Case-insensitive containment of ``q`` in any of the columns; None if there is nothing to look for."""
    if not q:
        return None
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{escaped(q)}%"), F.lit(False))
    return hit


def entity_rollup(entities: DataFrame, documents: DataFrame, chunks: DataFrame, *, q: str | None = None, place: str | None = None, with_docs: bool = False) -> DataFrame:
    """Entities (entity_id, entity, place) with doc_count, total_value, last_ts, chunk_count.

    ``documents`` has entity_id, document_id, value, ts; ``chunks`` has document_id.  Counts of
    entities without documents are 0; their last_ts is null.
    """
    keep = matches(q, "entity", "place")
    if keep is not None:
        entities = entities.where(keep)
    if place is not None:
        entities = entities.where(F.lower("place") == place.lower())
    per_document = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    stats = (
        documents.join(per_document, "document_id", "left")
        .groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("doc_count"), F.sum("value").alias("total_value"), F.max("ts").alias("last_ts"), F.sum(F.coalesce("n_chunks", F.lit(0))).alias("chunk_count"))
    )
    out = entities.join(stats, "entity_id", "inner" if with_docs else "left")
    return out.select("entity_id", "entity", "place", F.coalesce("doc_count", F.lit(0)).cast("long").alias("doc_count"), F.coalesce("total_value", F.lit(0.0)).alias("total_value"), "last_ts", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))


def page(df: DataFrame, name: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows by name without regard to case, then by key, so that no page repeats a row."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return df.orderBy(F.lower(name), name, key).offset(offset).limit(limit)


def count_by_place(entities: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Entities of each place; only those with documents if ``documents`` is given."""
    if documents is not None:
        entities = entities.join(documents.select("entity_id"), "entity_id", "left_semi")
    return entities.groupBy("place").agg(F.countDistinct("entity_id").alias("entities"))


def coverage(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """For each place and for all of them (place null): entities, those with documents, and their percentage."""
    held = documents.select("entity_id").distinct().withColumn("held", F.lit(1))
    rows = entities.join(held, "entity_id", "left")
    out = rows.rollup("place").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.coalesce("held", F.lit(0))).cast("long").alias("with_documents"), F.grouping("place").alias("is_total"))
    return out.select("place", F.col("is_total").cast("int").alias("is_total"), "entities", "with_documents", F.round(100.0 * F.col("with_documents") / F.col("entities"), 1).alias("pct"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes to k a group on the map side before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def without_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_anti")


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_semi")


def histogram(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """Rows of each category; a missing one and the word for it are one category."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def lastmod_rollup(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Latest document and number of entities for each region, place, and all (grouping sets)."""
    rows = entities.join(documents.groupBy("entity_id").agg(F.max("ts").alias("lastmod")), "entity_id")
    out = rows.rollup("region", "place").agg(F.max("lastmod").alias("lastmod"), F.count(F.lit(1)).alias("urls"), F.grouping_id().alias("level"))
    return out.select("region", "place", F.col("level").cast("int").alias("level"), "lastmod", "urls")


def participation(records: DataFrame) -> DataFrame:
    """For each entity: mean votes and rate, latest units, proxies to swing a vote, confidence.

    ``records`` has entity_id, record_id, held (date), total_units, votes.  Means are over records
    with votes; rates over those with units too.  Whole means round half to even.
    """
    rate = F.when(F.col("total_units") > 0, F.col("votes") / F.col("total_units"))
    g = records.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("data_points"),
        F.coalesce(F.avg("votes"), F.lit(0.0)).alias("mean_votes"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("mean_rate"),
        F.max_by("total_units", F.struct("held", "record_id")).alias("total_units"),
    )
    return g.select(
        "entity_id",
        F.round("mean_rate", 4).alias("average_participation_rate"),
        F.bround("mean_votes").cast("long").alias("average_votes_cast"),
        F.coalesce("total_units", F.lit(0)).cast("long").alias("total_units"),
        (F.ceil(F.col("mean_votes") / 2) + 1).cast("long").alias("proxies_to_swing"),
        "data_points",
        F.when(F.col("data_points") < 3, "low").when(F.col("data_points") <= 5, "medium").otherwise("high").alias("confidence"),
    )


def demote_stacks(rows: DataFrame, key: Sequence[Column], quality: str = "quality", least: int = 5, to: str = "city_only") -> DataFrame:
    """Rows without a quality that share their key with at least ``least`` - 1 others get the quality ``to``; null keys are equal. Counts stacks while the plan is built."""
    names = [f"_key{i}" for i in range(len(key))]
    keyed = rows.withColumns(dict(zip(names, key, strict=True)))
    # stacks are counted on the map side and joined back, so none is gathered, and they are few beside the rows
    stacks = keyed.groupBy(*(F.col(k).alias(f"{k}s") for k in names)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
    met = keyed.join(broadcast_if_small(stacks), same, "left")
    return met.withColumn(quality, F.when(F.col(quality).isNull() & F.col("_n").isNotNull(), F.lit(to)).otherwise(F.col(quality))).select(rows.columns)


def argmax(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """For each key the value with the largest summed weight; the least value wins ties."""
    totals = rows.groupBy(key, value).agg(F.sum(weight).alias("weight"))
    return top_per_group(totals, [key], [F.desc("weight"), F.asc(value)], 1).drop("rank")


def metro_groups(places: DataFrame, metros: DataFrame) -> DataFrame:
    """Each place goes to the first metro (by rule_order) that lists it, else to 'other'."""
    first = metros.groupBy("place").agg(F.min_by("metro", "rule_order").alias("metro"))
    return places.join(first, "place", "left").withColumn("metro", F.coalesce("metro", F.lit("other")))


def cosign_status(proposals: DataFrame, cosigners: DataFrame, least: int = 2) -> DataFrame:
    """A proposal is published with at least ``least`` cosigners, else private; archived ones stay so."""
    n = cosigners.groupBy("proposal_id").agg(F.countDistinct("user_id").alias("cosigners"))
    out = proposals.join(n, "proposal_id", "left").withColumn("cosigners", F.coalesce("cosigners", F.lit(0)))
    return out.withColumn("status", F.when(F.col("status") == "archived", "archived").when(F.col("cosigners") >= least, "published").otherwise("private"))
