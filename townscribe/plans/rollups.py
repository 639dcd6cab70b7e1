"""Catalogue rollups over customers (entities), orders (documents) and lineitems (chunks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, windows
from ..sources.tables import table
from .registry import query

TS = "date_format({}, 'yyyy-MM-dd HH:mm:ss')"


def stamp(c: str):
    """A time as text, the same on any engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def entities(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows by the data model
    return table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity"), F.col("n_name").alias("place"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("document_id"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"))


SQL_ROLLUP = """
with lines as (select l_orderkey, count(*) as n from lineitem group by 1),
stats as (select o_custkey, count(*) as doc_count, sum(o_totalprice) as total_value, max(o_orderdate) as last_ts, sum(coalesce(n, 0)) as chunk_count
  from orders left join lines on o_orderkey = l_orderkey group by 1)
select c_custkey as entity_id, c_name as entity, n_name as place, cast(coalesce(doc_count, 0) as bigint) as doc_count, round(coalesce(total_value, 0), 2) as total_value,
  strftime(last_ts, '%Y-%m-%d %H:%M:%S') as last_ts, cast(coalesce(chunk_count, 0) as bigint) as chunk_count
from customer join nation on c_nationkey = n_nationkey {join} join stats on o_custkey = c_custkey {where}
"""


def _rollup(df: DataFrame) -> DataFrame:
    return df.withColumns({"total_value": F.round("total_value", 2), "last_ts": stamp("last_ts")})


@query("entity_rollup", SQL_ROLLUP.format(join="left", where=""))
def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rollup(catalog.entity_rollup(entities(spark, d), documents(spark, d), chunks(spark, d)))


@query("entity_rollup_filtered", SQL_ROLLUP.format(join="", where="where (contains(lower(c_name), '1') or contains(lower(n_name), '1')) and lower(n_name) = (select lower(min(n_name)) from nation where n_nationkey in (select c_nationkey from customer where contains(c_name, '1')))"))
def entity_rollup_filtered(spark: SparkSession, d: str) -> DataFrame:
    place = entities(spark, d).where(F.col("entity").contains("1")).agg(F.min("place")).first()[0]
    return _rollup(catalog.entity_rollup(entities(spark, d), documents(spark, d), chunks(spark, d), q="1", place=place, with_docs=True))


@query("entity_page", SQL_ROLLUP.format(join="left", where="order by lower(c_name), c_name, c_custkey limit 25 offset 50"))
def entity_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page(_rollup(catalog.entity_rollup(entities(spark, d), documents(spark, d), chunks(spark, d))), "entity", "entity_id", 25, 50)


@query("entity_count_by_place", "select n_name as place, count(distinct c_custkey) as entities from customer join nation on c_nationkey = n_nationkey where c_custkey in (select o_custkey from orders) group by 1")
def entity_count_by_place(spark: SparkSession, d: str) -> DataFrame:
    return catalog.count_by_place(entities(spark, d), documents(spark, d))


@query("place_counts", "select n_name as place, count(distinct c_custkey) as entities from customer join nation on c_nationkey = n_nationkey group by 1")
def place_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.count_by_place(entities(spark, d))


@query(
    "coverage_by_place",
    """
with held as (select distinct o_custkey from orders where o_orderstatus = 'F'),
r as (select n_name, case when o_custkey is null then 0 else 1 end as h from customer join nation on c_nationkey = n_nationkey left join held on o_custkey = c_custkey)
select n_name as place, cast(grouping(n_name) as integer) as is_total, count(*) as entities, cast(sum(h) as bigint) as with_documents, round(100.0 * sum(h) / count(*), 1) as pct from r group by rollup (n_name)
""",
)
def coverage_by_place(spark: SparkSession, d: str) -> DataFrame:
    return catalog.coverage(entities(spark, d), documents(spark, d).where("status = 'F'"))


@query(
    "top_entities_per_place",
    """
with n as (select n_name as place, c_custkey as entity_id, c_name as entity, count(*) as doc_count from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3)
select place, entity_id, entity, doc_count, cast(rank as integer) as rank from (select *, row_number() over (partition by place order by doc_count desc, entity, entity_id) as rank from n) where rank <= 5
""",
)
def top_entities_per_place(spark: SparkSession, d: str) -> DataFrame:
    n = documents(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("doc_count"))
    rows = entities(spark, d).select("place", "entity_id", "entity").join(n, "entity_id")
    return catalog.top_per_group(rows, ["place"], [F.desc("doc_count"), F.asc("entity"), F.asc("entity_id")], 5).select("place", "entity_id", "entity", "doc_count", "rank")


@query("childless_documents", "select o_orderkey as document_id, o_custkey as entity_id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def childless_documents(spark: SparkSession, d: str) -> DataFrame:
    return catalog.without_children(documents(spark, d), chunks(spark, d), "document_id").select("document_id", "entity_id")


@query("entities_with_documents", "select c_custkey as entity_id, c_name as entity from customer where c_custkey in (select o_custkey from orders)")
def entities_with_documents(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_children(entities(spark, d), documents(spark, d), "entity_id").select("entity_id", "entity")


@query("category_histogram", "select coalesce(o_orderpriority, 'unknown') as category, count(*) as n from orders group by 1")
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return catalog.histogram(documents(spark, d), "category")


@query("status_pivot", "select o_custkey as entity_id, count(*) filter (where o_orderstatus = 'O') as open_docs, count(*) filter (where o_orderstatus = 'F') as filed_docs, count(*) filter (where o_orderstatus = 'P') as pending_docs from orders group by 1")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    g = documents(spark, d).groupBy("entity_id")
    return g.agg(*(F.count_if(F.col("status") == s).alias(f"{n}_docs") for s, n in (("O", "open"), ("F", "filed"), ("P", "pending"))))


@query(
    "sitemap_rollup",
    """
with e as (select r_name as region, n_name as place, max(o_orderdate) as lastmod from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join orders on o_custkey = c_custkey group by c_custkey, 1, 2)
select region, place, cast(grouping(region, place) as integer) as level, strftime(max(lastmod), '%Y-%m-%d %H:%M:%S') as lastmod, count(*) as urls from e group by rollup (region, place)
""",
)
def sitemap_rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.lastmod_rollup(entities(spark, d), documents(spark, d)).withColumn("lastmod", stamp("lastmod"))


@query(
    "magic_number",
    """
with r as (select o_custkey as entity_id, o_orderkey as record_id, o_orderdate as held, 100 + o_orderkey % 50 as total_units, case when o_orderkey % 7 = 0 then null else o_orderkey % 100 end as votes from orders),
g as (select entity_id, count(*) as n, coalesce(avg(votes), 0.0) as mv, coalesce(avg(votes / total_units), 0.0) as mr, arg_max(total_units, (held, record_id)) as tu from r group by 1)
select entity_id, round(mr, 4) as average_participation_rate, cast(round_even(mv, 0) as bigint) as average_votes_cast, cast(tu as bigint) as total_units, cast(ceil(mv / 2) + 1 as bigint) as proxies_to_swing, n as data_points,
  case when n < 3 then 'low' when n <= 5 then 'medium' else 'high' end as confidence from g
""",
)
def magic_number(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("document_id")
    records = documents(spark, d).select("entity_id", k.alias("record_id"), F.col("ts").alias("held"), (100 + k % 50).alias("total_units"), F.when(k % 7 == 0, None).otherwise(k % 100).alias("votes"))
    return catalog.participation(records)


@query(
    "stack_demotion",
    """
with c as (select c_custkey as entity_id, c_nationkey, cast(floor(c_acctbal / 1000) as integer) as cell, case when c_custkey % 3 = 0 then 'address' end as quality from customer)
select entity_id, case when quality is null and count(*) over (partition by c_nationkey, cell) >= 5 then 'city_only' else quality end as quality from c
""",
)
def stack_demotion(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).select("entity_id", "place", F.floor(F.col("balance") / 1000).alias("cell"), F.when(F.col("entity_id") % 3 == 0, F.lit("address")).alias("quality"))
    return catalog.demote_stacks(rows, [F.col("place"), F.col("cell")]).select("entity_id", "quality")


@query(
    "argmax_weight",
    """
with t as (select l_partkey as part_id, l_suppkey as supplier_id, round(sum(l_quantity), 2) as weight from lineitem group by 1, 2)
select part_id, supplier_id, weight from (select *, row_number() over (partition by part_id order by weight desc, supplier_id) as n from t) where n = 1
""",
)
def argmax_weight(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"), "l_quantity")
    return catalog.argmax(rows, "part_id", "supplier_id", "l_quantity").withColumn("weight", F.round("weight", 2))


@query("latest_per_key", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) as n from events) where n = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest_per_key(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("oldest_per_key", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 1")
def oldest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return windows.oldest_per_key(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("preferred_row", "select o_custkey as entity_id, o_orderkey as document_id from (select *, row_number() over (partition by o_custkey order by case when o_orderpriority = '1-URGENT' then 0 else 1 end, o_orderdate desc, o_orderkey) as n from orders) where n = 1")
def preferred_row(spark: SparkSession, d: str) -> DataFrame:
    return windows.preferred(documents(spark, d), ["entity_id"], F.col("category") == "1-URGENT", "ts", "document_id").select("entity_id", "document_id")


@query("first_seen_dedupe", "select doc_id, sha256(text) as checksum from (select *, row_number() over (partition by sha256(text) order by doc_id) as n from documents) where n = 1")
def first_seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    # hashes and ids alone are shuffled, not the texts
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return windows.first_seen(rows, ["checksum"], "doc_id")


@query("dedupe_keep_null_keys", "select event_id, k from (select event_id, case when event_id % 5 = 0 then null else user_id end as k, row_number() over (partition by case when event_id % 5 = 0 then null else user_id end order by event_id) as n from events) where n = 1 or k is null")
def dedupe_keep_null_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("user_id")).alias("k"))
    return windows.first_seen(rows, ["k"], "event_id", keep_null_keys=True)


@query(
    "top3_per_group",
    """
with c as (select user_id, event_type, count(*) as n, min(event_id) as first_id from events group by 1, 2)
select user_id, event_type, n, cast(rank as integer) as rank from (select *, row_number() over (partition by user_id order by n desc, first_id) as rank from c) where rank <= 3
""",
)
def top3_per_group(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    return catalog.top_per_group(n, ["user_id"], [F.desc("n"), F.asc("first_id")], 3).drop("first_id")


@query(
    "top_agents",
    """
with a as (select c_mktsegment as agent, count(*) as n, max(c_name) as last_name, array_slice(list(c_name order by c_name), 1, 5) as s from customer group by 1)
select agent, n, last_name, array_to_string(s, '|') as sample from a order by n desc, agent limit 50
""",
)
def top_agents(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    first = catalog.top_per_group(e.select("segment", "entity"), ["segment"], [F.asc("entity")], 5).groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list("entity")), "|").alias("sample"))
    n = e.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("entity").alias("last_name"))
    return n.join(first, "segment").select(F.col("segment").alias("agent"), "n", "last_name", "sample").orderBy(F.desc("n"), "agent").limit(50)


@query(
    "label_join_rollup",
    """
select lang, coalesce(cast(quality as varchar), 'none') as quality, count(*) as n, sum(n_chars)::bigint as chars from documents left join (select distinct on (doc_id) doc_id, quality from labels order by doc_id) l using (doc_id) group by 1, 2
""",
)
def label_join_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left").groupBy("lang", F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("site_stats", "select (select count(*) from customer) as entities, (select count(*) from orders) as documents, (select count(*) from lineitem) as chunks, (select count(*) from events where ts >= (select max(ts) from events) - interval 7 days) as recent_events")
def site_stats(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    last = ev.agg(F.max("ts").alias("last"))
    recent = ev.join(F.broadcast(last)).agg(F.count_if(F.col("ts") >= F.col("last") - F.expr("interval 7 days")).alias("recent_events"))  # one row
    n = lambda t, a: table(spark, d, t).agg(F.count(F.lit(1)).alias(a))
    return n("customer", "entities").join(n("orders", "documents")).join(n("lineitem", "chunks")).join(recent)


@query("metro_groups", "select n_name as place, case when n_name < 'F' then 'north' when n_name < 'K' then 'middle' else 'other' end as metro from nation")
def metro_groups(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").select(F.col("n_name").alias("place"))
    metros = places.where("place < 'F'").select("place", F.lit("north").alias("metro"), F.lit(1).alias("rule_order")).unionAll(places.where("place < 'K'").select("place", F.lit("middle").alias("metro"), F.lit(2).alias("rule_order")))
    return catalog.metro_groups(places, metros)


@query(
    "cosign_status",
    """
with n as (select l_orderkey as proposal_id, count(distinct l_suppkey) as k from lineitem group by 1)
select o_orderkey as proposal_id, coalesce(k, 0) as cosigners, case when o_orderstatus = 'P' then 'archived' when coalesce(k, 0) >= 2 then 'published' else 'private' end as status from orders left join n on proposal_id = o_orderkey
""",
)
def cosign_status(spark: SparkSession, d: str) -> DataFrame:
    proposals = documents(spark, d).select(F.col("document_id").alias("proposal_id"), F.when(F.col("status") == "P", "archived").otherwise("open").alias("status"))
    signers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_suppkey").alias("user_id"))
    return catalog.cosign_status(proposals, signers).select("proposal_id", "cosigners", "status")


@query(
    "map_points",
    """select c_custkey as entity_id, n_name as place from customer join nation on c_nationkey = n_nationkey where c_acctbal is not null and (c_mktsegment in ('BUILDING', 'MACHINERY') or c_custkey % 4 = 0) and (contains(lower(c_name), '9') or contains(lower(n_name), '9'))""",
)
def map_points(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d)
    return rows.where(F.col("balance").isNotNull() & (F.col("segment").isin("BUILDING", "MACHINERY") | (F.col("entity_id") % 4 == 0)) & catalog.matches("9", "entity", "place")).select("entity_id", "place")
