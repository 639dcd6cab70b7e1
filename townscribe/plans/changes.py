"""Writes and state machines over slices of customers, orders and lineitems."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, resolve, shared
from ..sources import contracts, files, records, versions
from ..sources.tables import table
from .registry import query


@query(
    "coalesce_upsert",
    """
with o as (select c_custkey as id, c_name as name, case when c_custkey % 2 = 0 then c_mktsegment end as segment from customer where c_custkey % 3 <> 0),
n as (select c_custkey as id, case when c_custkey % 5 <> 0 then upper(c_name) end as name, case when c_custkey % 4 <> 0 then 'NEW' end as segment from customer where c_custkey % 2 = 0)
select coalesce(o.id, n.id) as id, coalesce(n.name, o.name) as name, case when n.id is not null then n.segment else o.segment end as segment from o full join n on o.id = n.id
""",
)
def coalesce_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    k = F.col("id")
    old = c.where(k % 3 != 0).withColumn("segment", F.when(k % 2 == 0, F.col("segment")))
    new = c.where(k % 2 == 0).select("id", F.when(k % 5 != 0, F.upper("name")).alias("name"), F.when(k % 4 != 0, "NEW").alias("segment"))
    return changes.coalesce_upsert(old, new, "id", ["name", "segment"], clear=["segment"])


@query(
    "document_upsert",
    """
with o as (select o_custkey as e, o_orderkey as p, md5(o_orderstatus) as c, case when o_orderkey % 2 = 0 then o_orderpriority end as k from orders where o_orderkey % 3 <> 0),
n as (select o_custkey as e, o_orderkey as p, md5(case when o_orderkey % 5 = 0 then 'new' else o_orderstatus end) as c, case when o_orderkey % 7 <> 0 then 'fresh' end as k from orders where o_orderkey % 4 <> 0)
select coalesce(o.e, n.e) as entity_id, cast(coalesce(o.p, n.p) as varchar) as path, coalesce(n.c, o.c) as checksum, case when o.c = n.c then coalesce(o.k, n.k) else coalesce(n.k, o.k) end as category,
  case when n.e is null then 'kept' when o.e is null then 'inserted' when o.c = n.c then 'filled' else 'replaced' end as action from o full join n on o.e = n.e and o.p = n.p
""",
)
def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    row = lambda c, cat: [F.col("o_custkey").alias("entity_id"), k.cast("string").alias("path"), F.md5(c).alias("checksum"), cat.alias("category"), F.lit(None).cast("string").alias("source_url")]
    old = o.where(k % 3 != 0).select(*row(F.col("o_orderstatus"), F.when(k % 2 == 0, F.col("o_orderpriority"))))
    new = o.where(k % 4 != 0).select(*row(F.when(k % 5 == 0, "new").otherwise(F.col("o_orderstatus")), F.when(k % 7 != 0, "fresh")))
    return changes.upsert_documents(old, new).drop("source_url")


@query("replace_children", "select l_orderkey as id, l_linenumber as n, 'old' as version from lineitem where l_orderkey % 3 <> 0 union all select l_orderkey, l_linenumber + 100, 'new' from lineitem where l_orderkey % 3 = 0")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"))
    return changes.replace_children(rows.withColumn("version", F.lit("old")), rows.where("id % 3 = 0").select("id", (F.col("n") + 100).alias("n"), F.lit("new").alias("version")), "id")


@query("insert_or_ignore", "select user_id, event_type from events group by 1, 2")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type")
    return changes.insert_or_ignore(e.where("user_id % 2 = 0").distinct(), e, ["user_id", "event_type"])


@query(
    "merge_entities",
    """
with e as (select c_custkey as id, case when c_custkey % 10 = 1 then 'merged ' || (c_custkey // 100) else c_name end as name, c_custkey % 10 = 1 as renamed from customer),
f as (select *, first_value(id) over (partition by lower(name) order by renamed, id) as target from e)
select target as entity_id, count(distinct o_orderstatus || o_orderpriority) as documents from f join orders on o_custkey = id group by 1
""",
)
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    docs = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("document_id"), F.concat("o_orderstatus", "o_orderpriority").alias("path"))
    renames = e.where("entity_id % 10 = 1").select("entity_id", F.concat(F.lit("merged "), F.floor(F.col("entity_id") / 100).cast("string")).alias("new_name"))
    _, moved = resolve.rename_or_merge(e, docs, renames)
    return moved.groupBy("entity_id").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "queue_cycle",
    """
with q as (select o_orderkey as job_id, o_orderdate as t, row_number() over (order by o_orderdate, o_orderkey) as n from orders)
select job_id, case when n > 100 then 'pending' when job_id % 3 = 0 then 'done' else 'pending' end as status, cast(case when n <= 100 then 1 else 0 end as integer) as attempts from q
""",
)
def queue_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Enqueue twice, claim the oldest hundred, settle them: a third succeeds."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("enqueued_at"))
    empty = jobs.limit(0).withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})
    q = changes.claim(changes.enqueue(changes.enqueue(empty, jobs), jobs), 100)
    return changes.settle(q, q.where("status = 'in_progress'").select("job_id", (F.col("job_id") % 3 == 0).alias("ok"))).select("job_id", "status", "attempts")


@query("queue_states", "select o_orderkey as job_id, case when o_orderkey % 4 = 3 then 'dead' else 'pending' end as status, cast(o_orderkey % 4 as integer) as attempts, case when o_orderkey % 4 = 0 then 2.5 else least(120.0, 5 * 2.0 ** (o_orderkey % 4 - 1)) end as backoff from orders")
def queue_states(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("in_progress").alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"))
    return changes.settle(q, q.select("job_id", F.lit(False).alias("ok"))).withColumn("backoff", changes.backoff_seconds(F.col("attempts")))


@query("status_sweep", "select o_orderkey as id, case when o_orderstatus <> 'F' and o_orderdate < timestamp '1996-01-01' then 'expired' when o_orderstatus = 'F' and cast(o_orderdate as date) < date '1995-01-01' then 'purged' when o_orderstatus = 'F' then 'expired' else 'signed' end as status from orders")
def status_sweep(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "expired").otherwise("signed").alias("status"), F.to_date("o_orderdate").alias("expires_at"))
    return changes.expire(p, F.to_date(F.lit("1996-01-01"))).select("id", "status")


@query("stale_archive", "select o_orderkey as id, case when o_orderstatus = 'O' and o_orderdate < timestamp '1997-03-01' - interval 60 days then 'archived' when o_orderstatus = 'O' then 'published' else 'private' end as status from orders")
def stale_archive(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "published").otherwise("private").alias("status"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    return changes.archive_stale(p, F.to_timestamp(F.lit("1997-03-01 00:00:00"))).select("id", "status")


@query("upvotes", "select o_orderkey as proposal_id, greatest(0, o_orderkey % 3 + coalesce(x, 0)) as upvotes from orders left join (select l_orderkey, sum(case when l_linenumber % 2 = 0 then 1 else -1 end) as x from lineitem group by 1) on l_orderkey = o_orderkey")
def upvotes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("proposal_id"), (F.col("o_orderkey") % 3).alias("upvotes"))
    return changes.upvotes(p, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("delta")))


@query("transition_counts", "select o_orderstatus || '->' || case when o_orderkey % 2 = 0 then 'X' else o_orderstatus end as transition, count(*) as n from orders where o_orderkey % 2 = 0 group by 1")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return changes.transitions(o, o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus"))), "o_orderkey", "o_orderstatus")


@query("verdict_actions", "select c_custkey as entity_id, case when c_custkey % 9 = 0 then 'null_name' when c_custkey % 2 = 0 and (c_custkey % 100) / 100.0 >= 0.85 and c_custkey % 3 >= 1 then 'delete' when c_nationkey % 5 = 0 then 'foreign_state' when (c_custkey % 100) / 100.0 >= 0.6 then 'backfill_city' else 'keep' end as action from customer")
def verdict_actions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ledger = table(spark, d, "customer").select(k.alias("entity_id"), F.when(k % 9 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 2 == 0, "not_entity").otherwise("entity").alias("verdict"), ((k % 100) / 100.0).alias("confidence"), F.lit("NC").alias("state"), F.when(F.col("c_nationkey") % 5 == 0, "GA").alias("foreign_state"), F.lit("Raleigh").alias("city"), (k % 3).alias("doc_count"))
    return changes.verdicts(ledger).select("entity_id", "action")


@query(
    "filename_audit",
    """
with g as (select l_orderkey as entity_id, count(*) as n, count(*) filter (where l_returnflag = 'R') as f, count(*) filter (where l_linestatus = 'F') as j from lineitem group by 1)
select entity_id, n, f as n_foreign, j as n_junk, case when f >= greatest(2, n // 2) then 'foreign' when j = n then 'all_junk' when n > 5 and f >= 2 then 'sink' else 'fine' end as flag from g
""",
)
def filename_audit(spark: SparkSession, d: str) -> DataFrame:
    return changes.filename_audit(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("file_id"), (F.col("l_returnflag") == "R").alias("foreign"), (F.col("l_linestatus") == "F").alias("junk_host")))


@query("manifest_merge")
def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    """One manifest a customer from one each order."""
    o = table(spark, d, "orders")
    m = o.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("n"), (F.col("o_orderkey") % 3).cast("string")).alias("name"), F.array("o_orderpriority").alias("aliases"), F.col("o_orderstatus").alias("city"), F.lit("NC").alias("state"), F.col("o_orderpriority").alias("platform"), F.when(F.col("o_orderstatus") == "F", "banked").otherwise("stub").alias("status"), F.array(F.struct(F.sha2("o_orderpriority", 256).alias("sha256"), F.col("o_orderkey").alias("size"))).alias("documents"))
    return resolve.merge_manifests(m)


@query("index_backfill", "select vec_id as chunk_id from embeddings where vec_id % 3 <> 0")
def index_backfill(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import backfill_index

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return backfill_index(e.where("chunk_id % 3 = 0"), e).select("chunk_id")


@query(
    "partition_replacement",
    """
select cast(s_nationkey as integer) as nation, s_suppkey as id, case when s_nationkey < 5 then 'new' else 'old' end as state
from supplier where s_nationkey <> 7 and not (s_nationkey < 5 and s_suppkey % 2 = 1)
union all
select cast(s_nationkey as integer), s_suppkey, 'old' from supplier where s_nationkey < 5 and s_suppkey % 2 = 1
  and s_nationkey not in (select s_nationkey from supplier where s_nationkey < 5 and s_suppkey % 2 = 0)
""",
)
def partition_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by nation: the first five nations' are replaced by those of even key, nation 7's are dropped, the others stay."""
    base = f"{shared.shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("old").alias("state"), F.col("s_nationkey").cast("int").alias("nation"))
    versions.replace_partitions(rows, base, ["nation"])
    new = rows.where("nation < 5 and id % 2 = 0").withColumn("state", F.lit("new"))
    versions.replace_partitions(new, base, ["nation"], emptied=[{"nation": "7"}])
    return versions.read(spark, base).select("nation", "id", "state")


@query("fixed_width_records", "select cast(c_custkey as varchar) as id, c_name as name, c_mktsegment as segment, case when c_custkey % 3 = 0 then 'skip_status' when c_mktsegment = 'BUILDING' then 'skip_rejected_pattern' else 'written' end as reason from customer")
def fixed_width_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as records of 60 bytes and read back by bytes."""
    at = f"{shared.shared_dir(spark)}/records-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    table(spark, d, "customer").select(F.concat(F.rpad(k.cast("string"), 12, " "), F.rpad("c_name", 30, " "), F.when(k % 3 == 0, "I").otherwise("A"), F.rpad("c_mktsegment", 17, " "))).write.text(at)
    rows = records.read_records(spark, at, 60, {"id": (0, 12), "name": (12, 30), "status": (42, 1), "segment": (43, 17)})
    return records.sifted(rows, F.col("name") != "", F.col("segment") == "BUILDING").select("id", "name", "segment", "reason")


@query("schema_contract", "select doc_id, case when doc_id % 3 = 0 then 'unknown' else source end as source, lang is not null as known, cast(n_chars as bigint) as n_chars, md5(text) as digest from documents where doc_id is not null")
def schema_contract(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as files of three versions, beside a file that is none, and opened by the contract of the third."""
    at = f"{shared.shared_dir(spark)}/contract-{uuid.uuid4().hex}"
    third = F.pmod("doc_id", F.lit(3))
    docs = table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("int"))
    docs.where(third == 0).select("doc_id", F.col("text").alias("body"), "lang", "n_chars").write.parquet(f"{at}/first")
    docs.where(third == 1).select("source", "n_chars", "lang", F.col("text").alias("body"), "doc_id").write.parquet(f"{at}/second")
    docs.where(third == 2).select("doc_id", "text", "source", F.col("lang").isNotNull().alias("known"), F.col("n_chars").cast("long").alias("n_chars"), F.lit(1).alias("extra")).write.parquet(f"{at}/third")
    spark.createDataFrame([("no parquet",)], "line string").write.text(f"{at}/broken")
    steps = (
        contracts.Step(add={"source": ("string", "'unknown'")}),
        contracts.Step(rename={"body": "text"}, drop=("lang",), cast={"n_chars": "bigint"}, add={"known": ("boolean", "lang is not null")}),
    )
    opened = contracts.open_folder(spark, at, contracts.Contract("doc_id bigint, body string, lang string, n_chars int", steps, ("doc_id",)))
    return opened.rows.select("doc_id", "source", "known", "n_chars", F.md5("text").alias("digest"))


@query("ready_bundles", "select s_suppkey as bundle_id from supplier where s_suppkey % 3 <> 0 order by cast(s_suppkey as varchar) limit 25")
def ready_bundles(spark: SparkSession, d: str) -> DataFrame:
    """A folder with a status file for each supplier; the first 25 that are ready, by path."""
    at = f"{shared.shared_dir(spark)}/bundles-{uuid.uuid4().hex}"
    k = F.col("s_suppkey").cast("string")
    status = F.to_json(F.struct(F.when(F.col("s_suppkey") % 3 != 0, "ready").otherwise("failed").alias("status"), k.alias("bundle_id")))
    # a level of folders by the first three digits keeps each folder small, and paths in the order of the digits
    files.write_statuses(table(spark, d, "supplier").select(F.concat_ws("/", F.substring(k, 1, 3), k).alias("prefix"), status.alias("json")), at)
    return files.read_ready_bundles(spark, f"{at}/*/*/status.json", 25).select(F.col("bundle_id").cast("long").alias("bundle_id"))
