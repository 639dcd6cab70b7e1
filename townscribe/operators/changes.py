"""Writes as pure transforms: old rows and changes give new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce_upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], clear: Sequence[str] = ()) -> DataFrame:
    """Old rows with new values where they are not null; columns in ``clear`` take the new value as it is."""
    n = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_new"))
    j = old.join(n, F.col(key) == F.col("_key"), "full_outer")
    value = lambda c: F.when(F.col("_new") & F.lit(c in clear), F.col(f"_{c}")).otherwise(F.coalesce(f"_{c}", c))
    return j.select(F.coalesce(key, "_key").alias(key), *(value(c).alias(c) for c in columns))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """documents (entity_id, path, checksum, category, source_url) with changes.

    New: inserted.  Same checksum: only missing metadata is filled.  Changed: checksum replaced,
    metadata kept where the new one is missing.
    """
    n = new.select(F.col("entity_id").alias("_e"), F.col("path").alias("_p"), F.col("checksum").alias("_c"), F.col("category").alias("_k"), F.col("source_url").alias("_s"))
    j = old.join(n, (F.col("entity_id") == F.col("_e")) & (F.col("path") == F.col("_p")), "full_outer")
    same = F.col("checksum") == F.col("_c")
    action = F.when(F.col("_e").isNull(), "kept").when(F.col("entity_id").isNull(), "inserted").when(same, "filled").otherwise("replaced")
    merged = lambda a, b: F.when(same, F.coalesce(a, b)).otherwise(F.coalesce(b, a))
    return j.select(F.coalesce("entity_id", "_e").alias("entity_id"), F.coalesce("path", "_p").alias("path"), F.coalesce("_c", "checksum").alias("checksum"), merged("category", "_k").alias("category"), merged("source_url", "_s").alias("source_url"), action.alias("action"))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of the keys that ``new`` has are replaced by it whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks, one of each."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def enqueue(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs (job_id, enqueued_at) wait with no attempt made, unless the queue has them."""
    fresh = jobs.groupBy("job_id").agg(F.min("enqueued_at").alias("enqueued_at")).withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})
    return queue.unionByName(fresh.join(queue.select("job_id"), "job_id", "left_anti"))


def claim(queue: DataFrame, n: int = 1) -> DataFrame:
    """The queue with its ``n`` oldest waiting jobs in progress."""
    first = queue.where("status = 'pending'").orderBy("enqueued_at", "job_id").limit(n).select(F.col("job_id").alias("_job"))
    first = F.broadcast(first) if n <= 10_000 else first
    j = queue.join(first, F.col("job_id") == F.col("_job"), "left")
    taken = F.col("_job").isNotNull()
    return j.withColumns({"status": F.when(taken, "in_progress").otherwise(F.col("status")), "attempts": F.when(taken, F.col("attempts") + 1).otherwise(F.col("attempts"))}).drop("_job")


def settle(queue: DataFrame, results: DataFrame, most: int = 3) -> DataFrame:
    """Results (job_id, ok): done, or waiting again, or dead after ``most`` attempts."""
    r = results.select(F.col("job_id").alias("_job"), F.col("ok").alias("_ok"))
    j = queue.join(r, F.col("job_id") == F.col("_job"), "left")
    status = F.when(F.col("_ok").isNull(), F.col("status")).when(F.col("_ok"), "done").when(F.col("attempts") >= most, "dead").otherwise("pending")
    return j.withColumn("status", status).drop("_job", "_ok")


def revive(queue: DataFrame) -> DataFrame:
    dead = F.col("status") == "dead"
    return queue.withColumns({"attempts": F.when(dead, 0).otherwise(F.col("attempts")), "status": F.when(dead, "pending").otherwise(F.col("status"))})


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(120.0), 5 * F.pow(F.lit(2.0), attempts - 1))


def expire(proxies: DataFrame, now: Column, purge_days: int = 365) -> DataFrame:
    """Proxies past their end expire; those expired for ``purge_days`` are purged."""
    live = F.col("status").isin("draft", "signed", "delivered", "acknowledged")
    status = F.when(live & (F.col("expires_at") < now), "expired").when((F.col("status") == "expired") & (F.col("expires_at") < F.date_sub(now, purge_days)), "purged").otherwise(F.col("status"))
    return proxies.withColumn("status", status)


def archive_stale(proposals: DataFrame, now: Column, days: int = 60) -> DataFrame:
    old = (F.col("status") == "published") & (F.col("published_at") < now - F.expr(f"interval {days} days"))
    return proposals.withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def upvotes(proposals: DataFrame, changes: DataFrame) -> DataFrame:
    """Votes after changes (proposal_id, delta), never below 0."""
    d = changes.groupBy("proposal_id").agg(F.sum("delta").alias("_d"))
    return proposals.join(d, "proposal_id", "left").withColumn("upvotes", F.greatest(F.lit(0), F.col("upvotes") + F.coalesce("_d", F.lit(0)))).drop("_d")


def verdicts(ledger: DataFrame, least: float = 0.85) -> DataFrame:
    """What a ledger of verdicts (entity_id, verdict, confidence, state, foreign_state, city, doc_count, name) decides."""
    action = (
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "null_name")
        .when((F.col("verdict") == "not_entity") & (F.col("confidence") >= least) & (F.col("doc_count") >= 1), "delete")
        .when(F.col("foreign_state").isNotNull() & (F.col("foreign_state") != F.col("state")), "foreign_state")
        .when(F.col("city").isNotNull() & (F.col("confidence") >= 0.6), "backfill_city")
        .otherwise("keep")
    )
    return ledger.withColumn("action", action)


def filename_audit(files: DataFrame) -> DataFrame:
    """Entities by their files (entity_id, file_id, foreign, junk_host): foreign, all_junk, sink or fine."""
    g = files.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("foreign").alias("n_foreign"), F.count_if("junk_host").alias("n_junk"))
    flag = F.when(F.col("n_foreign") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2)), "foreign").when(F.col("n_junk") == F.col("n"), "all_junk").when((F.col("n") > 5) & (F.col("n_foreign") >= 2), "sink").otherwise("fine")
    return g.withColumn("flag", flag)


def transitions(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """How often each 'a->b' changed between two versions of a table."""
    b = after.select(key, F.col(column).alias("_after"))
    j = before.join(b, key).where(~F.col(column).eqNullSafe(F.col("_after")))
    return j.groupBy(F.concat_ws("->", F.coalesce(column, F.lit("null")), F.coalesce("_after", F.lit("null"))).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def latest_version(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
