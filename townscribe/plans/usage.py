"""Usage analytics over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, usage, windows
from ..sources.tables import table
from .registry import query
from .rollups import stamp


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("usage_by_service", "select event_type as service, count(*) as calls, round(sum(value), 4) as units, min(substr(event_type, 1, 1)) as unit_type, round(sum(value * 0.02), 6) as cost from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1")
def usage_by_service(spark: SparkSession, d: str) -> DataFrame:
    log = events(spark, d).where(usage.month_of("ts", 2024, 1)).withColumn("unit", F.substring("event_type", 1, 1))
    return usage.by_service(log, "event_type", "value", "unit", F.col("value") * 0.02).withColumns({"units": F.round("units", 4), "cost": F.round("cost", 6)})


SQL_PERIOD = "select strftime(date_trunc('{p}', ts), '%Y-%m-%d %H:%M:%S') as period, event_type as service, count(*) as calls, round(sum(value), 4) as units from events group by 1, 2"


@query("usage_daily", SQL_PERIOD.format(p="day"))
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_period(events(spark, d), "ts", "day", "event_type", "value").withColumns({"period": stamp("period"), "units": F.round("units", 4)})


@query("usage_hourly", SQL_PERIOD.format(p="hour"))
def usage_hourly(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_period(events(spark, d), "ts", "hour", "event_type", "value").withColumns({"period": stamp("period"), "units": F.round("units", 4)})


@query(
    "usage_multigrain",
    """
with e as (select event_type as a, cast(user_id % 10 as varchar) as b, cast(extract(hour from ts) as integer) as hour, value as v from events)
select a, b, hour, cast(grouping(a, b, hour) as integer) as grain, count(*) as n, round(sum(v), 4) as total from e group by grouping sets ((a), (a, b), (hour, a), ())
""",
)
def usage_multigrain(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("tenth", F.col("user_id") % 10)
    return usage.multigrain(rows, "event_type", "tenth", F.hour("ts"), "value").withColumn("total", F.round("total", 4))


@query(
    "percentile_lower",
    """
with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(case when i = floor((n - 1) * 0.5) then value end) as p50, max(case when i = floor((n - 1) * 0.95) then value end) as p95 from r group by 1
""",
)
def percentile_lower(spark: SparkSession, d: str) -> DataFrame:
    return windows.percentiles_lower(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("rolling_24h_spend", "select event_id, round(sum(value) over (partition by user_id order by ts range between interval 24 hours preceding and current row), 4) as spend from events")
def rolling_24h_spend(spark: SparkSession, d: str) -> DataFrame:
    return windows.rolling_sum(events(spark, d), ["user_id"], "ts", "value", 86_400, "spend").select("event_id", F.round("spend", 4).alias("spend"))


@query("rate_window_upper_bound", "select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as hits from events")
def rate_window_upper_bound(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_hits(events(spark, d), ["user_id"], "ts", 3600, "hits").select("event_id", "hits")


@query("rate_limited")
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Exact sliding limiter: refused rows do not count, so SQL windows cannot express it."""
    return windows.rate_limited(events(spark, d), "user_id", "ts", 3, 86_400, "event_id")


@query("retention_kept", "select event_id from events where ts >= timestamp '2024-01-30' - interval 14 days")
def retention_kept(spark: SparkSession, d: str) -> DataFrame:
    return usage.kept_after(events(spark, d), "ts", F.to_timestamp(F.lit("2024-01-30 00:00:00")), 14).select("event_id")


@query("spend_gate", "select round(coalesce(sum(value), 0), 4) as spent, coalesce(sum(value), 0) + 5.0 <= 10000.0 as allowed from events where ts > timestamp '2024-01-15' - interval 24 hours and ts <= timestamp '2024-01-15'")
def spend_gate(spark: SparkSession, d: str) -> DataFrame:
    return usage.spend_gate(events(spark, d), "ts", "value", F.to_timestamp(F.lit("2024-01-15 00:00:00")), 5.0, 10_000.0).withColumn("spent", F.round("spent", 4))


@query(
    "cost_report",
    """
with m as (select 'metered' as kind, event_type as service, round(sum(value / 1000), 6) as cost from events group by 2),
f as (select 'fixed' as kind, s_name as service, round(sum(case when s_suppkey % 2 = 0 then abs(s_acctbal) else round(abs(s_acctbal) / 12, 2) end), 2) as cost from supplier where s_suppkey % 3 <> 0 group by 2),
r as (select * from m union all select * from f)
select kind, service, cost from r union all select kind, '(total)', round(sum(cost), 6) from r group by kind
""",
)
def cost_report(spark: SparkSession, d: str) -> DataFrame:
    metered = events(spark, d).select(F.col("event_type").alias("service"), (F.col("value") / 1000).alias("cost"))
    k = F.col("s_suppkey")
    fixed = table(spark, d, "supplier").select(F.col("s_name").alias("service"), F.abs("s_acctbal").alias("amount"), F.when(k % 2 == 0, "monthly").otherwise("yearly").alias("frequency"), F.when(k % 3 != 0, 1).otherwise(0).alias("active"))
    return usage.cost_report(metered, fixed)


@query("cost_formulas", "select l_orderkey as document_id, l_linenumber as line_no, round(l_quantity * 1000 / 1e6 * 0.02, 8) as embedding_cost, round(l_quantity * 0.0015, 8) as ocr_cost, round(l_quantity * 0.001, 8) as search_cost from lineitem")
def cost_formulas(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_no"), usage.embedding_cost(q * 1000).alias("embedding_cost"), usage.ocr_cost(q).alias("ocr_cost"), usage.search_cost(q).alias("search_cost"))


@query("event_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("spend_admission")
def spend_admission(spark: SparkSession, d: str) -> DataFrame:
    """Every event asks its type's budget of the last 24 hours for its value; refused ones spend nothing.

    The budget is 1.05 times what a type asks for on a mean day, so some hours are contested at any size.
    """
    asked = events(spark, d).select(F.col("event_id").alias("request_id"), F.col("event_type").alias("service"), "ts", F.col("value").alias("cost"))
    mean = asked.agg(F.sum("cost") / F.countDistinct("service", F.to_date("ts"))).first()[0]
    return admission.admit(asked, round(1.05 * mean, 2))
