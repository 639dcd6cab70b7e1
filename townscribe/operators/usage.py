"""Usage and request analytics over an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Price of a million tokens, of an OCR page, of a search query, in dollars.
EMBEDDING_PER_MILLION = 0.02
OCR_PER_PAGE = 0.0015
SEARCH_PER_QUERY = 0.001


def month_of(ts: str, year: int, month: int) -> Column:
    """Rows of a month: from its first instant to before the next one's."""
    first = f"{year:04d}-{month:02d}-01 00:00:00"
    after = f"{year + (month == 12):04d}-{month % 12 + 1:02d}-01 00:00:00"
    return (F.col(ts) >= F.to_timestamp(F.lit(first))) & (F.col(ts) < F.to_timestamp(F.lit(after)))


def by_service(log: DataFrame, service: str, units: str, unit_type: str, cost: Column) -> DataFrame:
    return log.groupBy(F.col(service).alias("service")).agg(F.count(F.lit(1)).alias("calls"), F.sum(units).alias("units"), F.min(unit_type).alias("unit_type"), F.sum(cost).alias("cost"))


def by_period(log: DataFrame, ts: str, period: str, service: str, units: str) -> DataFrame:
    """Calls and units of each day or hour and service."""
    return log.groupBy(F.date_trunc(period, F.col(ts)).alias("period"), F.col(service).alias("service")).agg(F.count(F.lit(1)).alias("calls"), F.sum(units).alias("units"))


def monthly(amount: Column, frequency: Column) -> Column:
    """A fixed cost by the month: a twelfth, to the cent, unless it is monthly."""
    return F.when(frequency == "monthly", amount).otherwise(F.round(amount / 12, 2))


def embedding_cost(tokens: Column) -> Column:
    return F.round(tokens / 1e6 * EMBEDDING_PER_MILLION, 8)


def ocr_cost(pages: Column) -> Column:
    return F.round(pages * OCR_PER_PAGE, 8)


def search_cost(queries: Column) -> Column:
    return F.round(queries * SEARCH_PER_QUERY, 8)


def cost_report(metered: DataFrame, fixed: DataFrame) -> DataFrame:
    """Metered costs by service (6 places) and fixed ones by month (2 places), with a total of each kind."""
    m = metered.groupBy("service").agg(F.sum("cost").alias("cost")).select(F.lit("metered").alias("kind"), "service", F.round("cost", 6).alias("cost"))
    f = fixed.where("active = 1").groupBy("service").agg(F.sum(monthly(F.col("amount"), F.col("frequency"))).alias("cost")).select(F.lit("fixed").alias("kind"), "service", F.round("cost", 2).alias("cost"))
    rows = m.unionByName(f)
    return rows.unionByName(rows.groupBy("kind").agg(F.lit("(total)").alias("service"), F.round(F.sum("cost"), 6).alias("cost")))


def multigrain(log: DataFrame, a: str, b: str, hour: Column, value: str) -> DataFrame:
    """Counts and sums by a, by a and b, by hour and a, and of all: one pass with grouping sets."""
    rows = log.select(F.col(a).alias("a"), F.col(b).cast("string").alias("b"), hour.alias("hour"), F.col(value).alias("v"))
    rows = rows.groupingSets([["a"], ["a", "b"], ["hour", "a"], []], "a", "b", "hour").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.grouping_id().alias("grain"))
    return rows.select("a", "b", "hour", F.col("grain").cast("int").alias("grain"), "n", "total")


def kept_after(log: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Retention: rows not older than ``days`` days at ``now``, by true times."""
    return log.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def spend_gate(log: DataFrame, ts: str, cost: str, now: Column, projected: float, cap: float, hours: int = 24) -> DataFrame:
    """One row: what the last hours cost, and whether a projected cost may still be spent."""
    spent = log.where((F.col(ts) > now - F.expr(f"interval {hours} hours")) & (F.col(ts) <= now)).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("spent"))
    return spent.withColumn("allowed", F.col("spent") + projected <= cap)


def model_family(model: Column) -> Column:
    """A model's name before its date suffix."""
    return F.substring_index(model, "-2026", 1)
