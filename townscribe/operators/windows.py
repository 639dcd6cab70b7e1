"""First, latest and sliding rows of keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str | Column], ts: str, tie: str) -> DataFrame:
    """The row of each key with the largest ``ts``; the least ``tie`` wins where it is equal."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(ts), F.asc(tie))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_seen(df: DataFrame, keys: Sequence[str | Column], order: str, keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key by ``order``; rows with a null key are all kept if ``keep_null_keys``.

    Those are split off first and stay where they are; of the others a task hands on one row a key.
    """
    if keep_null_keys:
        no_key = F.lit(False)
        for k in keys:
            no_key = no_key | (F.col(k) if isinstance(k, str) else k).isNull()
        return first_seen(df.where(~no_key), keys, order).unionAll(df.where(no_key))
    w = Window.partitionBy(*keys).orderBy(F.asc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def oldest_per_key(df: DataFrame, keys: Sequence[str | Column], date: str, tie: str) -> DataFrame:
    """The row of each key with the least date; rows with a date come before those without."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(date), F.asc(tie))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def preferred(df: DataFrame, keys: Sequence[str], is_exact: Column, updated: str, tie: str) -> DataFrame:
    """The row of each key that matches exactly, else the one updated last."""
    w = Window.partitionBy(*keys).orderBy(F.when(is_exact, 0).otherwise(1), F.desc_nulls_last(updated), F.asc(tie))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def percentile_lower(values: Column, p: float) -> Column:
    """The value at index floor((n - 1) * p) of a sorted array; null if it is empty."""
    ordered = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.get(ordered, F.floor((F.size(ordered) - 1) * p).cast("int"))


def percentiles_lower(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float], buckets: int = 64) -> DataFrame:
    """Exact index-truncating percentiles (name -> p) of groups of any size, by bucketed selection.

    Approximate quantiles cut each group into buckets of about equal size, the values equal to a
    cut apart.  Counts tell which bucket holds each wanted place, and only the rows of that one
    are ranked; a bucket of one value needs no ranking.  So no task sorts a large group.
    """
    same = [(k, f"_of_{k}") for k in keys]
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in same))
    renamed = lambda d: d.withColumnsRenamed(dict(same))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"), F.count(F.lit(1)).alias("_n"))
    # between two cuts, and after that the values equal to the upper one
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) * 2 + F.array_contains("_cuts", F.col("_v")).cast("int")
    placed = rows.join(renamed(cuts), on).select(*keys, "_v", "_n", bucket.alias("_b"))
    held = placed.groupBy(*keys, "_n", "_b").agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    held = held.withColumn("_before", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_m"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.floor((F.col("_n") - 1) * p).alias("i")) for name, p in ps.items())))
    held = held.withColumn("_w", wanted).where((F.col("_w.i") >= F.col("_before")) & (F.col("_w.i") < F.col("_before") + F.col("_m")))
    plain = held.where("_least = _most").select(*keys, F.col("_w.name").alias("_name"), F.col("_least").alias("_v"))
    sought = held.where("_least < _most").select(*keys, F.col("_b").alias("_in"), F.col("_w.name").alias("_name"), (F.col("_w.i") - F.col("_before")).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_b", "_name").orderBy("_v")) - 1
    ranked = placed.join(renamed(sought), on & (F.col("_b") == F.col("_in"))).withColumn("_r", rank).where("_r = _k").select(*keys, "_name", "_v")
    return plain.unionByName(ranked).groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ps))


def _trailing(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, value: str | None, first: int, out: str, aggregate: Column) -> DataFrame:
    """``df`` with an aggregate over the rows of a key in the trailing window, whose far end lies at ``first`` microseconds.

    Rows are dealt by key and time, in buckets as wide as the window; each also stands in the next
    bucket, unseen, as what comes before.  So no task sorts all rows of a busy key.
    """
    wide = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"_micros": micros, "_bucket": F.floor(micros / wide), "_own": F.lit(True)})
    before = rows.select(*dict.fromkeys([*keys, *([value] if value else [])]), "_micros", (F.col("_bucket") + 1).alias("_bucket"), F.lit(False).alias("_own"))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_micros").rangeBetween(first, 0)
    return rows.unionByName(before, allowMissingColumns=True).withColumn(out, aggregate.over(w)).where("_own").drop("_micros", "_bucket", "_own")


def rolling_sum(df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int, out: str) -> DataFrame:
    """Sum of a key's values in the ``seconds`` up to each row, both ends included."""
    return _trailing(df, keys, ts, seconds, value, -seconds * 1_000_000, out, F.sum(value))


def window_hits(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str) -> DataFrame:
    """Rows of a key in the ``seconds`` before each row (open at the far end), itself included."""
    return _trailing(df, keys, ts, seconds, None, -seconds * 1_000_000 + 1, out, F.count(F.lit(1)))


def rate_limited(df: DataFrame, key: str, ts: str, limit: int, seconds: int, tie: str) -> DataFrame:
    """Which rows a sliding limiter lets pass: at most ``limit`` allowed rows in the trailing window.

    Refused rows do not count, so each decision needs the ones before it: one pass over a key's
    rows in order, that keeps the last ``limit`` allowed times only.  Rows are first cut at
    pauses of a window or more, where the limiter has forgotten all, so that a busy key is
    many groups.  Such pauses lie between buckets of time as wide as the window, so the first and
    last time of each bucket find them, and only buckets are ordered.
    """
    micros, wide = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    rows = df.select(key, tie, micros.alias("_micros"), F.floor(micros / wide).alias("_bucket"))
    spans = rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_at")).agg(F.min("_micros").alias("_first"), F.max("_micros").alias("_last"))
    order = Window.partitionBy("_key").orderBy("_at")
    spans = spans.withColumn("_new", F.when(F.col("_first") - F.lag("_last").over(order) < wide, 0).otherwise(1))
    spans = spans.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("_key", "_at", "_run")
    cut = rows.join(spans, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")))

    def decide(batches):
        from collections import deque

        group, held = None, deque()
        for rows in batches:
            allowed = []
            for k, run, t in zip(rows[key], rows["_run"], rows["_micros"], strict=True):
                if (k, run) != group:
                    group = (k, run)
                    held.clear()
                while held and t - held[0] >= seconds * 1_000_000:
                    held.popleft()
                allowed.append(len(held) < limit)
                if allowed[-1]:
                    held.append(t)
            yield rows[[key, tie]].assign(allowed=allowed)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    # runs are dealt out whole and stand one after another in their partition, in order
    dealt = cut.select(key, "_run", "_micros", tie).repartition(key, "_run").sortWithinPartitions(key, "_run", "_micros", tie)
    return dealt.mapInPandas(decide, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, allowed boolean")
