"""Admission by a running budget: a request is let in if what was let in before it leaves room.

A refused request spends nothing, so each decision depends on those before it in the trailing window. Most need no such
care: if all requests of the window together, let in or not, stay within the budget, every one of them is let in. So
costs are first summed by buckets of time (one pass, combined on the map side); a bucket is settled if it and the
buckets that reach into its window fit the budget together. Its rows are let in where they stand. Only the others
are contested. Contested buckets that lie closer together than the window form a stretch; a stretch begins
where nothing contested is left in the window, so it knows its start exactly. Stretches are dealt out, ordered by
time and folded as streams: a task holds the requests that the window let in, never a stretch, let alone a service.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizes import broadcast_if_small

#: Costs are compared as whole millionths.
MILLION = 1_000_000
#: Buckets of a window.
BUCKETS = 24


def contested(requests: DataFrame, service: str, cap: int, buckets: int) -> DataFrame:
    """(service, bucket, stretch, is_contested): the buckets that cannot be settled by their sums, and those that reach into them."""
    sums = requests.groupBy(service, "bucket").agg(F.sum("micro").alias("cost"))
    # what a bucket's rows see at most: its own bucket and all that its window touches
    reach = sums.select(service, F.explode(F.sequence(F.col("bucket"), F.col("bucket") + buckets)).alias("bucket"), "cost")
    over = reach.groupBy(service, "bucket").agg(F.sum("cost").alias("seen")).where(F.col("seen") > cap)
    order = Window.partitionBy(service).orderBy("bucket")  # a service has a row a bucket here, not a row a request
    runs = over.withColumn("fresh", F.when(F.col("bucket") - F.lag("bucket").over(order) <= buckets, 0).otherwise(1))
    runs = runs.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(service, "bucket", "stretch")
    around = runs.select(service, F.explode(F.sequence(F.col("bucket") - buckets, F.col("bucket"))).alias("bucket"), "stretch", F.col("bucket").alias("_of"))
    return around.groupBy(service, "bucket").agg(F.min("stretch").alias("stretch"), F.max(F.col("_of") == F.col("bucket")).alias("is_contested"))


def admit(requests: DataFrame, budget: float, seconds: int = 86_400, request: str = "request_id", service: str = "service", ts: str = "ts", cost: str = "cost", buckets: int = BUCKETS) -> DataFrame:
    """(request, service, ts, cost, admitted, path) of every request.

    Requests of a service are taken by time, then by id. One is admitted if the admitted costs of the
    ``seconds`` before it (open at the far end) and its own stay within ``budget``. A cost that is null or not above zero is
    admitted and spends nothing; without a time nothing is admitted; requests without a service are one service.
    ``path`` says how it was decided: free, settled (by its bucket's sums) or folded.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    cap, wide = int(round(budget * MILLION)), seconds * MILLION // buckets
    micro = F.round(F.col(cost) * MILLION).cast("long")
    rows = requests.select(request, F.col(service), F.col(ts), F.col(cost), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), micro.alias("micro"))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / wide))
    out = [request, service, ts, cost]
    free = rows.where(F.coalesce(F.col("micro"), F.lit(0)) <= 0).select(*out, F.col("at").isNotNull().alias("admitted"), F.lit("free").alias("path"))
    paid = rows.where(F.col("micro") > 0)
    dated, undated = paid.where(F.col("at").isNotNull()), paid.where(F.col("at").isNull()).select(*out, F.lit(False).alias("admitted"), F.lit("free").alias("path"))
    spots = broadcast_if_small(contested(dated, service, cap, buckets).withColumnsRenamed({service: "_service", "bucket": "_bucket"}))
    met = dated.join(spots, F.col(service).eqNullSafe(F.col("_service")) & (F.col("bucket") == F.col("_bucket")), "left").drop("_service", "_bucket")
    settled = met.where(~F.coalesce("is_contested", F.lit(False))).select(*out, F.lit(True).alias("admitted"), F.lit("settled").alias("path"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        group, held, spent = None, deque(), 0
        for b in batches:
            keep, decided = [], []
            for i, (s, stretch, at, cost_, open_) in enumerate(zip(b["key"], b["stretch"], b["at"], b["micro"], b["is_contested"], strict=True)):
                if (s, stretch) != group:
                    group, spent = (s, stretch), 0
                    held.clear()
                while held and at - held[0][0] >= seconds * MILLION:
                    spent -= held.popleft()[1]
                ok = not open_ or spent + cost_ <= cap
                if ok:
                    held.append((at, cost_))
                    spent += cost_
                if open_:
                    keep.append(i)
                    decided.append(ok)
            yield b.iloc[keep][out].assign(admitted=decided, path="folded")

    # a null service sorts and compares like a name of its own
    key = F.coalesce(F.concat(F.lit("s"), F.col(service).cast("string")), F.lit("n")).alias("key")
    dealt = met.where(F.col("stretch").isNotNull()).select(*out, key, "stretch", "at", "micro", "is_contested").repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at", request)
    folded = dealt.mapInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in out) + ", admitted boolean, path string")
    return free.unionAll(undated).unionAll(settled).unionAll(folded)
