"""Benchmark passages in documents: SimHash of item-sized windows, multi-index blocks, exact check.

1. Benchmark items (classes of equal words) give 5-word shingles and, of those, a 128-bit
   SimHash.
2. Windows of an item's size are laid at every start that can reach the similarity: two
   sets of k and m shingles need 3 (k + m) / 7 in common, so a window counts only if so many of
   its shingles stand in some item of that size.  This leaves out no window that reaches it.
3. Windows meet items of their size in a multi-index, which knows nothing of the item whose
   shingles laid the window: BLOCKS blocks of 8 bits, and each item stands in it with all values
   within PROBE bits of its own.  Two fingerprints that differ in less than BLOCKS * (PROBE + 1)
   bits, hence all within the radius, agree within PROBE bits in a block, so none is missed.
4. Weighted Jaccard of the shingles (weights: how often a shingle occurs) on the words
   themselves decides; SIMILARITY or more is a leak.

At similarity 0.75 two fingerprints differ in 22 bits on average, with a deviation of 4.3:
a radius of 36 misses one such pair in some thousands, and closer pairs hardly ever.
Words are runs of anything but ASCII white space, with A to Z lower-cased.  An item with
fewer than five words is one shingle; items without words match nothing.  Null and empty
texts have no windows.  A document shorter than the item is one window.  Repeated rows are
judged each; null doc_ids are a value like others.  Texts and items may be long: what is
gathered is one document's own windows.  Extra columns stay in ``clean``, whatever their names
(but ``_townscribe_``), and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
SIMILARITY = 0.75
BITS, RADIUS = 128, 36
BLOCKS, PROBE = 16, 2


def _word_list(text: Column) -> Column:
    return common.words(common.ascii_lower(text))


def _shingles(hashes: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` word hashes, an array."""
    one = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width)))
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), one)).otherwise(F.array().cast("array<bigint>"))


def _with_simhash(df: DataFrame) -> DataFrame:
    """``df`` with the halves low and high of the SimHash of its column shingles: a bit is set if more shingles have it than not."""
    # what a lambda names is evaluated for every element, so it is a column first
    df = df.withColumns({f"_h{i}": _seeded(i) for i in (1, 2)})

    def half(values: str) -> Column:
        bit = lambda b: F.size(F.filter(values, lambda x: F.getbit(x, b) == 1)) * 2 > F.size(values)
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: F.when(bit(b), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc))

    return df.withColumns({"low": half("_h1"), "high": half("_h2")}).drop("_h1", "_h2")


def _seeded(seed: int) -> Column:
    return F.transform("shingles", lambda x: F.xxhash64(x, F.lit(seed)))


def _block(low: Column, high: Column, i: int) -> Column:
    """The i-th run of 8 bits."""
    return F.shiftrightunsigned(low if i < 8 else high, 8 * (i % 8)).bitwiseAND(F.lit(255)).cast("int")


def _blocks(low: Column, high: Column) -> Column:
    """All blocks, each with its number above its bits."""
    return F.array(*(_block(low, high, i) + i * 256 for i in range(BLOCKS)))


def _probed(low: Column, high: Column) -> Column:
    """All values within PROBE bits of each block, each with its number above its bits."""
    flips = F.array(*(F.lit(x) for x in range(256) if x.bit_count() <= PROBE))
    return F.flatten(F.transform(_blocks(low, high), lambda block: F.transform(flips, lambda x: block.bitwiseXOR(x))))


def _first_block(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """The number of the first block in which two fingerprints differ in at most PROBE bits, so that a pair counts once."""
    return F.coalesce(*(F.when(F.bit_count(_block(low, high, i).bitwiseXOR(_block(low2, high2, i))) <= PROBE, i) for i in range(BLOCKS)))


def _texts(words: Column, width: Column) -> Column:
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))).otherwise(F.array().cast("array<string>"))


def _repeated(sorted_texts: Column) -> Column:
    return F.array_distinct(F.filter(sorted_texts, lambda x, i: (i > 0) & (x == F.get(sorted_texts, i - 1))))


def _weighted_jaccard(a: str, b: str) -> Column:
    """Of columns of sorted shingles; only what repeats in both is counted one by one."""
    count = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    twice = F.aggregate(F.array_intersect(f"{a}_again", f"{b}_again"), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)) - 1)
    both = F.size(F.array_intersect(a, b)) + twice
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def items(benchmark: DataFrame) -> DataFrame:
    """Classes of equal items: item, item_ids, words, size, width, low, high, shingles; written to the shared folder."""
    own = benchmark.select("item_id", _word_list(F.col("text")).alias("words")).where(F.size("words") > 0)
    own = own.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    own = own.withColumn("size", F.size("words")).withColumn("width", F.least(F.lit(WIDTH), F.size("words")))
    own = own.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    short = F.lit(None)
    for k in range(1, WIDTH + 1):
        short = F.when(F.col("width") == k, _shingles(F.col("hashes"), k)).otherwise(short)
    # a number of its own for each class, whatever the ids are; the written table keeps it
    own = common.materialize(own.withColumn("shingles", short).drop("hashes").withColumn("item", F.monotonically_increasing_id()), "items")
    return common.materialize(_with_simhash(own), "item-hashes")


def _starts(at: Column, shingles: Column, wide: Column, need: Column) -> Column:
    """The starts of all windows of ``wide`` shingles that hold ``need`` or more of the places ``at`` (sorted)."""
    run = lambda i: F.when(
        F.get(at, i + need - 1) - F.get(at, i) < wide,
        F.sequence(F.greatest(F.lit(0), F.get(at, i + need - 1) - wide + 1), F.least(F.get(at, i), shingles - wide)),
    ).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(at) >= need, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), run)))).otherwise(F.array().cast("array<int>"))


def windows(docs: DataFrame, item: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, windows of (size, start)) of every document with a window that can reach the similarity; written to the shared folder."""
    seeds = item.select("size", "width", F.explode("shingles").alias("shingle")).distinct()
    seeds = common.maybe_broadcast(common.materialize(seeds.groupBy("width", "shingle").agg(F.collect_set("size").alias("sizes")), "seeds"))
    widths = sorted(r[0] for r in item.select("width").distinct().collect()) or [WIDTH]  # of 1 to 5
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), _word_list(F.col("text")).alias("words"))
    hashed = rows.select("doc_id", "text_key", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    found = None
    for k in widths:
        here = hashed.select("doc_id", "text_key", (F.col("n") - k + 1).alias("n"), F.posexplode(_shingles(F.col("hashes"), k)).alias("at", "shingle"))
        here = here.join(seeds.where(F.col("width") == k), "shingle").select("doc_id", "text_key", "n", "at", F.explode("sizes").alias("size"), F.lit(k).alias("width"))
        found = here if found is None else found.unionAll(here)
    # a document's own places: no more than its words
    found = found.groupBy("doc_id", "text_key", "n", "size", "width").agg(F.array_sort(F.collect_set("at")).alias("at"))
    own = F.col("size") - F.col("width") + 1
    found = found.withColumn("wide", F.least(own, F.col("n")))
    need = F.greatest(F.lit(1), F.ceil((own + F.col("wide")) * (similarity / (1 + similarity)) - 1e-9).cast("int"))
    found = found.withColumn("need", need).where("size(at) >= need")
    found = found.withColumn("starts", _starts(F.col("at"), F.col("n"), F.col("wide"), F.col("need"))).where("size(starts) > 0")
    found = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("size", "starts")).alias("windows"))
    return common.materialize(found, "windows")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, item_ids, start, size, similarity) of every window that reaches the similarity."""
    item = items(benchmark)
    laid = windows(docs, item, similarity)
    laid = common.maybe_broadcast(laid.select(F.col("doc_id").alias("_townscribe_doc"), F.col("text_key").alias("_townscribe_key"), "windows"))
    near = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    near = near.join(laid, (F.col("text_key") == F.col("_townscribe_key")) & F.col("doc_id").eqNullSafe(F.col("_townscribe_doc"))).select("doc_id", "text_key", _word_list(F.col("text")).alias("words"), "windows")
    near = near.select("doc_id", "text_key", "words", F.explode("windows").alias("w")).select("doc_id", "text_key", "words", "w.size", F.explode("w.starts").alias("start"))
    near = near.withColumn("words", F.slice("words", F.col("start") + 1, F.col("size")))
    near = near.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("width", F.least(F.lit(WIDTH), F.col("size")))
    own = F.lit(None)
    for k in range(1, WIDTH + 1):
        own = F.when(F.col("width") == k, _shingles(F.col("hashes"), k)).otherwise(own)
    near = common.materialize(_with_simhash(near.withColumn("shingles", own)).drop("hashes", "shingles"), "window-hashes")
    # the multi-index: windows and items of a size that agree in a block
    index = item.select(F.col("size").alias("_size"), "item", F.col("low").alias("item_low"), F.col("high").alias("item_high"), F.explode(_probed(F.col("low"), F.col("high"))).alias("_block"))
    met = near.withColumn("block", F.explode(_blocks(F.col("low"), F.col("high")))).join(common.maybe_broadcast(index), (F.col("size") == F.col("_size")) & (F.col("block") == F.col("_block")))
    distance = F.bit_count(F.col("low").bitwiseXOR(F.col("item_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("item_high")))
    once = F.shiftright("block", 8) == _first_block(F.col("low"), F.col("high"), F.col("item_low"), F.col("item_high"))
    met = met.where((distance <= RADIUS) & once).select("doc_id", "text_key", "item", "start", "size", "width", "words")
    # the items' words come to the few pairs that are left, not to the index
    met = met.join(common.maybe_broadcast(item.select("item", "item_ids", F.col("words").alias("item_words"))), "item").drop("item")
    # the shingles are columns of a table before they are compared: what a lambda or a pushed filter names is evaluated anew
    met = met.withColumns({"a": F.array_sort(_texts(F.col("words"), F.col("width"))), "b": F.array_sort(_texts(F.col("item_words"), F.col("width")))}).drop("words", "item_words")
    met = met.withColumns({"a_again": _repeated(F.col("a")), "b_again": _repeated(F.col("b"))})
    met = common.materialize(met, "met")
    return met.select("doc_id", "text_key", "item_ids", "start", "size", _weighted_jaccard("a", "b").alias("similarity")).where(F.col("similarity") >= similarity)


def leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (doc_id, text) with a leak: doc_id, text_key, items, similarity; written to the shared folder."""
    one = leaks(docs, benchmark).groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"), F.max("similarity").alias("similarity"))
    return common.materialize(one, "leaks")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    bad = leaked(docs, benchmark).select(F.col("doc_id").alias("_townscribe_doc"), F.col("text_key").alias("_townscribe_key"))
    return docs.join(common.maybe_broadcast(bad), (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_townscribe_key")) & F.col("doc_id").eqNullSafe(F.col("_townscribe_doc")), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, leaked, items, similarity) of every row of ``docs``."""
    bad = leaked(docs, benchmark).select(F.col("doc_id").alias("_townscribe_doc"), F.col("text_key").alias("_townscribe_key"), "items", "similarity")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.join(common.maybe_broadcast(bad), (F.col("text_key") == F.col("_townscribe_key")) & F.col("doc_id").eqNullSafe(F.col("_townscribe_doc")), "left").select(
        "doc_id", F.col("items").isNotNull().alias("leaked"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity")
    )
