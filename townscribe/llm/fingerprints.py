"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A paragraph (a line) gives a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo powers of two:

* LANES lanes of 32 bits, hashed from the paragraph's SHA-512 digest.  Equal multisets of
  paragraphs have equal lanes, whatever their order.
* SKETCH lanes of 16 bits: each run of three words of the paragraph (shorter at its end) adds
  +1 or -1 to one lane, a count sketch.  Their cosine estimates how much of two documents is
  the same, with an error of about 1 / sqrt(SKETCH).

Sums can be added and taken away again, so ``add`` and ``subtract`` insert or delete
paragraphs without the rest of the document.  Only DataFrame functions are used.

A null text is empty; an empty text has no paragraphs and the zero vector.  In ``edited``,
rows that repeat a doc_id take the same next document, and of several rows of that one the
least text; a row without doc_id has no next document and stays unedited (likeness to the
next: 0).  Equal texts tie with likeness 1.  Texts may be long: they are hashed whole.  An empty table
gives an empty one.  ``fingerprint`` keeps extra columns, whatever their names (but ``_townscribe_``, and
an old fingerprint is replaced); ``edited`` ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LANES, LANE_BITS = 32, 32
SKETCH, SKETCH_BITS = 128, 16

def _zero() -> Column:
    return F.lit(0).cast("long")


def _signed(x: Column) -> Column:
    """A sketch lane modulo 2^SKETCH_BITS, as a signed number."""
    half = 1 << (SKETCH_BITS - 1)
    return F.pmod(x + half, F.lit(1 << SKETCH_BITS).cast("long")) - half


def wide(text: Column) -> Column:
    """The 32-bit lanes of a text, array<bigint>."""
    paragraphs = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    digests = F.transform(paragraphs, lambda p: F.sha2(p, 512))
    mask = F.lit((1 << LANE_BITS) - 1).cast("long")
    zero = F.array_repeat(_zero(), LANES)
    one = lambda d: F.array(*(F.xxhash64(F.lit(i), d).bitwiseAND(mask) for i in range(LANES)))
    total = F.aggregate(digests, zero, lambda acc, d: F.zip_with(acc, one(d), lambda a, b: a + b))
    return F.transform(total, lambda x: x.bitwiseAND(mask))


def with_vectors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of a text column as struct<wide, lanes, values>; null texts are empty.

    lanes are the sketch lanes that are not zero, in order.  Each step is a column of its own:
    what a lambda names is evaluated for every element, so it must be a column already.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_townscribe_words", F.when(t == "", F.array().cast("array<array<string>>")).otherwise(F.transform(F.split(t, "\n"), lambda p: F.split(p, " "))))
    pairs = lambda ws: F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: F.xxhash64(a, b))
    codes = lambda ws: F.zip_with(pairs(ws), F.slice(ws, 3, F.size(ws)), lambda h, c: F.pmod(F.xxhash64(h, c), F.lit(2 * SKETCH)).cast("smallint"))
    df = df.withColumn("_townscribe_codes", F.sort_array(F.flatten(F.transform("_townscribe_words", codes))))
    df = df.withColumn("_townscribe_kinds", F.array_distinct("_townscribe_codes"))
    begins = F.transform("_townscribe_codes", lambda c, i: F.when((i == 0) | (c != F.get("_townscribe_codes", i - 1)), i + 1))
    df = df.withColumn("_townscribe_first", F.filter(begins, lambda p: p.isNotNull()))
    df = df.withColumn("_townscribe_count", F.transform("_townscribe_first", lambda p, i: F.coalesce(F.get("_townscribe_first", i + 1), F.size("_townscribe_codes") + 1) - p))
    df = df.withColumn("_townscribe_lanes", F.array_distinct(F.transform("_townscribe_kinds", lambda k: F.shiftright(k, 1).cast("smallint"))))
    count = lambda code: F.coalesce(F.get("_townscribe_count", (F.array_position(F.col("_townscribe_kinds"), code.cast("smallint")) - 1).cast("int")), _zero())
    df = df.withColumn("_townscribe_values", F.transform("_townscribe_lanes", lambda lane: _signed(count(lane.cast("int") * 2 + 1) - count(lane.cast("int") * 2)).cast("smallint")))
    pairs = F.filter(F.arrays_zip("_townscribe_lanes", "_townscribe_values"), lambda x: x["_townscribe_values"] != 0)
    df = df.withColumn("_townscribe_pairs", pairs)
    v = F.struct(wide(t).alias("wide"), F.transform("_townscribe_pairs", lambda x: x["_townscribe_lanes"]).alias("lanes"), F.transform("_townscribe_pairs", lambda x: x["_townscribe_values"]).alias("values"))
    return df.withColumn(out, v).drop("_townscribe_words", "_townscribe_codes", "_townscribe_kinds", "_townscribe_first", "_townscribe_count", "_townscribe_lanes", "_townscribe_values", "_townscribe_pairs")


def _value(v: Column, lane: Column) -> Column:
    """The value of a sketch lane, 0 if the fingerprint has none."""
    return F.coalesce(F.get(v["values"], (F.array_position(v["lanes"], lane) - 1).cast("int")).cast("long"), _zero())


def _combine(a: Column, b: Column, sign: int) -> Column:
    mask = F.lit((1 << LANE_BITS) - 1).cast("long")
    lanes = F.array_sort(F.array_union(a["lanes"], b["lanes"]))
    both = F.filter(F.transform(lanes, lambda n: F.struct(n.alias("lane"), _signed(_value(a, n) + _value(b, n) * sign).cast("smallint").alias("value"))), lambda x: x["value"] != 0)
    return F.struct(F.zip_with(a["wide"], b["wide"], lambda x, y: (x + y * sign).bitwiseAND(mask)).alias("wide"), F.transform(both, lambda x: x["lane"]).alias("lanes"), F.transform(both, lambda x: x["value"]).alias("values"))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of all paragraphs of both."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of ``a`` without those of ``b``."""
    return _combine(a, b, -1)


def text_of(v: Column) -> Column:
    """A fingerprint as text: the lanes in hexadecimal, a colon, the sketch lanes that are not zero."""
    lanes = F.array_join(F.transform(v["wide"], lambda x: F.lpad(F.lower(F.hex(x)), LANE_BITS // 4, "0")), "")
    rest = F.array_join(F.zip_with(v["lanes"], v["values"], lambda n, x: F.concat_ws("=", n.cast("string"), x.cast("string"))), ",")
    return F.concat(lanes, F.lit(":"), rest)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the sketches (at least 0)."""
    square = lambda v: F.aggregate(v["values"], F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    dot = F.aggregate(F.zip_with(a["lanes"], a["values"], lambda n, x: x.cast("double") * _value(b, n).cast("double")), F.lit(0.0), lambda n, x: n + x)
    size = F.sqrt(square(a) * square(b))
    cosine = F.when(size > 0, dot / size).otherwise(F.lit(0.0))
    return F.when(a["wide"] == b["wide"], F.lit(1.0)).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with a column fingerprint."""
    return with_vectors(docs, "text", "_townscribe_v").withColumn("fingerprint", text_of(F.col("_townscribe_v"))).drop("_townscribe_v")


def neighbours(ids: DataFrame) -> DataFrame:
    """For each distinct doc_id: next_id (the next lower, after the lowest the highest), and its
    predecessor's id and n, where it is the next one.

    Ids are dealt out by range, linked within each range, and the ends of the ranges are joined.
    """
    spark = ids.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = ids.groupBy("doc_id").agg(F.max("n").alias("n")).repartitionByRange(parts, "doc_id").withColumn("range", F.spark_partition_id())
    ids = common.materialize(ids, "ids")
    ends = ids.groupBy("range").agg(F.min("doc_id").alias("low"), F.max(F.struct("doc_id", "n")).alias("high"), F.min(F.struct("doc_id", "n")).alias("first"))
    # as many rows as there are ranges
    by = Window.orderBy("range")
    ends = ends.select("range", F.lag("high.doc_id").over(by).alias("below"), F.lead("first").over(by).alias("above"), F.max("high.doc_id").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"), F.min("first").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("bottom"))
    own = Window.partitionBy("range").orderBy("doc_id")
    linked = ids.select("range", "doc_id", F.lag("doc_id").over(own).alias("lower"), F.lead(F.struct("doc_id", "n")).over(own).alias("higher"))
    linked = linked.join(F.broadcast(ends), "range")
    before = F.coalesce("higher", "above", "bottom")
    return linked.select("doc_id", F.coalesce("lower", "below", "top").alias("next_id"), before["doc_id"].alias("pred_id"), before["n"].alias("pred_n"))


def edited(docs: DataFrame) -> DataFrame:
    """Each row's text, edited text, their fingerprints (structs v, edited_v) and the next document's (next_v)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = with_vectors(docs, "text", "v")
    pairs = neighbours(docs.where("doc_id is not null").select("doc_id", F.length("text").cast("long").alias("n")))
    rows = hashed.where("doc_id is not null").join(pairs, "doc_id")
    tails = rows.select(F.col("pred_id").alias("for_id"), F.expr("substring(text, 1, cast(pred_n div 2 as int))").alias("tail"), F.col("v").alias("next_v")).groupBy("for_id").agg(F.min(F.struct("tail", "next_v")).alias("next"))
    half = "cast(length(text) div 2 as int)"
    changed = F.concat(F.expr(f"substring(text, 1, length(text) - {half})"), F.expr(f"substring(next.tail, 1, {half})"))
    with_next = rows.join(tails, F.col("doc_id") == F.col("for_id")).select("doc_id", "text", "v", changed.alias("edited"), F.col("next.next_v").alias("next_v"))
    with_next = with_vectors(with_next, "edited", "edited_v")
    alone = hashed.where("doc_id is null").select("doc_id", "text", "v", F.col("text").alias("edited"), F.lit(None).cast(hashed.schema["v"].dataType).alias("next_v"), F.col("v").alias("edited_v"))
    return with_next.unionByName(alone)
