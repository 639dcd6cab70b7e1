"""Near duplicates: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Each text becomes its set of distinct 5-word shingles, 200 MinHash lanes, and 40 band
   keys of 5 lanes.  A pair of similarity 0.75 shares no band with probability
   (1 - 0.75^5)^40 = 2e-5.  Texts with the same set form a class at once; only the least
   doc_id of a class goes on.
2. For every set that shares a bucket, the shingles that no other such set has are counted.
   They bound its similarity to any other: heavily edited copies of one text, which resemble
   each other but link with nothing, leave here without being paired.
   Round one pairs every class of a bucket with the bucket's least class (a star, no square).
   Pairs whose bound is too low, or whose lanes make a similarity of 0.75 improbable batch
   after batch, are pruned; full sets confirm the rest exactly.
3. Classes linked so far are components.  Round two pairs what remains: classes of a bucket
   that stand in different components, and of these only pairs that can reach the similarity
   by what each shares with the bucket's head (bits, compared in the join).  A bucket of
   copies has nothing left here.  Nothing is capped, so no link is lost to a large bucket.
4. Components by large-star and small-star steps.

A text with fewer than five words is one shingle; texts without words, and null texts, have
an empty set and link with nothing.  Rows that repeat a doc_id are one node.  A row without
doc_id links with nothing and is kept.  doc_id must be an integer (TypeError otherwise), as the least
of a component stays; ties can't be.  Texts may be long and are read whole.  Extra columns stay in
``keep_one``, whatever their names (but ``_townscribe_``), and are ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingling import Hasher, mix, shingle_set

BANDS, ROWS = 40, 5
LANES = BANDS * ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair is pruned where its posterior probability of reaching the similarity is below this.
MISS = 1e-6
#: Lanes compared at a time.
BATCH = 20
#: Rows of a bucket that meet as many others in one task.
BLOCK = 1000

_rng = np.random.default_rng(20240607)
XORS = _rng.integers(0, 2**32, LANES, dtype=np.uint32)
ODDS = _rng.integers(0, 2**31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(lanes: int, similarity: float = PERCENT / 100, miss: float = MISS) -> int:
    """The fewest equal lanes of ``lanes`` that leave a posterior of ``miss`` for the similarity.

    With a uniform prior, P(J >= t | m equal of n) is P(Binomial(n + 1, t) <= m).
    """
    total, m = 0.0, -1
    while total < miss:
        m += 1
        total += math.comb(lanes + 1, m) * similarity**m * (1 - similarity) ** (lanes + 1 - m)
    return m


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash lanes of a set of 64-bit shingle hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(LANES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        part = x[None, at : at + 512] ^ XORS[:, None]
        part *= ODDS[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0xD1342543DE82EF95) + sig[j::ROWS])
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        h, at = hasher.words(b.column("text").to_pylist(), lower=True)
        n, one, two, keys, sigs = [], [], [], [], []
        for i in range(b.num_rows):
            s = shingle_set(h[at[i] : at[i + 1]])
            n.append(len(s))
            one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            two.append(int(mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64).view(np.int64)))
            sig = signature(s) if len(s) else None
            keys.append(band_keys(sig).view(np.int64) if len(s) else None)
            sigs.append((sig & np.uint32(0xFFFF)).astype("<u2").tobytes() if len(s) else None)
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "set1": pa.array(one, pa.int64()), "set2": pa.array(two, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64())), "sig": pa.array(sigs, pa.binary())})


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = [(k, least_matches(k)) for k in range(BATCH, LANES + 1, BATCH)]
    for b in batches:
        if not b.num_rows:
            continue
        lanes = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(-1, LANES) for c in ("sig_a", "sig_b")]
        alive, same = np.arange(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
        for k, least in need:
            same[alive] += (lanes[0][alive, k - BATCH : k] == lanes[1][alive, k - BATCH : k]).sum(axis=1)
            alive = alive[same[alive] >= least]
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(alive)), b.column("b").take(pa.array(alive))], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        h, at = hasher.words(b.column("text").to_pylist(), lower=True)
        sets = [shingle_set(h[at[i] : at[i + 1]]).tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for i, (x, y) in enumerate(zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common_n = int((both[1:] == both[:-1]).sum())
            if 100 * common_n >= PERCENT * (len(x) + len(y) - common_n):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep, pa.int64())), b.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(x, dtype=np.int64) for x in b.column("shingles").to_pylist()]
        ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), np.array([len(x) for x in sets], dtype=np.int64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["id", "shingle"])


def _against_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the head's shingles a set has, as bits, and how many others it has that another set might have."""
    for b in batches:
        bits, extra = [], []
        for x, h, own in zip(b.column("set_x").to_pylist(), b.column("set_h").to_pylist(), b.column("own").to_pylist(), strict=True):
            x, h = np.frombuffer(x, dtype=np.uint64), np.frombuffer(h, dtype=np.uint64)
            has = np.isin(h, x, assume_unique=True)
            packed = np.packbits(has)
            bits.append(np.pad(packed, (0, -len(packed) % 8)).view(np.int64))
            extra.append(int(own) - int(has.sum()))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("of"), pa.array(bits, pa.list_(pa.int64())), pa.array(extra, pa.int64())], ["id", "of", "bits", "extra"])


def verify(pairs: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that reach the similarity; ``sigs`` has (doc_id, sig), ``sets`` (id, shingles)."""
    at = lambda s: sigs.select(F.col("doc_id").alias(s), F.col("sig").alias(f"sig_{s}"))
    likely = common.materialize(pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune, "a long, b long"), "likely")
    of = lambda s: sets.select(F.col("id").alias(s), F.col("shingles").alias(f"set_{s}"))
    return likely.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long")


def _possible(n_a: str, own_a: str, n_b: str, own_b: str):
    """Whether two sets can reach the similarity, from their sizes and how much of each any other set has at all."""
    most = F.least(own_a, own_b)
    return 100 * most >= PERCENT * (F.col(n_a) + F.col(n_b) - most)


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, set1, set2) with their shingle sets' hashes, classes of equal sets (n, set1, set2, rep, size), links (a, b) of reps, components (node, component)."""
    docs = common.integer_ids(docs).select("doc_id", "text")
    rows = common.materialize(docs.mapInArrow(_signatures, "doc_id long, n long, set1 long, set2 long, bands array<long>, sig binary"), "signatures")
    real = rows.where("doc_id is not null and n > 0")
    classes = common.materialize(real.groupBy("n", "set1", "set2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "sets")
    reps = real.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sigs = reps.select("doc_id", "sig")
    keys = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head")
    buckets = common.materialize(keys.join(heads, "key"), "buckets")

    # the sets of all that share a bucket, and how much of each set any other of these sets has
    ids = common.materialize(buckets.select("doc_id").distinct(), "ids")
    sets = common.materialize(docs.join(common.maybe_broadcast(ids), "doc_id").mapInArrow(_sets, "id long, shingles binary"), "sets")
    lone = sets.mapInArrow(_exploded, "id long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("id").alias("id")).where("sets = 1").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    lone = common.maybe_broadcast(common.materialize(lone, "lone"))
    buckets = buckets.join(lone, buckets["doc_id"] == lone["id"], "left").withColumn("own", F.col("n") - F.coalesce("lone", F.lit(0))).drop("id", "lone")
    # too much of the set stands nowhere else: no link at all
    buckets = buckets.where(100 * F.col("own") >= PERCENT * F.col("n"))
    first = buckets.where("doc_id = head").select(F.col("key").alias("head_key"), F.col("n").alias("head_n"), F.col("own").alias("head_own"))
    star = buckets.where("doc_id <> head").join(first, (F.col("key") == F.col("head_key")) & _possible("n", "own", "head_n", "head_own")).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = common.materialize(verify(star, sigs, sets), "links")
    comp = common.materialize(components(edges), "components")
    placed = buckets.join(comp, buckets["doc_id"] == comp["node"], "left").select("key", "doc_id", "n", "own", "head", F.coalesce("component", "doc_id").alias("place"))
    open_keys = placed.groupBy("key").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").select("key")
    rest = common.materialize(placed.join(open_keys, "key").where("doc_id <> head"), "unlinked")
    # each set against its bucket's head: two sets share at most what both share with it, and the rest of the smaller rest
    with_head = rest.groupBy(F.col("doc_id").alias("id"), F.col("head").alias("of")).agg(F.max("own").alias("own"))
    with_head = with_head.join(sets.select("id", F.col("shingles").alias("set_x")), "id").join(sets.select(F.col("id").alias("of"), F.col("shingles").alias("set_h")), "of").select("id", "of", "own", "set_x", "set_h")
    placed = rest.join(with_head.mapInArrow(_against_head, "id long, of long, bits array<long>, extra long"), (F.col("doc_id") == F.col("id")) & (F.col("head") == F.col("of")))
    placed = common.materialize(placed.select("key", "doc_id", "n", "place", "bits", "extra"), "placed")
    # a bucket's pairs are dealt by classes of size (sets further apart than neighbours can't link) and by blocks of rows and columns
    blocks = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(blocks, "key").withColumns({"near": F.floor(F.log("n") / F.log(F.lit(1.4))), "block": F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")})
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cell = {"a": [F.col("near").alias("near_a"), F.col("block").alias("row_a"), others.alias("column_a")], "b": [F.col("near_b"), others.alias("row_b"), F.col("block").alias("column_b")]}
    sides = {"a": placed, "b": placed.withColumn("near_b", F.explode(F.array(F.col("near") - 1, F.col("near"), F.col("near") + 1)))}
    side = lambda s: sides[s].select(F.col("key").alias(f"key_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "place", "bits", "extra")), *cell[s])
    apart = (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("place_a") != F.col("place_b")) & _possible("n_a", "n_a", "n_b", "n_b")
    both = F.aggregate(F.zip_with("bits_a", "bits_b", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda n, k: n + k) + F.least("extra_a", "extra_b")
    reach = 100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both)
    same = (F.col("key_a") == F.col("key_b")) & (F.col("near_a") == F.col("near_b")) & (F.col("row_a") == F.col("row_b")) & (F.col("column_a") == F.col("column_b"))
    more = side("a").join(side("b"), same & apart & reach).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    late = common.materialize(verify(more, sigs, sets), "late-links")
    if not late.isEmpty():
        edges = edges.unionAll(late)
        comp = common.materialize(components(edges), "components")
    return rows.select("doc_id", "n", "set1", "set2"), classes, edges, comp


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    rows, classes, _, comp = links(docs)
    # the component comes to the class first, so that one join with the rows remains
    placed = common.materialize(classes.join(comp, classes["rep"] == comp["node"], "left").select("n", "set1", "set2", "size", F.coalesce("component", "rep").alias("component")), "placed-sets")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return common.join_classes(rows, placed, ["n", "set1", "set2"], "size").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but the least doc_id of each component; of rows that repeat a doc_id one stays."""
    ids = near_duplicates(docs)
    gone = common.materialize(ids.where("not kept").select(F.col("doc_id").alias("_townscribe_gone")).distinct(), "gone")
    kept = docs.join(common.maybe_broadcast(gone), docs["doc_id"] == F.col("_townscribe_gone"), "left_anti")
    again = common.materialize(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_townscribe_again")).count().where("count > 1").select("_townscribe_again"), "repeated")
    if again.isEmpty():
        return kept
    again = common.maybe_broadcast(again)
    once = kept.join(again, kept["doc_id"] == F.col("_townscribe_again"), "left_anti")
    return once.unionAll(kept.join(again, kept["doc_id"] == F.col("_townscribe_again"), "left_semi").dropDuplicates(["doc_id"]))
