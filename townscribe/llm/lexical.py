"""Ranked lexical search: impact-ordered postings, score at a time.

For a block of items (the stated queries) the documents are read once. Each gives its number of terms and the
places in the block's vocabulary of the terms it shares with the items (a table in the shared folder). From it come N,
L and the document frequencies, which fix every posting's impact, a 64-bit integer. Then each task indexes its
documents in shards of bounded size: postings grouped by term and exact impact, groups in descending order. For an
item the groups of its terms are processed from the highest impact down, in waves, into one accumulator a document.
After each wave the next impact of every term bounds what any document can still gain. Processing stops only once that bound
is below the k-th score, so that no document outside the accumulators can be among the first k, and once few enough
accumulators can still reach it; their scores are completed from the documents' own postings. The k-th
score is that of all shards the task has seen. Each task gives its k best documents an item, and the k best of these are the result.

Documents are not shuffled. What moves is k rows an item and task, and counts by term. Items are dealt into blocks
of at most about ``BLOCK_BYTES`` of text (by a hash of their row number); a block's vocabulary goes to the tasks, and the documents are read once for each block.

Definitions (all integers, ``div`` rounds down): terms are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``, A to Z
lower-cased; N documents have a term, L is the number of their terms, n a document's terms, df the documents
with a term, tf its occurrences in one; ``w = floor(1000 * ln((2N+2) / (2df+1)))``, ``m = 50 + ((50 n N) div L)``;
a term's impact is ``w * ((1000000000 tf) div (1000 tf + 20 m))`` and a score is the sum over the item's terms, once each.

Defined results:

* a document whose text is null or without a term is in no count and no ranking; an item without a term has no rows.
* every row is a document: rows of one doc_id are ranked each (equal ones in any order); a null doc_id comes after all ids of equal score.
* every row of the items is an item: rows that share an item_id, or have none, are ranked each on their own.
* documents with score 0 (a term that all documents hold can weigh 0) are not returned.
* whole texts count, however long; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of an item.
K = 50
#: Bytes of item texts in a block.
BLOCK_BYTES = 4 << 20
#: Postings of a shard, which a task holds in memory as arrays.
SHARD_POSTINGS = 1 << 20
#: Postings of the first wave; each wave has twice those of the one before.
FIRST_WAVE = 1 << 12

#: Bytes that are no part of a term become spaces, A to Z lower case; UTF-8 of other characters stays.
_FOLD = bytes(32 if c < 0x30 or 0x39 < c < 0x41 or 0x5A < c < 0x61 or 0x7A < c < 0x80 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's terms, and those of the vocabulary with their occurrences; documents without a term are left out."""
    known = common.ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known().get
        for b in batches:
            rows, ns, ids, tfs = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                all_terms = [t for t in terms(text) if t]
                if all_terms:
                    found = Counter(map(place, all_terms))
                    found.pop(None, None)
                    rows.append(i)
                    ns.append(len(all_terms))
                    ids.append(list(found.keys()))
                    tfs.append(list(found.values()))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array(rows, pa.int64())), "n": pa.array(ns, pa.int64()), "terms": pa.array(ids, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int32()))})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.materialize(given.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")


class Shard:
    """The postings of some documents, grouped by term and exact impact in descending order, and by document."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, all_docs: int, all_terms: int) -> None:
        self.ids = ids
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        m = 50 + 50 * n * all_docs // all_terms
        doc = np.repeat(np.arange(len(ids)), sizes)
        self.term, self.part = term, 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])  # under 2^20
        key = (term.astype(np.int64) << 20) + ((1 << 20) - 1 - self.part)
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.docs = doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        self.group_start = first
        self.group_size = np.diff(np.concatenate([first, [len(key)]]))
        self.group_part = (1 << 20) - 1 - (key[first] & ((1 << 20) - 1))
        self.of_term = np.searchsorted(key[first] >> 20, np.arange(n_terms + 1))

    def best(self, item: np.ndarray, weights: np.ndarray, k: int, known: np.ndarray, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of which the k best of this shard and of ``known`` (scores found before) are surely a part."""
        counts = self.of_term[item + 1] - self.of_term[item]
        term = np.repeat(np.arange(len(item)), counts)
        group = _ranges(self.of_term[item], counts)
        impact = self.group_part[group] * weights[item][term]
        order = np.argsort(-impact, kind="stable")
        group, term, impact = group[order], term[order], impact[order]
        size = np.cumsum(self.group_size[group])
        acc, done, wave = np.zeros(len(self.ids), dtype=np.int64), 0, FIRST_WAVE
        while done < len(group):
            at = min(len(group), 1 + int(np.searchsorted(size, (size[done - 1] if done else 0) + wave)))
            now = group[done:at]
            np.add.at(acc, self.docs[_ranges(self.group_start[now], self.group_size[now])], np.repeat(impact[done:at], self.group_size[now]))
            done, wave = at, wave * 2
            ahead = np.zeros(len(item), dtype=np.int64)
            np.maximum.at(ahead, term[done:], impact[done:])
            bound = int(ahead.sum())
            least = _kth(np.concatenate([known, acc]), k)
            if bound < least:  # what has no accumulator cannot be among the first k
                left = np.flatnonzero(acc + bound >= least)
                if (self.starts[left + 1] - self.starts[left]).sum() <= size[-1] - size[done - 1]:
                    break
        else:
            left = np.flatnonzero(acc)
        if seen is not None:
            seen["postings"], seen["of"] = int(size[done - 1]) if done else 0, int(size[-1]) if len(size) else 0
        mine = np.zeros(len(weights), dtype=np.int64)
        mine[item] = weights[item]
        sizes = self.starts[left + 1] - self.starts[left]
        place = _ranges(self.starts[left], sizes)
        total = np.zeros(len(left), dtype=np.int64)
        np.add.at(total, np.repeat(np.arange(len(left)), sizes), self.part[place] * mine[self.term[place]])
        return left, total


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if total else np.zeros(0, dtype=np.int64)


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th highest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Tops:
    """The k best documents of each item so far: by score, then by doc_id, null last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.rows = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)) for _ in range(items)]

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray, null: np.ndarray) -> None:
        ids, scores, null = (np.concatenate([a, b[scores > 0]]) for a, b in zip(self.rows[i], (ids, scores, null), strict=True))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.rows[i] = ids[order], scores[order], null[order]


def search_block(docs: DataFrame, items: list[tuple[int, str | None]], k: int = K, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item, doc_id, score, rank): the k best documents of each of some numbered items, held on the driver."""
    spark = docs.sparkSession
    wanted = [(no, sorted(set(terms(text)) - {b""})) for no, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in wanted for t in ts}))}
    table = counted(docs, vocabulary)
    n_docs, n_terms = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    queries = common.ship(spark, ([no for no, _ in wanted], [np.array([vocabulary[t] for t in ts], dtype=np.int64) for _, ts in wanted], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, item_terms, weights = queries()
        tops, held, postings = Tops(len(numbers), k), [], 0

        def search(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: t.column(c).chunk(0)
            null = np.asarray(column("doc_id").is_null())
            ids = np.where(null, _LAST, np.asarray(column("doc_id").fill_null(_LAST)))
            lists, tfs = column("terms"), column("tfs")
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            shard = Shard(ids, np.asarray(column("n")), sizes, np.asarray(lists.flatten()).astype(np.int64), np.asarray(tfs.flatten()).astype(np.int64), len(weights), n_docs, n_terms)
            for i, item in enumerate(item_terms):
                if len(item):
                    left, scores = shard.best(item, weights, k, tops.rows[i][1])
                    tops.add(i, ids[left], scores, null[left])

        for b in batches:
            if b.num_rows:
                held.append(b)
                postings += len(b.column("terms").flatten()) + b.num_rows
            if postings >= shard_postings:
                search(held)
                held, postings = [], 0
        if held:
            search(held)
        for no, (ids, scores, null) in zip(numbers, tops.rows, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_pydict({"item": pa.array([no] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=null), "score": pa.array(scores, pa.int64())})

    found = table.mapInArrow(run, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best ``docs`` of each row of ``items`` (item_id, text)."""
    numbered = common.materialize(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("item")), "items")
    size = numbered.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()  # about block_bytes
        if own or (out is None and b == blocks - 1):
            part = search_block(docs, [tuple(r) for r in own], k, shard_postings)
            out = part if out is None else out.unionAll(part)
    ids = numbered.select("item", "item_id")
    return out.join(common.maybe_broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = """
with low as (select doc_id, row_number() over () as no, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select no, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from low where text is not null),
tfs as (select no, term, count(*) as tf from words group by no, term),
lens as (select no, sum(tf)::bigint as n from tfs group by no),
tot as (select count(*)::bigint as nn, sum(n)::bigint as ll from lens),
dfs as (select term, floor(1000 * ln((2 * (select nn from tot) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs group by term),
ms as (select no, 50 + ((50 * n * nn) // ll) as m from lens, tot),
items as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark where text is not null),
scores as (
  select item_id, no, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from items join dfs using (term) join tfs using (term) join ms using (no) group by item_id, no),
ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
  from scores join low using (no) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
