"""Repeated passages: suffix automata of reference shards, through which documents stream.

A window is 50 consecutive words.  A word goes if a window over it also starts in a document
with a smaller doc_id.

1. Routing.  Each window names the least hash of its 25-word runs (its minimizer), so equal
   windows name the same one.  Only windows whose minimizer stands in two documents go on, as
   hashes; grouping them (with a map-side minimum, so a passage that a third of all documents
   hold is one row a partition) gives the first document of each repeated window.  Of documents
   with equal texts only the least doc_id takes part; the others are routed to its whole text.
2. Reference shards.  Consecutive windows that a document is the first to have are a reference
   passage.  Passages are cut to at most PIECE words (overlapping by 49) and dealt to shards of
   about SHARD words, so no automaton grows with the corpus: their number does.
3. Streaming.  A shard goes to as many tasks as its documents need, TASK_ROWS documents each.
   A task builds the shard's suffix automaton; every state carries the least doc_id that has its
   words.  Whole documents stream through it for matching statistics: where the longest match that
   ends at a word has 50 words or more, and the least doc_id of the last 50 of them is smaller, these
   50 words go; such words make up the maximal spans.
4. The spans that all shards of a document found are united and removed.

Hashes choose which documents meet which shard; the automaton compares words, so a collision can
remove nothing.  It can hide a window: two unequal windows with equal 64-bit hashes count as one.
The reference grows with the repeated text alone.  Words are runs of anything but ASCII white space,
unchanged.  Null and empty texts have no words.  Rows without doc_id are left as they are and cover
nothing.  Rows that repeat a doc_id do not cover each other.  doc_id must be an integer (TypeError
otherwise): its order decides.  Texts may be long: a row is held whole, never cut.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingling import Hasher, windows

SPAN = 50
#: Words of the runs of which a window's minimizer is the least.
RUN = 25
#: Minimizers are broadcast up to so many, else joined.
BROADCAST_MINIMIZERS = 1_000_000
#: Words of a shard, of a piece of a passage, and documents of a task.
SHARD, PIECE, TASK_ROWS = 100_000, 20_000, 5_000


class SuffixAutomaton:
    """The suffix automaton of passages; each state has the least owner of a passage that holds its words."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [2**63 - 1]
        self.top: list[int] = []

    def add(self, words: list, owner: int) -> None:
        """Add a passage.  Matches never run from one passage into the next."""
        last = 0
        for w in words:
            last = self._add(last, w)
            self.least[last] = min(self.least[last], owner)

    def _add(self, last: int, w) -> int:
        """The state of the passage so far and ``w``, from that of the passage so far."""
        step, link, size = self.step, self.link, self.size
        known = step[last].get(w)
        if known is not None and size[known] == size[last] + 1:
            return known
        if known is not None:
            return self._split(last, w, known)
        new = self._state({}, size[last] + 1)
        p = last
        while p != -1 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = step[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, step: dict, size: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(0)
        self.least.append(2**63 - 1)
        return len(self.size) - 1

    def _split(self, p: int, w, q: int) -> int:
        """Part the shorter words of state ``q`` off, those that ``p`` and ``w`` make."""
        twin = self._state(dict(self.step[q]), self.size[p] + 1)
        self.link[twin] = self.link[q]
        while p != -1 and self.step[p].get(w) == q:
            self.step[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def close(self, span: int) -> None:
        """Hand owners down to shorter words, and find for each state the one that holds its last ``span`` words."""
        order = np.argsort(np.array(self.size), kind="stable").tolist()
        for s in reversed(order[1:]):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]
        self.top = [0] * len(order)
        for s in order[1:]:
            self.top[s] = s if self.size[self.link[s]] < span else self.top[self.link[s]]

    def statistics(self, words: list) -> Iterator[tuple[int, int]]:
        """For each word, the length of the longest match that ends at it and its state."""
        step, link, size = self.step, self.link, self.size
        state, n = 0, 0
        for w in words:
            after = step[state].get(w)
            while after is None and state:
                state = link[state]
                n = size[state]
                after = step[state].get(w)
            if after is not None:
                state, n = after, n + 1
            yield n, state

    def spans(self, words: list, before: int, span: int = SPAN) -> list[tuple[int, int]]:
        """The maximal runs of words in matches of ``span`` words that an owner under ``before`` has: (first, past)."""
        out: list[tuple[int, int]] = []
        first, past = 0, -1
        least, top = self.least, self.top
        for i, (n, state) in enumerate(self.statistics(words), 1):
            if n >= span and least[top[state]] < before:
                if i - span > past:
                    if past > 0:
                        out.append((first, past))
                    first = i - span
                past = i
        if past > 0:
            out.append((first, past))
        return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space


def _minimizers(h: np.ndarray, span: int = SPAN, run: int = RUN) -> np.ndarray:
    """The minimizer of each window of ``span`` words."""
    g = windows(h, run)
    wide, size = span - run + 1, 1
    low = g
    while 2 * size <= wide:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    n = len(g) - wide + 1
    return np.minimum(low[:n], low[wide - size : wide - size + n])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(minimizer, doc_id), each once a document."""
    hasher = Hasher()
    for b in batches:
        h, at = hasher.words(b.column("text").to_pylist(), lower=False)
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        found = [np.unique(_minimizers(h[at[i] : at[i + 1]])) if at[i + 1] - at[i] >= SPAN else h[:0] for i in range(b.num_rows)]
        sizes = [len(x) for x in found]
        yield pa.RecordBatch.from_arrays([_long(np.concatenate([h[:0], *found])), pa.array(np.repeat(ids, np.array(sizes, dtype=np.int64)).astype(np.int64))], ["minimizer", "doc_id"])


def _hashed_windows(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(window, doc_id, start) of the windows whose minimizer is in ``shared`` (minimizer)."""

    def emit(b: pa.RecordBatch, hasher: Hasher, wanted) -> pa.RecordBatch:
        h, at = hasher.words(b.column("text").to_pylist(), lower=False)
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        for i in range(b.num_rows):
            own = h[at[i] : at[i + 1]]
            if len(own) >= SPAN and len(want := wanted(i)):
                m = _minimizers(own).view(np.int64)
                j = np.searchsorted(want, m)
                j[j == len(want)] = 0
                hit = np.flatnonzero(want[j] == m)
                if len(hit):
                    out.append((windows(own, SPAN)[hit], np.full(len(hit), ids[i], dtype=np.int64), hit))
        cols = list(zip(*out, strict=True)) or [(h[:0],), (np.zeros(0, np.int64),), (np.zeros(0, np.int64),)]
        return pa.RecordBatch.from_arrays([_long(np.concatenate(cols[0])), pa.array(np.concatenate(cols[1])), pa.array(np.concatenate(cols[2]).astype(np.int32))], ["window", "doc_id", "start"])

    kind = "window long, doc_id long, start int"
    if common.at_most(shared, BROADCAST_MINIMIZERS):
        values = np.sort(shared.toArrow().column("minimizer").to_numpy())
        shipped = common.ship(docs.sparkSession, values)

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, wanted = Hasher(), shipped()
            for b in batches:
                yield emit(b, hasher, lambda i: wanted)

        return docs.mapInArrow(by_broadcast, kind)

    named = docs.mapInArrow(_named, "minimizer long, doc_id long").join(shared, "minimizer").groupBy("doc_id").agg(F.array_sort(F.collect_set("minimizer")).alias("minimizers"))

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            lists = b.column("minimizers")
            yield emit(b, hasher, lambda i, lists=lists: np.array(lists[i].as_py(), dtype=np.int64))

    return docs.join(named, "doc_id").select("doc_id", "text", "minimizers").mapInArrow(by_join, kind)


def _stretches(starts, *others) -> Iterator[tuple]:
    """Runs of consecutive starts (and equally consecutive ``others``): (first start, windows, firsts of the others)."""
    rows = sorted(set(zip(starts, *others, strict=True)))
    i = 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and all(rows[j][c] == rows[i][c] + (j - i) for c in range(len(rows[i]))):
            j += 1
        yield (rows[i][0], j - i, *rows[i][1:])
        i = j


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Diagonal stretches of a document's windows: (doc_id, start, n, owner, owner_start)."""
    for b in batches:
        out: list[tuple] = []
        for doc, found in zip(b.column("doc_id").to_pylist(), b.column("found").to_pylist(), strict=True):
            by: dict[int, list] = {}
            for f in found:
                by.setdefault(f["owner"], []).append((f["start"], f["owner_start"]))
            out += [(doc, start, n, owner, first) for owner, pairs in by.items() for start, n, first in _stretches(*zip(*pairs, strict=True))]
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n", "owner", "owner_start"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reference passages of owners, cut to PIECE words: (owner, first, past, size, passage) with its windows' first and past-last start."""
    for b in batches:
        out: list[tuple] = []
        for owner, text, starts, whole in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "starts", "whole")), strict=True):
            w = _words(text)
            for a, n in [(0, len(w) - SPAN + 1)] if whole else _stretches(starts):
                for first in range(a, min(a + n, len(w) - SPAN + 1), PIECE - SPAN + 1):
                    past = min(first + PIECE - SPAN + 1, a + n, len(w) - SPAN + 1)
                    out.append((owner, first, past, past - first + SPAN - 1, b" ".join(w[first : past + SPAN - 1])))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["owner", "first", "past", "size", "passage"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, sorted: each shard's passages (owner, words), then its documents (doc_id, text).  Gives (doc_id, text_key, spans)."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    at, auto, numbers, closed = None, SuffixAutomaton(), {}, False
    for b in batches:
        out: list[tuple] = []
        for shard, deal, is_doc, doc, key, words in zip(*(b.column(c).to_pylist() for c in ("shard", "deal", "is_doc", "id", "text_key", "words")), strict=True):
            if (shard, deal) != at:
                at, auto, numbers, closed = (shard, deal), SuffixAutomaton(), {}, False
            if not is_doc:
                auto.add([numbers.setdefault(w, len(numbers)) for w in words.split()], doc)
                continue
            if not closed:
                auto.close(SPAN)
                closed = True
            # words no passage has are None, which no state knows
            spans = auto.spans(list(map(numbers.get, words.split())), doc)
            if spans:
                out.append((doc, key, [{"first": x, "past": y} for x, y in spans]))
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["doc_id", "text_key", "spans"])


def _finish(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                kept = w = _words(text)
                if spans:
                    gone = np.zeros(len(w), dtype=bool)
                    for x in spans:
                        gone[x["first"] : x["past"]] = True
                    kept = [x for x, g in zip(w, gone, strict=True) if not g]
                joined = b" ".join(kept)
                out.append((len(w), len(w) - len(kept), hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass")))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _routes(real: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The passages wanted of each owner (doc_id, starts, whole), and which documents repeat them (doc_id, start, n, owner, owner_start)."""
    keyed = real.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    classes = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).where("own < last").drop("last")
    classes = common.materialize(classes, "copies")
    # a doc_id with several rows takes part itself: its rows may hold different words
    single = keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("k1").alias("k1"), F.min("k2").alias("k2")).where("rows = 1").drop("rows")
    copies = common.join_classes(single, classes, ["k1", "k2"], "size").where("doc_id > own").select("doc_id", "own")
    copies = common.materialize(copies, "copy-ids")
    fresh = real.join(common.maybe_broadcast(copies.select(F.col("doc_id").alias("_copy"))), F.col("doc_id") == F.col("_copy"), "left_anti")

    named = fresh.mapInArrow(_named, "minimizer long, doc_id long")
    shared = common.materialize(named.groupBy("minimizer").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("minimizer"), "minimizers")
    hashed = common.materialize(_hashed_windows(fresh, shared), "windows")
    owners = hashed.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("own"), F.max("doc_id").alias("last")).where("own.doc_id < last").select("window", "own")
    owners = common.materialize(owners, "owners")
    repeats = hashed.join(owners, "window").where("doc_id > own.doc_id").select("doc_id", F.struct("start", F.col("own.doc_id").alias("owner"), F.col("own.start").alias("owner_start")).alias("f"))
    # of one document: no more than its words
    claims = repeats.groupBy("doc_id").agg(F.collect_list("f").alias("found")).mapInArrow(_claims, "doc_id long, start long, n long, owner long, owner_start long").select("doc_id", "owner", "owner_start", "n")
    claims = claims.unionAll(copies.select("doc_id", F.col("own").alias("owner"), F.lit(0).cast("long").alias("owner_start"), F.lit(2**62).alias("n")))
    starts = owners.select(F.col("own.doc_id").alias("doc_id"), F.col("own.start").alias("start")).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.lit(False).alias("whole"))
    whole = classes.select(F.col("own").alias("doc_id"), F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    wanted = starts.unionAll(whole).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.max("whole").alias("whole"))
    return common.materialize(wanted, "wanted"), common.materialize(claims, "claims")


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans) of the documents with words that an earlier document covers; text_key is xxhash64 of the text."""
    real = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    wanted, claims = _routes(real)
    pieces = real.join(common.maybe_broadcast(wanted), "doc_id").mapInArrow(_pieces, "owner long, first long, past long, size long, passage binary")
    pieces = common.materialize(pieces, "pieces")
    n = max(1, -(-(pieces.agg(F.sum("size")).first()[0] or 0) // SHARD))
    # the pieces of an owner stay together, up to a shard's length
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("owner", F.floor(F.col("first") / SHARD)), F.lit(n)))
    places = pieces.select("owner", "first", "past", "shard")
    met = (F.col("owner_start") < F.col("past")) & (F.col("owner_start") + F.col("n") > F.col("first"))
    routes = claims.join(common.maybe_broadcast(places), "owner").where(met).select("doc_id", "shard").distinct()
    routes = common.materialize(routes, "routes")
    # a shard goes to one task for each TASK_ROWS of its documents, and documents are dealt over these
    deals = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("deals"))
    deals = common.maybe_broadcast(common.materialize(deals, "deals"))
    dealt = routes.join(deals, "shard").select("doc_id", "shard", F.pmod(F.xxhash64("doc_id"), "deals").cast("int").alias("deal"))
    readers = real.join(common.maybe_broadcast(dealt), "doc_id").select("shard", "deal", F.lit(True).alias("is_doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("words"))
    reference = pieces.join(deals, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(False).alias("is_doc"), F.col("owner").alias("id"), F.lit(0).cast("long").alias("text_key"), F.col("passage").alias("words"))
    both = reference.unionAll(readers).repartition("shard", "deal").sortWithinPartitions("shard", "deal", "is_doc")
    found = both.mapInArrow(_stream, "doc_id long, text_key long, spans array<struct<first: long, past: long>>")
    return common.materialize(found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept is the text left, or its SHA-256 if ``digest``."""
    docs = common.integer_ids(docs).select("doc_id", "text")
    gone = covered(docs).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "spans")
    rows = docs.join(common.maybe_broadcast(gone), (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_key")), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_finish(digest), "doc_id long, n_words long, n_removed long, kept string")
