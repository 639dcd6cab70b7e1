"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens (each document ends with id 0).  The
stream is a row of mixture windows; in each window the queues are served in turn, and
queue s gets its share T_s / T of the tokens.  A queue's quantum is rarely whole: what a
window owes it is its deficit, carried into the next one.  With W windows the tokens
served to s before window w are floor(T_s * w / W), so the deficit is always under one token,
and where any token goes follows from its place in its queue alone.  Deficits thus carry
across partitions without moving tokens: a partition needs only how many tokens of each
queue stand before it.  Sequences of ``length`` tokens are cut from that stream; what is
left at the end is cut into powers of two, so nothing is padded.

The target proportions are the sources' shares of all tokens, or those passed as ``weights``: then
each window takes so much of each queue that still has tokens, until all are empty.

Two passes: tokenise once and write ids with their place in the partition's queues, then
cut.  Null texts are empty: they give the one closing id.  A null source is a queue of its
own, as is everything if there is no source column.  Every source has its own queue at any
number of sources: up to ``MAX_QUEUES`` the driver holds their totals, above that a table
does, and the tokens' places, the same ones, come by joins with it.  Repeated rows are packed
as documents of their own.  Texts of any length are encoded whole.  An empty table has no pieces.
Extra columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 1024
#: Tokens of a mixture window, about.
WINDOW = 32 * LENGTH
#: Queues whose totals the driver holds; more are held in a table.
MAX_QUEUES = 4096
#: Windows of a block, in whose order the table's windows are summed up; rows of an Arrow batch of runs.
BLOCK, RUN_ROWS = 1024, 8192
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts as the tokenizer gives them.

    The same vocabulary, read as ranks, encodes several times as fast as the tokenizer and
    gives the same ids (the tests compare them).  Texts in which a special token is written
    out, which only the tokenizer knows, and texts the rank encoder gives up on go to the
    tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.tok = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tok.get_vocab_size() <= 65_536 else "<u4"

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of a text, without special tokens of its own."""
        text = text or ""
        if not any(s in text for s in self.special):
            try:
                return np.asarray(self.ranks.encode_ordinary(text), dtype=self.kind).tobytes()
            except BaseException as e:  # noqa: BLE001  a panic of the native code is no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, source: str = "source") -> DataFrame:
    """(doc_id, queue, part, place, n, ids): each row's ids and where they stand in its partition's queue; written once."""
    queue = F.concat(F.lit("s"), F.col(source)) if source in docs.columns else F.lit("s")
    queue = F.coalesce(queue, F.lit("n"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = common.worker_state("encoders")
        enc = state.get(tokenizer) or state.setdefault(tokenizer, Encoder(tokenizer, ranks))
        part, place = TaskContext.get().partitionId(), {}
        close = np.zeros(1, dtype=enc.kind).tobytes()
        for b in batches:
            ids = [enc.encode(t) + close for t in b.column("text").to_pylist()]
            n, at = [len(x) // len(close) for x in ids], []
            for q, k in zip(b.column("queue").to_pylist(), n, strict=True):
                at.append(place.get(q, 0))
                place[q] = at[-1] + k
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "queue": b.column("queue"), "part": pa.array([part] * len(n), pa.int64()), "place": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})

    return common.materialize(docs.select("doc_id", "text", queue.alias("queue")).mapInArrow(run, f"doc_id {kind}, queue string, part long, place long, n long, ids binary"), "tokens")


class Schedule:
    """Where the tokens of the queues go; ``totals`` are the queues' tokens in serving order."""

    def __init__(self, totals: list[int], length: int = LENGTH, window: int = WINDOW) -> None:
        self.totals, self.length = totals, length
        self.all = sum(totals)
        self.windows = max(1, -(-self.all // window))
        self.whole, self.part = (np.array([f(t, self.windows) for t in totals], dtype=np.int64) for f in (lambda t, w: t // w, lambda t, w: t % w))

    def served(self, w: int) -> np.ndarray:
        """Tokens of each queue served before window ``w``."""
        return self.whole * w + self.part * w // self.windows

    def window_of(self, queue: int, place: int) -> int:
        """The window that serves a token of a queue."""
        return -(-(place + 1) * self.windows // self.totals[queue]) - 1

    def runs(self, queue: int, place: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(stream position, tokens of the document before, length) of the runs of a document's tokens."""
        done = 0
        w = self.window_of(queue, place)
        now = self.served(w)
        while done < n:
            then = self.served(w + 1)
            take = min(place + n, int(then[queue])) - (place + done)
            if take > 0:
                yield int(now.sum()) + int((then - now)[:queue].sum()) + place + done - int(now[queue]), done, take
                done += take
            w, now = w + 1, then

    def sequence(self, at: int) -> tuple[int, int, int]:
        """Sequence id, offset in it, and its length, of a stream position."""
        full = self.all // self.length
        if at < full * self.length:
            return at // self.length, at % self.length, self.length
        left, first, seq = self.all % self.length, full * self.length, full
        for bit in reversed(range(self.length.bit_length())):
            size = 1 << bit
            if left & size:
                if at < first + size:
                    return seq, at - first, size
                first, seq = first + size, seq + 1
        raise ValueError("position outside the stream")

    def pieces(self, queue: int, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence id, offset) of the pieces of a document."""
        for run in self.runs(queue, place, n):
            yield from self.cut(*run)

    def cut(self, at: int, start: int, left: int) -> Iterator[tuple[int, int, int, int]]:
        """The pieces of a run of ``left`` tokens at a stream position."""
        while left:
            seq, offset, size = self.sequence(at)
            take = min(left, size - offset)
            yield start, take, seq, offset
            at, start, left = at + take, start + take, left - take


class Weighted(Schedule):
    """A schedule with given whole weights: at virtual time v a queue has given min(total, weight * v / SCALE) tokens,
    and a window ends at the first v at which all have given so many windows of tokens together."""

    SCALE = 1 << 20

    def __init__(self, totals: list[int], weights: list[int], length: int = LENGTH, window: int = WINDOW) -> None:
        super().__init__(totals, length, window)
        if min(weights, default=1) < 1 or max(weights, default=1) > self.SCALE:
            raise ValueError(f"weights must be whole numbers from 1 to {self.SCALE}")
        self.weights, self.window = weights, window
        self.last = max((-(-t * self.SCALE // w) for t, w in zip(totals, weights, strict=True)), default=0)

    def given(self, v: int) -> list[int]:
        return [min(t, w * v // self.SCALE) for t, w in zip(self.totals, self.weights, strict=True)]

    def served(self, w: int) -> np.ndarray:
        lo, hi = 0, self.last
        while lo < hi and w < self.windows:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if sum(self.given(mid)) >= w * self.window else (mid + 1, hi)
        return np.array(self.given(hi), dtype=np.int64)

    def window_of(self, queue: int, place: int) -> int:
        return sum(self.given(-(-(place + 1) * self.SCALE // self.weights[queue]) - 1)) // self.window


def cells(totals: DataFrame, windows: int) -> DataFrame:
    """(w, queue, first): the stream position at which each window serves each queue (queue, total) it serves at all."""
    t, i = F.col("total"), F.col("i")
    served = lambda w: f"((total div {windows}L) * ({w}) + ((total % {windows}L) * ({w})) div {windows}L)"
    each = totals.select("queue", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.least(t, F.lit(windows).cast("long")) - 1)).alias("i"))
    each = each.select("queue", "total", F.when(t >= windows, i).otherwise(F.expr(f"((i + 1) * {windows}L + total - 1) div total - 1")).alias("w"))
    each = each.select("queue", "w", F.expr(f"{served('w + 1')} - {served('w')}").alias("c"))
    per = each.groupBy("w").agg(F.sum("c").alias("c")).withColumn("block", F.expr(f"w div {BLOCK}"))
    blocks = per.groupBy("block").agg(F.sum("c").alias("b"))
    blocks = blocks.select("block", (F.sum("b").over(Window.orderBy("block")) - F.col("b")).alias("b"))
    base = per.join(blocks, "block").select("w", (F.col("b") + F.sum("c").over(Window.partitionBy("block").orderBy("w")) - F.col("c")).alias("base"))
    return each.join(base, "w").select("w", "queue", (F.col("base") + F.sum("c").over(Window.partitionBy("w").orderBy("queue")) - F.col("c")).alias("first"))


def placed_by_table(placed: DataFrame, totals: DataFrame, length: int, window: int) -> DataFrame:
    """Pieces of ``placed`` (doc_id, queue, place, n, ids) whatever the number of queues (queue, total): each run
    of a document's tokens in a window takes its ids along to the window's first position for its queue."""
    plan = Schedule([totals.agg(F.sum("total")).first()[0]], length, window)
    windows, doc = plan.windows, placed.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rows = b.schema.field("doc_id").type, []
            for doc, queue, place, n, ids, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "queue", "place", "n", "ids", "total")), strict=True):
                wide, done, w = len(ids) // n, 0, -(-(place + 1) * windows // t) - 1
                while done < n:
                    take = min(place + n, t * (w + 1) // windows) - (place + done)
                    if take > 0:
                        rows.append((doc, queue, w, done, take, place + done - t * w // windows, n, ids[done * wide : (done + take) * wide]))
                        done += take
                    # the window of the next token
                    w = -(-(place + done + 1) * windows // t) - 1
                    if len(rows) >= RUN_ROWS:
                        yield runs(rows, kind)
                        rows = []
            if rows:
                yield runs(rows, kind)

    def runs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], kind), pa.array(c[1], pa.string()), *(pa.array(x, pa.int64()) for x in c[2:7]), pa.array(c[7], pa.binary())], ["doc_id", "queue", "w", "start", "take", "skip", "n", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, start, take, at, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "take", "at", "n", "ids")), strict=True):
                wide = np.frombuffer(ids, dtype=f"<u{len(ids) // take}").astype("<u4")
                rows += [(doc, a, k, zlib.crc32(wide[a - start : a - start + k].tobytes()), n, s, o) for a, k, s, o in plan.cut(at, start, take)]
            yield piece_batch(rows, b.schema.field("doc_id").type)

    dealt = placed.join(common.maybe_broadcast(totals), "queue").mapInArrow(split, f"doc_id {doc}, queue string, w long, start long, take long, skip long, n long, ids binary")
    at = dealt.join(cells(totals, windows), ["w", "queue"]).select("doc_id", "start", "take", (F.col("first") + F.col("skip")).alias("at"), "n", "ids")
    return at.mapInArrow(cut, PIECES.format(doc))


#: Columns of a piece.
PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def piece_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, source: str = "source", length: int = LENGTH, window: int = WINDOW, weights: dict[str | None, int] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs`` (doc_id, text, source).

    ``weights`` gives every source its part of a window, in whole numbers; without it parts follow the sources' tokens.
    """
    tokens = tokenised(docs, tokenizer, ranks, source)
    parts = common.materialize(tokens.groupBy("part", "queue").agg(F.sum("n").alias("tokens")), "queue-parts")
    totals = parts.groupBy("queue").agg(F.sum("tokens").alias("total"))
    before = parts.select("part", "queue", (F.sum("tokens").over(Window.partitionBy("queue").orderBy("part")) - F.col("tokens")).alias("before"))
    placed = tokens.join(common.maybe_broadcast(before), ["part", "queue"]).select("doc_id", "queue", (F.col("place") + F.col("before")).alias("place"), "n", "ids")
    if not common.at_most(totals, MAX_QUEUES):
        if weights is not None:
            raise ValueError(f"weights are for at most {MAX_QUEUES} sources")
        return placed_by_table(placed, common.materialize(totals, "queue-totals"), length, window)
    queues = [(r["queue"], r["total"]) for r in totals.orderBy("queue").collect()]
    number = {q: i for i, (q, _) in enumerate(queues)}
    if weights is None:
        plan = Schedule([t for _, t in queues], length, window)
    else:
        part = {"n" if k is None else f"s{k}": w for k, w in weights.items()}
        if lacking := sorted(set(number) - set(part)):
            raise ValueError(f"no weight for {[q[1:] or None for q in lacking]}")
        plan = Weighted([t for _, t in queues], [part[q] for q, _ in queues], length, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, queue, place, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "queue", "place", "n", "ids")), strict=True):
                wide = np.frombuffer(ids, dtype=f"<u{len(ids) // n}").astype("<u4")
                rows += [(doc, a, k, zlib.crc32(wide[a : a + k].tobytes()), n, s, o) for a, k, s, o in plan.pieces(number[queue], place, n)]
            yield piece_batch(rows, b.schema.field("doc_id").type)

    return placed.mapInArrow(cut, PIECES.format(docs.schema["doc_id"].dataType.simpleString()))
