"""Cross-tokenizer alignment by segment deduplication.

Every text is encoded by two tokenizers, A (byte-level BPE, applied to a space and the text) and B (piece BPE, which adds
that space itself), and their tokens are cut into groups wherever a token of A and a token of B end at the same byte.

A text is split before its runs of white space, at characters across which neither vocabulary can merge: that is read
from the vocabularies themselves (``cut_characters``; no entry has such a character after one that is no white
space, A's pre-tokenizer always breaks there, and a piece of B that starts with one of them can follow any
text). So segments are tokenised independently of each other, and both tokenizers end a token where a segment ends.

1. Tasks gather documents into blocks of about ``BLOCK_CHARS`` and write them as places in the block's own list of distinct segments.
2. The lists are dealt by segment, so that equal segments of all blocks are neighbours: each distinct segment is
   tokenised and aligned once, and its alignment goes back to every block that has it.
3. Block by block, documents meet their alignments and are composed. A block counts in how many of its documents each id
   pair is linked; the counts of all blocks are summed, and each A id's highest is found.
4. Block by block again, documents meet the counts of their pairs.

A segment crosses the shuffle once a block, not once an occurrence, and a key has at most a row a block, whatever its
frequency. Documents cross it twice, as numbers of their segments and pairs. A block is bounded (but for a
longer single text), so is what a task holds.

Defined results:

* a null or empty text, or one whose joined A or B bytes differ from space and text (such as one with U+2581), has no
  tokens: zeros, and an empty digest. It is in no count.
* every row is a document, also rows of one doc_id (null is an id too); whole texts count, however long.
* strings of special tokens inside a text are plain text.
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Characters of a block, which a task holds in memory as numbers and distinct segments.
BLOCK_CHARS = 24 << 20
#: Distinct segments of a batch that is tokenised at once.
SEGMENT_ROWS = 8192

#: White space by any definition in use: Python's, and U+180E, which was one once.
_SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()] + ["\u180e"]
_MARK = "\u2581"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 in order."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def a_entries(path: str) -> dict[int, bytes]:
    """Bytes of A's entries by id."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    special = {t["content"] for t in known["added_tokens"]}
    pre = known["pre_tokenizer"]
    if pre["type"] != "ByteLevel" or not pre["use_regex"] or known["normalizer"] is not None:
        raise ValueError("A must be a byte-level tokenizer with its own pattern and without a normalizer")
    alphabet = byte_alphabet()
    return {i: bytes(alphabet[c] for c in t) for t, i in known["model"]["vocab"].items() if t not in special}


def b_entries(path: str) -> dict[int, bytes]:
    """Bytes of B's pieces by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(_MARK, " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))}


def cut_characters(a_path: str = A_FILE, b_path: str = B_FILE) -> str:
    """The white space before which a text can be split, proven from both vocabularies; a space must be among it."""
    a = [t.decode("utf-8", "replace") for t in a_entries(a_path).values()]
    b = [t.decode("utf-8", "replace") for t in b_entries(b_path).values()]
    spaces = set(_SPACES)
    out = ""
    for c in " \t\n\r":
        crossed = any(c in t and any(y == c and x not in spaces for x, y in zip(t, t[1:], strict=False)) for t in (*a, *b))
        after_mark = c != " " and any(c in t and t.startswith(" ") for t in b)  # the space that B adds must stand alone
        if not crossed and not after_mark:
            out += c
    if " " not in out:
        raise ValueError("these vocabularies have entries that reach across spaces")
    return out


def segment_pattern(cuts: str) -> str:
    """A pattern whose matches, one after the other, are the segments of a string that starts with a cut character."""
    one = lambda chars: "[" + "".join(f"\\U{ord(c):08x}" for c in chars) + "]"
    none = "[^" + one(_SPACES)[1:]
    others = one([c for c in _SPACES if c not in cuts])
    return f"{one(cuts)}{one(_SPACES)}*{none}*(?:{others}{one(_SPACES)}*{none}*)*"


class Aligner:
    """Both tokenizers in a worker; aligns single segments."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = a_entries(a_path), b_entries(b_path)
        self.mark = self.b.piece_to_id(_MARK)

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments that start with a cut character; B adds a space of its own, which is the segment's or is taken off."""
        given = [s[1:] if s[0] == " " else s for s in segments]
        out = self.b.encode(given, num_threads=1)
        for i, (s, g) in enumerate(zip(segments, given, strict=True)):
            if not g:
                out[i] = [self.mark]  # a space alone
            elif s[0] != " ":
                # cut_characters has shown that nothing merges with the added space
                out[i] = out[i][1:] if out[i][:1] == [self.mark] else []
        return out

    def align(self, segments: list[str]) -> list[str | None]:
        """The groups of each segment as text; null where the joined bytes of A or B are others than the segment's."""
        out: list[str | None] = []
        for s, a, b in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), self.b_ids(segments), strict=True):
            raw, a_ids = s.encode("utf-8", "surrogatepass"), a.ids
            a_parts, b_parts = [self.a_bytes[i] for i in a_ids], [self.b_bytes.get(i, b"") for i in b]
            if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
                out.append(None)
                continue
            groups, i, j, x, y, from_i, from_j = [], 0, 0, 0, 0, 0, 0
            while i < len(a_ids):
                x += len(a_parts[i])
                i += 1
                while y < x:
                    y += len(b_parts[j])
                    j += 1
                if x == y:
                    groups.append(f"{','.join(map(str, a_ids[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
                    from_i, from_j = i, j
            out.append(";".join(groups))
        return out


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, compressed; high bytes stand together, as most are zero."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype="u1")
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, cuts: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents (block, doc_id, places) and the blocks' distinct segments (block, place, segment), in one table written once."""
    pattern = segment_pattern(cuts)
    schema = f"block long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, places binary, place int, segment string"
    ids = pa.field("doc_id", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        split, block, known, chars = re.compile(pattern).findall, TaskContext.get().partitionId() << 32, {}, 0

        def listed() -> Iterator[pa.RecordBatch]:
            names = list(known)
            for at in range(0, len(names), SEGMENT_ROWS):
                part = names[at : at + SEGMENT_ROWS]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(range(at, at + n), pa.int32()), pa.array(part, pa.string())], names=["block", "doc_id", "places", "place", "segment"])

        kind = ids.type
        for b in batches:
            kind = b.schema.field("doc_id").type
            owners, places = [], []
            for text in b.column("text").to_pylist():
                found = split(" " + text) if text else []
                # one after the other: the list's length is the next place
                places.append(_pack(np.array([known.setdefault(s, len(known)) for s in found], dtype="<u4")))
                owners.append(block)
                chars += len(text or "")
                if chars >= block_chars:
                    yield from listed()
                    block, known, chars = block + 1, {}, 0
            n = len(owners)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), b.column("doc_id"), pa.array(places, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=["block", "doc_id", "places", "place", "segment"])
        if known:
            yield from listed()

    return common.materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "blocks")


def aligned_segments(listed: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE) -> DataFrame:
    """(block, place, groups) of (block, place, segment): each distinct segment is tokenised and aligned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = common.worker_state("aligners")
        aligner = state.get((a_path, b_path)) or state.setdefault((a_path, b_path), Aligner(a_path, b_path))
        last: tuple[str | None, str | None] = (None, None)
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("segment").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = distinct[1:] if distinct[0] == last[0] else distinct  # equal rows are neighbours, also across batches
            made = aligner.align(new)
            groups = made if len(new) == len(distinct) else [last[1], *made]
            last = distinct[-1], groups[-1]
            yield pa.RecordBatch.from_pydict({"block": b.column("block"), "place": b.column("place"), "groups": pa.array(groups, pa.string()).take(coded.indices)})

    return listed.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "block long, place int, groups string")


class Compositions:
    """The alignments of a block's segments by place, as arrays."""

    def __init__(self, groups: list[str | None]) -> None:
        self.groups = groups
        self.valid = np.array([g is not None for g in groups], dtype=bool)
        self.pairs: dict[int, int] = {}
        sums, flat_pair, flat_n, sizes = [], [], [], []
        for g in groups:
            own: Counter[int] = Counter()
            n_a = n_b = n_groups = n_links = 0
            for part in g.split(";") if g else ():
                a, _, b = part.partition("|")
                xs, ys = a.split(","), b.split(",")
                n_a += len(xs)
                n_b += len(ys)
                n_groups += 1
                n_links += len(xs) * len(ys)
                for x in xs:
                    for y in ys:
                        own[(int(x) << 32) + int(y)] += 1
            sums.append((n_a, n_b, n_groups, n_links))
            sizes.append(len(own))
            for p, n in own.items():
                flat_pair.append(self.pairs.setdefault(p, len(self.pairs)))
                flat_n.append(n)
        self.sums = np.array(sums, dtype=np.int64).reshape(-1, 4)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.pair, self.n = np.array(flat_pair, dtype=np.int64), np.array(flat_n, dtype=np.int64)

    def compose(self, places: np.ndarray) -> tuple[np.ndarray, str, np.ndarray, np.ndarray] | None:
        """Sums, groups, linked pairs and their links of a document; None if it has no tokens."""
        if not len(places) or not self.valid[places].all():
            return None
        seg, times = np.unique(places, return_counts=True)
        sizes = self.start[seg + 1] - self.start[seg]
        at = np.repeat(self.start[seg] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        pairs, where = np.unique(self.pair[at], return_inverse=True)
        links = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(links, where, self.n[at] * np.repeat(times, sizes))
        return self.sums[places].sum(axis=0), ";".join([self.groups[p] for p in places.tolist()]), pairs, links


#: Columns of a composed document.
_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def composed(table: DataFrame, alignments: DataFrame, digest: bool) -> DataFrame:
    """Documents with their sums, groups and linked pairs, and of each block its id pairs with the number of documents that link them; written once."""
    kind = table.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_id {kind}, {', '.join(f'{c} long' for c in _SUMS)}, groups string, pairs binary, links binary, pair int, a long, b long, n_docs long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        places = np.asarray(right.column("place").combine_chunks()).astype(np.int64) if right.num_rows else np.zeros(0, dtype=np.int64)
        listed: list[str | None] = [None] * len(places)
        for p, g in zip(places.tolist(), right.column("groups").to_pylist(), strict=True):
            listed[p] = g
        known = Compositions(listed)
        n_docs = np.zeros(len(known.pairs), dtype=np.int64)
        rows: list[list] = [[] for _ in range(7)]
        for raw in left.column("places").to_pylist():
            made = known.compose(_unpack(raw))
            if made is None:
                sums, groups, pairs, links = [0] * 4, "", None, None
            else:
                n_docs[made[2]] += 1
                sums, groups, pairs, links = made[0].tolist(), hashlib.sha256(made[1].encode()).hexdigest() if digest else made[1], _pack(made[2]), _pack(made[3])
            for column, v in zip(rows, (*sums, groups, pairs, links), strict=True):
                column.append(v)
        n, m = left.num_rows, len(n_docs)
        block = (left.column("owner") if n else right.column("block"))[0].as_py()
        keys = np.fromiter(known.pairs, dtype=np.int64, count=m)
        docs_part = [pa.array([block] * n, pa.int64()), left.column("doc_id").combine_chunks(), *(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], pa.string()), *(pa.array(x, pa.binary()) for x in rows[5:]), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in range(3))]
        pair_part = [pa.array([block] * m, pa.int64()), *(pa.nulls(m, x.type) for x in docs_part[1:9]), pa.array(np.arange(m), pa.int32()), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n_docs)]
        names = ["block", "doc_id", *_SUMS, "groups", "pairs", "links", "pair", "a", "b", "n_docs"]
        return pa.concat_tables([pa.table(docs_part, names=names), pa.table(pair_part, names=names)])

    docs = table.where("place is null").select(F.col("block").alias("owner"), "doc_id", "places")
    return common.materialize(docs.groupBy("owner").cogroup(alignments.groupBy("block")).applyInArrow(run, schema), "composed")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n_docs, is_best) of (a, b, n_docs) rows: each pair's documents, and whether no other pair of its A id has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
    counts = common.materialize(counts, "pair-counts")
    best = counts.groupBy("a").agg(F.max("n_docs").alias("best"))
    return counts.join(best, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("best")).alias("is_best"))


def align(docs: DataFrame, a_path: str = A_FILE, b_path: str = B_FILE, digest: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document; ``digest`` gives the groups' SHA-256 instead."""
    spark = docs.sparkSession
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = blocks(docs, cut_characters(a_path, b_path), block_chars)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SEGMENT_ROWS))  # segments are short
    try:
        listed = aligned_segments(table.where("place is not null").select("block", "place", "segment"), a_path, b_path)
        made = composed(table, listed, digest)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    common.discard(table)
    pairs = made.where("pair is not null").select("block", "pair", "a", "b", "n_docs")
    counts = pair_counts(pairs.select("a", "b", "n_docs"))
    met = pairs.select("block", "pair", "a", "b").join(counts, ["a", "b"]).select("block", "pair", "n_docs", "is_best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n_docs, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=bool)
        if right.num_rows:
            place = np.asarray(right.column("pair").combine_chunks())
            n_docs[place], best[place] = np.asarray(right.column("n_docs").combine_chunks()), np.asarray(right.column("is_best").combine_chunks())
        n_best, total = [], []
        for p, n in zip(left.column("pairs").to_pylist(), left.column("links").to_pylist(), strict=True):
            if p is None:
                n_best.append(0)
                total.append(0)
            else:
                at, links = _unpack(p), _unpack(n)
                n_best.append(int(links[best[at]].sum()))
                total.append(int((links * n_docs[at]).sum()))
        out = {c: left.column(c) for c in ("doc_id", *_SUMS)} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups": left.column("groups")}
        return pa.table(out)

    own = made.where("pair is null").select(F.col("block").alias("owner"), "doc_id", *_SUMS, "groups", "pairs", "links")
    return own.groupBy("owner").cogroup(met.groupBy("block")).applyInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in (*_SUMS, 'n_best', 'count_sum'))}, groups string")
