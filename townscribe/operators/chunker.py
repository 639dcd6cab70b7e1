"""Paragraph chunks of documents with an overlap and page spans.

A document's pages come as one array, so nothing but a document's own pages is ever gathered, and
documents that are one row already are cut where they are.  Chunks are ranges of paragraphs: running
lengths are summed once, and each cut is looked up in them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import narrow, sliced

MAX_CHARS, OVERLAP = 1800, 200


def ranges(texts: list[str], max_chars: int, overlap: int) -> Iterator[tuple[int, int, bool, str]]:
    """(first paragraph, past the last, whether it begins with an overlap, text) of each chunk.

    A chunk takes paragraphs, a character between them, while they fit beside the overlap, but
    always at least one.
    """
    ends = [0, *accumulate(len(t) + 1 for t in texts)]
    at, carry = 0, ""
    while at < len(texts):
        past = bisect_right(ends, ends[at] + max_chars - len(carry), lo=at) - 1
        past = max(past, at + 1)
        text = "\n".join([carry, *texts[at:past]] if carry else texts[at:past]).strip()
        yield at, past, carry != "", text
        at, carry = past, text[-overlap:] if 0 < overlap < len(text) else ""


def spans(cuts: list[tuple[int, int, bool, str]], pages: list[int]) -> Iterator[tuple[int | None, int | None]]:
    """First and last page of each chunk, from its paragraphs' pages; an overlap is of the page the chunk before ended on."""
    last = None
    for at, past, overlaps, _ in cuts:
        first = last if overlaps else pages[at]
        last = pages[past - 1] if past > at else first
        yield first, last


def spans_of_begun_pages(cuts: list[tuple[int, int, bool, str]], pages: list[int]) -> Iterator[tuple[int | None, int | None]]:
    """Spans that know a page only where it begins: at the paragraph that opens it, which counts for the chunk before if it opens a new one."""
    begins = [i for i, n in enumerate(pages) if i == 0 or n != pages[i - 1]]
    last = None
    for at, past, overlaps, _ in cuts:
        inside = begins[bisect_left(begins, at + (at > 0)) : bisect_right(begins, past)]
        first = last if overlaps else None
        if first is None and inside:
            first = pages[inside[0]]
        last = pages[inside[-1]] if inside else None
        yield first, last


def chunks_of(pages: list[tuple[int, str | None]], max_chars: int = MAX_CHARS, overlap: int = OVERLAP, compat: bool = False) -> list[tuple[int, str, int | None, int | None]]:
    """(index, text, first page, last page) of the chunks of (number, text) pages.

    Paragraphs are lines without the white space around them; empty ones do not count.  A chunk
    begins with the last ``overlap`` characters of the one before.  Spans are true; with ``compat``
    they know only pages that begin in the chunk.
    """
    lines = [(number, line.strip()) for number, text in pages for line in (text or "").strip().split("\n") if line.strip()]
    numbers = [n for n, _ in lines]
    cuts = list(ranges([t for _, t in lines], max_chars, overlap))
    found = (spans_of_begun_pages if compat else spans)(cuts, numbers)
    kept = [(text, span) for (*_, text), span in zip(cuts, found, strict=True) if text]
    return [(i, text, *span) for i, (text, span) in enumerate(kept)]


def chunk_documents(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, compat: bool = False) -> DataFrame:
    """Chunks (document_id, chunk_index, text, start_page, end_page) of ``docs`` (document_id, pages array<struct<number, text>> in order); no shuffle."""
    names = ["document_id", "chunk_index", "text", "start_page", "end_page"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(doc, *c) for doc, pages in zip(b.column("document_id").to_pylist(), b.column("pages").to_pylist(), strict=True) for c in chunks_of([(p["number"], p["text"]) for p in pages or ()], max_chars, overlap, compat)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("document_id").type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names)

    narrow(docs.sparkSession)
    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "pages").mapInArrow(cut, f"document_id {kind}, chunk_index long, text string, start_page long, end_page long")


def chunk(pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, compat: bool = False) -> DataFrame:
    """The same of ``pages`` (document_id, number, text), a row a page."""
    page = F.struct("number", "text")
    docs = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return chunk_documents(docs, max_chars, overlap, compat)
