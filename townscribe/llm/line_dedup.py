"""Boilerplate lines by their site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; a line in
more than ``ratio`` of them is boilerplate there and is dropped wherever it stands on that
host, if it repeats at all: a line of one page (``min_pages``) is no boilerplate, or the only page
of a host would lose all its text.  Lines are compared without the spaces around them; a line
counts once a page; blank lines are neither counted nor dropped.

Counting pre-aggregates before its shuffle, so a host with a third of all pages is spread
over the map side.  The boilerplate of one host is bounded (lines a page / ratio); the
table of all hosts is broadcast only if its rows and bytes are few, else joined by host.

Null texts stay null and have no lines.  Null hosts form one host.  Repeated rows are pages
of their own.  Texts may be long and are never cut.  ``apply`` sets n_lines, n_dropped and kept_text
(replacing columns of these names); ``clean`` only text and n_chars.  All other columns pass
through unchanged, whatever they are called (but ``_townscribe_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATIO = 0.10
MIN_PAGES = 2


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.crc32(line.cast("binary")).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop): for each host that has any, the keys of its boilerplate lines."""
    pages = docs.select(F.col(host).alias("_townscribe_host"), F.split(F.coalesce("text", F.lit("")), "\n").alias("_townscribe_lines"))
    total = pages.groupBy("_townscribe_host").agg(F.count(F.lit(1)).alias("_townscribe_pages")).select(F.col("_townscribe_host").alias("_townscribe_of"), "_townscribe_pages")
    distinct = F.array_distinct(F.filter(F.transform("_townscribe_lines", lambda x: F.trim(x)), lambda x: x != ""))
    count = pages.select("_townscribe_host", F.explode(distinct).alias("_townscribe_line")).select("_townscribe_host", _key(F.col("_townscribe_line")).alias("_townscribe_key")).groupBy("_townscribe_host", "_townscribe_key").agg(F.count(F.lit(1)).alias("_townscribe_n")).where(F.col("_townscribe_n") >= min_pages)
    return count.join(total, F.col("_townscribe_host").eqNullSafe(F.col("_townscribe_of"))).where(F.col("_townscribe_n") > ratio * F.col("_townscribe_pages")).groupBy("_townscribe_host").agg(F.collect_list("_townscribe_key").alias("_townscribe_drop"))


def _lines(docs: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """``docs`` with _townscribe_lines and _townscribe_kept, the lines before and after."""
    drop = common.maybe_broadcast(common.materialize(boilerplate(docs, host, ratio, min_pages), "boilerplate"))
    kept = F.when(F.col("_townscribe_drop").isNull(), F.col("_townscribe_lines")).otherwise(F.filter("_townscribe_lines", lambda x: ~F.array_contains(F.col("_townscribe_drop"), _key(F.trim(x)))))
    return docs.withColumn("_townscribe_lines", F.split("text", "\n")).join(drop, F.col(host).eqNullSafe(F.col("_townscribe_host")), "left").withColumn("_townscribe_kept", kept)


def apply(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text."""
    size = lambda c: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(c))
    n, left = size("_townscribe_lines"), size("_townscribe_kept")
    return (
        _lines(docs, host, ratio, min_pages)
        .withColumns({"n_lines": n, "n_dropped": n - left, "kept_text": F.array_join("_townscribe_kept", "\n")})
        .drop("_townscribe_lines", "_townscribe_kept", "_townscribe_drop", "_townscribe_host")
    )


def clean(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the lines left as text; n_chars, if there is such a column, follows where lines went."""
    kept = _lines(docs, host, ratio, min_pages)
    text = F.array_join("_townscribe_kept", "\n")
    changed = F.size("_townscribe_kept") < F.size("_townscribe_lines")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(new).select(*docs.columns)


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
total as (select source, count(*) as n from d group by source),
line as (select distinct rid, source, unnest(list_transform(ls, lambda x: trim(x))) as line from d),
drops as (
  select c.source, list(line) as drops
  from (select source, line, count(*) as n from line where line <> '' group by source, line having count(*) >= {MIN_PAGES}) c
  join total on c.source is not distinct from total.source
  where c.n > {RATIO} * total.n group by c.source),
kept as (
  select doc_id, text, ls, case when drops is null then ls else list_filter(ls, lambda x: not list_contains(drops, trim(x))) end as k
  from d left join drops on d.source is not distinct from drops.source)
select doc_id, cast(case when text is null then 0 else len(ls) end as bigint) as n_lines,
  cast(case when text is null then 0 else len(ls) - len(k) end as bigint) as n_dropped,
  sha256(array_to_string(k, chr(10))) as kept_sha256
from kept
"""
