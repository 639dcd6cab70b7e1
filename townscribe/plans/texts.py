"""Text operators over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunker, resolve
from ..sources import files
from ..sources.tables import table
from .registry import query


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def lit(s: str) -> str:
    """A text as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


@query("excerpt", "select doc_id, case when length(text) > 280 then replace(substr(text, 1, 280), chr(10), ' ') || '...' else replace(substr(text, 1, 280), chr(10), ' ') end as excerpt from documents")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@query(
    "word_quality",
    f"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as ts from documents),
c as (select doc_id, len(list_filter(ts, lambda x: regexp_matches(lower(trim(x, {lit(tx.AROUND)})), {lit(tx.REAL_WORD)}))) as real, len(ts) as tokens from t)
select doc_id, cast(real as bigint) as real, cast(tokens as bigint) as tokens, tokens >= 200 and real / tokens < 0.60 as garbled from c
""",
)
def word_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", tx.word_counts(F.col("text")).alias("w")).select("doc_id", "w.real", "w.tokens")
    return rows.withColumn("garbled", tx.ocr_garbled(F.col("real"), F.col("tokens")))


def _n(pattern: str) -> str:
    return f"cast(len(regexp_extract_all(text, {lit(pattern)})) as bigint)"


@query("pii_counts", f"select doc_id, {_n(tx.NAME_ADDRESS)} as name_address, {_n(tx.LOT_OWNER)} as lot_owner, {_n(tx.DIRECTORY)} as directory, {_n(tx.PHONE)} as phones from documents")
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.pii(F.col("text")).alias("p")).select("doc_id", "p.name_address", "p.lot_owner", "p.directory", "p.phones")


@query("pii_scan")
def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    """All kinds and the risk; the pattern of numbers looks around, which RE2 cannot."""
    return docs(spark, d).select("doc_id", tx.pii(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("pii_page_rollup")
def pii_page_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a document's lines as pages, and its worst risk."""
    pages = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("page")).select("doc_id", tx.pii(F.col("page")).alias("p"))
    return pages.groupBy("doc_id").agg(F.sum("p.ssn").alias("ssn"), F.sum("p.personal_emails").alias("personal_emails"), F.sum("p.phones").alias("phones"), tx.worst_risk(F.col("p.risk")).alias("risk"))


SQL_TEXT = " ".join(f"when regexp_matches(lower(text), {lit(p)}) then {lit(c)}" for p, c, _ in tx.BY_TEXT)
SQL_CLASSIFY = f"""
select doc_id, case when len(regexp_extract_all(text, {lit(tx.ROSTER)})) >= 5 then 'membership_list'
  when regexp_matches(lower(text), {lit(tx.BALLOT[0])}) and regexp_matches(lower(text), {lit(tx.BALLOT[1])}) then 'ballot'
  when regexp_matches(lower(text), {lit(tx.VIOLATION[0])}) and regexp_matches(lower(text), {lit(tx.VIOLATION[1])}) then 'violation' {SQL_TEXT} end as category from documents
"""


@query("classify_text", SQL_CLASSIFY)
def classify_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.classify_text(F.col("text"))["category"].alias("category"))


SQL_FILE = " ".join(f"when regexp_matches(lower(url), {lit(p)}) then {lit(c)}" for p, c in tx.BY_FILENAME)


@query("classify_filename", f"select page_id, case {SQL_FILE} end as category from pages")
def classify_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.classify_filename(F.col("url"))["category"].alias("category"))


SQL_SURE = " ".join(f"when regexp_matches(lower(text), {lit(p)}) then {c}" for p, _, c in tx.BY_TEXT)
SQL_NAME = " ".join(f"when regexp_matches(lower(source || '.pdf'), {lit(p)}) then {lit(c)}" for p, c in tx.BY_FILENAME)


@query(
    "classify_cascade",
    f"""
with c as ({SQL_CLASSIFY}),
t as (select doc_id, case when length(trim(text)) > 50 then category end as by_text, case when category in ('membership_list') then 0.85 when category in ('ballot', 'violation') then 0.8 else case {SQL_SURE} end end as sure, case {SQL_NAME} end as by_name from documents join c using (doc_id))
select doc_id, coalesce(by_text, by_name, case when doc_id % 2 = 0 then 'minutes' end) as category, cast(case when by_text is not null then sure when by_name is not null then 0.7 when doc_id % 2 = 0 then 1.0 end as double) as confidence from t
""",
)
def classify_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Text, then file name, then a model's verdict, whose JSON is checked."""
    verdict = tx.coerce_verdict(F.concat(F.lit('{"category": "'), F.when(F.col("doc_id") % 2 == 0, "Minutes").otherwise("poetry"), F.lit('", "confidence": 1.7}')))
    c = tx.classify(F.col("text"), F.concat("source", F.lit(".pdf")), verdict)
    return docs(spark, d).select("doc_id", c["category"].alias("category"), c["confidence"].alias("confidence"))


@query("html_strip", "select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?is)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("boilerplate_strip")
def boilerplate_strip(spark: SparkSession, d: str) -> DataFrame:
    t = tx.strip_boilerplate(tx.strip_html(F.col("html")))
    return table(spark, d, "pages").select("page_id", t.alias("text")).withColumn("navigation_heavy", tx.navigation_heavy(F.col("text")))


@query("pdf_text_quality", "select doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 120 or len(regexp_extract_all(text, '[A-Za-z]{3,}')) < 20 as low_quality, length(trim(text)) >= 50 as extractable from documents")
def pdf_text_quality(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.low_quality_pdf(F.col("text")).alias("low_quality"), tx.extractable(F.col("text")).alias("extractable"))


SQL_P = " ".join(f"when regexp_matches(lower(html), {lit(p)}) then {lit(c)}" for p, c in [*tx.PUBLIC_PLATFORMS, *tx.WALLED_PLATFORMS])
SQL_PUBLIC = " or ".join(f"regexp_matches(lower(html), {lit(p)})" for p, _ in tx.PUBLIC_PLATFORMS)
SQL_WALLED = " or ".join(f"regexp_matches(lower(html), {lit(p)})" for p, _ in tx.WALLED_PLATFORMS)


@query("fingerprint", f"select page_id, case {SQL_P} when length(html) > 1000 and contains(html, '<') then 'static' else 'unknown' end as platform, not ({SQL_PUBLIC}) and ({SQL_WALLED}) as walled from pages")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.platform(F.col("html")).alias("p")).select("page_id", "p.platform", "p.walled")


@query("link_harvest")
def link_harvest(spark: SparkSession, d: str) -> DataFrame:
    return resolve.harvest_links(table(spark, d, "pages"))


def with_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages with links to documents and to lists of them after their own."""
    listed = F.concat(*(F.lit(f'<a href="/forms/{k}">Papers</a>') for k in range(1, 8)))
    added = F.concat(F.lit('<a href="/files/declaration-'), F.col("page_id").cast("string"), F.lit('.pdf">Paper</a><a href="/login/bylaws.pdf">Enter</a><a href="https://other.example/library">Elsewhere</a>'), listed)
    return table(spark, d, "pages").withColumn("html", F.concat("html", added))


SITE = "regexp_extract(url, '^(https?://[^/]+)', 1)"


@query("pdf_candidates", f"select page_id, {SITE} || '/files/declaration-' || page_id || '.pdf' as url, true as is_pdf from pages")
def pdf_candidates(spark: SparkSession, d: str) -> DataFrame:
    return resolve.pdf_candidates(resolve.harvest_links(with_documents(spark, d))).select("page_id", "url", "is_pdf")


@query("doc_subpages", f"select page_id, {SITE} || '/forms/' || k as url, cast(k as integer) as n from pages, range(1, 6) t(k)")
def doc_subpages(spark: SparkSession, d: str) -> DataFrame:
    """Seven lists are linked; five are taken."""
    pages = with_documents(spark, d)
    return resolve.doc_subpages(resolve.harvest_links(pages), pages).select("page_id", "url", "n")


@query("chunk_documents")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents of one page each."""
    page = F.struct(F.lit(1).alias("number"), F.col("text").alias("text"))
    return chunker.chunk_documents(docs(spark, d).select(F.col("doc_id").alias("document_id"), F.array(page).alias("pages")))


@query("checksums", "select doc_id, sha256(text) as checksum from documents")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("checksum"))


@query(
    "page_plan",
    """
with p as (select doc_id as document_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as number, case doc_id % 3 when 0 then true when 1 then false end as x from documents)
select document_id, cast(number as bigint) as number, case when x then 'parser' when not x then case when number <= 25 then 'ocr' else 'none' end when trim(text) <> '' then 'parser' when number <= 200 then 'ocr' else 'none' end as method from p
""",
)
def page_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    rows = docs(spark, d).select(F.col("doc_id").alias("document_id"), F.when(k == 0, True).when(k == 1, False).alias("text_extractable"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return files.plan_pages(rows.withColumn("number", (F.col("pos") + 1).cast("long"))).select("document_id", "number", "method")


@query(
    "most_mentioned",
    """
with m as (select doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) as w, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{2,}'), 1) as i from documents),
c as (select doc_id, w, count(*) as n, min(i) as first from m group by 1, 2)
select doc_id, w as word from (select *, row_number() over (partition by doc_id order by n desc, first) as r from c) where r = 1
""",
)
def most_mentioned(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))
    return docs(spark, d).select("doc_id", tx.most_mentioned(found).alias("word")).where("word is not null")


@query("proxy_context", "select doc_id, array_to_string(list_slice(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the') or contains(lower(x), 'le ') or contains(lower(x), 'der ')), 1, 6), chr(10) || chr(10)) as context from documents")
def proxy_context(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.proxy_context(F.split("text", "\n"), ["the", "le ", "der "]).alias("context"))


@query(
    "category_phrase",
    """
with c as (select o_custkey as entity_id, o_orderpriority as category, count(*) as n from orders group by 1, 2),
l as (select entity_id, list(n || ' ' || category order by n desc, category) as ws from c group by 1)
select entity_id, case len(ws) when 1 then ws[1] when 2 then ws[1] || ' and ' || ws[2] else array_to_string(ws[1:len(ws) - 1], ', ') || ', and ' || ws[len(ws)] end as phrase from l
""",
)
def category_phrase(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.collect_list(F.struct("n", "category")).alias("c")).select("entity_id", tx.category_phrase(F.col("c")).alias("phrase"))


@query("verification_code", "select o_orderkey as id, substr(sha256(o_orderkey::varchar || ':' || strftime(o_orderdate, '%Y-%m-%d') || ':' || sha256(o_orderstatus)), 1, 20) as code from orders")
def verification_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tx.verification_code(F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.sha2("o_orderstatus", 256)).alias("code"))
