"""Legal rules over sentences of documents and benchmark items, salted with legal words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import legal
from ..sources.tables import table
from .registry import query

# Sentences with every kind of rule, laid over the tables' texts.
PHRASES = [
    "A proxy may be directed by the member and must be in writing.",
    "The proxy is revocable at the pleasure of the person executing it.",
    "The association shall provide records within 10 business days after written request.",
    "An electronic signature satisfies the law and the electronic record satisfies any law.",
    "The membership list may not be used for commercial purposes by any person.",
    "Minutes and the budget are open to inspection by every owner of a lot.",
]


def rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % len(PHRASES)
    phrase = F.element_at(F.array(*(F.lit(p) for p in PHRASES)), (k + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("jurisdiction"), F.when(k == 3, "electronic_transactions_overlay").otherwise("proxy_voting").alias("bucket"), F.concat(phrase, F.lit(" "), F.col("text")).alias("text"))
    return legal.extract_rules(docs).select("doc_id", "jurisdiction", "sentence_no", "topic_family", "rule_type", "confidence", "needs_human_review", "value_text")


@query("sentence_rules")
def sentence_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules(spark, d)


@query("section_split")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("text", "\n", "\nSection 1. ")
    return table(spark, d, "documents").select("doc_id", F.explode(tx.split_sections(t)).alias("s")).select("doc_id", "s.section_key", "s.heading", F.length("s.text").alias("n_chars"))


@query("jurisdiction_profiles")
def jurisdiction_profiles(spark: SparkSession, d: str) -> DataFrame:
    return legal.profiles(rules(spark, d), ["jurisdiction"])


@query("cluster_coverage")
def cluster_coverage(spark: SparkSession, d: str) -> DataFrame:
    clusters = spark.createDataFrame([("permission", ["proxy_allowed", "proxy_directed_option"]), ("duration", ["proxy_validity_duration"]), ("records", ["records_inspection_right", "records_document_types"])], "cluster_id string, any_of array<string>")
    return legal.cluster_coverage(rules(spark, d), clusters, ["jurisdiction"])


@query("review_queue")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return legal.review_queue(rules(spark, d).withColumn("needs_human_review", F.lit(1)))


@query(
    "corpus_counters",
    """
with s as (select upper(lang) as jurisdiction, count(*) as seeded from documents group by 1), f as (select upper(lang) as jurisdiction, count(*) as fetched from documents where doc_id % 10 <> 0 group by 1),
n as (select upper(lang) as jurisdiction, count(*) as normalized from documents where lang <> 'es' group by 1), e as (select upper(lang) as jurisdiction, count(*) as extracted from documents where lang in ('en', 'fr') group by 1)
select jurisdiction, coalesce(seeded, 0) as seeded, coalesce(fetched, 0) as fetched, coalesce(normalized, 0) as normalized, coalesce(extracted, 0) as extracted,
  coalesce(seeded, 0) > 0 and coalesce(fetched, 0) >= coalesce(seeded, 0) and coalesce(normalized, 0) > 0 and coalesce(extracted, 0) > 0 as release
from s full join f using (jurisdiction) full join n using (jurisdiction) full join e using (jurisdiction)
""",
)
def corpus_counters(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", F.col("lang").alias("jurisdiction"))
    return legal.corpus_counters(j, j.where("doc_id % 10 <> 0"), j.where("jurisdiction <> 'es'"), j.where("jurisdiction in ('en', 'fr')"))


@query("proxy_expiry", "select o_orderkey as id, strftime(case o_orderkey % 5 when 0 then o_orderdate::date + 335 when 1 then o_orderdate::date + 365 when 2 then o_orderdate::date + 180 when 3 then date '2000-01-01' end, '%Y-%m-%d') as expires from orders")
def proxy_expiry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    law = F.when(k == 0, "valid for 11 months").when(k == 1, "for one year").when(k == 2, "for 180 days").when(k == 3, "within 90 days").otherwise("while it lasts")
    e = legal.proxy_expiry(law, F.to_date("o_orderdate"), F.when(k >= 3, F.to_date(F.lit("2000-01-01"))))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(e, "yyyy-MM-dd").alias("expires"))


@query(
    "source_quality",
    "with h as (select page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as host from pages) select page_id, case when contains(host, 'tion') then 'aggregator' when host = 'blog.ththan.example.net' then case when page_id % 2 = 0 then 'official_primary' else 'official_secondary' end else 'unknown' end as quality from h",
)
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 2 == 0, "statute").otherwise("secondary")
    q = legal.source_quality(kind, F.col("url"), ["tion"], ["blog.ththan.example.net"], ["statute"])
    return table(spark, d, "pages").select("page_id", q.alias("quality"))
