"""Names and slugs over parts, customers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..sources.tables import table
from .registry import query

SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("slug", f"select p_partkey as id, {SLUG.format(c='p_name')} as slug from part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.slug(F.col("p_name")).alias("slug"))


@query("entity_path", f"select c_custkey as id, '/entity/' || lower(n_name) || '/' || {SLUG.format(c='c_mktsegment')} || '/' || {SLUG.format(c='c_name')} as path from customer join nation on c_nationkey = n_nationkey")
def entity_path(spark: SparkSession, d: str) -> DataFrame:
    n = F.broadcast(table(spark, d, "nation"))  # 25 rows by the data model
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), names.path(F.col("n_name"), F.col("c_mktsegment"), F.col("c_name")).alias("path"))


@query("identity_slug", "with s as (select p_partkey as id, p_name, regexp_replace(regexp_replace(regexp_replace(lower(p_name), '(?i)\\b(hoa|homeowners?|home\\s*owners?|community|civic|cluster|condominium|condo|property\\s*owners?|owners?|master|association|assn|assoc|inc|llc|co|the)\\b', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as s from part) select id, coalesce(nullif(s, ''), regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug from s")
def identity_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.identity_slug(F.col("p_name")).alias("slug"))


@query("namespace_slug", "select p_partkey as id, regexp_replace(replace(lower(p_name), ' ', '_'), '[^\\p{L}\\p{N}_-]', '', 'g') as slug from part")
def namespace_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.namespace(F.col("p_name")).alias("slug"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Names of documents, with a page's url each: a document's name is its first line, as there is no table of such names."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("name"))
    urls = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source_url"))
    return docs.join(urls, "id", "left")


@query("dirty_names")
def dirty_names(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("id", "name", names.dirty_reason(F.col("name")).alias("reason")).withColumn("dirty", F.col("reason").isNotNull())


@query("clean_names")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    return names.recover(lines(spark, d).where(names.is_dirty(F.col("name")))).select("id", "name", "cleaned")


@query("title_case")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("id", names.title_case(F.upper("name")).alias("title"))


SQL_FORM = "regexp_replace(upper(p_name), '[,.\\-''’]', ' ', 'g')"
for _p in names.DEDUPE_DROPS:
    SQL_FORM = f"regexp_replace({SQL_FORM}, '{_p}', '', 'g')"


@query("dedupe_form", f"select p_partkey as id, trim(regexp_replace({SQL_FORM}, '\\s+', ' ', 'g')) as form, array_to_string(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' and not list_contains({names.SIGNATURE_DROPS!r}, w)), ' ') as signature from part")
def dedupe_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.dedupe_form(F.col("p_name")).alias("form"), names.signature(F.col("p_name")).alias("signature"))


@query("case_predicates", "select doc_id, regexp_matches(text, '\\p{L}') and not regexp_matches(text, '\\p{Ll}') as all_caps, case when length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 8 then 0.0 else round(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 6) end as upper_ratio from documents")
def case_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.all_caps(t).alias("all_caps"), F.round(text.count_words_ratio(t), 6).alias("upper_ratio"))


@query("acceptable_names", "select c_custkey as id, length(trim(c_name)) >= 4 and regexp_matches(c_name, '\\p{L}') and not regexp_matches(trim(c_name), '^[A-Z][a-z]+$') as ok from customer")
def acceptable_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), names.acceptable(F.col("c_name")).alias("ok"))


@query(
    "registrants",
    r"select s_suppkey as id, trim(regexp_replace(regexp_replace(upper(s_name || case when s_suppkey % 2 = 0 then ', Inc. LLC' else '' end), '[.,]', '', 'g'), '(?:\s+(?:INC|LLC|LLP|LP|LTD|CORP|CO|CORPORATION|COMPANY|INCORPORATED))+\s*$', '')) as registrant, len(regexp_split_to_array(trim(s_name), '\s+')) between 2 and 3 and len(list_filter(regexp_split_to_array(trim(s_name), '\s+'), lambda w: not regexp_matches(w, '^\p{L}[\p{L}.''-]*$'))) = 0 and not regexp_matches(upper(s_name), '\b(INC|LLC|LLP|LP|LTD|CORP|COMPANY|MANAGEMENT|PROPERTIES|REALTY|GROUP|SERVICES|ASSOCIATION|LAW|OFFICES?)\b') as personal from supplier",
)
def registrants(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ", Inc. LLC").otherwise(""))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), names.registrant(n).alias("registrant"), names.is_personal(F.col("s_name")).alias("personal"))


@query("names_from_urls")
def names_from_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", names.name_from_url(F.col("url")).alias("name"))
