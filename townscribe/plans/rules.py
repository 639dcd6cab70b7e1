"""Ordered rules over names of customers, parts and first lines, pages' links and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import resolve
from ..sources.tables import table
from .names import lines
from .registry import query


@query("non_entity_names")
def non_entity_names(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("id", rules.non_entity(F.col("name")).alias("pattern"), rules.restore_or_keep(F.col("name"), F.lit("NC")).alias("restore"), rules.clear_or_delete(F.col("name"), F.lit("HI")).alias("clear"))


NAMED = "(doc_id % 5)"
STATES_SQL = "case {k} when 0 then 'North Carolina' when 1 then 'West Virginia' when 2 then 'Arkansas' when 3 then 'Ohio' end"


def named(k):
    return F.when(k == 0, "North Carolina").when(k == 1, "West Virginia").when(k == 2, "Arkansas").when(k == 3, "Ohio")


@query("verify_state", "select doc_id, case doc_id % 5 when 0 then 'NC' when 1 then 'WV' when 2 then 'AR' when 3 then 'OH' else case when doc_id % 2 = 0 then 'TX' end end as state, case when doc_id % 5 = 4 then 'low' else 'medium' end as confidence from documents")
def verify_state(spark: SparkSession, d: str) -> DataFrame:
    """The state that each text with its recorder's mark names, and those expected where none is named."""
    k = F.col("doc_id") % 5
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" recorded in "), F.coalesce(named(k), F.lit("no state at all"))).alias("page"), F.when((k == 4) & (F.col("doc_id") % 2 == 0), "TX").alias("expected"))
    return rows.select("doc_id", rules.verify_state(F.col("page"), F.col("expected")).alias("s")).select("doc_id", "s.state", "s.confidence")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(
    "governing_results",
    f"""
with p as (select page_id, url, case when page_id % 2 = 0 then url || '/declaration.pdf' else url end as link from pages)
select page_id, ends_with(regexp_replace(lower(link), '[?#].*$', ''), '.pdf') and not regexp_matches(link, {lit(rules.BAD_HOSTS)}) and not regexp_matches(link || ' Declaration of covenants ', {lit(rules.RESULT_BAD)}) and regexp_matches(link || ' Declaration of covenants ', {lit(rules.RESULT_GOOD)}) as governing,
  regexp_matches(url, '(?i)\\b(NC|North Carolina)\\b') as hinted from p
""",
)
def governing_results(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    link = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/declaration.pdf"))).otherwise(F.col("url"))
    return p.select("page_id", rules.governing_result(link, F.lit("Declaration of covenants"), F.lit("")).alias("governing"), rules.state_hint(F.col("url"), "NC", "North Carolina").alias("hinted"))


@query("bucket_scores")
def bucket_scores(spark: SparkSession, d: str) -> DataFrame:
    links = resolve.harvest_links(table(spark, d, "pages"))
    return links.select("page_id", "ord", rules.bucket_score("proxy_voting", F.col("url"), F.col("text"), ["proxy", "vote", "the"]).alias("score"), rules.community_type(F.col("text"), {"condo": ["an"], "coop": ["th"]}).alias("kind"))


@query("compact_names", "select p_partkey as id, p_name || ' Owners Association, Inc.' as name from part where false union all select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') from part")
def compact_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.compact_name(F.concat("p_name", F.lit(" Owners Association Inc."))).alias("name"))


@query(
    "geocode_choice",
    """
with r as (select l_orderkey as query_id, l_linenumber as ord, l_linenumber % 3 > 0 as outline, l_suppkey % 2 = 0 as place, l_partkey % 4 = 0 as nb, l_discount as importance from lineitem),
s as (select *, 100 + case when nb then 35 else 0 end + case when place then 20 else 0 end + least(15, cast(trunc(importance * 20) as integer)) as score from r where outline and (nb or place))
select query_id, ord, score from (select *, row_number() over (partition by query_id order by score desc, ord) as n from s) where n = 1
""",
)
def geocode_choice(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 3 > 0, "Polygon").alias("geometry"), F.when(F.col("l_partkey") % 4 == 0, "suburb").otherwise("administrative").alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, "place").otherwise("boundary").alias("group"), F.col("l_discount").alias("importance"))
    return rules.best_outline(r).select("query_id", "ord", "score")


@query("registry_cascade", "with c as (select c_custkey as ord, case c_custkey % 6 when 0 then '' when 1 then 'Elm Condominium ' || c_nationkey when 2 then 'Oak Owners Inc ' || c_custkey when 3 then 'Church Owners Association ' || c_custkey when 4 then 'Plain Name' else 'Ash Homeowners Association ' || c_nationkey end as name, case when c_custkey % 10 = 5 then 'BUSINESS' else 'NOT-FOR-PROFIT' end as t from customer), s as (select *, case when name = '' then 'skip_empty_name' when t <> 'NOT-FOR-PROFIT' then 'skip_entity_type' when name = 'Plain Name' then 'skip_no_keyword' when starts_with(name, 'Church') then 'skip_rejected_pattern' end as stage from c) select ord, coalesce(stage, case when row_number() over (partition by stage, name order by ord) > 1 then 'skip_dup_name' else 'written' end) as reason, case when stage is null and row_number() over (partition by stage, name order by ord) = 1 then case when contains(name, 'Condominium') then 'condo' when contains(name, 'Owners Inc') then 'coop' else 'hoa' end end as metadata_type from s")
def registry_cascade(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("Elm Condominium "), F.col("c_nationkey").cast("string"))).when(k % 6 == 2, F.concat(F.lit("Oak Owners Inc "), c)).when(k % 6 == 3, F.concat(F.lit("Church Owners Association "), c)).when(k % 6 == 4, "Plain Name").otherwise(F.concat(F.lit("Ash Homeowners Association "), F.col("c_nationkey").cast("string")))
    rows = table(spark, d, "customer").select(k.alias("ord"), name.alias("name"), F.when(k % 10 == 5, "BUSINESS").otherwise("NOT-FOR-PROFIT").alias("entity_type"))
    return rules.registry_cascade(rows, ["NOT-FOR-PROFIT"]).select("ord", "reason", "metadata_type")


@query("mailing_names")
def mailing_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, " CONDO ASSN C/O ALMA PROP").otherwise(" HOA, INC."))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.mailing_name(raw).alias("name"))


@query("lead_names")
def lead_names(spark: SparkSession, d: str) -> DataFrame:
    c = F.array(F.concat(F.lit("Declaration of "), F.col("p_name")), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " Owners Association").otherwise(" document")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.lead_name(c).alias("name"))


@query("state_county")
def state_county(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws(" ", "text", F.lit("recorded in"), F.lit("Wake County, North Carolina"), named(F.col("doc_id") % 5), F.when(F.col("doc_id") % 2 == 0, "Lake County, Ohio. Lake County, Ohio"))
    return table(spark, d, "documents").select("doc_id", rules.state_county(t).alias("s")).select("doc_id", "s.state", "s.county")


@query("address_candidates")
def address_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("The community is located at 12 Oak Street, Raleigh, NC 27601. "), F.col("text"), F.lit(" Prepared by attorney, 9 Elm Road, Cary, NC 27511. Again 12 Oak Street, Raleigh, NC 27601."))
    return rules.address_candidates(table(spark, d, "documents").select("doc_id", t.alias("text")), "NC")
