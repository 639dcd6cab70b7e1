"""Lookups, rankings and answers over customers, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, names
from ..operators import legal, lookup, resolve, usage
from ..sources.tables import table
from .registry import query


def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rules: brand is the jurisdiction, size tells form and citation."""
    k = F.col("p_partkey")
    topic = F.when(k % 5 == 0, "records_access").when(k % 5 == 1, "records_sharing_limits").otherwise("proxy_voting")
    form = F.when(F.col("p_size") % 3 == 0, "corporation").when(F.col("p_size") % 3 == 1, "unknown").otherwise("trust")
    cited = F.when(k % 11 != 0, F.concat(F.lit("S. "), (F.col("p_size") % 40).cast("string")))
    return table(spark, d, "part").select(k.alias("ord"), F.col("p_brand").alias("jurisdiction"), form.alias("entity_form"), topic.alias("topic_family"), F.col("p_type").alias("rule_type"), F.col("p_name").alias("value_text"), cited.alias("citation"), F.lit("").alias("citation_url"))


RULES = """r as (select p_partkey as ord, p_brand as jurisdiction, case p_size % 3 when 0 then 'corporation' when 1 then 'unknown' else 'trust' end as entity_form,
  case p_partkey % 5 when 0 then 'records_access' when 1 then 'records_sharing_limits' else 'proxy_voting' end as topic_family, p_type as rule_type, p_name as value_text,
  case when p_partkey % 11 <> 0 then 'S. ' || (p_size % 40) end as citation from part)"""


@query("rules_in_scope", f"with {RULES} select ord, 'any' as asked from r where entity_form in ('corporation', 'unknown') union all select ord, 'proxy_voting' from r where entity_form in ('trust', 'unknown') and topic_family = 'proxy_voting'")
def rules_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a form or of none in particular, of all topics and of one."""
    r = rule_rows(spark, d)
    ask = lambda form, topic: lookup.in_form(lookup.in_scope(r, topic_family=topic), form).select("ord", F.lit(topic or "any").alias("asked"))
    return ask("corporation", None).unionAll(ask("trust", "proxy_voting"))


@query(
    "law_answers",
    f"""
with {RULES}, q as (select * from r where topic_family <> 'proxy_voting'),
s as (select distinct p_brand as jurisdiction from part),
n as (select *, row_number() over (partition by jurisdiction, topic_family order by ord) as k, case topic_family when 'records_access' then 0 else 1 end as t from q),
c as (select jurisdiction, citation, min(ord) as o from q where citation is not null group by 1, 2),
cr as (select *, row_number() over (partition by jurisdiction order by o, citation) as k from c),
p as (select distinct p_brand as jurisdiction, cast(substr(p_brand, 7, 1) as integer) as b from part),
pr as (select jurisdiction, case b when 1 then null when 2 then 'high' else 'medium' end as profile, b = 3 as gap from p),
a as (select s.jurisdiction, (select count(*) from q where q.jurisdiction = s.jurisdiction) as n_rules,
  coalesce((select list(rule_type || ': ' || value_text order by t, k) from n where n.jurisdiction = s.jurisdiction and k <= 8), []) as checklist,
  coalesce((select list(citation order by k) from cr where cr.jurisdiction = s.jurisdiction and k <= 25), []) as citations,
  list_concat(case when gap then ['old statute'] else [] end, list_filter([
    case when not exists (select 1 from q where q.jurisdiction = s.jurisdiction and topic_family = 'records_access') then 'No extracted records_access rules were found for this scope.' end,
    case when not exists (select 1 from q where q.jurisdiction = s.jurisdiction and topic_family = 'records_sharing_limits') then 'No extracted records_sharing_limits rules were found for this scope.' end], lambda x: x is not null)) as gaps,
  profile, gap from s join pr on s.jurisdiction = pr.jurisdiction)
select jurisdiction, n_rules, array_to_string(checklist, chr(10)) as checklist, array_to_string(gaps, chr(10)) as gaps, array_to_string(citations, chr(10)) as citations,
  case when n_rules = 0 or profile is null then 'low' when gap and profile = 'high' then 'medium' when gap then 'low' else profile end as confidence from a
""",
)
def law_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers on records for every jurisdiction: checklists of 8 and 8, gaps, at most 25 citations, confidence."""
    r = rule_rows(spark, d)
    scopes = r.select("jurisdiction").distinct()
    b = F.substring("jurisdiction", 7, 1).cast("int")
    profiles = scopes.select("jurisdiction", F.when(b == 1, None).when(b == 2, "high").otherwise("medium").alias("profile"), F.when(b == 3, F.array(F.lit("old statute"))).alias("known_gaps"))
    out = legal.answers(scopes, r, profiles, ["jurisdiction"], {"records_access": 8, "records_sharing_limits": 8})
    return out.withColumns({c: F.array_join(c, "\n") for c in ("checklist", "gaps", "citations")})


@query("jurisdiction_summary", f"with {RULES} select jurisdiction, count(distinct entity_form) as types, count(*) as profiles, max(ord) as last_verified, cast(sum(length(value_text)) as bigint) as rules from r group by 1")
def jurisdiction_summary(spark: SparkSession, d: str) -> DataFrame:
    r = rule_rows(spark, d).select("jurisdiction", F.col("entity_form").alias("community_type"), F.col("ord").alias("last_verified"), F.length("value_text").alias("n_rules"))
    return legal.jurisdictions(r)


@query("bogus_states", "select c_custkey as id from customer where lower(substr(c_mktsegment, 1, 2)) not in ('au', 'bu', 'ma')")
def bogus_states(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.substring("c_mktsegment", 1, 2).alias("state"))
    return lookup.bogus_states(c, ["AU", "BU", "MA"]).select("id")


@query(
    "ranked_matches",
    "select p_partkey as entity_id, p_name as name, cast(instr(lower(p_name), 'an') as integer) as position, cast(length(p_name) as integer) as length from part where contains(lower(p_name), 'an') order by lower(p_name) <> 'an', position, length, lower(p_name), entity_id limit 50",
)
def ranked_matches(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best names for what was typed (a top-k report)."""
    return lookup.ranked_matches(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")), " AN ", 50)


@query("proposal_feed", "select o_orderkey as proposal_id, o_custkey as entity_id, cast(row_number() over (partition by o_custkey order by cast(floor(o_totalprice / 10000) as bigint) desc, o_orderdate desc, o_orderkey) as integer) as place from orders")
def proposal_feed(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("proposal_id"), F.col("o_custkey").alias("entity_id"), F.floor(F.col("o_totalprice") / 10000).alias("upvotes"), F.col("o_orderdate").alias("created_at"))
    return lookup.feed(o).select("proposal_id", "entity_id", "place")


@query("longest_texts", "select source, doc_id, n_chars, cast(rank as integer) as rank from (select source, doc_id, length(text) as n_chars, row_number() over (partition by source order by length(text) desc, doc_id) as rank from documents) where rank <= 10")
def longest_texts(spark: SparkSession, d: str) -> DataFrame:
    """The ten longest texts of each source, read whole."""
    return lookup.longest(table(spark, d, "documents"), "source", 10, row="doc_id").select("source", "doc_id", "n_chars", "rank")


@query("delegate_assignments", "select l_orderkey as assignment_id, l_linenumber as line_no, s_name as entity, c_name as person from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_returnflag = 'R'")
def delegate_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Assignments as a delegate sees them: the entity's and the grantor's name."""
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("assignment_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("delegate_id"))
    given = line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("assignment_id"), F.col("o_custkey").alias("grantor_id")), "assignment_id")
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    return lookup.labelled(given, entities, people, "delegate_id").select("assignment_id", "line_no", "entity", "person")


@query("entity_locations", "select c_custkey as entity_id, c_name as entity, n_name as place from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1, 2, 3")
def entity_locations(spark: SparkSession, d: str) -> DataFrame:
    """One row an entity: a join with its documents, grouped away again, would add nothing, so there is none."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(n, "c_nationkey").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity"), "place")


@query(
    "projected_pages",
    """
with r as (select doc_id, case when doc_id % 4 = 0 then (doc_id % 23) - 3 end as est, doc_id % 3 <> 0 as readable, doc_id % 50 as pages from documents),
p as (select doc_id, cast(case when est is not null then greatest(0, est) when not readable then pages else 0 end as integer) as projected from r)
select doc_id, projected, cast(sum(projected) over (order by doc_id) as bigint) as running, sum(projected) over (order by doc_id) <= 5000 as within from p
""",
)
def projected_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that would be scanned for each document, and which documents a budget of 5,000 still covers."""
    k = F.col("doc_id")
    pages = lookup.projected_pages(F.when(k % 4 == 0, k % 23 - 3), k % 3 != 0, (k % 50).cast("int"))
    return lookup.cap_pages(table(spark, d, "documents").select("doc_id", k.alias("ord"), pages.alias("projected")), 5000).select("doc_id", "projected", "running", "within")


@query("iso_dates", "select event_id, strftime(ts, '%Y-%m-%d') as day from events")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("event_id") % 2 == 1
    return table(spark, d, "events").select("event_id", lookup.iso_date(F.when(odd, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", " yyyy-MM-dd HH:mm:ss"))).alias("day"))


@query("audited_quality", "select c_custkey as id, case when c_custkey % 7 = 0 then 'polygon' when c_custkey % 5 = 0 then 'address' when c_custkey % 3 = 0 and c_custkey % 2 = 0 then 'zip_centroid' when c_custkey % 2 = 1 then 'city_only' end as quality from customer")
def audited_quality(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    q = geo.audited_quality(k % 7 == 0, F.when(k % 5 == 0, "1 Main St").otherwise(" "), F.when(k % 3 == 0, "27601"), F.when(k % 2 == 0, 35.0), F.when(k % 2 == 1, "Cary").otherwise(""))
    return table(spark, d, "customer").select(k.alias("id"), q.alias("quality"))


@query("picked_places", "select c_custkey as id, case when c_custkey % 3 = 0 then 'Albany' when c_custkey % 5 = 0 then 'Buffalo' else 'Trenton' end as city, case when c_custkey % 4 = 0 then '12207' when c_custkey % 6 = 0 then '08601' end as zip from customer")
def picked_places(spark: SparkSession, d: str) -> DataFrame:
    """City and ZIP of a registry row, from the first columns that are fit."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("id"), F.lit("Trenton").alias("c1"), F.lit("NJ").alias("s1"), F.when(k % 3 == 0, "Albany").otherwise("").alias("c2"), F.when(k % 2 == 0, "ny").otherwise("").alias("s2"), F.when(k % 5 == 0, "Buffalo").alias("c3"), F.lit("NY").alias("s3"),
        F.when(k % 4 == 0, " 12207-1234").otherwise("none").alias("z1"), F.when(k % 6 == 0, "08601").alias("z2"),
    )
    return rows.select("id", resolve.pick_city(["c1", "c2", "c3"], ["s1", "s2", "s3"], "NY").alias("city"), resolve.pick_zip(["z1", "z2"]).alias("zip"))


@query("better_names", "select c_custkey as id, case when c_custkey % 4 = 0 then c_name when c_custkey % 4 = 1 then 'x' || c_name when c_custkey % 4 = 2 then replace(c_name, '#', ' ') else c_name end as name from customer")
def better_names(spark: SparkSession, d: str) -> DataFrame:
    """The better of two names: the one there is, the longer, the one with more spaces, the first."""
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    other = F.when(k == 0, "").when(k == 1, F.concat(F.lit("x"), n)).when(k == 2, F.replace(n, F.lit("#"), F.lit(" "))).otherwise(n)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), names.better_name(n, other).alias("name"))


@query("model_families", "select event_id, 'm-' || (event_id % 7) as family from events")
def model_families(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", usage.model_family(F.concat(F.lit("m-"), (k % 7).cast("string"), F.when(k % 2 == 0, "-2026-05-01").otherwise(""))).alias("family"))
