"""Entity resolution over parts, customers, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import resolve, renames, stubs
from ..sources.tables import table
from .names import SLUG
from .registry import query

FORM = "trim(regexp_replace(regexp_replace(upper(p_name), '[,.\\-''’]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "name_dedupe_pairs",
    f"""
with b as (select p_partkey as id, p_brand as block, p_name as name, {FORM} as form, p_size as weight from part),
c as (select *, row_number() over (partition by block, form order by length(name) desc, weight desc, id desc) as n, first_value(id) over (partition by block, form order by length(name) desc, weight desc, id desc) as rep from b where length(form) >= 4),
r as (select * from c where n = 1),
p as (select a.id as a, b.id as b, a.form as fa, b.form as fb, length(a.name) > length(b.name) or (length(a.name) = length(b.name) and a.weight > b.weight) as wins
  from r a join r b on a.block = b.block and a.id < b.id where length(a.form) >= 6 and length(b.form) >= 6 and (contains(a.form, b.form) or contains(b.form, a.form)))
select id as source_id, rep as target_id, form as shared_form from c where n > 1
union all select case when wins then b else a end, case when wins then a else b end, case when contains(fb, fa) then fa else fb end from p
""",
)
def name_dedupe_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_size").alias("weight"), F.col("p_brand").alias("block"))
    return resolve.dedupe_pairs(rows, "block")


@query(
    "token_jaccard",
    """
with t as (select p_partkey as id, list_distinct(string_split(lower(p_name), ' ')) as ts from part),
l as (select id as left_id, ts, len(ts) as n, unnest(ts) as w from t where id % 20 = 0), r as (select id as right_id, len(ts) as m, unnest(ts) as w from t),
j as (select left_id, right_id, round(count(*) / (n + m - count(*)), 6) as jaccard from l join r using (w) where left_id <> right_id group by left_id, right_id, n, m)
select left_id, right_id, jaccard from (select *, row_number() over (partition by left_id order by jaccard desc, right_id) as k from j) where k = 1
""",
)
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The most similar other name for every twentieth one, among all others."""
    t = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("tokens"))
    left = t.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("left_id"), "tokens")
    right = t.select(F.col("p_partkey").alias("right_id"), "tokens")
    return resolve.best_jaccard(left, right, others=True).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "resolve_slug",
    f"""
with e as (select c_custkey as entity_id, c_name as entity from customer), q as (select c_custkey as query_id, case when c_custkey % 2 = 0 then upper(c_name) else replace({SLUG.format(c='c_name')}, '-', '_') end as q from customer),
a as (select lower(entity) as k, min(entity_id) as x from e group by 1), b as (select {SLUG.format(c='entity')} as k, min(entity_id) as x from e group by 1)
select query_id, coalesce(a.x, b.x) as entity_id from q left join a on lower(q) = a.k left join b on {SLUG.format(c="replace(q, '_', '-')")} = b.k
""",
)
def resolve_slug(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity"))
    asked = F.when(F.col("entity_id") % 2 == 0, F.upper("entity")).otherwise(F.replace(names.slug(F.col("entity")), F.lit("-"), F.lit("_")))
    return resolve.resolve_slug(e.select(F.col("entity_id").alias("query_id"), asked.alias("q")), e)


@query(
    "resolve_alias",
    f"""
with a as (select o_orderstatus as place, lower(o_orderpriority) as city_slug, {SLUG.format(c="c_name")} as name_slug, o_orderdate as made, o_custkey as entity_id from orders join customer on c_custkey = o_custkey)
select place, city_slug, name_slug, entity_id from (select *, row_number() over (partition by place, city_slug, name_slug order by made desc, entity_id desc) as n from a) where n = 1
""",
)
def resolve_alias(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("place"), F.lower("o_orderpriority").alias("city_slug"))
    a = o.join(e, "entity_id").select("entity_id", "created_at", "place", "city_slug", names.slug(F.col("entity")).alias("name_slug"))
    return resolve.resolve_alias(a.select("place", "city_slug", "name_slug").distinct(), a, e).select("place", "city_slug", "name_slug", "entity_id")


@query(
    "state_aware_identity",
    """
with c as (select c_custkey as k, c_name as n, case when c_custkey % 3 = 0 then '99' else cast(case when c_custkey % 7 = 0 then 1 else c_nationkey end as varchar) end as place from customer),
a as (select *, case when k % 5 = 0 then 'create' when k % 3 = 0 and k % 7 <> 0 then 'create_marked' else 'same' end as action from c)
select k as row_id, case when action = 'same' then k end as entity_id, action, case action when 'create' then n || ' New' when 'create_marked' then n || ' (' || place || ')' else n end as stored_name from a
""",
)
def state_aware_identity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("string")).alias("place"))
    k = F.col("entity_id")
    incoming = e.select(k.alias("row_id"), F.when(k % 5 == 0, F.concat("name", F.lit(" New"))).otherwise(F.col("name")).alias("name"), F.when(k % 3 == 0, F.lit("99")).otherwise(F.coalesce("place", F.lit("1"))).alias("place"))
    return resolve.state_aware_id(incoming, e)


@query("anti_known", "select doc_id from documents d where not exists (select 1 from benchmark b where sha256(b.text) = sha256(d.text))")
def anti_known(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("sha"))
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).join(known, "sha", "left_anti").select("doc_id")


@query(
    "precheck_duplicates",
    """
with r as (select doc_id, sha256(text) as sha, lang, doc_id % 260 as pages, doc_id % 2 = 0 as scanned, row_number() over (partition by sha256(text) order by doc_id) as n from documents),
live as (select distinct sha256(text) as sha from documents where doc_id % 11 = 0)
select doc_id, case when exists (select 1 from live where live.sha = r.sha) then 'duplicate_live' when n > 1 then 'duplicate_prepared' when lang = 'es' then 'pii' when lang = 'fr' then 'junk' when pages > 200 then 'page_cap' when scanned and pages > 25 then 'scanned_cap' when lang = 'de' then 'unsupported_category' end as reason from r
""",
)
def precheck_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 260).alias("pages"), (F.col("doc_id") % 2 == 0).alias("scanned"), F.when(F.col("lang") == "es", "ballot").when(F.col("lang") == "fr", "court").when(F.col("lang") == "de", "poetry").otherwise("minutes").alias("category"))
    return resolve.reject_reason(rows, docs.where("doc_id % 11 = 0").select(F.sha2("text", 256).alias("sha256"))).select("doc_id", "reason")


LEADS = """
with l as (select page_id as ord, case when page_id % 10 = 0 then 'https://x.example/a.pdf?token=1' when page_id % 4 = 0 then 'https://x.example/same' else url end as url from pages),
k as (select distinct lower(url) as u from pages where page_id % 6 = 1),
r as (select ord, url, contains(url, '?token=') as s, lower(url) in (select u from k) as known from l)
select ord, case when s then 'signed_url' when known then 'known_url' when row_number() over (partition by lower(url), not s and not known order by ord) > 1 then 'duplicate_in_run' else 'kept' end as reason from r
"""


@query("lead_filter", LEADS)
def lead_filter(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d).select("ord", "reason")


@query("lead_counts", f"select reason, count(*) as leads, count(distinct lower(case when ord % 10 = 0 then 'https://x.example/a.pdf?token=1' when ord % 4 = 0 then 'https://x.example/same' else url end)) as urls from ({LEADS}) join pages on page_id = ord group by reason")
def lead_counts(spark: SparkSession, d: str) -> DataFrame:
    """Leads by what the filter did with them."""
    return resolve.reason_counts(_filtered(spark, d))


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    k = F.col("page_id")
    leads = pages.select(k.alias("ord"), F.when(k % 10 == 0, "https://x.example/a.pdf?token=1").when(k % 4 == 0, "https://x.example/same").otherwise(F.col("url")).alias("url"))
    return resolve.filter_leads(leads, pages.where("page_id % 6 = 1"))


@query(
    "registry_join",
    """
with legal as (select l_orderkey as doc_id, min((l_partkey, l_suppkey)) as m from lineitem where l_returnflag <> 'R' group by 1)
select o_orderkey as doc_id, c_name as party, cast(m[1] as varchar) as lot, cast(m[2] as varchar) as block from orders join legal on doc_id = o_orderkey join customer on c_custkey = o_custkey
""",
)
def registry_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    legals = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_returnflag") != "R").alias("residential"), F.lit(1).alias("borough"), F.col("l_suppkey").cast("string").alias("block"), F.col("l_partkey").cast("string").alias("lot"))
    parties = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.col("c_name").alias("name"), F.lit(1).alias("ord"))
    return resolve.registry_join(o.select(F.col("o_orderkey").alias("doc_id")), legals, parties).select("doc_id", "party", "legal.lot", "legal.block")


@query("representative", "select o_custkey, o_orderstatus, min(o_orderkey) as o_orderkey, count(*) as units from orders group by 1, 2")
def representative(spark: SparkSession, d: str) -> DataFrame:
    return resolve.representative(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey", "units")


@query(
    "signature_groups",
    f"""
with s as (select p_partkey as id, array_to_string(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' and not list_contains({names.SIGNATURE_DROPS!r}, w)), ' ') as signature from part)
select * from (select signature, id as entity_id, count(*) over (partition by signature) as n from s where length(signature) >= 4) where n >= 2
""",
)
def signature_groups(spark: SparkSession, d: str) -> DataFrame:
    return resolve.signature_groups(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")))


@query(
    "crosswalk",
    """
with z as (select printf('%05d', n_nationkey) as zip, n_name as county from nation where n_nationkey % 3 <> 0)
select c_custkey as id, coalesce(a.county, b.county) as county from customer left join z a on a.zip = printf('%05d', c_nationkey) left join z b on b.zip = printf('%05d', c_custkey % 40)
""",
)
def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zip"), F.col("n_name").alias("county"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("principal_zip"), F.lpad((F.col("c_custkey") % 40).cast("string"), 5, "0").alias("mailing_zip"))
    return resolve.crosswalk(rows, z).select("id", "county")


@query("crawl_frontier")
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    links = resolve.harvest_links(pages).join(pages.select("page_id", F.col("url").alias("from_url")), "page_id").select("from_url", F.col("url").alias("to_url"))
    return resolve.crawl(pages, links, 2)


@query(
    "query_variants",
    """
with s as (select c_custkey as seed_id, c_name || case when c_custkey % 2 = 0 then ' Condominium Association' else '' end as name, trim(c_name) as base, substr(c_mktsegment, 1, 2) as state, c_mktsegment as whole, c_custkey % 2 = 0 as based from customer),
v as (select seed_id, list_filter([
  case when based then '"' || base || '" "' || whole || '" "Condominium Association"' end, case when based then '"' || base || '" "' || state || '" "Condominium" Bylaws filetype:pdf' end,
  case when based then '"' || base || ' Condominium" "' || state || '" Declaration' end, case when based then '"' || base || '" "' || state || '" "Unit Owners Association"' end,
  '"' || name || '" "' || whole || '" filetype:pdf', '"' || name || '" "' || state || '" Bylaws', base || ' "Washington" "' || state || '" Condominium Declaration filetype:pdf'], lambda x: x is not null) as vs from s)
select seed_id, cast(i as integer) as variant, vs[i + 1] as search from v, range(7) t(i) where i < len(vs)
""",
)
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " Condominium Association").otherwise(""))
    return resolve.query_variants(table(spark, d, "customer").select(F.col("c_custkey").alias("seed_id"), name.alias("name"), F.substring("c_mktsegment", 1, 2).alias("state"), F.col("c_mktsegment").alias("state_name")))


def stub_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities named after suppliers, and a record of every customer: few names, five places."""
    place = lambda c: F.concat(F.lit("N"), F.col(c) % 5)
    name = lambda c, n: F.concat(F.lit("Estate "), F.col(c) % n)
    blank = F.lit(None).cast("string")
    held = table(spark, d, "supplier").groupBy(name("s_suppkey", 40).alias("name")).agg(F.min_by(place("s_nationkey"), "s_suppkey").alias("state"))
    entities = held.select("name", "state", *(blank.alias(c) for c in ("city", "display_name", "location_quality", "source")))
    k = F.col("c_custkey")
    records = table(spark, d, "customer").select(k.alias("ord"), name("c_custkey", 60).alias("name"), place("c_nationkey").alias("state"), F.col("c_mktsegment").alias("city"), F.when(k % 10 == 9, "bad").when(k % 2 == 0, "address").alias("location_quality"), F.when(k % 3 != 0, "disambiguate").alias("on_collision"), blank.alias("source"), blank.alias("display_name"))
    return entities, records


@query("stub_upsert")
def stub_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A batch of records by name: the first makes the entity, others update it, are refused, or get a row of their own."""
    return stubs.upsert(*stub_batch(spark, d))[1]


@query(
    "chained_renames",
    """
with f as (
  select l_orderkey * 10 + l_linenumber as document_id, l_partkey as p, 's' || l_suppkey as path,
    least(l_partkey // 3 * 3 + 2, (select max(p_partkey) from part)) as entity_id
  from lineitem)
select entity_id, path, arg_min(document_id, (entity_id - p) * 1000000000000 + document_id) as document_id from f group by entity_id, path
""",
)
def chained_renames(spark: SparkSession, d: str) -> DataFrame:
    """Parts are renamed to the next part's name, but for every third: they merge along the chain, and so do their lines."""
    k = F.col("p_partkey")
    parts = table(spark, d, "part").select(k.alias("entity_id"), F.concat(F.lit("Part "), k).alias("name"))
    asked = table(spark, d, "part").where(k % 3 != 2).select(k.alias("ord"), k.alias("entity_id"), F.concat(F.lit("Part "), k + 1).alias("new_name"))
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"), F.col("l_partkey").alias("entity_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("path"))
    return renames.move(lines, renames.apply_renames(parts, asked)[2], ["path"])
