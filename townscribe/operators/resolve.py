"""Entity resolution: lookup by name and place, aliases, duplicate pairs, merges, leads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .batches import narrow, sliced
from .sizes import broadcast_if_small


def resolve_slug(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id): by exact name without case, else by slug ('_' as '-'); the least id wins."""
    by_name = entities.groupBy(F.lower("entity").alias("_name")).agg(F.min("entity_id").alias("_by_name"))
    by_slug = entities.groupBy(names.slug(F.col("entity")).alias("_slug")).agg(F.min("entity_id").alias("_by_slug"))
    q = queries.withColumn("_qname", F.lower("q")).withColumn("_qslug", names.slug(F.replace(F.col("q"), F.lit("_"), F.lit("-"))))
    j = q.join(by_name, F.col("_qname") == F.col("_name"), "left").join(by_slug, F.col("_qslug") == F.col("_slug"), "left")
    return j.select("query_id", F.coalesce("_by_name", "_by_slug").alias("entity_id"))


def resolve_alias(queries: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity to which the newest alias (place, city_slug, name_slug) points."""
    w = Window.partitionBy("place", "city_slug", "name_slug").orderBy(F.desc("created_at"), F.desc("entity_id"))
    newest = aliases.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return queries.join(newest, ["place", "city_slug", "name_slug"]).join(entities, "entity_id")


def state_aware_id(incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """What becomes of incoming (row_id, name, place) against entities (entity_id, name, place).

    In order: the same name in the same place (or in none), the name with its place in brackets,
    the name taken elsewhere (a new entity with the place in brackets), a new name.
    """
    wanted = incoming.withColumn("_marked", F.concat_ws("", "name", F.lit(" ("), "place", F.lit(")")))
    same = entities.select(F.col("name").alias("_n1"), F.col("place").alias("_p1"), F.col("entity_id").alias("_id1"))
    j = wanted.join(same, (F.lower("name") == F.lower("_n1")) & (F.col("_p1").isNull() | (F.col("_p1") == F.col("place"))), "left")
    w = Window.partitionBy("row_id").orderBy(F.col("_p1").isNull(), "_id1")
    j = j.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    marked = entities.groupBy(F.lower("name").alias("_n2")).agg(F.min("entity_id").alias("_id2"))
    taken = entities.select(F.lower("name").alias("_n3")).distinct()
    j = j.join(marked, F.lower("_marked") == F.col("_n2"), "left").join(taken, F.lower("name") == F.col("_n3"), "left")
    action = F.when(F.col("_id1").isNotNull(), "same").when(F.col("_id2").isNotNull(), "marked").when(F.col("_n3").isNotNull(), "create_marked").otherwise("create")
    return j.select("row_id", F.coalesce("_id1", "_id2").alias("entity_id"), action.alias("action"), F.when(action.isin("marked", "create_marked"), F.col("_marked")).otherwise(F.col("name")).alias("stored_name"))


def dedupe_pairs(rows: DataFrame, block: str) -> DataFrame:
    """Pairs (source_id, target_id) within a block whose normal forms are equal or contain each other.

    ``rows`` has entity_id, name, weight and the block's column.  Rows of one form are a class: each
    points to its representative (the longest name, then the weightiest, then the greatest id),
    and only representatives meet, so copies never become all their pairs.  A form contains
    another of at least six characters only if it has all of its six-character pieces: each
    representative offers its rarest piece and meets those that have it.
    """
    base = rows.select(block, F.col("entity_id").alias("id"), "name", "weight", names.dedupe_form(F.col("name")).alias("form")).where(F.length("form") >= 4)
    first = F.max(F.struct(F.length("name").alias("n"), "weight", "id", "name")).alias("r")
    reps = base.groupBy(block, "form").agg(first, F.count(F.lit(1)).alias("members")).select(block, "form", F.col("r.id").alias("rep"), F.col("r.name").alias("name"), F.col("r.weight").alias("weight"), "members")
    again = reps.where("members > 1").select(block, "form", "rep")
    members = base.join(again, [block, "form"]).where("id <> rep").select(F.col("id").alias("source_id"), F.col("rep").alias("target_id"), F.col("form").alias("shared_form"))
    long = reps.where(F.length("form") >= 6)
    pieces = F.transform(F.sequence(F.lit(1), F.length("form") - 5), lambda i: F.substring(F.col("form"), i, F.lit(6)))
    have = long.select(block, F.col("rep").alias("id"), F.explode(F.array_distinct(pieces)).alias("piece"))
    rare = have.groupBy(block, "piece").agg(F.count(F.lit(1)).alias("n"))
    offer = have.join(rare, [block, "piece"]).groupBy(block, "id").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    met = offer.withColumnRenamed("id", "small").join(have, [block, "piece"]).where("small <> id").select(F.least("small", "id").alias("a"), F.greatest("small", "id").alias("b")).distinct()
    side = lambda s: long.select(F.col("rep").alias(s), F.col("name").alias(f"name_{s}"), F.col("form").alias(f"form_{s}"), F.col("weight").alias(f"weight_{s}"))
    j = met.join(side("a"), "a").join(side("b"), "b").where(F.col("form_a").contains(F.col("form_b")) | F.col("form_b").contains(F.col("form_a")))
    a_wins = (F.length("name_a") > F.length("name_b")) | ((F.length("name_a") == F.length("name_b")) & (F.col("weight_a") > F.col("weight_b")))
    shared = F.when(F.col("form_b").contains(F.col("form_a")), F.col("form_a")).otherwise(F.col("form_b"))
    return members.unionAll(j.select(F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("source_id"), F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("target_id"), shared.alias("shared_form")))


def best_jaccard(left: DataFrame, right: DataFrame, least: float = 0.0, others: bool = False) -> DataFrame:
    """For each left (left_id, tokens) the right one (right_id, tokens) of the largest token Jaccard; with ``others`` not the row of the same id.

    A pair that reaches t shares one of the left side's n - ceil(t n) + 1 rarest tokens.  Each
    left row meets the right ones on its rarest token first; the best of these bounds t, and only
    the few tokens that can still lead to a better one are met as well.  Right rows of equal
    token sets are one, under their least ids (two, so that one of them is another).
    """
    sets = right.select("right_id", F.array_sort(F.array_distinct("tokens")).alias("t")).where(F.size("t") > 0)
    one = sets.groupBy("t").agg(F.min("right_id").alias("r1"), F.max("right_id").alias("r9"))
    two = sets.join(one.where("r1 < r9").select("t", "r1"), "t").where("right_id > r1").groupBy("t").agg(F.min("right_id").alias("r2")) if others else one.select("t", F.lit(None).cast(right.schema["right_id"].dataType).alias("r2")).limit(0)
    b = one.select("t", "r1").join(two, "t", "left").withColumnRenamed("t", "tb")
    tokens = b.select("tb", "r1", "r2", F.explode("tb").alias("token"))
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    a = left.select("left_id", F.array_distinct("tokens").alias("ta")).select("left_id", "ta", F.explode("ta").alias("token")).join(rare, "token")
    a = a.groupBy("left_id", "ta").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("by"))
    both = F.size(F.array_intersect("ta", "tb"))

    def best(asked: DataFrame) -> DataFrame:
        j = asked.join(tokens, "token").select("left_id", "ta", "tb", "r1", "r2").distinct()
        right_id = F.when(F.col("r1") == F.col("left_id"), F.col("r2")).otherwise(F.col("r1")) if others else F.col("r1")
        j = j.select("left_id", right_id.alias("right_id"), (both / (F.size("ta") + F.size("tb") - both)).alias("jaccard")).where("right_id is not null")
        return j.groupBy("left_id").agg(F.max(F.struct("jaccard", (-F.col("right_id")).alias("last"))).alias("m")).select("left_id", (-F.col("m.last")).alias("right_id"), "m.jaccard")

    first = best(a.select("left_id", "ta", F.get("by", F.lit(0))["token"].alias("token")))
    bound = a.join(first.select("left_id", F.col("jaccard").alias("t")), "left_id", "left")
    n = F.size("ta")
    prefix = F.least(F.size("by"), n - F.ceil(F.coalesce("t", F.lit(0.0)) * n - 1e-9).cast("int") + 1)
    later = best(bound.select("left_id", "ta", F.explode(F.transform(F.slice("by", 1, prefix), lambda x: x["token"])).alias("token")))
    return later.where(F.col("jaccard") >= least)


def registry_join(master: DataFrame, legals: DataFrame, parties: DataFrame) -> DataFrame:
    """master (doc_id) with its residential legal of least lot and block, and its first named party."""
    lot = F.coalesce(F.expr("try_cast(lot as bigint)"), F.lit(1_000_000_000))
    block = F.coalesce(F.expr("try_cast(block as bigint)"), F.lit(1_000_000_000))
    one = legals.where("residential").groupBy("doc_id").agg(F.min_by(F.struct("borough", "block", "lot"), F.struct(lot, block)).alias("legal"))
    named = parties.where(F.trim(F.coalesce("name", F.lit(""))) != "").groupBy("doc_id").agg(F.min_by("name", "ord").alias("party"))
    return master.join(one, "doc_id").join(named, "doc_id")


def rename_or_merge(entities: DataFrame, documents: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and documents after renames (entity_id, new_name).

    A new name that another entity has merges the renamed one into it: its documents move, less
    those whose path the target has; the target's own row stays.  Two renames to one new name
    merge into the least id.
    """
    asked = renames.groupBy("entity_id").agg(F.min("new_name").alias("new_name"))
    named = entities.join(asked, "entity_id", "left").withColumn("_final", F.lower(F.coalesce("new_name", "name")))
    w = Window.partitionBy("_final").orderBy(F.col("new_name").isNotNull(), "entity_id")
    named = named.withColumn("target_id", F.first("entity_id").over(w))
    map_ = named.select("entity_id", "target_id")
    kept = named.where("entity_id = target_id").withColumn("name", F.coalesce("new_name", "name")).drop("new_name", "_final", "target_id")
    docs = documents.join(map_, "entity_id")
    first = Window.partitionBy("target_id", "path").orderBy(F.col("entity_id") != F.col("target_id"), "document_id")
    docs = docs.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("entity_id", F.col("target_id")).drop("_n", "target_id")
    return kept, docs


# How good a manifest's status is.
STATUS = ["stub_unverified", "stub", "verified", "probed", "banked"]


def merge_manifests(manifests: DataFrame) -> DataFrame:
    """One manifest a key (key, ord, name, aliases, city, state, platform, status, documents array<struct<sha256, size>>).

    The first value of a scalar stays and a different later one is a conflict; the platform is
    the newest; aliases and documents (by sha256, first kept) are united; the best status wins.
    All of it combines on the map side: no more of a key is gathered than its merged manifest holds.
    """
    order = F.struct("ord", "name")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    when = lambda c: F.when(filled(c).isNotNull(), order)
    others = lambda c: F.greatest(F.size(F.collect_set(filled(c))) - 1, F.lit(0))
    rank = F.array(*(F.lit(s) for s in STATUS))
    scalars = manifests.groupBy("key").agg(
        F.min_by("name", order).alias("name"),
        F.collect_set("name").alias("_names"),
        F.min_by(filled("city"), when("city")).alias("city"),
        F.min_by(filled("state"), when("state")).alias("state"),
        F.max_by(filled("platform"), when("platform")).alias("platform"),
        F.element_at(rank, F.greatest(F.lit(1), F.max(F.array_position(rank, F.col("status")))).cast("int")).alias("status"),
        (others("city") + others("state")).cast("int").alias("conflicts"),
    )
    given = manifests.select("key", F.explode("aliases").alias("alias")).groupBy("key").agg(F.collect_set("alias").alias("_given"))
    found = manifests.select("key", "ord", F.posexplode("documents").alias("pos", "d"))
    found = found.groupBy("key", "d.sha256").agg(F.min(F.struct("ord", "pos", "d")).alias("f")).groupBy("key").agg(F.array_sort(F.collect_list("f")).alias("_found"))
    j = scalars.join(given, "key", "left").join(found, "key", "left")
    none = F.array().cast("array<string>")
    named = F.filter(F.array_union(F.coalesce("_given", none), "_names"), lambda x: (F.coalesce(x, F.lit("")) != "") & (x != F.coalesce("name", F.lit(""))))
    docs = F.coalesce(F.transform("_found", lambda x: x["d"]), F.array().cast("array<struct<sha256:string,size:bigint>>"))
    return j.select("key", "name", F.array_sort(named).alias("aliases"), "city", "state", "platform", "status", docs.alias("documents"), "conflicts")


# Query keys of signed urls.
CREDENTIAL_KEYS = ["x-amz-signature", "x-goog-signature", "signature", "sig", "token", "expires"]


def signed_url(url: Column) -> Column:
    query = F.lower(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")))
    keys = F.transform(F.split(query, "&"), lambda kv: F.element_at(F.split(kv, "="), 1))
    return F.arrays_overlap(keys, F.array(*(F.lit(k) for k in CREDENTIAL_KEYS)))


def _repeated(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """(_again, _first): each key that more than one row has, with its least ``order``; broadcast if that is small, which is counted while the plan is built."""
    n = rows.groupBy(key.alias("_again")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return broadcast_if_small(n.where("_n > 1").drop("_n"))


def filter_leads(leads: DataFrame, known: DataFrame) -> DataFrame:
    """leads (ord, url) with a reason: signed_url, known_url, duplicate_in_run or kept, in that order.

    Of one url the lead of the least ``ord``, which is unique, is kept; a url of any number of leads is never gathered.
    """
    k = known.select(F.lower("url").alias("_known")).distinct()
    rows = leads.join(k, F.lower("url") == F.col("_known"), "left").withColumn("_signed", signed_url(F.col("url")))
    fresh = ~F.col("_signed") & F.col("_known").isNull()
    again = _repeated(rows.where(fresh), F.lower("url"), "ord")
    rows = rows.join(again, F.lower("url").eqNullSafe(F.col("_again")) & fresh, "left")
    reason = F.when(F.col("_signed"), "signed_url").when(F.col("_known").isNotNull(), "known_url").when(F.col("ord") > F.col("_first"), "duplicate_in_run").otherwise("kept")
    return rows.withColumn("reason", reason).drop("_known", "_signed", "_again", "_first")


def reason_counts(filtered: DataFrame) -> DataFrame:
    """(reason, leads, urls): how many leads each step of the filter took, and how many different urls."""
    urls = filtered.groupBy("reason", F.lower("url").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    return urls.groupBy("reason").agg(F.sum("n").alias("leads"), F.count("u").alias("urls"))


def reject_reason(rows: DataFrame, live: DataFrame, page_cap: int = 200, scanned_cap: int = 25) -> DataFrame:
    """Why a prepared document (sha256, category, pages, scanned, ord) is not taken, or null.

    In order: live already, prepared twice (all but the least ``ord``, which is unique), personal data, junk, too many
    pages, too many scanned pages, unsupported. Copies of one file are never gathered.
    """
    from ..functions.text import JUNK, PERSONAL, VALID

    l = live.select(F.col("sha256").alias("_live")).distinct()  # noqa: E741
    again = F.col("ord") > F.col("_first")
    j = rows.join(l, F.col("sha256") == F.col("_live"), "left").join(_repeated(rows, F.col("sha256"), "ord"), F.col("sha256").eqNullSafe(F.col("_again")), "left")
    why = (
        F.when(F.col("_live").isNotNull(), "duplicate_live")
        .when(again, "duplicate_prepared")
        .when(F.col("category").isin(PERSONAL), "pii")
        .when(F.col("category").isin(JUNK), "junk")
        .when(F.col("pages") > page_cap, "page_cap")
        .when(F.col("scanned") & (F.col("pages") > scanned_cap), "scanned_cap")
        .when(~F.coalesce(F.col("category").isin(VALID), F.lit(False)), "unsupported_category")
    )
    return j.withColumn("reason", why).drop("_live", "_again", "_first")


def representative(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each group, with the group's size as units; combined on the map side, so no group is gathered."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.min_by(whole, order).alias("_r"), F.count(F.lit(1)).alias("units")).select("_r.*", "units")


def signature_groups(rows: DataFrame, least: int = 4) -> DataFrame:
    """Rows (entity_id, name) that share a signature of ``least`` characters or more with another, with its number of rows; groups are not gathered."""
    g = rows.select("entity_id", names.signature(F.col("name")).alias("signature")).where(F.length("signature") >= least)
    n = g.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return g.join(broadcast_if_small(n), "signature")


def crosswalk(rows: DataFrame, zips: DataFrame) -> DataFrame:
    """The county of the principal ZIP, else of the mailing ZIP; the crosswalk (zip, county) joins twice."""
    a = zips.select(F.col("zip").alias("_z1"), F.col("county").alias("_c1"))
    b = zips.select(F.col("zip").alias("_z2"), F.col("county").alias("_c2"))
    return rows.join(a, F.substring("principal_zip", 1, 5) == F.col("_z1"), "left").join(b, F.substring("mailing_zip", 1, 5) == F.col("_z2"), "left").withColumn("county", F.coalesce("_c1", "_c2")).drop("_z1", "_c1", "_z2", "_c2")


def pick_city(cities: list[str], states: list[str], home: str) -> Column:
    """The first city whose state is blank or the home state, else the first that is not empty."""
    fit = [F.when((F.coalesce(F.col(c), F.lit("")) != "") & F.upper(F.coalesce(F.col(s), F.lit(""))).isin("", home), F.col(c)) for c, s in zip(cities, states, strict=True)]
    return F.coalesce(*fit, *(F.nullif(F.col(c), F.lit("")) for c in cities))


def pick_zip(columns: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"^\s*(\d{5})", 1), F.lit("")) for c in columns))


def harvest_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, url, text) of the absolute http links of pages (page_id, url, html), first of each url.

    Relative links need the rules of URL joining, so this runs in Arrow batches.
    """
    import html as entities
    import re
    from urllib.parse import urljoin, urlparse

    anchor = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>((?:[^<]|<(?!/?a\b))*+)", re.I)
    tag = re.compile(r"<[^>]*>")

    def run(batches):
        for b in sliced(batches):
            rows = []
            for page_id, base, text in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                seen = set()
                for m in anchor.finditer(text or ""):
                    href = entities.unescape(m[1] or m[2] or m[3] or "").strip()
                    if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
                        continue
                    try:
                        url = urljoin(base or "", href)
                        ok = urlparse(url).scheme in ("http", "https")
                    except ValueError:
                        continue
                    if ok and url not in seen:
                        seen.add(url)
                        rows.append((page_id, len(seen) - 1, url, " ".join(entities.unescape(tag.sub("", m[4])).split())))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "ord", "url", "text"])

    narrow(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, ord long, url string, text string")


# Words of governing documents and of pages that list them, urls to skip.
GOVERNING = r"(?i)(declaration|covenant|ccr|cc&r|bylaw|by-law|articles|incorporat|rules|regulation|guideline|amendment|resolution|architectural|governing)"
LISTING = r"(?i)(document|library|forms|governing|resources|bylaws|covenants)"
SKIP = r"(?i)(login|signin|logout|facebook\.com|twitter\.com|instagram\.com|\.(?:jpg|jpeg|png|gif|svg|css|js)(?:\?|$))"


def pdf_candidates(links: DataFrame) -> DataFrame:
    """Links to PDF files, or whose url or text names a governing document."""
    is_pdf = F.regexp_replace(F.lower("url"), r"[?#].*$", "").endswith(".pdf")
    return links.where((is_pdf | F.col("url").rlike(GOVERNING) | F.col("text").rlike(GOVERNING)) & ~F.col("url").rlike(SKIP)).withColumn("is_pdf", is_pdf)


def doc_subpages(links: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` links of a page to pages of its host that list documents, in page order."""
    host = lambda c: F.lower(F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")))
    base = pages.select("page_id", host(F.col("url")).alias("_host"))
    where = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("/")).rlike(LISTING) | F.col("text").rlike(LISTING)
    rows = links.join(base, "page_id").where((host(F.col("url")) == F.col("_host")) & where & ~F.col("url").rlike(SKIP) & ~F.regexp_replace(F.lower("url"), r"[?#].*$", "").endswith(".pdf"))
    w = Window.partitionBy("page_id").orderBy("ord")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("_host")


def crawl(seeds: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """Urls within ``depth`` links of the seeds, with the fewest links to each; one join a step."""
    found = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    edge = links.select(F.col("from_url"), F.col("to_url")).distinct()
    front = found
    for d in range(1, depth + 1):
        front = edge.join(front, edge["from_url"] == front["url"]).select(F.col("to_url").alias("url")).distinct().join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        found = found.unionByName(front)
    return found


# Words that a name's base leaves out.
BASE_DROPS = r"(?i)\b(the\s+)?(condo|condominium|condominiums|condos|coop|co-?op|cooperative|cooperatives|hoa|association|apartments?|apts?)\b"


def query_variants(seeds: DataFrame) -> DataFrame:
    """Up to seven search texts for each seed (seed_id, name, state, state_name): four with the quoted base of
    the name, if that is another name of four characters or more, two with the whole, one with the plain base."""
    base = F.btrim(F.regexp_replace(F.regexp_replace("name", BASE_DROPS, " "), r"\s+", " "), F.lit(" ,.-"))
    b, n, s, whole = (F.col(c) for c in ("_base", "name", "state", "state_name"))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    other = F.length(b) >= 4
    based = other & (F.lower(b) != F.lower(n))
    variants = [
        F.when(based, text('"', b, '" "', whole, '" "Condominium Association"')),
        F.when(based, text('"', b, '" "', s, '" "Condominium" Bylaws filetype:pdf')),
        F.when(based, text('"', b, ' Condominium" "', s, '" Declaration')),
        F.when(based, text('"', b, '" "', s, '" "Unit Owners Association"')),
        text('"', n, '" "', whole, '" filetype:pdf'),
        text('"', n, '" "', s, '" Bylaws'),
        F.when(other, text(b, ' "Washington" "', s, '" Condominium Declaration filetype:pdf')),
    ]
    rows = seeds.withColumn("_base", base)
    return rows.select("seed_id", F.posexplode(F.filter(F.array(*variants), lambda v: v.isNotNull())).alias("variant", "search"))
