"""Ordered rules over names, links and registry rows.  Rule tables are parameters."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import any_of, let

# States and their codes.
STATES = {
    "california": "CA", "north carolina": "NC", "south carolina": "SC", "virginia": "VA", "georgia": "GA", "texas": "TX", "florida": "FL", "new york": "NY", "pennsylvania": "PA", "maryland": "MD",
    "new jersey": "NJ", "connecticut": "CT", "massachusetts": "MA", "rhode island": "RI", "vermont": "VT", "new hampshire": "NH", "maine": "ME", "delaware": "DE", "colorado": "CO", "utah": "UT",
    "arizona": "AZ", "nevada": "NV", "washington": "WA", "oregon": "OR", "idaho": "ID", "montana": "MT", "wyoming": "WY", "new mexico": "NM", "illinois": "IL", "indiana": "IN", "ohio": "OH",
    "michigan": "MI", "wisconsin": "WI", "minnesota": "MN", "iowa": "IA", "missouri": "MO", "kansas": "KS", "nebraska": "NE", "south dakota": "SD", "north dakota": "ND", "oklahoma": "OK",
    "arkansas": "AR", "louisiana": "LA", "mississippi": "MS", "alabama": "AL", "tennessee": "TN", "kentucky": "KY", "west virginia": "WV", "hawaii": "HI", "alaska": "AK",
}
# Endings that make a name an association's; words that hint at one.
ENTITY_ENDING = r"(?i)\b(condo|condominium|condominiums|cooperative|coop|co-?op|association|council|homeowners?|owners|townhomes?|townhouse|villas?|tower|apartments?|units?\s+owners)\b\s*(?:,?\s*inc\.?|,?\s*l\.?l\.?c\.?)?\.?\s*$"
ENTITY_HINT = r"(?i)\b(association|owners|homeowners|condominiums?|condos?|coop|cooperative|council|townhomes?|townhouse|villas?|tower|apartments?|estates|property\s+owners?|hoa|h\.o\.a\.|poa)\b"
# Names of associations that the patterns below would take for junk.
SAFE_NAMES = [
    "BELLA VISTA TOWNHOUSE ASSOCIATION", "ALASKAN BAY OWNERS ASSOCIATION", "EASTRIDGE 4 CONDOMINIUM ASSOCIATION", "POTTER CREEK HOMEOWNER ASSOCIATION", "PALISADES HOMEOWNERS ASSOCIATION, INC.",
    "WINDJAMMER CONDOMINIUM ASSOCIATION, INC.",
]
# Patterns of junk that win over an association's ending, in order, without case.
SURE_JUNK = [
    r"\bSquarespace\b", r"\bDocuWare\b", r"^BOG!", r"^[A-Z]\s+[A-Z]\s+[A-Z][a-z]?\s*$", r"^Th\s+(?:Restrictions|Phase|Property|Owner|Member)\b", r"^Sr\s+HOA\s*$", r"^Of [A-Z][a-z]+ for\s+[A-Z]",
    r"^OF [A-Z]+ FOR\s+[A-Z]", r"^Of Condominium\s+\.{2,}", r"^conditions and\b", r"^of\s*,\s+conditions\b", r"^Beckley Springs Cc Rs\b", r"^Council-[A-Z][a-z]+-", r"^The-[A-Z][a-z]+-[A-Z]",
    r"^MeadowCreek-", r"^Recorder of [A-Z][a-z]+\s+County", r"^Office of the Register of Deeds", r"^Notary Public for State", r"^Certificate of Amendment to", r"\bCondominium Property Act\b",
    r"\bPlaintiff cites\b", r"\bHOAs by changing\b", r"\bHomeowner Information and\b", r"\bLifestyle Clubhouse\b", r"\bSite Map Ownership Opportunities\b", r"\bComplica\s+Tion\b",
    r"\bDermatological Association\b", r"\bParks and Recreation Association\b", r"\bCc Rs(?:\s+Redline)?\s*$", r"^COLLECTIONS RESOLUTION\b", r"\b\d{3,5}\s+TOWNHOMES\s+HOA\s*$",
    r"\bConditions and Oak Harbor\b", r"\bTerm\.\s+of\b", r"\bRestrictive and for\b",
]
# Patterns of junk that an association's ending wins over, in order, without case.
LIKELY_JUNK = [
    r"^\d+ of \d+\b", r"^\d+\.\s+", r"^\d{4}r-?\d", r"^Doc[#]", r"\bRecording Dist", r"\bRecorded HOA$", r"\.pdf HOA$", r"^Of\s+", r"^of [A-Z]", r"^of\s*,", r"^of \d",
    r"\b(City|Town|Municipality|Borough) of\b", r"\bCounty of [A-Z]", r"\bCity and (Borough|County) of\b", r"\b(Code|Ordinance|Zoning|Subdivision Regulations?|Submittal Guidelines)\b",
    r"\b(Land Development|Maintenance Agreement|Growth Area|Overlay District|Comprehensive Plan)\b", r"\bUnified Development\b", r"\bChapter Five\b", r"\bChapter Two\b", r"\bCHAPTER [V\d]",
    r"\bArticle [VIX\d]+\b", r"\bAo No\.", r"\bPlanning (Department|Commission|Board)\b", r"\bCurve Table\b", r"\bBLOCKS \d+-\d+\b", r"\bCertificate of Dedication\b",
    r"\bDEED OF DEDICATION AND RESTRICTIVE\b", r"\bBill of Assurance\b", r"\bWilderness Area\b", r"\bForest Service\b", r"\bConservation Easement\b", r"\bIrrigation District\b", r"\bGrazing\b",
    r"\bFishing Access\b", r"\bAcequia\b", r"\bENERGY (INC|CORP)\b", r"\bWater (Association|Authority|District)\b", r"\bBar Rag\b", r"\bColumns Featured\b", r"\bIn This Issue\b",
    r"\bThree secrets\b", r"\bForeclosure\b", r"\bSchool (District|Board)\b", r"\bAffordable Housing\b", r"\bHOUSING (FINANCE CORP|AUTHORITY)\b", r"\bProperty Trust, Inc\b", r"\bForm 10[-]?[KQ]\b",
    r"\bSEC Filing\b", r"\bMERS\b", r"\bIRS\b", r"\bTitle Insurance\b", r"\bTitle Company\b", r"\bAbstract Company\b", r"\bClosing Company\b", r"\bHOMEOWNER.S POLICY\b", r"\bAttorney",
    r"\bLAW UPDATE\b", r"\bLaw Update\b", r"\bSection Law\b", r"\bAnnual Report\b", r"\bLandmark Nomination\b", r"\bGrassroots\b", r"\bChamber of Commerce\b", r"\bCommunity Health\b",
    r"\bRecorder\b", r"\bRegister of Deeds\b", r"\bTransfer Fees\b", r"\bAccess Agreement\b", r"\bAgreement HOA$", r"\bExhibit [A-Z]\b", r"\bDue Diligence\b", r"\b\.xlsx\b",
    r"\bRequest for (Proposal|Quote)\b", r"\bOpen Records\b", r"^Candi Ussery\b", r"^Becky\b", r"\bilil\b", r"\billil\b", r"\bH OA$", r"\bSeconp\b", r"^Conditions?$", r"^Restrictions?$",
    r"^Restrictive\b", r"^Protective\b", r"^PROTECTIVE\b", r"^Subdivision\b", r"^Untitled\b", r"^Test\b", r"^[A-Z][a-z]+$", r"^Powder Ridge$", r"^Bentonville$", r"^Northbrook$",
    r"^Subdivision HOA$", r"^\d{3,5}\s+\w+\s+(Street|Road|Avenue|Drive|Lane|Way|Place|Boulevard)\b",
]
# Patterns of document fragments that were taken for names, without case.
FRAGMENTS = [
    r"\bStormwater\s+Drainage\b", r"\bZONING\s+UPDATE\b", r"^R\s+E\s+S\s+O\s+L\s+U\s+T\s+I\s+O\s+N", r"^Summary\s+of\b", r"^Staff\s+Analysis",
    r"^January\s+\d+,?\s+\d{4}", r"^February\s+\d+,?\s+\d{4}", r"^March\s+\d+,?\s+\d{4}", r"^Madison\s+County\s+Zoning", r"\bSloa\s+Bulletin\b",
    r"\bBoard\s+of\s+County\s+Commissioners\b", r"\bTo\s+Whom\s+It\s+May\s+Concern\b",
]
REGISTRY_STATES = ["HI", "DC"]


def matched_pattern(name: Column, patterns: list[str]) -> Column:
    """The first pattern found in a name, without case, or null.

    One test of all of them comes first: most names match none.
    """
    any_one = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    found = reduce(lambda w, p: w.when(name.rlike(f"(?i){p}"), F.lit(p)), patterns[1:], F.when(name.rlike(f"(?i){patterns[0]}"), F.lit(patterns[0])))
    return F.when(name.rlike(any_one), found)


def non_entity(name: Column, safe: list[str] = SAFE_NAMES, sure: list[str] = SURE_JUNK, likely: list[str] = LIKELY_JUNK) -> Column:
    """The pattern by which a name is no association's; null if it may be one.

    In order: empty, safe names, patterns that win over anything, association endings, the rest.
    """
    n = F.coalesce(name, F.lit(""))
    certain = matched_pattern(n, sure)
    return F.when(n == "", F.lit("empty_name")).when(F.upper(n).isin(safe), F.lit(None)).otherwise(F.coalesce(certain, F.when(~n.rlike(ENTITY_ENDING), matched_pattern(n, likely))))


def keeps_entity(name: Column, state: Column) -> Column:
    """Whether a name is an entity's: no document fragment, and from a public registry or hinting at an association."""
    n = F.coalesce(name, F.lit(""))
    return ~n.rlike("(?i)" + "|".join(FRAGMENTS)) & (F.upper(F.coalesce(state, F.lit(""))).isin(REGISTRY_STATES) | n.rlike(ENTITY_HINT))


def restore_or_keep(name: Column, state: Column) -> Column:
    return F.when(keeps_entity(name, state), "restore").otherwise("keep_deleted")


def clear_or_delete(name: Column, state: Column) -> Column:
    return F.when(keeps_entity(name, state), "clear_docs").otherwise("delete_entity")


def verify_state(text: Column, expected: Column, compat: bool = False) -> Column:
    """struct(state, confidence) from a first page.

    The first state named in the text; only the expected one if there is one, then with high
    confidence, else low without a hit.  By default names are whole words, the longest first;
    ``compat`` looks for names anywhere in the order of the table.
    """
    lower, length = F.lower(F.coalesce(text, F.lit(""))), F.length(F.coalesce(text, F.lit("")))
    order = list(STATES) if compat else sorted(STATES, key=lambda s: (-len(s), s))
    # one pass over the text; the longest name is tried first at each word, so it hides the shorter one inside it
    named = lower if compat else F.array_distinct(F.regexp_extract_all(lower, F.lit(rf"\b({'|'.join(order)})\b"), F.lit(1)))
    there = lambda n, s: n.contains(s) if compat else F.array_contains(n, s)
    found = let(named, lambda n: first_match_of([(there(n, s) & (expected.isNull() | (expected == STATES[s])), STATES[s]) for s in order]))

    def judged(found: Column) -> Column:
        state = F.when(length < 10, F.lit(None)).otherwise(F.coalesce(found, expected))
        sure = F.when((length < 10) | found.isNull(), "low").when(expected.isNotNull(), "high").otherwise("medium")
        return F.struct(state.alias("state"), sure.alias("confidence"))

    return let(found, judged)


def first_match_of(rules: list[tuple[Column, str]]) -> Column:
    return reduce(lambda w, r: w.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))


def state_hint(text: Column, state: str, name: str) -> Column:
    return F.coalesce(text.rlike(rf"(?i)\b({state}|{name})\b"), F.lit(False))


# Words of search results that are, and are not, governing documents; hosts that hold none.
RESULT_GOOD = r"(?i)(bylaws?|by-laws?|declarations?|cc&?rs?|covenants?|restrictions?|rules?\s+and\s+regulations?|articles?\s+of\s+incorporation|amend(?:ment|ed)?|master\s+deed|condominium\s+(?:declaration|bylaws|association|act)|unit\s+owners?\s+association|cooperative\s+(?:bylaws|declaration)|offering\s+plan|governing\s+documents?|hoa\s+documents?|declaration\s+of\s+condominium|public\s+offering\s+statement)"
RESULT_BAD = r"(?i)\b(listing|brochure|appraisal|prospectus|annual\s+report|press\s+release|news|article|blog|review|inspection\s+report|invoice|receipt|coupon|estoppel|closing\s+statement|tax\s+return|990|sale\s+sheet|floor\s+plan|menu|registration\s+form|application\s+form)\b"
BAD_HOSTS = r"(?i)(casetext|courtlistener|justia|scholar\.google|ssrn|jstor|papers\.ssrn|law\.cornell|leagle|casemine|govinfo\.gov/content/pkg|congress\.gov|pacer|lexis|westlaw|bizjournals|reuters|bloomberg|nytimes|washingtonpost|wsj|cnn|marketwatch|foxbusiness|scribd|issuu|yumpu|dokumen|pdfcoffee|fliphtml5|zillow|redfin|trulia|realtor|homes\.com|55places|apartments|facebook|instagram|reddit|nextdoor|hoamanagement|hopb|propublica|sec\.gov/edgar|bbb\.org|yelp|indeed|glassdoor|academia\.edu|researchgate)"


def governing_result(link: Column, title: Column, snippet: Column) -> Column:
    """Whether a search result is a PDF of a governing document: no junk host, no junk word, a governing word."""
    lower = F.lower(F.coalesce(link, F.lit("")))
    is_pdf = F.regexp_replace(lower, r"[?#].*$", "").endswith(".pdf") | lower.contains("format=pdf")
    hay = F.concat_ws(" ", link, title, snippet)
    return is_pdf & ~lower.rlike(BAD_HOSTS) & ~hay.rlike(RESULT_BAD) & hay.rlike(RESULT_GOOD)


# What each bucket of law adds for words in its context.
BUCKET_BONUS = {
    "proxy_voting": [(["proxy"], 20), (["vote", "voting"], 8)],
    "nonprofit_corp_overlay": [(["nonprofit", "not-for-profit"], 20), (["corporation"], 8), (["proxy"], 6)],
    "electronic_transactions_overlay": [(["electronic signature"], 22), (["transactions act", "ueta"], 16), (["facsimile", "remote communication"], 8)],
}


def bucket_score(bucket: str, url: Column, label: Column, keywords: list[str], state_slug: str | None = None) -> Column:
    """How well a link fits a bucket of law: keywords (phrases count double), bonus words, and its path."""
    context = F.concat_ws(" ", F.lower(url), F.lower(label))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    parts = [F.when(context.contains(k), 6 if " " in k else 3).otherwise(0) for k in keywords]
    parts += [F.when(any_of(context, words), n).otherwise(0) for words, n in BUCKET_BONUS.get(bucket, [])]
    if state_slug:
        parts.append(F.when(path.endswith(f"/codes/{state_slug}/"), -20).otherwise(0))
    parts += [F.when(F.length(path) - F.length(F.replace(path, F.lit("/"))) <= 2, -6).otherwise(0), F.when(path.contains("/chapter") | path.contains("/article"), 3).otherwise(0), F.when(path.contains("/section") | path.contains("section-"), 6).otherwise(0)]
    return reduce(lambda a, b: a + b, parts)


def community_type(text: Column, hints: dict[str, list[str]]) -> Column:
    """The first community type one of whose hints stands in the text, else hoa."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return first_match_of([(any_of(lower, words), kind) for kind, words in hints.items()]).otherwise("hoa")


# Phrases a compact name drops, in order.
COMPACT_DROPS = ["homeowners association", "homeowners", "home owners association", "homes association", "property owners association", "owners association", "community association", "condominium association", "association", "hoa", "inc.", "inc"]


def compact_name(name: Column) -> Column:
    n = F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("&"), F.lit(" and ")))
    for p in COMPACT_DROPS:
        n = F.replace(n, F.lit(p), F.lit(" "))
    return F.initcap(F.trim(F.regexp_replace(n, r"\s+", " ")))


# Kinds of places whose outlines are neighbourhoods.
OUTLINES = ["neighbourhood", "neighborhood", "residential", "suburb", "quarter", "hamlet", "village"]


def geocode_score(geometry: Column, kind: Column, group: Column, importance: Column) -> Column:
    """How good a geocoder's result is: an outline +100, another geometry +20, a neighbourhood +35, a place +20, administrative -50, importance up to 15."""
    k, g = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(group, F.lit("")))
    outline = F.when(geometry.isin("Polygon", "MultiPolygon"), 100).when(geometry.isNotNull(), 20).otherwise(0)
    return outline + F.when(k.isin(OUTLINES), 35).otherwise(0) + F.when(g == "place", 20).otherwise(0) - F.when((g == "boundary") & (k == "administrative"), 50).otherwise(0) + F.least(F.lit(15), F.coalesce((importance * 20).cast("int"), F.lit(0)))


def best_outline(results: DataFrame) -> DataFrame:
    """For each query its best outline (query_id, ord, geometry, kind, group, importance) that is no administrative boundary."""
    k, g = F.lower("kind"), F.lower("group")
    fit = results.where(F.col("geometry").isin("Polygon", "MultiPolygon") & ~((g == "boundary") & (k == "administrative")) & (k.isin(OUTLINES) | (g == "place")))
    scored = fit.withColumn("score", geocode_score(F.col("geometry"), F.col("kind"), F.col("group"), F.col("importance")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# Registry names that are, and are not, associations; types by name and by entity type.
REGISTRY_NAME = [
    r"CONDOMINIUM(S)?", r"CONDO(S)?", r"HOMEOWNERS?\s+ASSOC(IATION)?S?", r"HOME\s+OWNERS?\s+ASSOC(IATION)?S?", r"HOA", r"OWNERS?\s+ASSOC(IATION)?S?", r"COMMUNITY\s+ASSOC(IATION)?S?",
    r"PROPERTY\s+OWNERS?\s+ASSOC(IATION)?S?", r"TENANTS?\s+CORP(ORATION)?", r"TENANTS?\s+CO\-?OP(ERATIVE)?", r"HOUSING\s+CORP(ORATION)?", r"HOUSING\s+CO\-?OP(ERATIVE)?",
    r"COOPERATIVE\s+APART(MENT)?S?", r"APARTMENT\s+CORP(ORATION)?", r"APARTMENT\s+CO\-?OP(ERATIVE)?", r"MUTUAL\s+HOUSING", r"RESIDENTIAL\s+ASSOC(IATION)?S?", r"TOWNHOUSE\s+ASSOC(IATION)?S?",
    r"TOWN\s*HOUSE\s+ASSOC(IATION)?S?", r"TOWNHOMES?\s+ASSOC(IATION)?S?", r"VILLAGE\s+ASSOC(IATION)?S?", r"GARDEN\s+APART(MENT)?S?", r"HDFC", r"OWNERS,?\s+(INC|CORP|LLC|LTD)",
]
REGISTRY_REJECT = [
    r"CHURCH", r"MINISTRY", r"TEMPLE", r"SYNAGOGUE", r"MOSQUE", r"CONGREGATION", r"CATHEDRAL", r"PARENT\s+TEACHER", r"PTA", r"PTO", r"ALUMNI", r"VETERAN", r"VFW", r"AMERICAN\s+LEGION",
    r"BOOSTER", r"ATHLETIC", r"YACHT\s+CLUB", r"GOLF\s+CLUB", r"FRATERN", r"SORORITY", r"MASONIC", r"LODGE", r"ROTARY", r"KIWANIS", r"LIONS\s+CLUB", r"MEDICAL\s+ASSOC", r"DENTAL\s+ASSOC",
    r"HOSPITAL", r"BAR\s+ASSOC", r"CHAMBER\s+OF", r"BUSINESS\s+IMPROVEMENT\s+DIST", r"NEIGHBORHOOD\s+IMPROVEMENT", r"MERCHANTS?\s+ASSOC", r"LANDLORDS?\s+ASSOC", r"REALTORS?\s+ASSOC",
    r"REALTY\s+ASSOC", r"BLOCK\s+ASSOC", r"TENANTS?\s+UNION", r"TENANTS?\s+ASSOC", r"MUSEUM", r"FOUNDATION", r"SCHOLARSHIP",
]
CONDO = r"\bCONDOMINIUM(S)?\b|\bCONDO(S)?\b|\bC\.?O\.?A\.?\b"
COOP = r"\bHDFC\b|\bTENANTS?\s+CORP\b|\bAPARTMENT\s+CORP\b|\bCOOPERATIVE\b|\bCO\-?OP\b|\bMUTUAL\s+HOUSING\b|\bHOUSING\s+CORP\b|\bHOUSING\s+DEVELOPMENT\s+FUND\b"
OWNERS = r"\bOWNERS,?\s+(INC|CORP|LLC|LTD)\b"


def registry_type(name: Column, entity_type: Column) -> Column:
    n, t = F.upper(name), F.upper(F.coalesce(entity_type, F.lit("")))
    return F.when(n.rlike(CONDO) | t.contains("DOMESTIC CONDOMINIUM"), "condo").when(n.rlike(COOP) | any_of(t, ["COOPERATIVE CORPORATION", "HOUSING DEVELOPMENT FUND", "LIMITED-PROFIT HOUSING"]) | n.rlike(OWNERS), "coop").otherwise("hoa")


def registry_cascade(rows: DataFrame, kept_types: list[str]) -> DataFrame:
    """Registry rows (ord, name, entity_type) with a reason (written, or why not) and the association's type.

    Of the rows of one name that pass the rest the one of the least ``ord``, which is unique, is written. Only the
    least of each name is looked for, and joined back, so a name of any number of rows is never gathered.
    """
    n = F.trim(F.coalesce("name", F.lit("")))
    one_of = lambda ps: n.rlike(rf"(?i)\b({'|'.join(ps)})\b")
    stage = F.when(n == "", "skip_empty_name").when(~any_of(F.upper(F.coalesce("entity_type", F.lit(""))), kept_types), "skip_entity_type").when(~one_of(REGISTRY_NAME), "skip_no_keyword").when(one_of(REGISTRY_REJECT), "skip_rejected_pattern")
    typed = lambda r: r.withColumn("metadata_type", F.when(F.col("reason") == "written", registry_type(n, F.col("entity_type")))).drop("_stage", "_name")
    rows = rows.withColumn("_stage", stage).withColumn("_name", F.regexp_replace(F.upper(n), r"\s+", " "))
    good = rows.where("_stage is null")
    first = good.groupBy("_name").agg(F.min("ord").alias("_first"))
    kept = good.join(first, "_name").withColumn("reason", F.when(F.col("ord") == F.col("_first"), "written").otherwise("skip_dup_name")).drop("_first")
    return typed(rows.where("_stage is not null").withColumn("reason", F.col("_stage"))).unionByName(typed(kept))


def stage_counts(rows: DataFrame) -> DataFrame:
    """(reason, rows): how many rows of a cascade were written, and refused for each reason."""
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


# Abbreviations that a mailing name spells out.
ABBREVIATIONS = [(r"\bAssn\b", "Association"), (r"\bAssoc\b", "Association"), (r"(?i)\bTwnhm\b", "Townhomes"), (r"(?i)\bTh\b", "Townhomes"), (r"(?i)\bTerr\b", "Terrace"), (r"(?i)\bMgmt\b", "Management"), (r"(?i)\bCondo\b", "Condominium"), (r"(?i)\bDev\b", "Development")]
CONNECTORS = ["of", "the", "at", "on", "and", "de", "la", "del", "in", "by", "for"]


def mailing_name(raw: Column) -> Column:
    """A mailing name without care-of parts and legal suffix; one in capitals is cased and its abbreviations spelt out."""
    s = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\"'"))
    s = F.regexp_replace(s, r"(?i)^(C/O|CO|CARE\s+OF)\s+", "")
    s = F.regexp_replace(s, r"(?i)\s+(C/O|C\.O\.|C\s+O|CARE\s+OF)\s+.*$", "")
    s = F.regexp_replace(s, r"(?i)\s*,?\s*(INC|LLC|CORP|LTD|LP|N\.?P\.?|CO)\.?\s*$", "")
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    cased = F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(CONNECTORS), F.lower(w)).when(w.rlike(r"^(II|III|IV|V|VI|VII|VIII|IX|X)$|^\d"), w).otherwise(F.initcap(w))), " ")
    for p, by in ABBREVIATIONS:
        cased = F.regexp_replace(cased, p, by)
    return F.when((s == F.upper(s)) & s.rlike(r"\p{L}"), cased).otherwise(s)


# Words of places that communities are named after; words of names that are none.
COMMUNITY = r"(?i)\b(estates?|creek|lakes?|hills?|ridge|woods?|villas?|village|place|park|trails?|crossing|landing|farms?|meadows?|point|reserve|springs?|bend|run|grove|harbor|plantation|preserve|commons|square|trace|bay|fields?)\b"
NO_NAME = r"(?i)\b(document|untitled|godaddy|rackcdn|wordpress|county register|suite|street|overview)\b"


def lead_name(candidates: Column) -> Column:
    """The best of candidate names, the first of equals: +5 for an association, +2 for a community word, -6 for a word of no name; null below 2."""
    score = lambda c: F.when(F.lower(c).contains("association"), 5).otherwise(0) + F.when(c.rlike(COMMUNITY), 2).otherwise(0) - F.when(c.rlike(NO_NAME), 6).otherwise(0)
    clean = F.transform(candidates, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)\b(?:declaration|covenants?|conditions|restrictions?|bylaws?|rules?|regulations?|guidelines?|amendments?|recorded|final|pdf)\b", " "), r"\s+", " ")))
    fit = F.filter(clean, lambda c: F.length(c).between(5, 120))
    ranked = F.transform(fit, lambda c, i: F.struct(score(c).alias("score"), (-i).alias("first"), c.alias("name")))
    best = F.array_max(ranked)
    return F.when(best["score"] >= 2, best["name"])


def state_county(text: Column) -> Column:
    """struct(state, county): the county and state named together most often, else the state named most often; the first seen wins ties.

    A county is one to three capitalised words before "County", a comma, which may be missing, and a state in title
    case. States alone are found without regard to case.
    """
    from .text import most_mentioned

    known = STATES | {"district of columbia": "DC"}
    names = "|".join(sorted((s.title() for s in known), key=lambda s: (-len(s), s)))
    code = F.create_map(*(F.lit(x) for s, c in known.items() for x in (s, c)))
    together = rf"\b((?:[A-Z][A-Za-z'.]+\s+){{0,2}}[A-Z][A-Za-z'.]+)\s+County,?\s+({names})\b"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(together), F.lit(1)).alias("county"), F.regexp_extract_all(text, F.lit(together), F.lit(2)).alias("state"))
    real = F.filter(pairs, lambda p: p["county"].rlike("[A-Za-z]{3,}") & ~F.lower(p["county"]).isin("the", "this", "of", "and", "for", "in", "by", "on"))
    pair = most_mentioned(F.transform(real, lambda p: F.concat(F.try_element_at(code, F.lower(p["state"])), F.lit("|"), p["county"])))
    alone = most_mentioned(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b({names})\b"), F.lit(1)), lambda s: F.try_element_at(code, F.lower(s))))
    return F.struct(F.coalesce(F.substring(pair, 1, 2), alone).alias("state"), F.substring(pair, 4, 1_000_000).alias("county"))


# A city with its state and ZIP, kinds of streets, anchors that speak for and against an address.
CITY = r"\b([A-Z][\w\s.&'-]{1,40}?),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)\b"
STREET_TYPES = "Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Way|Place|Pl|Boulevard|Blvd|Court|Ct|Circle|Cir|Trail|Trl|Pike|Pkwy|Parkway|Highway|Hwy|Terrace|Ter|Square|Sq|Loop|Crescent|Cres|Run|Path|Walk"
FOR_ADDRESS = ["premises", "subject property", "located at", "known as", "commonly known", "property is", "property situated", "real property", "described as", "property address", "site address"]
AGAINST_ADDRESS = ["attorneys?", "counsel", "law offices?", "registered agent", "prepared by", "returned to", "recorder", "after recording", "mail to", "please return", "office of the secretary", "agent for service"]
STREET = rf"\b(\d{{1,6}}[A-Z]?\s+(?:[NSEW]\.?\s+)?[A-Z][\w\s.&-]{{1,40}}\b(?:{STREET_TYPES})\b\.?)"


#: Characters on each side of an address in which anchors and streets are looked for.
AROUND = 80


def _place_hits(texts: pd.Series) -> pd.Series:
    """Of each text its cities with state and ZIP, where they stand, and what stands around them."""
    import re

    find = re.compile(CITY).finditer
    hits = lambda t: [{"city": m[1].strip(), "state": m[2], "zip": m[3], "at": m.start(), "before": t[max(0, m.start() - AROUND) : m.start()], "around": t[max(0, m.start() - AROUND) : m.end() + AROUND]} for m in find(t)]
    return texts.map(lambda t: [] if t is None else hits(t))


def address_candidates(texts: DataFrame, state: str, most: int = 5) -> DataFrame:
    """Addresses in texts (doc_id, text) of one state: (doc_id, query, score, occurrences, rank), the best ``most`` of each.

    Each occurrence scores +2 with a good anchor within 80 characters and -3 with a bad one, and an address has the sum.
    Its street is the last one in the 80 characters before the city, if there is one. Repeated addresses come first,
    then those of higher score, then the first seen.
    """
    hits = F.pandas_udf(_place_hits, "array<struct<city string, state string, zip string, at int, before string, around string>>")
    # a text without five digits in a row holds no ZIP and is not sent to Python
    found = texts.where(F.col("text").rlike(r"\d{5}")).select("doc_id", F.explode(hits("text")).alias("h")).select("doc_id", "h.*").where(F.upper("state") == state.upper())
    streets = F.regexp_extract_all("before", F.lit("(?iU)" + STREET), F.lit(1))
    street = F.trim(F.try_element_at(streets, F.lit(-1)))
    place = F.concat("city", F.lit(", "), "state", F.lit(" "), "zip")
    anchored = lambda words: F.col("around").rlike("(?i)" + "|".join(words))
    score = F.when(anchored(FOR_ADDRESS), 2).otherwise(0) - F.when(anchored(AGAINST_ADDRESS), 3).otherwise(0)
    rows = found.select("doc_id", F.when(street.isNull(), place).otherwise(F.concat(street, F.lit(", "), place)).alias("query"), score.alias("score"), "at")
    rows = rows.groupBy("doc_id", "query").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("occurrences"), F.min("at").alias("at"))
    w = Window.partitionBy("doc_id").orderBy((F.col("occurrences") >= 2).desc(), F.desc("score"), "at")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("at")
