"""Texts: excerpts, quality, personal data, document categories, HTML, sections, sentences, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHARS = "[A-Za-z]"


def any_of(lower: Column, terms: list[str]) -> Column:
    """Whether a text holds any of the terms. A term that holds another one is not searched for."""
    least = [t for t in dict.fromkeys(terms) if not any(u in t for u in terms if u != t)]
    return reduce(lambda a, b: a | b, (lower.contains(t) for t in least))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The label of the first pattern found."""
    out = F.when(text.rlike(rules[0][0]), F.lit(rules[0][1]))
    for pattern, label in rules[1:]:
        out = out.when(text.rlike(pattern), F.lit(label))
    return out if otherwise is None else out.otherwise(otherwise)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def excerpt(text: Column, n: int = 280) -> Column:
    """The first ``n`` characters on one line, with dots if there is more."""
    flat = F.translate(F.substring(text, 1, n), "\n", " ")
    return F.when(F.length(text) > n, F.concat(flat, F.lit("..."))).otherwise(flat)


# What stands around a word, and what a real word looks like.
AROUND = ".,;:()[]{}\"'!?"
REAL_WORD = "^[a-z][a-z'-]{1,18}[a-z]$|^[a-z]$"


def word_counts(text: Column) -> Column:
    """struct(real, tokens): tokens that look like words, and all tokens."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda t: t != "")
    bare = F.transform(tokens, lambda t: F.lower(F.btrim(t, F.lit(AROUND))))
    return F.struct(F.size(F.filter(bare, lambda t: t.rlike(REAL_WORD))).cast("long").alias("real"), F.size(tokens).cast("long").alias("tokens"))


def ocr_garbled(real: Column, tokens: Column, least_tokens: int = 200, ratio: float = 0.60) -> Column:
    return (tokens >= least_tokens) & (real / tokens < ratio)


# Patterns of personal data.
SSN = r"(?<!\d)(?!(?:19|20)\d{2})[0-8]\d{2}[-\s]\d{2}[-\s]\d{4}(?!\d)"
PHONE = r"(?:\(\d{3}\)\s*|\d{3}[-.\s])\d{3}[-.\s]\d{4}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
NAME_ADDRESS = r"[A-Z][a-z]+\s+[A-Z][a-z]+\s*\n\s*\d+\s+[A-Z]"
LOT_OWNER = r"(?i)(?:lot|unit|apt)\s*(?:#|no\.?|num)?\s*\d+\s*[-:,]?\s*[A-Z][a-z]+\s+[A-Z][a-z]+"
DIRECTORY = r"[A-Z][a-z]+\s+[A-Z][a-z]+\s*[-:,]?\s*(?:\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}|[a-zA-Z0-9._%+-]+@)"
SHARED_MAILBOXES = ["info@", "contact@", "admin@", "office@", "hoa@", "board@", "management@", "support@", "noreply@", "no-reply@"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def pii(text: Column) -> Column:
    """struct of the counts of each kind of personal data and the risk (none, low, high)."""
    text = F.coalesce(text, F.lit(""))
    mails = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    own = F.size(F.filter(mails, lambda m: ~reduce(lambda a, b: a | b, (F.lower(m).startswith(p) for p in SHARED_MAILBOXES)))).cast("long")
    ssn, roster, lots, directory = (_count(text, p) for p in (SSN, NAME_ADDRESS, LOT_OWNER, DIRECTORY))
    risk = F.when((ssn >= 1) | (roster >= 5) | (directory >= 3) | (lots >= 5) | (own >= 5), "high").when(own >= 3, "low").otherwise("none")
    return F.struct(ssn.alias("ssn"), own.alias("personal_emails"), roster.alias("name_address"), lots.alias("lot_owner"), directory.alias("directory"), _count(text, PHONE).alias("phones"), risk.alias("risk"))


RISKS = ["none", "low", "high"]


def worst_risk(risk: Column) -> Column:
    """The worst risk of a group of pages."""
    rank = F.max(F.array_position(F.array(*(F.lit(r) for r in RISKS)), risk))
    return F.element_at(F.array(*(F.lit(r) for r in RISKS)), rank.cast("int"))


# Document categories by file name, first match wins.
BY_FILENAME = [
    (r"cc.?r|covenant|restriction|declaration", "ccr"),
    (r"bylaw", "bylaws"),
    (r"article|incorporat", "articles"),
    (r"rule|regulation|guideline|architectural|design.?standard", "rules"),
    (r"amendment|supplement|amend|restat", "amendment"),
    (r"resolution", "resolution"),
    (r"plat|subdivision.?plat|final.?plat|recorded.?plat", "plat"),
    (r"minute|meeting", "minutes"),
    (r"budget|financial|reserve.?stud|assessment", "financial"),
    (r"insurance|certificate|management.?cert", "insurance"),
    (r"policy", "rules"),
    (r"990|tax|irs", "tax"),
    (r"court|lawsuit|judgment|lien", "court"),
    (r"agenda|city.?council|planning.?commission|reappraisal|bond", "government"),
    (r"listing|mls", "real_estate"),
    (r"ballot|voter", "ballot"),
    (r"directory|member.?list|roster", "membership_list"),
]
VALID = ["ccr", "bylaws", "articles", "rules", "amendment", "resolution", "plat", "minutes", "financial", "insurance"]
JUNK = ["court", "tax", "government", "real_estate", "unrelated"]
PERSONAL = ["membership_list", "ballot", "violation"]


def classify_filename(name: Column) -> Column:
    """struct(category, confidence), or null."""
    category = first_match(F.lower(name), BY_FILENAME)
    return F.when(category.isNotNull(), F.struct(category.alias("category"), F.lit(0.7).alias("confidence")))


# Document categories by text (lower case), in order, with their confidence.
BY_TEXT = [
    (r"declaration\s+of\s+(?:protective\s+)?(?:covenants?|restrictions?)|declaration\s+of\s+covenants?,?\s+conditions,?\s+and\s+restrictions|covenants,?\s+conditions,?\s+and\s+restrictions|conditions,?\s+covenants,?\s+and\s+restrictions|protective\s+covenants|restrictive\s+covenants|cc\s*&\s*r", "ccr", 0.95),
    (r"(?s)by-?laws?\s+of|\bby-?laws?\b.{0,120}\b(?:article\s+[ivx\d]+|members|board|officers|meetings|corporation)\b|\barticle\s+[ivx\d]+.*(?:members|board|officers|meetings)", "bylaws", 0.9),
    (r"articles\s+of\s+incorporation|certificate\s+of\s+incorporation", "articles", 0.9),
    (r"(?:architectural|design)\s+(?:guidelines?|standards?|review)|rules\s+and\s+regulations", "rules", 0.9),
    (r"(?:first|second|third|\d+(?:st|nd|rd|th))\s+amendment|supplemental\s+declaration|amended\s+and\s+restated", "amendment", 0.85),
    (r"resolution\s+(?:no\.?|of\s+the\s+board|#)", "resolution", 0.8),
    (r"\b(?:final|recorded|subdivision)?\s*plat\b|plat\s+book|book\s+of\s+plats", "plat", 0.75),
    (r"(?:bankruptcy|district)\s+court|plaintiff|defendant|docket\s+no", "court", 0.9),
    (r"form\s+990|return\s+of\s+organization\s+exempt|internal\s+revenue", "tax", 0.9),
    (r"(?:planning|city)\s+commission|city\s+council\s+agenda|environmental\s+impact", "government", 0.85),
    (r"(?:annual|board|special)\s+meeting\s+minutes|minutes\s+of\s+(?:the\s+)?(?:annual|board)", "minutes", 0.85),
    (r"(?:proposed\s+)?budget|financial\s+statement|reserve\s+(?:study|fund)|assessment\s+schedule", "financial", 0.8),
    (r"certificate\s+of\s+(?:insurance|liability)|insurance\s+(?:policy|certificate)", "insurance", 0.8),
]
# What personal lists, ballots and notices look like.
ROSTER = r"(?:mr|mrs|ms|dr)?\.?\s*[A-Z][a-z]+\s+[A-Z][a-z]+\s*\n\s*\d+\s+\w+"
BALLOT = (r"(?:ballot|proxy\s+form).*(?:signature|sign\s+here|owner\s+name)", r"(?:unit\s*(?:#|no|num)|lot\s*(?:#|no|num)).*\d")
VIOLATION = (r"violation\s+notice|notice\s+of\s+(?:violation|hearing)", r"(?:dear\s+(?:mr|mrs|ms|homeowner)|property\s+address)")


#: Alternatives that look for a word anywhere after a first mark: the first mark decides, so no regular expression has to try them all.
LATER = {"bylaws": (r"|\barticle\s+[ivx\d]+.*(?:members|board|officers|meetings)", r"\barticle\s+[ivx\d]", ["members", "board", "officers", "meetings"])}


#: Of each category's pattern, terms of which every match holds one: a text without them is not searched for the pattern.
TERMS = {
    "ccr": ["covenant", "restriction", "&"],
    "bylaws": ["bylaw", "by-law"],
    "articles": ["incorporation"],
    "rules": ["architectural", "design", "regulations"],
    "amendment": ["amendment", "supplemental", "restated"],
    "resolution": ["resolution"],
    "plat": ["plat"],
    "court": ["court", "plaintiff", "defendant", "docket"],
    "tax": ["990", "exempt", "revenue"],
    "government": ["commission", "council", "environmental"],
    "minutes": ["minutes"],
    "financial": ["budget", "financial", "reserve", "schedule"],
    "insurance": ["insurance", "liability"],
}
BALLOT_TERMS, VIOLATION_TERMS = (["ballot", "proxy"], ["unit", "lot"]), (["violation", "hearing"], ["dear", "property"])
#: Every match of ROSTER has one of these to itself.
ROSTER_LINE = r"\n[^\S\n]*\d"


def _by_text(lower: Column, pattern: str, category: str) -> Column:
    if category not in LATER:
        return any_of(lower, TERMS[category]) & lower.rlike(pattern)
    alternative, mark, words = LATER[category]
    first = F.when(lower.contains("article"), F.regexp_instr(lower, F.lit(mark))).otherwise(0)
    return (any_of(lower, TERMS[category]) & lower.rlike(pattern.removesuffix(alternative))) | let(first, lambda at: (at > 0) & any_of(F.substr(lower, at), words))


def _both(lower: Column, patterns: tuple[str, str], terms: tuple[list[str], list[str]]) -> Column:
    return any_of(lower, terms[0]) & any_of(lower, terms[1]) & lower.rlike(patterns[0]) & lower.rlike(patterns[1])


def classify_text(text: Column) -> Column:
    """struct(category, confidence) by the first rule that holds; null if none does."""
    pick = lambda c, p: F.struct(F.lit(c).alias("category"), F.lit(p).alias("confidence"))

    def rules(lower: Column) -> Column:
        out = F.when((_count(text, ROSTER_LINE) >= 5) & (_count(text, ROSTER) >= 5), pick("membership_list", 0.85))
        out = out.when(_both(lower, BALLOT, BALLOT_TERMS), pick("ballot", 0.8))
        out = out.when(_both(lower, VIOLATION, VIOLATION_TERMS), pick("violation", 0.8))
        for pattern, category, p in BY_TEXT:
            out = out.when(_by_text(lower, pattern, category), pick(category, p))
        return out

    return let(F.lower(text), rules)


def classify(text: Column, filename: Column, model: Column | None = None) -> Column:
    """Text (over 50 characters) first, then file name, then a model's verdict (a struct like these)."""
    by_text = F.when(F.length(F.trim(text)) > 50, classify_text(text))
    steps = [by_text, classify_filename(filename)] + ([model] if model is not None else [])
    return F.coalesce(*steps)


def coerce_verdict(json: Column) -> Column:
    """A model's JSON verdict: its category if it is one of ours, confidence within 0 to 1 (0.5 if missing)."""
    v = F.from_json(json, "category string, confidence double, rationale string")
    known = F.lower(F.trim(v["category"])).isin(*VALID, *JUNK, *PERSONAL)
    p = F.least(F.greatest(F.coalesce(v["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return F.when(known, F.struct(F.lower(F.trim(v["category"])).alias("category"), p.alias("confidence")))


def strip_html(html: Column) -> Column:
    """Text without scripts, styles and tags, white space run together."""
    for pattern in (r"(?is)<script.*?>.*?</script>", r"(?is)<style.*?>.*?</style>", r"(?is)<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, r"\s+", " "))


# Site chrome.
CHROME = ["Go to Bill:", "Find Statutes:", "Within Chapter:", "Senate Tracker:", "Sign Up | Login", "FLHouse.gov", "Mobile Site", "Javascript must be enabled", "for site search", "Order - Legistore", "Welcome to LexisNexis", "Choose Your Path", "Solutions for professionals"]
NAVIGATION = [
    r"(?i)Skip to (Navigation|Main Content|Site Map)",
    r"\b(20\d{2}\s+){6,}",
    r"(?i)\b(Bills|Calendars|Journals|Appropriations|Conferences|Reports)\b.*?\b(Bills|Calendars|Journals)\b",
    r"(?i)Go to Bill:",
    r"(?i)Find Statutes:",
    r"(?i)Within Chapter:",
    r"(?i)Javascript must be enabled",
    r"(?i)Senate Tracker:",
    r"(?i)FLHouse\.gov",
    r"(?i)Home\s*[>|»]\s*Laws?\s*[>|»]",
    r"(?i)Order\s*[-–]\s*Legistore",
    r"(?i)Welcome to LexisNexis",
    r"(?i)Arizona Revised Statutes\s+Arizona Revised Statutes\s+Title",
]


def strip_boilerplate(text: Column) -> Column:
    """Text without runs of years, pipe menus (four short items or more), skip links and site chrome."""
    text = F.regexp_replace(text, r"(\b20\d{2}\b\s*){5,}", " ")
    text = F.regexp_replace(text, r"(\b19\d{2}\b\s*){5,}", " ")
    # a line of at least three bars whose parts are all short
    lines = F.transform(F.split(text, "\n"), lambda x: F.when((F.size(F.split(x, "\\|")) >= 4) & F.forall(F.split(x, "\\|"), lambda p: F.length(F.trim(p)) < 40), F.lit(" ")).otherwise(x))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"(?i)Skip to [A-Za-z ]+", " ")
    for phrase in CHROME:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    text = F.regexp_replace(text, r"\s{3,}", "\n\n")
    return F.trim(F.regexp_replace(text, r"[ \t]{2,}", " "))


def navigation_heavy(text: Column) -> Column:
    """Whether a text is a menu more than a text."""
    long_words, words = _count(text, r"[A-Za-z]{6,}"), _count(text, r"[A-Za-z]{3,}")
    hits = reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in NAVIGATION))
    return F.coalesce((F.length(text) < 50) | (words == 0) | (long_words / F.greatest(words, F.lit(1)) < 0.15) | (hits >= 3) | (long_words < 30), F.lit(True))


def low_quality_pdf(text: Column) -> Column:
    """Fewer than 120 letters or 20 words."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce((letters < 120) | (_count(text, r"[A-Za-z]{3,}") < 20), F.lit(True))


def extractable(text: Column, least: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= least


# The start of a section.
SECTION = r"(?im)(?=^\s*(?:section\s+\d|sec\.\s*\d|§+\s*\d))"


def split_sections(text: Column) -> Column:
    """Sections as array<struct<section_key, heading, text>>; one section if no marker stands in the first half."""
    text = F.trim(text)
    parts = F.filter(F.transform(F.split(text, SECTION), lambda p: F.trim(p)), lambda p: p != "")
    starts = F.filter(parts, lambda p: p.rlike(r"(?i)^(?:section\s+\d|sec\.\s*\d|§+\s*\d)"))
    preamble = F.when(F.size(parts) > F.size(starts), F.length(F.get(parts, F.lit(0)))).otherwise(F.lit(0))
    one = F.array(F.struct(F.lit("section_1").alias("section_key"), F.lit("Section 1").alias("heading"), text.alias("text")))
    many = F.transform(starts, lambda p, i: F.struct(F.concat(F.lit("section_"), (i + 1).cast("string")).alias("section_key"), F.trim(F.substring(F.get(F.split(p, "\n"), F.lit(0)), 1, 140)).alias("heading"), p.alias("text")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(f"array<struct<section_key:string,heading:string,text:string>>")).when((F.size(starts) == 0) | (preamble > F.floor(F.length(text) * 0.5)), one).otherwise(many)


def sentences(text: Column, least: int = 25, most: int = 800) -> Column:
    """Sentences (after . or ;) with white space run together, of 25 to 800 characters."""
    # white space is run together once for the whole text, so no part needs work of its own
    parts = F.split(F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " ")), "(?<=[.;]) ")
    return F.filter(parts, lambda s: (F.length(s) >= least) & (F.length(s) <= most))


def count_words_ratio(text: Column) -> Column:
    """Share of upper-case among letters; 0 with fewer than 8 letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return F.when(letters < 8, F.lit(0.0)).otherwise(upper / letters)


def all_caps(text: Column) -> Column:
    """At least one letter and no lower-case one."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"\p{Ll}")


# Site platforms, public ones first, then walled portals.
PUBLIC_PLATFORMS = [
    (r"wp-content|wp-includes|wp-json|/wp/v2/|wordpress", "wordpress"),
    (r"squarespace\.com|static1\.squarespace|squarespace-cdn", "squarespace"),
    (r"wixstatic\.com|wix\.com|static\.wix\.com", "wix"),
    (r"weebly\.com|weeblycloud", "weebly"),
    (r"webflow\.io|webflow\.com", "webflow"),
    (r"shopify\.com|cdn\.shopify", "shopify"),
    (r"hubspot|hsforms\.net", "hubspot"),
]
WALLED_PLATFORMS = [
    (r"townsq\.com|townsq\.io|powered\s+by\s+townsq", "townsq"),
    (r"frontsteps\.com|frontsteps\.io|powered\s+by\s+frontsteps", "frontsteps"),
    (r"connectresident\.com|powered\s+by\s+connectresident", "connectresident"),
    (r"cinc\s*systems|cincsystems|cincweb|cinc\.io", "cinc"),
    (r"caliber\.cloud|calibersoftware|caliber\s+web\s+axis", "caliber"),
    (r"enumerate\s*engage|enumerateengage|tops\s*one", "enumerate"),
    (r"appfolio\.com|appfolioassets", "appfolio"),
    (r"buildium\.com", "buildium"),
    (r"vinteum\.com|neigbrs\.com", "vinteum"),
]


def platform(html: Column) -> Column:
    """struct(platform, walled): a public platform beats a walled one; long pages are static, others unknown."""
    lower = F.lower(F.coalesce(html, F.lit("")))
    public, walled = first_match(lower, PUBLIC_PLATFORMS), first_match(lower, WALLED_PLATFORMS)
    rest = F.when((F.length(html) > 1000) & html.contains("<"), F.lit("static")).otherwise(F.lit("unknown"))
    return F.struct(F.coalesce(public, walled, rest).alias("platform"), (public.isNull() & walled.isNotNull()).alias("walled"))


def category_phrase(categories: Column) -> Column:
    """Categories (array<struct<n, category>>) by falling count as a phrase with an Oxford comma."""
    ordered = F.transform(F.array_sort(F.transform(categories, lambda c: F.struct((-c["n"]).alias("m"), c["category"].alias("category")))), lambda c: F.concat((-c["m"]).cast("string"), F.lit(" "), c["category"]))
    n = F.size(ordered)
    return F.when(n == 0, F.lit("")).when(n == 1, F.get(ordered, F.lit(0))).when(n == 2, F.array_join(ordered, " and ")).otherwise(F.concat(F.array_join(F.slice(ordered, 1, n - 1), ", "), F.lit(", and "), F.get(ordered, n - 1)))


def verification_code(ident: Column, time: Column, form_hash: Column) -> Column:
    """The first 20 hexadecimal digits of SHA-256 over id:time:hash."""
    return F.substring(F.sha2(F.concat_ws(":", ident.cast("string"), time.cast("string"), form_hash), 256), 1, 20)


# Mentions that point out proxy voting.
PROXY_WORDS = ["proxy", "proxies", "ballot", "quorum", "absentee"]


def proxy_context(chunks: Column, words: list[str] = PROXY_WORDS, most: int = 6) -> Column:
    """The first chunks that mention one of the words, joined."""
    hit = F.filter(chunks, lambda c: any_of(F.lower(c), words))
    return F.array_join(F.slice(hit, 1, most), "\n\n")


def most_mentioned(values: Column) -> Column:
    """The most frequent value of an array, nulls left out; the first seen wins ties. Sorted once and counted run by run, so long arrays take no square of time."""
    ordered = F.array_sort(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v, i: F.struct(v.alias("v"), i.alias("first"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(None).cast("string").alias("v"))

    def step(state: Column, x: Column) -> Column:
        """The run that x goes on with or begins, and the best so far."""
        same = state["run"]["v"] == x["v"]
        run = F.when(same, F.struct((state["run"]["n"] + 1).alias("n"), state["run"]["first"].alias("first"), x["v"].alias("v"))).otherwise(F.struct(F.lit(1).alias("n"), x["first"].alias("first"), x["v"].alias("v")))
        better = lambda r: (r["n"] > state["best"]["n"]) | ((r["n"] == state["best"]["n"]) & (r["first"] < state["best"]["first"]))
        return let(run, lambda r: F.struct(r.alias("run"), F.when(better(r), r).otherwise(state["best"]).alias("best")))

    return F.aggregate(ordered, F.struct(start.alias("run"), start.alias("best")), step, lambda state: state["best"]["v"])


def location_parts(text: Column) -> Column:
    """struct(city, state, zip, street): the first 'City, ST 12345' and the first street address of a text."""
    place = r"([A-Z][A-Za-z.' -]{2,40}),\s+([A-Z]{2})\s+(\d{5})"
    street = r"\b(\d{1,6}\s+[A-Z][A-Za-z0-9.' -]{2,50}\s+(?:Road|Rd|Street|St|Avenue|Ave|Drive|Dr|Lane|Ln|Way|Court|Ct|Circle|Cir|Boulevard|Blvd|Place|Pl|Parkway|Pkwy))\b"
    got = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    return F.struct(F.trim(got(place, 1)).alias("city"), got(place, 2).alias("state"), got(place, 3).alias("zip"), got(street, 1).alias("street"))


def anchor_score(text: Column, at: Column, positive: str, negative: str, around: int = 80) -> Column:
    """+2 if a positive anchor stands within ``around`` characters of a place, -3 if a negative one does."""
    near = F.lower(F.substr(text, F.greatest(F.lit(1), at - around), F.lit(2 * around)))
    return F.when(near.rlike(positive), 2).otherwise(0) - F.when(near.rlike(negative), 3).otherwise(0)
