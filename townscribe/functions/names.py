"""Names: slugs, title case, dirty-name rules, recovery, normal forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Lower case, white space to dashes, only a-z 0-9 and single dashes inside."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]", ""), "-+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def path(place: Column, city: Column, name: Column) -> Column:
    """/entity/place/city/name, or /entity/name where place or city is missing."""
    whole = F.concat(F.lit("/entity/"), F.lower(place), F.lit("/"), slug(city), F.lit("/"), slug(name))
    return F.when((F.coalesce(place, F.lit("")) != "") & (F.coalesce(city, F.lit("")) != ""), whole).otherwise(F.concat(F.lit("/entity/"), slug(name)))


# Words that do not tell one association from another.
NOISE = r"(?i)\b(hoa|homeowners?|home\s*owners?|community|civic|cluster|condominium|condo|property\s*owners?|owners?|master|association|assn|assoc|inc|llc|co|the)\b"


def identity_slug(name: Column) -> Column:
    """A slug without noise words; of the whole name if it is nothing but noise."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    plain = lambda s: F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(plain(F.regexp_replace(lower, NOISE, " ")), F.lit("")), plain(lower))


def namespace(name: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_-]", "")


# Words kept small inside a title, words kept upper.
SMALL = "a an the and or for to in on at by of with from as but nor yet so if via".split()
UPPER = "HOA POA COA LLC L.L.C. PLC PC P.C. USA US U.S. DC II III IV V VI VII VIII IX X XI XII".split()
TOKEN = r"^([A-Za-z'`‘’]+)([.,;:!?\"\)\]]*)$"


def _title_token(token: Column, anchor: Column) -> Column:
    core, tail = F.regexp_extract(token, TOKEN, 1), F.regexp_extract(token, TOKEN, 2)
    cased = F.when(F.upper(core).isin(UPPER), F.upper(core)).when(F.lower(core).isin(SMALL) & ~anchor, F.lower(core)).otherwise(F.concat(F.upper(F.substring(core, 1, 1)), F.lower(F.substr(core, F.lit(2)))))
    return F.when(core == "", token).otherwise(F.concat(cased, tail))


def title_case(name: Column) -> Column:
    """Title case that knows small words, abbreviations, hyphens and a trailing ', THE'."""
    s = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"([,;])(\S)", "$1 $2")
    comma, period = r"(?i),\s+the\s*\.?\s*$", r"(?i)(?<=\.)\s+the\s*\.?\s*$"
    by_comma, by_period = s.rlike(comma), s.rlike(period)
    body = F.when(by_comma, F.regexp_replace(F.regexp_replace(s, comma, ""), "[ ,]+$", "")).when(by_period, F.rtrim(F.regexp_replace(s, period, ""))).otherwise(s)
    the = by_comma | by_period
    tokens = F.filter(F.split(body, r"\s+"), lambda t: t != "")

    def case(token: Column, i: Column) -> Column:
        anchor = ((i == 0) & ~the) | (i == F.size(tokens) - 1)
        parts = F.array_join(F.transform(F.split(token, "-"), lambda p: _title_token(p, F.lit(True))), "-")
        return F.when(token.contains("-") & ~token.startswith("-") & ~token.endswith("-"), parts).otherwise(_title_token(token, anchor))

    out = F.array_join(F.transform(tokens, case), " ")
    return F.when(the, F.concat(F.lit("The "), out)).otherwise(out)


# Place words that name nothing alone.
GENERIC = (
    "sunrise sunset mountainside slopeside hillside hilltop lakeside riverside lakeview riverview mountain lake river creek pond brook "
    "intervale willows willow oaks oak pines pine maples maple birches birch elms elm meadow meadows valley valleys ridge ridges summit summits "
    "peak peaks hill hills wood woods woodland woodlands forest forests glen glens shore shores cove coves harbor harbors harbour point pointe "
    "garden gardens terrace terraces manor manors court courts place places plaza square downs field fields commons village villages highland highlands "
    "plantation plantations grove groves park parks estate estates acres trace knoll knolls heights crossing crossings landing landings "
    "town towne townhouse townhouses north south east west central old new upper lower"
).split()
# The rules of a dirty name in order: reason, pattern, least length (a name must be longer).
DIRTY = [
    ("leading_conjunction", r"(?i)^(?:or|and|as|in)\b", 0),
    ("starts_lowercase", r"^\p{Ll}", 0),
    ("leading_punctuation", r"^[&;:!?/\\,.]", 0),
    ("numeric_prefix", r"^\d+\s*[-)]\s*", 0),
    ("year_prefix", r"^(?:19|20)\d{2}\s+[A-Za-z]", 0),
    ("longdigit_prefix", r"^\d{6,}", 0),
    ("street_address_prefix", r"(?i)^\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-zA-Z]+){0,4}\s+(?:Rd|Road|St|Street|Ave|Avenue|Dr|Drive|Lane|Ln|Way|Cir|Ct|Court|Blvd|Boulevard|Place|Pl|Pkwy|Parkway|Trail|Tr|Hwy|Highway)\b", 0),
    ("shouting_prefix", r"^[A-Z][A-Z &\-]{3,}\s+", 40),
]
DIRTY_LATER = [
    ("stopword_prefix", r"(?i)^(?:by-?laws?|declarations?|articles?|covenants?|deed|amendment|supplement|plat|this |consideration|common|accordance|city of|county of|members of|voting|the property|is the |a homeowners|page |section |exhibit|schedule|such as|in addition|unless |any |all |or other|or by|a typical|recorded |submitted |squarespace|attachment |appendix |of for |of to |amended and )", 0),
    ("county_prefix", r"(?i)^[A-Z][a-z]+\s+County\s+(?:of|OF\.?)\s+", 0),
    ("doc_fragment_anywhere", r"(?i)\b(?:exhibit\s+[A-Za-z](?:\b|-\d)|supplemental\s+dec(?:laration)?|amended\s+and\s+restated|architectural\s+design\s+guidelines?|declaration\s+of(?:\s+covenants)?|by-?laws\s+of|articles\s+of\s+incorporation\s+of|protective\s+covenants?|wetland(?:-|\s)mitigation)\b", 0),
    ("tail_truncation", r"(?i)\b(?:and|or|of|to|the|for|with|on|in|by|both)\s+HOA$", 0),
    ("doubled_name", r"\b(POA|HOA)\s+[A-Z][A-Z &]{3,}\s+(?:PROPERTY|HOMEOWNERS|OWNERS)\s+ASSOCIATION\b", 0),
    ("garbled_acronym", r"\b[A-Z]{2,}-[A-Z]{2,}-[A-Z]{2,}\b", 0),
    ("project_code_prefix", r"(?i)^(?:[A-Z]{2,5}-?\d+(?:-\d+)+|[A-Z]{2,5}\d+|phase\s+(?:[ivx]+|\d+)|block\s+[a-z\d]+|building\s+\d+|unit\s+\d+|lot\s+\d+|parcel\s+[a-z\d]+)\b", 0),
]
LONG = 70
DIRTY_LAST = [
    ("very_long", r"(?s).*", LONG),
    ("citation_in_name", r"(?i)\bbook \d|page \d|paragraph", 0),
    ("ccr_in_name_long", r"(?i)\bcc&?rs?\b", 30),
]
SUFFIX = r"(?i)\s*,?\s*(?:(?:home|land|property|unit|condominium|condo)\s*owners?\s*(?:'\s*)?\s*association(?:,?\s+inc\.?)?|homes\s+association|home\s+owners\s+association|community\s+association(?:,?\s+inc\.?)?|condominium\s+association(?:,?\s+inc\.?)?|condominium\s+trust|townhome\s+association|townhouse\s+association|hoa|poa|coa)\.?\s*$"
QUALIFIER = r"(?i)\s+(?:[ivx]{1,5}|\d+|phase\s+(?:[ivx]+|\d+)|building\s+\d+|section\s+(?:[ivx]+|\d+)|unit\s+\d+)$"


def dirty_reason(name: Column) -> Column:
    """Why a name looks like a fragment of a document; null for a clean name."""
    n = F.trim(F.coalesce(name, F.lit("")))
    out = F.when(n.contains(" - ") & (F.length(n) > 50), F.lit("long_dashed_phrase"))
    add = lambda w, rules: reduce(lambda acc, r: acc.when(n.rlike(r[1]) & (F.length(n) > r[2]) if r[2] else n.rlike(r[1]), F.lit(r[0])), rules, w)
    out = add(out, DIRTY).when((F.length(n) <= 4) & ~n.rlike("(?i)hoa|poa"), F.lit("too_short"))
    out = add(out, DIRTY_LATER)
    stem = F.regexp_replace(F.regexp_replace(n, SUFFIX, ""), r"^[ \t,.\-]+|[ \t,.\-]+$", "")
    stem = F.trim(F.regexp_replace(stem, QUALIFIER, ""))
    only = F.regexp_replace(F.lower(stem), "[.,;:]+$", "")
    out = out.when(n.rlike(SUFFIX) & ~stem.rlike(r"\s") & only.isin(GENERIC), F.lit("generic_single_stem"))
    return add(out, DIRTY_LAST)


def is_dirty(name: Column) -> Column:
    """Whether a name has a reason; a long one has without a look at the others."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) > LONG) | dirty_reason(n).isNotNull()


# Title words in front of a name, and what a name ends on.
PREFIX = (
    r"(?i)^((?:19|20)\d{2}\s+(?:exhibit\s+[a-z]\s+)?(?:supplemental\s+)?dec(?:laration)?\s+|(?:19|20)\d{2}\s+exhibit\s+[a-z]\s+|(?:19|20)\d{2}\s+(?:amended|restated|amended\s+and\s+restated)\s+|"
    r"and\s+restated(?:\s*-\s*|\s+)|amended\s+and\s+restated\s+|squarespace\s*\.?\s*of\.?\s*|squarespace\s*[-.]\s*|architectural\s+design\s+guidelines?\s+(?:for\s+)?|design\s+guidelines?\s+(?:for\s+)?|"
    r"declaration\s+of(?:\s+covenants(?:,?\s+conditions(?:,?\s+and\s+restrictions)?)?\s+)?(?:for\s+|of\s+)?|by-?laws\s+of\s+(?:the\s+)?|articles\s+of\s+incorporation\s+of\s+(?:the\s+)?|protective\s+covenants?\s+(?:for\s+|of\s+)?|"
    r"supplemental\s+declaration\s+(?:for\s+|of\s+)?|\d{6,}|[A-Z][a-z]+\s+county\s+(?:of|OF\.?)\s+)"
)
NAME_END = r"(?i)\b(homeowners(?:'?\s|\s+)?association(?:,?\s+inc\.?)?|homes\s+association|home\s+owners\s+association|property\s+owners(?:'?\s+|\s+)association(?:,?\s+inc\.?)?|owners\s+association(?:,?\s+inc\.?)?|community\s+association|condominium\s+association(?:,?\s+inc\.?)?|condominium\s+owners\s+association|townhome\s+association|hoa|poa)\b\.?\s*$"
STOP = (
    "a an the and or of for to in with by is that this which if as be are was were hereinafter whereas wherein whereof thereof thereto amount restated amended articles article declaration "
    "declarations bylaws covenants certain first called made between among shall having hereby incorporation section subsection paragraph exhibit page pages all any each every no not such said "
    "you we us our your their his her its mr mrs ms mrhoa georgia ga tn nc north south east west nonprofit corporation company association associations agree agreed ated ation assiter subject date "
    "name names address addresses laws law"
).split()
SECTION_WORDS = (
    "mandatory age directors officers members membership meetings meeting voting votes vote dues fines assessments assessment liens lien easements easement definitions definition amendments "
    "arbitration permanent lots lot properties property subject purpose purposes notice notices rules regulations owner owners homeowners association associations corporation incorporation covenants "
    "declaration declarations bylaws articles amendment rights powers duties indemnity indemnification fees expenses books records consent approval approvals second first third preliminary general "
    "special annual regular recording recorded"
).split()
LEADING_JUNK = (
    "a an the and or of for to in with by is that this which as hereinafter whereas wherein witnesseth amount restated amended articles article declaration declarations covenants certain between "
    "having hereby incorporation section exhibit page agree agreed ated ation assiter subject"
).split()
JUNK_SLUG = [
    r"^[a-z]{1,3}$",
    r"^(" + "|".join(sorted(LEADING_JUNK)) + r")-",
    r"-(hereinafter|whereas|wherein|witnesseth|thereto|thereof|by-laws|board-of|secretary-of|committee-of|directors|as-of-date|nonprofit-corporation|with-georgia|of-georgia|this-second|that-parc)-",
    r"\b\d+-\d+-\d+\b",
    r"\b([a-z]{4,})\b.*-\1$",
    r"^(article-)?[ivx]{1,5}$",
]
NOISE_PARTS = ["covenant", "bylaws", "articleof", "articlesof", "amendment", "declaration", "incorporation", "subdivision"]
FILE_NOISE = r"(?i)\b(ccrs?|cc&rs?|covenants?|bylaws?|by-laws?|articles?|amendment|amendments?|amended|restated|declaration|declarations|rules|regulations?|hoa|homeowners?|association|incorporation|condominium|condo|original|final|copy|recorded|signed|executed|exhibit|schedule|attachment|appendix|of|the|for|and|to|by)\b"
SINGLE_REJECT = "incorporation declaration covenants bylaws amendment restated amended articles association homeowners subdivision condominium rules regulations".split()


def strip_title_prefix(name: Column) -> Column:
    """A name without document-title words in front (up to four times); null if there were none or no name is left."""
    n = F.trim(F.coalesce(name, F.lit("")))
    cleaned = n
    for _ in range(4):  # each step names the one before once, or the expression would double
        cleaned = F.regexp_replace(cleaned, PREFIX + r"[ \-.,;:]*", "")
    tidy = F.regexp_replace(F.regexp_replace(cleaned, r"\s+", " "), r"^[ \-.,;:]+|[ \-.,;:]+$", "")
    return F.when(n.rlike(NAME_END) & n.rlike(PREFIX) & (F.length(tidy) >= 4), tidy)


def junk_slug(s: Column) -> Column:
    return reduce(lambda a, b: a | b, (s.rlike(p) for p in JUNK_SLUG), (s == "") | (F.length(s) > 60))


def clean_slug(s: Column) -> Column:
    """Whether a slug is fit to be a name."""
    tokens = F.split(s, "-")
    word = lambda t: t.isin(SECTION_WORDS)
    bad = junk_slug(s) | (F.size(tokens) > 5) | F.exists(tokens, lambda t: t.isin(STOP)) | F.forall(tokens, lambda t: word(t) | t.rlike(r"^\d+$"))
    bad = bad | ((F.size(tokens) == 1) & ((F.length(s) < 5) | word(s))) | (F.element_at(tokens, -1) == "county")
    noise = lambda part: F.exists(tokens, lambda t: t.contains(part) & (t != part))
    bad = reduce(lambda a, b: a | b, map(noise, NOISE_PARTS), bad)
    return F.coalesce(~bad, F.lit(False))


def _trim_stop(tokens: Column, both: bool) -> Column:
    """Tokens without stop words in front (and at the end)."""
    keep = F.filter(F.transform(tokens, lambda t, i: F.when(~t.isin(STOP), i)), lambda i: i.isNotNull())
    first = F.get(keep, F.lit(0))
    last = F.element_at(keep, -1) if both else F.size(tokens) - 1
    return F.when(F.size(keep) > 0, F.array_join(F.slice(tokens, first + 1, last - first + 1), "-"))


def strip_leading_stopwords(s: Column) -> Column:
    got = _trim_stop(F.split(s, "-"), False)
    return F.when((F.length(got) >= 3) & ~junk_slug(got), got)


def marker_tails(s: Column) -> list[Column]:
    """What follows the last marker of each kind (committee-of, then of or for), without stop words around; null without one."""
    patterns = (r"-(?:committee|secretary|board|directors)-of-(.+)$", r"-(?:for|of)-([a-z][a-z0-9\-]+)$")
    return [F.when(s.rlike(p), _trim_stop(F.split(F.regexp_extract(s, p, 1), "-"), True)) for p in patterns]


def repeated_tails(s: Column) -> list[Column]:
    """A slug's last three, two, one words where they stand there twice; null where not."""
    tokens, out = F.split(s, "-"), []
    for k in (3, 2, 1):
        twice = (F.size(tokens) >= 2 * k) & (F.slice(tokens, -k, k) == F.slice(tokens, -2 * k, k))
        out.append(F.when(twice, F.array_join(F.slice(tokens, -k, k), "-")))
    return out


def _first_clean(slugs: list[Column]) -> Column:
    return F.coalesce(*(F.when(clean_slug(x), x) for x in slugs))


def after_marker(s: Column) -> Column:
    """The first marker's tail that is fit to be a name."""
    return _first_clean(marker_tails(s))


def dedupe_tail(s: Column) -> Column:
    """A repeated end of up to three words, the longest first, that is fit to be a name."""
    return _first_clean(repeated_tails(s))


def name_from_url(url: Column) -> Column:
    """A slug from the file name of a url."""
    last = F.regexp_replace(F.element_at(F.split(F.element_at(F.split(url, "/"), -1), "\\?"), 1), r"\.[^.]*$", "")
    steps = [(r"[_\-]+", " "), (r"(\d)([A-Za-z])", "$1 $2"), (r"([A-Za-z])(\d)", "$1 $2"), (r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), (FILE_NOISE, " "), (r"\b\d+\b", " "), (r"\s+", " ")]
    for pattern, by in steps:
        last = F.regexp_replace(last, pattern, by)
    got = identity_slug(F.trim(last))
    fit = F.exists(F.split(F.lower(F.trim(last)), " "), lambda t: t.rlike(r"^\p{L}{4,}$")) & (F.length(got) >= 3) & ~got.isin(SINGLE_REJECT) & ~junk_slug(got)
    return F.when(fit, F.coalesce(strip_leading_stopwords(got), got))


def recover(df, name: str = "name", url: str = "source_url", out: str = "cleaned"):
    """A frame with a clean name for each dirty one, by the first way that gives one.

    Title case, prefix words, leading stop words, what follows a marker, a repeated end, the
    url's file name.  Each step is a column of its own: an expression that is named twice would
    be evaluated twice, and its size would double at every step.
    """
    n, c = F.col(name), F.col
    named = lambda s: F.array_join(F.transform(F.split(s, "-"), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))), " ")
    # what is still longer than a clean name after all that a way may drop needs no such way
    size = F.length(F.regexp_replace(n, r"\s+", " "))
    d = df.withColumns({"_titled": F.when(size <= LONG + 30, title_case(n)), "_stripped": F.when(size <= 10 * LONG, strip_title_prefix(n)), "_slug": identity_slug(n)})
    tails = [*marker_tails(c("_slug")), *repeated_tails(c("_slug"))]
    slugs = {"_g0": _trim_stop(F.split("_slug", "-"), False), **{f"_g{i}": x for i, x in enumerate(tails, 1)}, "_g6": name_from_url(c(url))}
    d = d.withColumns(slugs)
    d = d.withColumns({f"{g}ok": clean_slug(c(g)) for g in slugs} | {"_few": F.size(F.filter(F.split("_slug", "-"), lambda t: t.isin(STOP))) < 4})
    ok = lambda g: F.when(c(f"{g}ok"), named(c(g)))
    few = lambda gs: F.when(c("_few"), F.coalesce(*map(ok, gs)))
    ways = {
        "_c0": F.when((c("_titled") != n) & (c("_titled") != ""), c("_titled")),
        "_c1": c("_stripped"),
        "_c2": F.when((c("_g0") != c("_slug")) & (F.length("_g0") >= 3), ok("_g0")),
        "_c3": few(["_g1", "_g2"]),
        "_c4": few(["_g3", "_g4", "_g5"]),
        "_c5": ok("_g6"),
    }
    # only what may be a name is tested, in order: a row stops at its first clean one
    d = d.withColumn("_tries", F.array(*ways.values()))
    first = lambda got, x: F.when(got.isNotNull(), got).when(x.isNotNull() & ~is_dirty(x), x)
    d = d.withColumn(out, F.aggregate("_tries", F.lit(None).cast("string"), first))
    return d.drop("_titled", "_stripped", "_slug", "_few", "_tries", *slugs, *(f"{g}ok" for g in slugs))


# What the normal form for duplicates drops, in order.
DEDUPE_DROPS = [
    r"\bINC(?:ORPORATED)?\b\.?", r"\bLLC\b\.?", r"\b(HOA|H\.O\.A\.|POA|P\.O\.A\.)\b", r"\bHOMEOWNERS?\s+ASSOCIATION\b", r"\bHOMEOWNER\b", r"\bPROPERTY\s+OWNERS?\s+ASSOCIATION\b",
    r"\bOWNERS?\s+ASSOCIATION\b", r"\bCONDOMINIUM\s+ASSOCIATION\b", r"\bCONDOMINIUM\b", r"\bCOMMUNITY\s+ASSOCIATION\b", r"\bASSOCIATION\b", r"\bSUBDIVISION\b",
]


def dedupe_form(name: Column) -> Column:
    """Upper case without punctuation and legal suffixes."""
    n = F.regexp_replace(F.upper(name), r"[,.\-'’]", " ")
    for p in DEDUPE_DROPS:
        n = F.regexp_replace(n, p, "")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


# Suffix words a signature leaves out.
SIGNATURE_DROPS = "hoa homeowners homeowner owners owner association assoc assn community condominium condo property inc incorporated llc the of at".split()


def signature(name: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(SIGNATURE_DROPS))
    return F.array_join(words, " ")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared among all of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def registrant(name: Column) -> Column:
    """A registrant's name without legal suffixes, however many."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), r"[.,]", ""), r"(?:\s+(?:INC|LLC|LLP|LP|LTD|CORP|CO|CORPORATION|COMPANY|INCORPORATED))+\s*$", ""))


def is_personal(name: Column) -> Column:
    """Whether a registrant looks like a person: two or three words of letters, none of a business."""
    words = F.split(F.trim(name), r"\s+")
    return F.size(words).between(2, 3) & F.forall(words, lambda w: w.rlike(r"^\p{L}[\p{L}.'-]*$")) & ~F.upper(name).rlike(r"\b(INC|LLC|LLP|LP|LTD|CORP|COMPANY|MANAGEMENT|PROPERTIES|REALTY|GROUP|SERVICES|ASSOCIATION|LAW|OFFICES?)\b")


def acceptable(name: Column) -> Column:
    """At least four characters, with letters, and not one capitalised word alone."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) >= 4) & n.rlike(r"\p{L}") & ~n.rlike(r"^[A-Z][a-z]+$")


def better_name(a: Column, b: Column) -> Column:
    """The one that is not empty, else the longer, else the one with more spaces, else the first."""
    rank = lambda x: F.struct(F.length(F.coalesce(x, F.lit(""))), F.length(F.regexp_replace(F.coalesce(x, F.lit("")), "[^ ]", "")))
    return F.when(F.coalesce(b, F.lit("")) == "", a).when(F.coalesce(a, F.lit("")) == "", b).when(rank(b) > rank(a), b).otherwise(a)
