"""Queries that SQL cannot express, against plain Python over whole tables."""

import datetime as dt
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from townscribe.functions import names, rules
from townscribe.functions import text as tx
from townscribe.operators import chunker
from townscribe.plans import catalog, registry

catalog.load()


def table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet").collect()


def run(spark, data, name):
    return registry.QUERIES[name](spark, data).collect()


def pii(text):
    text = text or ""
    own = [m for m in regex.findall(tx.EMAIL, text) if not m.lower().startswith(tuple(tx.SHARED_MAILBOXES))]
    n = {"ssn": tx.SSN, "name_address": tx.NAME_ADDRESS, "lot_owner": tx.LOT_OWNER, "directory": tx.DIRECTORY, "phones": tx.PHONE}
    n = {k: len(list(regex.finditer(p, text))) for k, p in n.items()} | {"personal_emails": len(own)}
    high = n["ssn"] >= 1 or n["name_address"] >= 5 or n["directory"] >= 3 or n["lot_owner"] >= 5 or len(own) >= 5
    return n | {"risk": "high" if high else "low" if len(own) >= 3 else "none"}


def test_pii_scan_and_pages(spark, data):
    docs = {r["doc_id"]: r["text"] for r in table(spark, data, "documents")}
    for r in run(spark, data, "pii_scan"):
        assert r.asDict() == pii(docs[r["doc_id"]]) | {"doc_id": r["doc_id"]}
    for r in run(spark, data, "pii_page_rollup"):
        pages = [pii(p) for p in docs[r["doc_id"]].split("\n")]
        assert (r["ssn"], r["personal_emails"], r["phones"]) == tuple(sum(p[k] for p in pages) for k in ("ssn", "personal_emails", "phones"))
        assert r["risk"] == max((p["risk"] for p in pages), key=["none", "low", "high"].index)


def test_limiter(spark, data):
    held, want = defaultdict(list), {}
    for e in sorted(table(spark, data, "events"), key=lambda e: (e["ts"], e["event_id"])):
        mine = held[e["user_id"]] = [t for t in held[e["user_id"]] if e["ts"] - t < dt.timedelta(days=1)]
        want[e["event_id"]] = len(mine) < 3
        if want[e["event_id"]]:
            mine.append(e["ts"])
    assert {r["event_id"]: r["allowed"] for r in run(spark, data, "rate_limited")} == want
    assert 0 < sum(want.values()) < len(want)


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.href, self.text = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.close_link()
            self.href, self.text = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag == "a":
            self.close_link()

    def handle_data(self, text):
        self.text.append(text)

    def close_link(self):
        if self.href:
            self.found.append((self.href.strip(), " ".join("".join(self.text).split())))
        self.href = None


def test_links(spark, data):
    got = defaultdict(list)
    for r in run(spark, data, "link_harvest"):
        got[r["page_id"]].append((r["ord"], r["url"], r["text"]))
    for page in table(spark, data, "pages"):
        p = Links()
        p.feed(page["html"])
        p.close_link()
        want = {}
        for href, text in p.found:
            url = urljoin(page["url"], href)
            if not href.startswith(("#", "javascript:", "mailto:", "tel:")) and urlparse(url).scheme in ("http", "https"):
                want.setdefault(url, text)
        assert sorted(got[page["page_id"]]) == [(i, u, t) for i, (u, t) in enumerate(want.items())]


def dirty(name):
    n = (name or "").strip(" ")
    if " - " in n and len(n) > 50:
        return "long_dashed_phrase"
    found = lambda table: next((k for k, p, least in table if regex.search(p, n) and len(n) > least), None)
    if r := found([(k, p, least or -1) for k, p, least in names.DIRTY]):
        return r
    if len(n) <= 4 and not regex.search("(?i)hoa|poa", n):
        return "too_short"
    if r := found([(k, p, least or -1) for k, p, least in names.DIRTY_LATER]):
        return r
    stem = regex.sub(r"^[ \t,.\-]+|[ \t,.\-]+$", "", regex.sub(names.SUFFIX, "", n))
    stem = regex.sub(names.QUALIFIER, "", stem).strip(" ")
    if regex.search(names.SUFFIX, n) and not regex.search(r"\s", stem) and regex.sub("[.,;:]+$", "", stem.lower()) in names.GENERIC:
        return "generic_single_stem"
    return found([(k, p, least or -1) for k, p, least in names.DIRTY_LAST])


def title(name):
    s = regex.sub(r"([,;])(\S)", r"\1 \2", (name or "").strip(" "))
    the = False
    for end, trim in ((r"(?i),\s+the\s*\.?\s*$", " ,"), (r"(?i)(?<=\.)\s+the\s*\.?\s*$", " ")):
        if not the and regex.search(end, s):
            s, the = regex.sub(end, "", s).rstrip(trim), True
    tokens = [t for t in regex.split(r"\s+", s) if t]

    def cased(t, anchor):
        m = regex.match(names.TOKEN, t)
        if not m:
            return t
        core = m[1]
        word = core.upper() if core.upper() in names.UPPER else core.lower() if core.lower() in names.SMALL and not anchor else core[0].upper() + core[1:].lower()
        return word + m[2]

    out = []
    for i, t in enumerate(tokens):
        if "-" in t and not t.startswith("-") and not t.endswith("-"):
            out.append("-".join(cased(p, True) for p in t.split("-")))
        else:
            out.append(cased(t, i == 0 and not the or i == len(tokens) - 1))
    return ("The " if the else "") + " ".join(out)


def test_names_of_documents(spark, data):
    first = {r["doc_id"]: r["text"].split("\n")[0] for r in table(spark, data, "documents")}
    assert {r["id"]: r["reason"] for r in run(spark, data, "dirty_names")} == {d: dirty(n) for d, n in first.items()}
    assert {r["id"]: r["title"] for r in run(spark, data, "title_case")} == {d: title(n.upper()) for d, n in first.items()}
    cleaned = {r["id"]: r["cleaned"] for r in run(spark, data, "clean_names")}
    assert set(cleaned) == {d for d, n in first.items() if dirty(n)}
    for d, name in cleaned.items():
        # a clean name is clean, and title case is the first way
        assert name is None or dirty(name) is None
        if (t := title(first[d])) not in (first[d], "") and dirty(t) is None:
            assert name == t


def test_junk_names(spark, data):
    def pattern(n):
        found = lambda table: next((p for p in table if regex.search(p, n, regex.I)), None)
        if not n:
            return "empty_name"
        if n.upper() in rules.SAFE_NAMES:
            return None
        return found(rules.SURE_JUNK) or (None if regex.search(rules.ENTITY_ENDING, n) else found(rules.LIKELY_JUNK))

    first = {r["doc_id"]: r["text"].split("\n")[0] for r in table(spark, data, "documents")}
    assert {r["id"]: r["pattern"] for r in run(spark, data, "non_entity_names")} == {d: pattern(n) for d, n in first.items()}
    made = ["City of Oaks", "oaks", "Oaks", "DocuWare Owners Association", "Alaskan Bay Owners Association", "Elm Foreclosure HOA", "12 of 13 pages", "123 Main Street", "Pine Condo", "SEC Filing", "The-Seven-At Run Condo", "Plain Name Here"]
    df = spark.createDataFrame([(n,) for n in made], "n string")
    assert {r["n"]: r["p"] for r in df.select("n", rules.non_entity(F.col("n")).alias("p")).collect()} == {n: pattern(n) for n in made}


def test_mailing_and_lead_names(spark, data):
    parts = {r["p_partkey"]: r["p_name"] for r in table(spark, data, "part")}
    small = {"of", "the", "at", "on", "and", "de", "la", "del", "in", "by", "for"}
    cap = lambda n: " ".join(w.lower() if i and w.lower() in small else w.capitalize() for i, w in enumerate(n.split()))
    for r in run(spark, data, "mailing_names"):
        assert r["name"] == cap(parts[r["id"]]) + (" Condominium Association" if r["id"] % 2 == 0 else " Hoa")
    for r in run(spark, data, "lead_names"):
        # the association's name, if there is one, else nothing scores
        assert r["name"] == (f"{parts[r['id']]} Owners Association" if r["id"] % 3 == 0 else None)


def test_most_named_places(spark, data):
    named = ["North Carolina", "West Virginia", "Arkansas", "Ohio", None]
    states = "|".join(sorted((s.title() for s in rules.STATES), key=lambda s: (-len(s), s)))
    seen = set()
    for r in run(spark, data, "state_county"):
        parts = ["Wake County, North Carolina", named[r["doc_id"] % 5], "Lake County, Ohio. Lake County, Ohio" if r["doc_id"] % 2 == 0 else None]
        pairs = Counter(m[0] for m in regex.finditer(rf"\b[A-Z][A-Za-z.' -]{{2,30}}? County,\s+(?:{states})\b", " ".join(p for p in parts if p)))
        county, state = pairs.most_common(1)[0][0].split(" County, ")  # the first seen wins ties
        assert (r["county"], r["state"]) == (county, rules.STATES[state.lower()])
        seen.add(county)
    assert seen == {"Wake", "Lake"}


def test_sections_of_marked_texts(spark, data):
    docs = {r["doc_id"]: r["text"] for r in table(spark, data, "documents")}
    got = defaultdict(list)
    for r in run(spark, data, "section_split"):
        got[r["doc_id"]].append((r["section_key"], r["heading"], r["n_chars"]))
    for d, text in docs.items():
        t = text.replace("\n", "\nSection 1. ").strip(" ")
        parts = [p.strip(" ") for p in regex.split(tx.SECTION, t)]
        parts = [p for p in parts if p]
        starts = [p for p in parts if regex.match(r"(?i)(?:section\s+\d|sec\.\s*\d|§+\s*\d)", p)]
        before = len(parts[0]) if len(parts) > len(starts) else 0
        if not t:
            want = []
        elif not starts or before > len(t) // 2:
            want = [("section_1", "Section 1", len(t))]
        else:
            want = [(f"section_{i}", p.split("\n")[0][:140].strip(" "), len(p)) for i, p in enumerate(starts, 1)]
        assert got[d] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), max_size=6), max_size=5), st.integers(0, 25))
def test_chunks_by_their_rule(pages, overlap):
    made = [(n, "\n".join(chr(97 + (n + i) % 26) * size for i, size in enumerate(sizes))) for n, sizes in enumerate(pages, 1)]
    paragraphs = [(n, p) for n, t in made for p in t.split("\n") if p]
    at, before = 0, ""
    for i, (k, text, first, last) in enumerate(chunker.chunks_of(made, 100, overlap)):
        carry = before[-overlap:] if 0 < overlap < len(before) else ""
        # each chunk goes on where the one before ended, and the next paragraph would not have fitted
        here = [carry] if carry else []
        size, begin = len(carry), at
        while at < len(paragraphs) and (at == begin or size + len(paragraphs[at][1]) + 1 <= 100):
            here.append(paragraphs[at][1])
            size += len(paragraphs[at][1]) + 1
            at += 1
        assert (k, text) == (i, "\n".join(here).strip())
        assert (first, last) == (paragraphs[begin - 1][0] if carry else paragraphs[begin][0], paragraphs[at - 1][0])
        before = text
    assert at == len(paragraphs)


def test_chunks_of_the_table(spark, data):
    docs = {r["doc_id"]: r["text"] for r in table(spark, data, "documents")}
    got = defaultdict(list)
    for r in run(spark, data, "chunk_documents"):
        got[r["document_id"]].append((r["chunk_index"], r["text"], r["start_page"], r["end_page"]))
    for d, t in docs.items():
        assert got[d] == chunker.chunks_of([(1, t)])
    pages = spark.createDataFrame([(1, 2, "b" * 1500), (1, 1, "a" * 1500), (2, 1, None)], "document_id long, number long, text string")
    assert [(r["start_page"], r["end_page"]) for r in chunker.chunk(pages, overlap=0).orderBy("chunk_index").collect()] == [(1, 1), (2, 2)]


def test_manifests_of_customers(spark, data):
    orders = defaultdict(list)
    for o in table(spark, data, "orders"):
        orders[str(o["o_custkey"])].append(o)
    for r in run(spark, data, "manifest_merge"):
        own = sorted(orders[r["key"]], key=lambda o: o["o_orderkey"])
        assert r["name"] == f"n{own[0]['o_orderkey'] % 3}" and r["city"] == own[0]["o_orderstatus"] and r["platform"] == own[-1]["o_orderpriority"]
        assert r["conflicts"] == len({o["o_orderstatus"] for o in own}) - 1
        assert r["status"] == ("banked" if any(o["o_orderstatus"] == "F" for o in own) else "stub")
        assert len(r["documents"]) == len({o["o_orderpriority"] for o in own})
        assert r["aliases"] == sorted({o["o_orderpriority"] for o in own} | {f"n{o['o_orderkey'] % 3}" for o in own} - {r["name"]})


def test_states_and_names_from_urls(spark, data):
    for r in run(spark, data, "names_from_urls"):
        assert r["name"] is None or regex.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", r["name"]) and len(r["name"]) >= 3
    df = spark.createDataFrame([("https://x.org/a/Walton-Reserve-Declaration-Recorded.pdf",), ("https://x.org/a/12.pdf",), ("https://x.org/OakHollowBylaws2019.pdf?x=1",), ("https://x.org/amendment.pdf",)], "u string")
    assert [r["n"] for r in df.select(names.name_from_url(F.col("u")).alias("n")).collect()] == ["walton-reserve", None, "oak-hollow", None]


def test_boilerplate_of_pages(spark, data):
    pages = {r["page_id"]: r["html"] for r in table(spark, data, "pages")}
    for r in run(spark, data, "boilerplate_strip"):
        t = pages[r["page_id"]]
        for p in (r"(?is)<script.*?>.*?</script>", r"(?is)<style.*?>.*?</style>", r"(?is)<[^>]+>"):
            t = regex.sub(p, " ", t)
        t = regex.sub(r"\s+", " ", t, flags=regex.A).strip(" ")
        t = regex.sub(r"(\b20\d{2}\b\s*){5,}", " ", t)
        t = regex.sub(r"(\b19\d{2}\b\s*){5,}", " ", t)
        t = "\n".join(" " if len(x.split("|")) >= 4 and all(len(p.strip(" ")) < 40 for p in x.split("|")) else x for x in t.split("\n"))
        t = regex.sub(r"(?i)Skip to [A-Za-z ]+", " ", t)
        for phrase in tx.CHROME:
            t = t.replace(phrase, " ")
        t = regex.sub(r"[ \t]{2,}", " ", regex.sub(r"\s{3,}", "\n\n", t, flags=regex.A)).strip(" ")
        assert r["text"] == t
        long, words = (len(regex.findall(p, t)) for p in (r"[A-Za-z]{6,}", r"[A-Za-z]{3,}"))
        hits = sum(bool(regex.search(p, t)) for p in tx.NAVIGATION)
        assert r["navigation_heavy"] == (len(t) < 50 or not words or long / words < 0.15 or hits >= 3 or long < 30)


def test_bucket_scores_of_links(spark, data):
    links = {(r["page_id"], r["ord"]): r for r in run(spark, data, "link_harvest")}
    got = run(spark, data, "bucket_scores")
    assert len(got) == len(links)
    for r in got:
        link = links[r["page_id"], r["ord"]]
        context, path = f"{link['url'].lower()} {link['text'].lower()}", urlparse(link["url"]).path.lower()
        score = 3 * sum(k in context for k in ("proxy", "vote", "the")) + 20 * ("proxy" in context) + 8 * ("vote" in context or "voting" in context)
        score += -6 * (path.count("/") <= 2) + 3 * ("/chapter" in path or "/article" in path) + 6 * ("/section" in path or "section-" in path)
        assert (r["score"], r["kind"]) == (score, "condo" if "an" in link["text"].lower() else "coop" if "th" in link["text"].lower() else "hoa")
