"""Main text of web pages by equivalence-class template deduction.

1. Tokens.  A page is a sequence of structural tokens, one an element, and of text tokens, one a
   block.  An element's token is its path: a hash of its parent's token and its own label (name,
   class, id and role; numbers of two digits or more are one).  A text token is a path with the block's words.
2. Equivalence classes.  Tokens of a host that occur equally often on each of its pages share an
   occurrence vector.  A vector is four sums of hashes of (page, times), which add up on the map
   side, so a host with a third of all pages is spread over the tasks.
3. Valid classes.  A class is valid if at least half of the host's pages have it, its tokens
   stand once on each of these and in the same order on all, and, but for the root class (that of
   most pages), all within one gap between two tokens of the root class.  Text tokens belong to
   the template if their vector is that of a valid class.  The tokens of at least half of the
   pages are at most twice as many as a page has on average: a host's template is as small as a page.
4. Template.  Valid tokens nest into a tree of elements; what of an element's text no valid
   element below it holds is its slot.  A slot whose text is the same on all pages is template
   text, one that is mostly links is navigation, a <form> with little text a form.
   Of the others the one with most varying text is the article, with the innermost <article> or
   <main> around it, or else the elements around it that hold nothing but content; a heading that
   varies (an <h1>, or else the one <h2> beside it) is its title.  Names (aside, comments, ...) settle what the vectors leave open: slots
   beside the article and elements that fewer than half of the pages have.
5. Extraction.  The article's blocks on each page, less the template's texts and the other slots.
   A page alone on its host, or without the host's article, is judged by its own tokens.

If most of a host's text is the same on all pages, its pages are copies; then sameness marks no
template.  Headings <h1> always stay.

A block ends where a block element begins or ends; <br> is white space.  Null or empty pages give
an empty text.  Null urls form one host.  Repeated rows are extracted each.  Ties between slots go
to the better name, then to more text, then to the smaller token.  Extra columns are ignored.  Any
text may be long, deep, cut short or have tags left open: time and memory grow with its length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    # text, embedded content (what it holds is shown in its place), formulas and drawings
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input "
    "object audio video canvas math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mstyle mspace mpadded mphantom mfenced menclose semantics "
    "svg g path rect circle ellipse line polyline polygon text tspan textpath defs symbol use image".split()
)
RAW = frozenset("script style noscript template iframe textarea select title annotation annotation-xml desc metadata".split())
#: Of these, what takes the rest of the page if it is left open; an open tag of the others is passed over.
TO_THE_END = frozenset("script style textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = frozenset("ul ol dl table article section div body main aside nav form td th".split())
BESIDE = frozenset("nav footer aside dialog menu head".split())
CONTROLS = frozenset("input button select textarea".split())
# Words of class names, ids and roles for what stands beside an article.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
ASIDES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager skip toolbar topbar adsbygoogle adbox adslot adunit adcontainer complementary contentinfo alertdialog".split()
)
#: Words that leave such a name what it is; any other word (share-price, with-sidebar) makes it another name.
PLAIN = frozenset("a and area article b bar bars block body bottom box button buttons c center column container content dialog entry form group header holder icons inner item items left links list main more news outer page panel post posts primary right row secondary section site slot stories the thread top unit us widget wrap wrapper".split())
CONTENT = frozenset("content article articlebody post entry story text maincontent postcontent entrycontent articlecontent".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}

#: Bits of an element: hidden, named like readers' comments, like an aside, <h1>, <form>, <html> or <body>, a text token; above them its rank as an article.
GONE, COMMENT, ASIDE, TITLE, FORM, FRAME, TEXT, SECOND, RANK = 1, 2, 4, 8, 16, 32, 64, 128, 256
#: Characters of text a control that make a form more than a form.
FORM_TEXT = 200
MASK, BASE = 2**64 - 1, 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 2**64)


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def _hash(*parts: bytes) -> int:
    return _signed(int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little"))


def _number(x: int) -> bytes:
    return x.to_bytes(8, "little", signed=True)


class Page(NamedTuple):
    """Elements in page order (token, parent's place, bits, controls) and blocks (text, element, characters in links)."""

    paths: list[int]
    parents: list[int]
    flags: list[int]
    controls: list[int]
    texts: list[str]
    at: list[int]
    links: list[int]


def _is_aside(word: str, vocabulary: frozenset) -> bool:
    """Whether a name consists of words of the vocabulary and plain words."""
    parts = WORD.findall(CAMEL.sub("-", word).lower())
    joined = "".join(parts)
    return joined in vocabulary or any(p in vocabulary for p in parts) and all(p in vocabulary or p in PLAIN for p in parts)


def _label(name: str, attributes: str) -> tuple[bytes, int]:
    """An element's label and bits, from its name and attributes alone."""
    label, rank = name, 3 if name == "article" else 2 if name == "main" else 0
    flags = (ASIDE if name in BESIDE else 0) | (TITLE if name == "h1" else 0) | (FORM if name == "form" else 0) | (SECOND if name == "h2" else 0) | (FRAME if name in ("html", "body") else 0)
    if attributes.strip():
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        named = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".split()
        if named:
            label += "." + DIGITS.sub("0", ".".join(named).lower())
            if name not in ("html", "body", "main"):
                if any(_is_aside(w, READERS) for w in named):
                    flags |= COMMENT
                elif name != "article" and any(_is_aside(w, ASIDES) for w in named):
                    flags |= ASIDE
            if a.get("role") == "main":
                rank = max(rank, 2)
            elif any(w in CONTENT for x in named for w in (*WORD.findall(x.lower()), x.lower().replace("-", "").replace("_", ""))):
                rank = max(rank, 1)
        if a.get("itemprop", "").lower() == "articlebody":
            rank = 3
        if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
            flags |= GONE
    return label.encode("utf-8", "surrogatepass"), flags | rank * RANK


def parse(page: str | None, known: dict) -> Page:
    """The elements and blocks of a page; ``known`` keeps labels and tokens from page to page."""
    page = page or ""
    out = Page([], [], [], [], [], [], [])
    names: list[str] = []
    scopes: list[dict] = []  # of each element: the ones of SAME open in its scope
    inside: list[bool] = []  # whether an article or main lies around it
    open_now: dict[str, int] = {}
    here, links, in_link = -1, 0, 0
    text: list[str] = []
    muted, depth, muted_at = "", 0, -1  # the hidden inline element that is open, how often, and the element around it
    never_ends: set[str] = set()

    def flush() -> None:
        nonlocal links
        if text:
            block = " ".join("".join(text).split())
            if block:
                out.texts.append(block)
                out.at.append(here)
                out.links.append(min(links, len(block)))
            text.clear()
        links = 0

    def leave(past: int) -> None:
        """Close elements until ``past`` is the open one."""
        nonlocal here, muted
        while here != past:
            if here == muted_at:
                muted = ""
            open_now[names[here]] -= 1
            here = out.parents[here]

    def labelled(name: str, attributes: str) -> tuple[bytes, int]:
        found = known.get((name, attributes))
        if found is None:
            if len(known) > 100_000:
                known.clear()
            found = known[name, attributes] = _label(name, attributes)
        return found

    def enter(name: str, attributes: str) -> None:
        nonlocal here
        label, flags = labelled(name, attributes)
        if name == "header" and not (here >= 0 and inside[here]):
            flags |= ASIDE
        up = out.paths[here] if here >= 0 else 0
        token = known.get((up, label))
        if token is None:
            token = known[up, label] = _hash(_number(up), label)
        out.paths.append(token)
        out.parents.append(here)
        out.flags.append(flags)
        out.controls.append(0)
        names.append(name)
        inside.append(here >= 0 and inside[here] or name in ("article", "main"))
        around = scopes[here] if here >= 0 and name not in SCOPE else {}
        here = len(names) - 1
        scopes.append({**around, name: here} if name in SAME else around)
        open_now[name] = open_now.get(name, 0) + 1

    enter("", "")  # stands for the page
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not muted:
            part = entities.unescape(page[at:lt])
            text.append(part)
            if in_link:
                links += len(part)
        if lt >= n:
            break
        m = MARKUP.match(page, lt)
        if m is None:
            if not muted:
                text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE or name in VOID:
                if name == muted:
                    depth -= 1
                    muted = muted if depth else ""
                if name == "br":
                    text.append(" ")
                elif name == "a":
                    in_link = max(0, in_link - 1)
                continue
            flush()
            in_link = 0
            if open_now.get(name):
                while names[here] != name:
                    leave(out.parents[here])
                leave(out.parents[here])
            continue
        if name in CONTROLS:
            out.controls[here] += 1
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                # one search finds that a name has no end tag any more; it isn't made again
                end = None if name in never_ends else RAW_END[name].search(page, at)
                if end:
                    at = end.end()
                elif name in TO_THE_END:
                    at = n
                else:
                    never_ends.add(name)
            continue
        if name in ("br", "hr"):
            text.append(" ")
            if name == "hr":
                flush()
            continue
        if name in INLINE or name in VOID:
            in_link += name == "a"
            if name not in VOID and not m[3].endswith("/"):
                if muted:
                    depth += name == muted
                elif m[3] and labelled(name, m[3])[1] & GONE:
                    muted, depth, muted_at = name, 1, here
            continue
        flush()
        for group in (("p",) if name in CLOSES_P else (), SAME.get(name, ())):
            ends = [scopes[here][x] for x in group if x in scopes[here]]
            if ends:
                leave(out.parents[max(ends)])
        if names[here] == "head" and name not in ("meta", "link", "title", "base"):
            leave(out.parents[here])
        enter(name, m[3])
    flush()
    return out


def _ranges(p: Page) -> tuple[list[int], list[int], list[int], list[int], list[int], list[bool]]:
    """Of each element: characters, characters in links and controls below, its first and past-last block, whether it is hidden."""
    n = len(p.paths)
    chars, links, controls, low, high = [0] * n, [0] * n, list(p.controls), [len(p.texts)] * n, [0] * n
    gone = [bool(p.flags[i] & GONE) for i in range(n)]
    for i in range(1, n):
        gone[i] = gone[i] or gone[p.parents[i]]
    for b, (i, t, k) in enumerate(zip(p.at, p.texts, p.links, strict=True)):
        if not gone[i]:
            chars[i] += len(t)
            links[i] += k
        low[i], high[i] = min(low[i], b), b + 1
    for i in range(n - 1, 0, -1):
        up = p.parents[i]
        chars[up] += chars[i]
        links[up] += links[i]
        controls[up] += controls[i]
        low[up], high[up] = min(low[up], low[i]), max(high[up], high[i])
    return chars, links, controls, low, high, gone


def tokens(p: Page) -> dict[int, list]:
    """Of a page: token -> [parent, bits, times, characters, in links, controls, least and most digest of the text below]."""
    chars, links, controls, low, high, gone = _ranges(p)
    sums, power = [0], 1
    for t in p.texts:
        sums.append((sums[-1] + _hash(t.encode("utf-8", "surrogatepass")) * power) & MASK)
        power = power * BASE & MASK
    found: dict[int, list] = {}
    for i, token in enumerate(p.paths):
        if gone[i]:
            continue
        digest = _signed((sums[high[i]] - sums[low[i]]) * pow(BACK, low[i], 2**64) & MASK) if low[i] < high[i] else 0
        t = found.get(token)
        if t is None:
            found[token] = [p.paths[p.parents[i]] if i else 0, p.flags[i], 1, chars[i], links[i], controls[i], digest, digest]
        else:
            t[2] += 1
            t[3] += chars[i]
            t[4] += links[i]
            t[5] += controls[i]
            t[6], t[7] = min(t[6], digest), max(t[7], digest)
    for i, text in zip(p.at, p.texts, strict=True):
        if not gone[i]:
            t = found.setdefault(text_token(p.paths[i], text), [p.paths[i], TEXT, 0, len(text), 0, 0, 0, 0])
            t[2] += 1
    return found


def text_token(path: int, text: str) -> int:
    return _hash(b"text", _number(path), text.encode("utf-8", "surrogatepass"))


class Slot(NamedTuple):
    """A token as the template knows it: valid if it stands once a page in a valid class, same if its text never varies."""

    token: int
    parent: int
    flags: int
    chars: int
    links: int
    controls: int
    valid: bool
    same: bool


def roles(slots: Iterable[Slot]) -> tuple[set[int], set[int]]:
    """The tokens of the article (its element and its title), and those of elements that are something else."""
    by = {s.token: s for s in slots if not s.flags & TEXT}
    valid = {t: s for t, s in by.items() if s.valid}
    # tokens by depth, each after its parent; the nearest valid element around each
    around: dict[int, int] = {}
    for t in by:
        chain = []
        while t in by and t not in around:
            chain.append(t)
            t = by[t].parent
        for x in reversed(chain):
            p = by[x].parent
            around[x] = p if p in valid else around.get(p, 0)
    order, depth = [], {}
    for t in valid:
        chain = []
        while t in valid and t not in depth:
            chain.append(t)
            t = around[t]
        for x in reversed(chain):
            depth[x] = depth.get(around[x], 0) + 1
            order.append(x)
    below: dict[int, list[int]] = {}
    for t in order:
        below.setdefault(around[t], []).append(t)
    plain = {t: s.chars - s.links for t, s in valid.items()}
    own = {t: max(0, plain[t] - sum(plain[c] for c in below.get(t, ()))) for t in order}
    whole = sum(own.values())
    copies = 2 * sum(own[t] for t in order if valid[t].same) > whole

    def other(t: int) -> bool:
        s = valid[t]
        most = 2 * plain[t] > whole
        return bool(
            s.flags & COMMENT
            or s.flags & ASIDE and not most
            or s.chars and s.same and not copies and not s.flags & TITLE
            or s.chars and 2 * s.links > s.chars and not s.flags & TITLE
            or s.flags & FORM and plain[t] < FORM_TEXT * max(1, s.controls) and not most
        )

    off = {t: other(t) for t in order}
    under: dict[int, bool] = {}
    for t in order:
        under[t] = off[t] or under.get(around[t], False)
    named: dict[int, int] = {}
    for t in order:
        named[t] = max(valid[t].flags // RANK, named.get(around[t], 0))
    # elements whose text is all navigation, say, are no article unless there is nothing else
    some = [t for t in order if own[t] and not under[t]] or [t for t in order if own[t] and not valid[t].flags & COMMENT] or [t for t in order if own[t]]
    if not some:
        return set(), set()
    most = max(own[t] for t in some)
    best = max((t for t in some if 2 * own[t] >= most), key=lambda t: (named[t], own[t], -t))
    article = best
    up = best
    while up in valid and valid[up].flags // RANK < 2:
        up = around[up]
    if up in valid:
        article = up
    else:
        while (up := around[article]) in valid and not valid[up].flags & FRAME and not any(off[c] for c in below[up]):
            article = up
    way, t = set(), article
    while t in valid:
        way.add(t)
        t = around[t]
    inside = set()
    for t in order:
        if t == article or around[t] in inside:
            inside.add(t)
    titles = [t for t in order if valid[t].flags & TITLE]
    keep = {article}
    if not any(t in inside for t in titles):
        keep |= {t for t in titles if not under[t] and not (valid[t].same and not copies)}
        if len(keep) == 1:  # no <h1>: the one <h2> that stands beside the article
            beside = [t for t in order if valid[t].flags & SECOND and around[t] == around[article] and not under[t]]
            keep |= set(beside) if len(beside) == 1 else set()
    return keep, {t for t in order if off[t]} - way


def extract(p: Page, keep: set[int], drop: set[int], template: frozenset | set = frozenset(), settled: frozenset | set = frozenset()) -> str:
    """The article's blocks.  ``template`` are texts to leave out, ``settled`` elements the host's template has judged."""
    chars, links, controls, _, _, gone = _ranges(p)
    n = len(p.paths)
    if not any(t in keep and not g for t, g in zip(p.paths, gone, strict=True)):
        found = tokens(p)
        keep, drop = roles(Slot(t, v[0], v[1], v[3], v[4], v[5], v[2] == 1, False) for t, v in found.items())
        template, settled = frozenset(), {t for t, v in found.items() if v[2] == 1}
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[i] = holds[i] or p.paths[i] in keep
        if holds[i]:
            holds[p.parents[i]] = True
    kept = [False] * n
    for i, t in enumerate(p.paths):
        up = p.parents[i]
        kept[i] = t in keep or i > 0 and kept[up]
        if i and gone[up]:
            gone[i] = True
        elif not gone[i] and not holds[i] and kept[i]:
            flags = p.flags[i]
            gone[i] = t in drop or t not in settled and bool(flags & COMMENT or flags & ASIDE and 2 * (chars[i] - links[i]) <= chars[0] - links[0] or flags & FORM and chars[i] - links[i] < FORM_TEXT * max(1, controls[i]))
    out = []
    for i, text in zip(p.at, p.texts, strict=True):
        if kept[i] and not gone[i] and not (template and not p.flags[i] & TITLE and text_token(p.paths[i], text) in template):
            out.append(text)
    return "\n".join(out)


def host_of(url: str = "url"):
    """The host of a url column; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


_TOKEN = "token long, parent long, flags int, times int, chars long, links long, controls int, least long, most long"
_PAGE = "paths array<long>, parents array<int>, flags array<int>, controls array<int>, texts array<string>, at array<int>, links array<int>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Every page's elements and blocks, and its tokens; written to the shared folder, so that no page is read twice."""
    rows = pages.select("page_id", "url", host_of().alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), "html")
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [longs, ints, ints, ints, pa.list_(pa.string()), ints, ints]
    token = pa.struct([(k, pa.int64() if v == "long" else pa.int32()) for k, v in (x.split() for x in _TOKEN.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            # few pages at a time: a batch of long ones is held whole
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                found = [parse(h, known) for h in part.column("html").to_pylist()]
                columns = [pa.array([p[i] for p in found], kind) for i, kind in enumerate(kinds)]
                sizes, flat = [0], []
                for p in found:
                    own = tokens(p)
                    flat += [(t, *v) for t, v in own.items()]
                    sizes.append(len(flat))
                cols = list(zip(*flat, strict=True)) or [()] * token.num_fields
                structs = pa.StructArray.from_arrays([pa.array(c, token.field(i).type) for i, c in enumerate(cols)], fields=list(token))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "key")), *columns, lists], ["page_id", "url", "host", "key", *Page._fields, "tokens"])

    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, key long, {_PAGE}, tokens array<struct<{_TOKEN.replace(' ', ':').replace(',:', ', ')}>>"
    return common.materialize(rows.mapInArrow(run, kind), "pages")


def _supported(parsed: DataFrame) -> DataFrame:
    """(host, tokens): for hosts of two pages or more, the tokens that at least half of the pages have, with their vectors."""
    one = parsed.select("host", "key", F.explode("tokens").alias("t")).select("host", "key", "t.*")
    a, b = F.xxhash64("key", "times"), F.xxhash64("times", F.lit(7), "key")
    low = F.lit(0xFFFFFFFF)
    lanes = {"v0": a.bitwiseAND(low), "v1": F.shiftrightunsigned(a, 32), "v2": b.bitwiseAND(low), "v3": F.shiftrightunsigned(b, 32)}
    sums = [F.sum(c).alias(c) for c in ("times", "chars", "links", "controls", *lanes)]
    by = one.withColumns(lanes).groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.min("parent").alias("parent"), F.bit_or("flags").alias("flags"), *sums, F.min("least").alias("least"), F.max("most").alias("most"))
    size = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).where("host_pages > 1")
    by = by.join(size, "host").where(2 * F.col("pages") >= F.col("host_pages"))
    return common.materialize(by.groupBy("host").agg(F.collect_list(F.struct(*(c for c in by.columns if c not in ("host", "host_pages")))).alias("tokens")), "tokens")


def _vector(t: dict) -> tuple:
    return t["pages"], t["v0"], t["v1"], t["v2"], t["v3"]


def classes(found: list[dict]) -> tuple[dict[int, int], int]:
    """The class (its least token) of each element's token that stands once a page, and the root class: that of most pages, then of most tokens."""
    by: dict[tuple, list[int]] = {}
    for t in found:
        if not t["flags"] & TEXT and t["times"] == t["pages"]:
            by.setdefault(_vector(t), []).append(t["token"])
    root = max(by.items(), key=lambda x: (x[0][0], len(x[1]), -min(x[1])), default=(None, [0]))[1]
    return {t: min(ts) for ts in by.values() for t in ts}, min(root)


def orders(paths: list[int], klass: dict[int, int], root: int) -> dict[int, tuple[int, bool]]:
    """Of each class on a page: a digest of the order of its tokens and the gap of the root class they stand in, and whether that is one gap."""
    seen: dict[int, list[int]] = {}
    gaps: dict[int, set[int]] = {}
    gap = 0
    for t in paths:
        k = klass.get(t)
        if k is None:
            continue
        if k == root:
            gap = t
        else:
            gaps.setdefault(k, set()).add(gap)
        seen.setdefault(k, []).append(t)
    return {k: (_hash(np.array([*ts, *sorted(gaps.get(k, ()))], dtype=np.int64).tobytes()), len(gaps.get(k, ())) <= 1) for k, ts in seen.items()}


def deduce(found: list[dict], valid: set[int]) -> tuple[set[int], set[int], set[int], set[int]]:
    """A host's template from its tokens and valid classes: the article's tokens, those of other slots, template texts, and all elements judged."""
    klass, _ = classes(found)
    vectors = {_vector(t) for t in found if klass.get(t["token"]) in valid}
    slots = [Slot(t["token"], t["parent"], t["flags"], t["chars"], t["links"], t["controls"], klass.get(t["token"]) in valid, t["least"] == t["most"]) for t in found]
    keep, drop = roles(slots)
    texts = [t for t in found if t["flags"] & TEXT and _vector(t) in vectors]
    inside = {t["token"]: t["parent"] for t in found if not t["flags"] & TEXT}

    def of_article(path: int) -> bool:
        while path in inside and path not in keep:
            path = inside[path]
        return path in keep

    # texts that make up most of the article are copies of an article
    template = {t["token"] for t in texts}
    size = {t["token"]: t["chars"] for t in found}
    if 2 * sum(t["chars"] for t in texts if of_article(t["parent"])) > sum(size[t] for t in keep):
        template = set()
    return keep, drop, template, {s.token for s in slots if s.valid}


def _with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    return rows.join(common.maybe_broadcast(hosts.withColumnRenamed("host", "_host"), 50_000), F.col("host") == F.col("_host"), "left").drop("_host")


def templates(parsed: DataFrame) -> DataFrame:
    """(host, keep, drop, template, settled, n_classes, n_valid) of each host of two pages or more; written to the shared folder."""
    supported = _supported(parsed)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list] = {}
        last, known = None, ({}, 0)
        for b in batches:
            for host, paths, token, of in zip(*(b.column(c).to_pylist() for c in ("host", "paths", "token", "class")), strict=True):
                if token is None:
                    continue
                if host != last:
                    last, known = host, (dict(zip(token, of, strict=True)), of[0])
                for k, (digest, nested) in orders(paths, *known).items():
                    t = total.setdefault((host, k), [digest, digest, nested])
                    t[0], t[1], t[2] = min(t[0], digest), max(t[1], digest), t[2] and nested
            if len(total) > 50_000:
                yield send(total)
        yield send(total)

    def send(total: dict) -> pa.RecordBatch:
        keys, values = list(zip(*total, strict=True)) or [(), ()], list(zip(*total.values(), strict=True)) or [(), (), ()]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(values[0], pa.int64()), pa.array(values[1], pa.int64()), pa.array(values[2], pa.bool_())], ["host", "class", "least", "most", "nested"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for found in b.column("tokens").to_pylist():
                klass, root = classes(found)
                # the root class comes first
                rows.append(sorted(klass.items(), key=lambda x: (x[1] != root, x)))
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.int64())), pa.array([[k for _, k in r] for r in rows], pa.list_(pa.int64()))], ["host", "token", "class"])

    named = common.materialize(supported.mapInArrow(name, "host string, token array<long>, class array<long>").where(F.size("token") > 0), "classes")
    seen = _with_hosts(parsed.select("host", "paths"), named).mapInArrow(check, "host string, class long, least long, most long, nested boolean")
    seen = seen.groupBy("host", "class").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.bool_and("nested").alias("nested"))
    valid = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n_classes"), F.collect_list(F.when((F.col("least") == F.col("most")) & F.col("nested"), F.col("class"))).alias("valid"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for b in batches:
            rows = [deduce(t, set(v)) for t, v in zip(b.column("tokens").to_pylist(), b.column("valid").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), *(pa.array([sorted(r[i]) for r in rows], kind) for i in range(4)), b.column("n_classes"), pa.array([len(v) for v in b.column("valid").to_pylist()], pa.int64())], ["host", "keep", "drop", "template", "settled", "n_classes", "n_valid"])

    kind = "host string, keep array<long>, drop array<long>, template array<long>, settled array<long>, n_classes long, n_valid long"
    return common.materialize(supported.join(valid, "host").select("host", "tokens", "valid", "n_classes").mapInArrow(build, kind), "templates")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    parsed = parsed_pages(pages)
    rows = _with_hosts(parsed.select("page_id", "url", "host", *Page._fields), templates(parsed).drop("n_classes", "n_valid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, (set(), set(), set(), set())
        for b in batches:
            parts = [b.column(c).to_pylist() for c in Page._fields]
            text = []
            for host, page, *sets in zip(b.column("host").to_pylist(), zip(*parts, strict=True), *(b.column(c).to_pylist() for c in ("keep", "drop", "template", "settled")), strict=True):
                if host != last:
                    last, known = host, tuple(set(s or ()) for s in sets)
                text.append(extract(Page(*page), *known))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
