import random

from townscribe.llm import html_extract as hx
from townscribe.llm.queries import op4_html_extraction

PAGES = "page_id long, url string, html string"


def site(kind, i, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    if kind == "article":
        return f"<html><head><title>T{i}</title><script>var a='<p>x</p>';</script><style>p{{}}</style></head><body><header>Site name</header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy {i}</div><article><h1>Head {i}</h1>{body}<aside>See also</aside><form><label>Name</label></form><div class='comments'><p>First!</p></div></article><footer>Fine print</footer></body></html>"
    if kind == "main":
        return f"<body><div id=menu>Menu</div><div class='cookie-notice'>We use cookies</div><main><h1>Head {i}</h1><div>{body}</div></main><div class=sidebar>Side {i}</div></body>"
    return f"<body><div class='top'><ul class='nav-bar'><li>One<li>Two</ul></div><div class='w{i}'><div class='post-body content'><h1>Head {i}</h1>{body}</div></div><section id='respond'>Leave a reply</section></body>"


def test_templates_of_several_sites(spark, tmp_path):
    rng = random.Random(1)
    rows, want = [], {}
    for k, kind in enumerate(("article", "main", "class")):
        for i in range(12):
            ps = [f"Paragraph {rng.randrange(10**6)} of &lt;{kind}&gt; &amp; more." for _ in range(rng.randrange(2, 6))]
            rows.append((100 * k + i, f"https://{kind}.example/{i}", site(kind, i, ps)))
            want[100 * k + i] = "\n".join([f"Head {i}", *(p.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") for p in ps)])
    rows += [(900, None, None), (901, "not a url", ""), (902, "http://one.example/", "just text"), (903, "https://article.example/0", rows[0][2]), (904, "http://cut.example/", "<article><p>Open <b>and<br>cut &am")]
    want |= {900: "", 901: "", 902: "just text", 903: want[0], 904: "Open and cut &am"}
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = op4_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    found = {r["host"]: r for r in hx.templates(hx.parsed_pages(spark.createDataFrame(rows, PAGES))).collect()}
    assert all(r["n_valid"] >= 1 and len(r["keep"]) == 1 for h, r in found.items() if h)


def test_no_pages(spark):
    assert hx.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_copies_of_one_page_keep_their_text(spark):
    page = site("article", 1, ["Same text on every page."])
    rows = [(i, "https://copies.example/x", page) for i in range(8)]
    assert {r["text"] for r in hx.main_text(spark.createDataFrame(rows, PAGES)).collect()} == {"Head 1\nSame text on every page."}


def test_wrappers_named_like_sidebars_keep_the_page(spark):
    body = "".join(f"<p>Paragraph {i} of the article text.</p>" for i in range(6))
    pages = {
        1: f"<body><div class='page with-sidebar'><article><h1>H</h1>{body}</article><div class='sidebar'>Side</div></div></body>",
        2: f"<body><div class='has-menu wrapper'><h1>H</h1>{body}<div class='menu'>Menu</div></div></body>",
        3: f"<body><div class='content'><h1>H</h1>{body}<div class='comments'>{'<p>A long comment.</p>' * 40}</div><div class='notice'>Cookies</div></div></body>",
        4: f"<body><article><h1>H</h1>{body}<!-- x --><div role='complementary'>More</div><section class='related'><article>Teaser</article></section></article></body>",
    }
    want = "\n".join(["H", *(f"Paragraph {i} of the article text." for i in range(6))])
    df = spark.createDataFrame([(k, f"http://h{k}.example/", v) for k, v in pages.items()], PAGES)
    assert {r["page_id"]: r["text"] for r in hx.main_text(df).collect()} == dict.fromkeys(pages, want)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in hx.main_text(spark.createDataFrame(rows, PAGES)).collect()}


def neutral(i, extra=""):
    """A page whose names say nothing: the vectors alone can tell article, promotion and menu."""
    rng = random.Random(i)
    body = "".join(f"<p>Sentence {rng.randrange(10**6)} about topic {rng.randrange(10**6)}.</p>" for _ in range(rng.randrange(3, 7)))
    menu = "".join(f"<li><a href='/{k}'>Entry {rng.randrange(99)}</a></li>" for k in range(rng.randrange(3, 9)))
    shown = "<div class='ke'><p>Follow us on all channels.</p></div>" if i % 4 else ""
    return f"<body><div class='ka'><ul>{menu}</ul></div><div class='kb'>Word {i}</div><div class='kc'><h1>Title {i}</h1>{body}{shown}<p>Written by our own staff.</p>{extra}</div><div class='kd'>All rights reserved</div></body>", body


def test_constant_blocks_with_neutral_names_are_template(spark):
    rows, want = [], {}
    for i in range(16):
        page, body = neutral(i)
        rows.append((i, "http://neutral.example/", page))
        want[i] = "\n".join([f"Title {i}", *body[3:-4].split("</p><p>")])
    assert texts(spark, rows) == want


def test_forms_around_the_page_and_compound_names_stay(spark):
    rows = [(i, "http://forms.example/", f"<body><form action='/'><input type=hidden><div id='menu'><a href='/'>Home</a></div><div id='main'><h1>H{i}</h1><p>A long enough text of page {i}.</p><div class='share-price'>Price {i}</div><p>And its second part {i * i}.</p><form><label>Mail</label><input></form></div></form></body>") for i in range(6)]
    assert texts(spark, rows) == {i: f"H{i}\nA long enough text of page {i}.\nPrice {i}\nAnd its second part {i * i}." for i in range(6)}


def test_long_names_are_not_one_element(spark):
    name = "x" * 80
    rows = [(i, "http://names.example/", f"<body><div class='{name}a'><p>Text {i} of the article, long enough.</p><p>More {i}.</p></div><div class='{name}b'>Same</div></body>") for i in range(4)]
    assert texts(spark, rows) == {i: f"Text {i} of the article, long enough.\nMore {i}." for i in range(4)}


def test_deep_long_and_clashing(spark):
    deep = "<div>" * 100_000 + "far down" + "</span></x>" * 1000
    long = "<article>" + "<p>one &amp; two</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "http://a.example/", deep), (2, "http://b.example/", long), (2, "http://b.example/", long)], PAGES)
    df = df.selectExpr("*", "1 host", "2 key", "3 tokens", "4 keep", "5 text", "6 paths")
    got = sorted((r["page_id"], len(r["text"])) for r in hx.main_text(df).collect())
    assert got == [(1, 8), (2, 20_000 * 10 - 1), (2, 20_000 * 10 - 1)]


def brute_classes(pages):
    """Equivalence classes of a host's elements by whole occurrence vectors, and which of them are valid."""
    parsed = [hx.parse(p, {}) for p in pages]
    vectors = {}
    for k, p in enumerate(parsed):
        for t in p.paths:
            vectors.setdefault(t, [0] * len(pages))[k] += 1
    by = {}
    for t, v in vectors.items():
        if max(v) == 1 and 2 * sum(v) >= len(pages):
            by.setdefault(tuple(v), set()).add(t)
    root = max(by.items(), key=lambda x: (sum(x[0]), len(x[1]), -min(x[1])))[1]
    valid = set()
    for v, ts in by.items():
        seen = set()
        for k, p in enumerate(parsed):
            if v[k]:
                gap, gaps, order = 0, set(), []
                for t in p.paths:
                    gap = t if t in root else gap
                    if t in ts:
                        order.append(t)
                        gaps.add(gap)
                seen.add((tuple(order), None if ts == root else tuple(sorted(gaps))))
        if len(seen) == 1 and (ts == root or len(next(iter(seen))[1]) == 1):
            valid |= ts
    return len(by), valid


def test_classes_as_brute_force(spark):
    def shuffled(i):
        parts = ["<div class=a>x</div>", "<div class=b>y</div>", "<div class=c>z</div>"]
        random.Random(i).shuffle(parts)
        swapped = "<div class=f></div><div class=g></div>" if i % 2 else "<div class=g></div><div class=f></div>"
        return neutral(i, parts[0] + (parts[1] + parts[2] if i % 3 else ""))[0] + (f"<section class=e>{swapped}</section>" if i % 4 else "")

    rows = [(100 * h + i, f"http://h{h}.example/", shuffled(i * h)) for h in (1, 2, 3) for i in range(12)]
    got = {r["host"]: r for r in hx.templates(hx.parsed_pages(spark.createDataFrame(rows, PAGES))).collect()}
    invalid = 0
    for h in (1, 2, 3):
        n, valid = brute_classes([p for _, u, p in rows if u == f"http://h{h}.example/"])
        r = got[f"h{h}.example"]
        assert r["n_classes"] == n and set(r["settled"]) == valid
        invalid += n - r["n_valid"]
    assert invalid


def blocks(page):
    return hx.parse(page, {}).texts


def test_embedded_content_stays():
    assert blocks("<p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>mc^2</annotation></math> holds</p>") == ["E = mc2 holds"]
    assert blocks("<p>A real text before.</p><object data=a.swf><p>And all that follows.</p>") == ["A real text before.", "And all that follows."]
    for t in ("object", "audio", "video", "canvas"):
        assert blocks(f"<p>one <{t} src=x>two</{t}> three</p><p>four</p>") == ["one two three", "four"]
        assert blocks(f"<div><p>one <{t}>two</p></div><p>three</p>") == ["one two", "three"]
    assert blocks("<p>a <svg viewBox='0 0 1 1'><title>icon</title><desc>d</desc><g><text>label</text><path d='M0'/></g></svg> b</p>") == ["a label b"]


def test_what_is_never_shown_ends_where_it_can():
    for t in ("noscript", "template", "iframe", "select"):
        assert blocks(f"<p>a <{t}>gone</{t}> b</p><p>c</p>") == ["a b", "c"]
        assert blocks(f"<p>a</p><{t}><p>c</p>") == ["a", "c"]
    assert blocks("<p>a</p><script>x<p>c</p>") == ["a"]
    assert blocks("<p>a</p><style>x</style><p>c</p>") == ["a", "c"]


def test_stray_quotes():
    assert blocks("<p><span class=it's>one</span> two</p>") == ["one two"]
    assert blocks("""<p><a href=x" title='a > b'>one</a> <i data-x="c > d">two</i></p>""") == ["one two"]
    assert blocks("<p><b '>one</b> it's <u \">two</u></p>") == ["one it's two"]
    assert hx._label("div", " class=it's id=x")[0] == b"div.it's.x"


def test_hidden_inline_elements():
    assert blocks("<p>a <span hidden>gone <b>too</b> <span>and this</span> still</span> b</p>") == ["a b"]
    assert blocks("<p>a <i style='display:none'>gone</p><p>b</p>") == ["a", "b"]
    assert blocks("<p>a <em>kept</em> <img hidden> b</p>") == ["a kept b"]
    assert blocks("<div>a <span hidden>gone <p>this too</p> and this</span> b</div>") == ["a", "b"]


def test_long_runs_of_tags_take_linear_time():
    import time

    for page in ("<svg/>x" * 150_000, "<noscript>x" * 100_000, "<iframe/>x" * 100_000, "<i class=a'b>x" * 80_000):
        began = time.perf_counter()
        hx.parse(page, {})
        assert time.perf_counter() - began < 3, page[:12]
