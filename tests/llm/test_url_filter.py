import random

import pytest

from townscribe.llm import queries, url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
KIND = "host string, path string, verdict string"


def brute(url, rules):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: (x[0], x[1], x[3] == "block"), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge(pages, spark.createDataFrame(rules, KIND), **more)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


ODD = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en", "http://example.net/en/", "http://xexample.net/en/1",
    "http://m.EXAMPLE.net/en/1?a=/de/", "http://example.net?/en/", "http://example.net#/en/", "http://example.com/de/ü", "http://example.com/DE/", "http://example.com:80/de/",
    "http://u@example.com/de/", "http://org/fr/", "http://.org/fr/", "http://org./fr/", "http://a..org/fr/x", "http://x/?u=http://a.net/", "a\nb://c.net/\nd", "http://" + "a." * 3000 + "net/" + "p" * 50000,
]


def test_odd_urls(spark):
    got = judged(spark, ODD, RULES)
    assert got == {i: brute(u, RULES) for i, u in enumerate(ODD)}
    assert got[9] == ("example.net", "/en/", "example.net/en/", "allow") and got[10][3] == "block" and got[0] == ("", "", None, "allow")


@pytest.mark.parametrize("block_rules", [10_000, 40])
def test_many_rules_equal_brute_force_in_any_blocks(spark, block_rules):
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join(rng.choice("/xy") for _ in range(rng.randrange(0, 5)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(300)]
    urls = [f"http://{host()}/{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(800)]
    settled = {}
    for h, p, v in rules:
        settled[h, p] = max(settled.get((h, p), ""), v)
    settled = [(*k, v) for k, v in settled.items()]
    assert judged(spark, urls, rules, block_rules=block_rules) == {i: brute(u, settled) for i, u in enumerate(urls)}


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_digest", lambda s: len(s) % 3)
    words = {bytes([97 + i]) * (1 + i % 5): i for i in range(20)}
    url_filter.DigestArray.write(str(tmp_path), "x", words)
    array = url_filter.DigestArray(str(tmp_path), "x")
    assert len(array.keys) == len(words)
    for w, n in words.items():
        at = array.find([w])[0]
        assert array.string(at) == w and array.numbers[at] == n
    assert list(array.find([b"zz", b"", b"b"])) == [-1, -1, -1]


def test_tables(spark):
    rules = spark.createDataFrame(RULES, KIND)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert judged(spark, ["http://a.net/"], [])[0] == ("a.net", "/", None, "allow")
    clash = spark.createDataFrame([(1, "x", "y", "http://a.net/", 2.0)] * 2, "page_id long, host string, rule string, url string, n double")
    got = url_filter.judge(clash, rules)
    assert got.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in got.collect()] == [(1, "http://a.net/", 2.0, "a.net", "/", "net/", "block")] * 2
    for bad in ([(None, "/", "block")], [("", "/", "block")], [("a", "/", "deny")]):
        with pytest.raises(ValueError):
            url_filter.publish(spark.createDataFrame(bad, KIND))
    assert judged(spark, ["http://A.b/c"], [("A.B", None, "block")])[0] == ("a.b", "/c", "a.b", "block")


def test_query_equals_sql_and_brute_force(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{data}/pages.parquet'")
    got = queries.QUERIES["op13_url_filters"](spark, data).select("page_id", "host", "path", "rule", "verdict").collect()
    want = con.execute(f"select page_id, host, path, rule, verdict from ({queries.ORACLES['op13_url_filters']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    urls = dict(con.execute("select page_id, url from pages").fetchall())
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: brute(u, RULES) for i, u in urls.items()}
