import random
from collections import Counter

from pyspark.sql import functions as F

from townscribe.llm import decontamination as dc

from .tables import DOC, awkward, sentence

BENCH = "item_id long, text string"


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, items):
    out = []
    for d, text, *_ in rows:
        w, hit, best = (text or "").lower().split(), set(), 0.0
        for item, t in items:
            v = (t or "").lower().split()
            if not v:
                continue
            k = min(5, len(v))
            want = grams(v, k)
            for i in range(max(1, len(w) - len(v) + 1)):
                got = grams(w[i : i + len(v)], k)
                n = sum((got & want).values())
                s = n / (sum(got.values()) + sum(want.values()) - n) if n else 0
                if s >= 0.75:
                    hit.add(item)
                    best = max(best, s)
        out.append((d, tuple(sorted(hit)), round(best, 9)))
    return sorted(out, key=str)


def planted(seed=8):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randrange(12, 60), 3000)) for i in range(25)] + [(90, "just four words here"), (91, ""), (92, None), (93, items_text := sentence(rng, 30, 3000)), (94, items_text)]
    rows = awkward(2)
    for i in range(60):
        v = items[i % 25][1].split()
        if i % 4 == 1:
            v[rng.randrange(len(v))] = "edited"
        elif i % 4 == 2:
            v.insert(rng.randrange(len(v)), "added")
        elif i % 4 == 3:
            v = v[: len(v) * 2 // 3]
        rows.append((1000 + i, f"{sentence(rng, rng.randrange(0, 50), 3000)}\n{' '.join(v).upper()}\n{sentence(rng, rng.randrange(0, 50), 3000)}", "en", "s", 0))
    rows.append((2000, items_text, "en", "s", 0))
    rows.append((2001, "well just four words here it is", "en", "s", 0))
    return rows, items


def test_as_brute_force(spark):
    rows, items = planted()
    df, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, BENCH)
    got = sorted(((r["doc_id"], tuple(r["items"]), round(r["similarity"], 9)) for r in dc.report(df, bench).collect()), key=str)
    want = brute(rows, items)
    assert got == want
    assert sum(bool(h) for _, h, _ in want) > 30
    bad = {d for d, h, _ in want if h}
    assert sorted(r["doc_id"] for r in dc.clean(df, bench).collect()) == sorted(d for d, *_ in rows if d not in bad)


def test_clashing_columns_null_ids_and_empty_tables(spark):
    rows, items = planted()
    bench = spark.createDataFrame(items, BENCH)
    df = spark.createDataFrame([(None, items[0][1], "en", "s", 0), *rows[:5]], DOC).withColumns({c: F.lit(1) for c in ("item", "words", "start", "hashes", "_doc", "_key", "low", "shingle")})
    got = dc.clean(df, bench)
    assert got.columns == df.columns and got.where("doc_id is null").count() == 0
    none, docs = spark.createDataFrame([], DOC), spark.createDataFrame(rows[:5], DOC)
    assert dc.report(none, bench).collect() == []
    assert dc.clean(docs, spark.createDataFrame([], BENCH)).count() == 5
    unnamed = dc.report(spark.createDataFrame([(1, items[0][1], "en", "s", 0)], DOC), spark.createDataFrame([(None, items[0][1])], BENCH)).first()
    assert unnamed["leaked"] and unnamed["items"] == []


def test_blocks_meet_within_the_radius(spark):
    """Any two fingerprints within the radius agree in a block."""
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        x = rng.getrandbits(128)
        y = x
        for b in rng.sample(range(128), dc.RADIUS):
            y ^= 1 << b
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        rows.append(tuple(signed(v) for z in (x, y) for v in (z & (2**64 - 1), z >> 64)))
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    a, b, c, d = (F.col(x) for x in "abcd")
    met = F.array_intersect(dc._blocks(a, b), dc._probed(c, d))
    got = df.select(F.array_min(F.transform(met, lambda x: F.shiftright(x, 8))).alias("least"), dc._first_block(a, b, c, d).alias("first")).collect()
    assert all(r["least"] == r["first"] is not None for r in got)
    assert dc.RADIUS < dc.BLOCKS * (dc.PROBE + 1) and dc.BLOCKS * 8 == dc.BITS


def test_windows_are_all_that_can_reach_the_similarity(spark):
    rows, items = planted(3)
    df, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, BENCH)
    laid = {(r["doc_id"], r["size"], s) for r in dc.windows(df, dc.items(bench)).select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.*").collect() for s in r["starts"]}
    met = {(r["doc_id"], r["size"], r["start"]) for r in dc.leaks(df, bench).collect()}
    want = set()
    for d, text, *_ in rows:
        w = (text or "").lower().split()
        for _, t in items:
            v = (t or "").lower().split()
            if not v:
                continue
            k = min(5, len(v))
            for i in range(max(1, len(w) - len(v) + 1)):
                got, have = grams(w[i : i + len(v)], k), grams(v, k)
                n = sum((got & have).values())
                if n and 4 * n >= 3 * (sum(got.values()) + sum(have.values()) - n):
                    want.add((d, len(v), i))
    assert want <= laid and len(met & want) >= 0.98 * len(want) and met <= want


def test_no_python_in_the_plan(spark):
    rows, items = planted()
    plan = dc.report(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, BENCH))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_weights_of_repeated_shingles_and_long_texts(spark):
    item = "a b c d e a b c d e a b c d e a b"
    rows = [(1, f"x {item} y", "en", "s", 0), (2, "a b c d e a b c d e", "en", "s", 0), (3, "z " * 30_000 + item, "en", "s", 0), (4, item, "en", "s", 0), (4, item, "en", "s", 0)]
    got = sorted((r["doc_id"], r["leaked"], round(r["similarity"], 9)) for r in dc.report(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, item)], BENCH)).collect())
    want = {d: (h == (1,), s) for d, h, s in brute(rows, [(1, item)])}
    assert got == sorted((d, *want[d]) for d, *_ in rows) and want[4] == (True, 1.0)
