import hashlib
import math

from pyspark.sql import functions as F

from townscribe.llm import fingerprints as fp
from townscribe.llm.queries import op1_fingerprints

from .tables import DOC, awkward


def test_sums_are_order_free_and_can_be_undone(spark):
    a, b = "First one. And more.\nSecond line", "Third, line.\nFirst one. And more."
    df = spark.createDataFrame([(1, f"{a}\n{b}", f"{b}\n{a}", a, b)], "doc_id long, ab string, ba string, a string, b string")
    for c in ("ab", "ba", "a", "b"):
        df = fp.with_vectors(df, c, f"v_{c}")
    v = {c: F.col(f"v_{c}") for c in ("ab", "ba", "a", "b")}
    r = df.select(*(fp.text_of(x).alias(n) for n, x in {**v, "sum": fp.add(v["a"], v["b"]), "rest": fp.subtract(v["ab"], v["b"])}.items())).first()
    assert r["ab"] == r["ba"] == r["sum"] and r["rest"] == r["a"] and r["a"] != r["b"]


def test_edited_texts_as_brute_force(spark, tmp_path):
    rows = [r for i, r in enumerate(awkward()) if i < 68]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op1_fingerprints(spark, str(tmp_path)).collect()}
    text = {d: t or "" for d, t, *_ in rows}
    assert set(got) == set(text)
    ids = sorted(text, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for d, t in text.items():
        half = len(t) // 2
        edited = t[: len(t) - half] + text[following[d]][:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if text[following[d]] == t:
            assert r["near_next"] == 1
    for a in text:
        for b in text:
            if text[a] == text[b]:
                assert got[a]["fingerprint"] == got[b]["fingerprint"]


def test_one_row_no_row_null_ids_and_repeats(spark):
    one = fp.edited(spark.createDataFrame([(5, "a. b. c. d.")], "doc_id long, text string")).first()
    assert one["edited"] == "a. b. a. b."[: len("a. b. c. d.") - 5] + "a. b."
    assert fp.edited(spark.createDataFrame([], DOC)).collect() == []
    rows = [(None, "null id", "en", "s", 1), (3, "aaaa", "en", "s", 1), (3, "aaaa", "en", "s", 1), (8, None, "en", "s", 1)]
    got = sorted((r["doc_id"] or 0, r["edited"]) for r in fp.edited(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(0, "null id"), (3, "aa"), (3, "aa"), (8, "")]


def test_no_python_on_the_path(spark):
    df = fp.edited(spark.createDataFrame(awkward(), DOC))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def brute_likeness(spark, a, b):
    """Cosine of the count sketches of two texts, run by run."""
    def runs(text):
        return [tuple([*ws[i : i + 3], None, None][:3]) for ws in (p.split(" ") for p in text.split("\n")) for i in range(len(ws))] if text else []

    every = sorted({r for t in (a, b) for r in runs(t)}, key=str)
    if not every:
        return 1.0 if a == b else 0.0
    df = spark.createDataFrame(every, "x string, y string, z string")
    code = {tuple(r)[:3]: r["c"] for r in df.select("*", F.pmod(F.xxhash64(F.xxhash64("x", "y"), "z"), F.lit(2 * fp.SKETCH)).alias("c")).collect()}
    lanes = []
    for t in (a, b):
        v = [0] * fp.SKETCH
        for r in runs(t):
            v[code[r] // 2] += 1 if code[r] % 2 else -1
        lanes.append(v)
    size = math.sqrt(sum(x * x for x in lanes[0]) * sum(x * x for x in lanes[1]))
    cosine = sum(x * y for x, y in zip(*lanes)) / size if size else 0.0
    return 1.0 if sorted(a.split("\n")) == sorted(b.split("\n")) else min(1.0, max(0.0, cosine))


def test_likeness_as_brute_force(spark):
    rows = awkward(9)
    texts = [(t or "") for _, t, *_ in rows]
    pairs = [(texts[i], texts[(i * 7 + 3) % len(texts)]) for i in range(len(texts))] + [(texts[3], texts[2]), (texts[5], texts[4])]
    df = fp.with_vectors(fp.with_vectors(spark.createDataFrame(pairs, "a string, b string"), "a", "va"), "b", "vb")
    got = {(r["a"], r["b"]): r["n"] for r in df.select("a", "b", fp.likeness(F.col("va"), F.col("vb")).alias("n")).collect()}
    for a, b in dict.fromkeys(pairs[::5] + pairs[-2:]):
        assert abs(got[a, b] - brute_likeness(spark, a, b)) < 1e-9


def test_extra_columns_long_texts_and_no_rows(spark):
    names = ("_words", "_codes", "_kinds", "_first", "_count", "_lanes", "_values", "_pairs", "_v", "words", "v")
    df = spark.createDataFrame([(1, "word " * 60_000 + "\nend", "en", "s", 0), (2, "end\n" + "word " * 60_000, "en", "s", 0)], DOC).withColumns({c: F.lit(7) for c in names})
    got = fp.fingerprint(df).collect()
    assert all(r[c] == 7 for r in got for c in names) and got[0]["fingerprint"] == got[1]["fingerprint"]
    none = spark.createDataFrame([], DOC)
    assert fp.fingerprint(none).collect() == [] and fp.edited(none).collect() == []
