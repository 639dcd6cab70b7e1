"""Queries read whole texts and whole tables: fixtures whose telling parts stand where a prefix or a subset ends."""

import random

import pytest

from townscribe.operators import vectors
from townscribe.plans import catalog, legal, registry
from townscribe.plans import vectors as plans_vectors

catalog.load()

FILLER = "The weather was mild and the harvest went on as before. " * 60
LATE = {
    "A quorum is reached once ten owners have come together.": ("proxy_voting", "proxy_quorum_counting"),
    "Each owner has the right to inspect the roster of the village.": ("records_access", "records_member_list_access"),
    "Files on litigation are withheld from inspection by owners.": ("records_sharing_limits", "sharing_privacy_redaction"),
}
# of the phrase that is laid over a document, by doc_id % 6; 3 is the overlay of electronic transactions
EARLY = [
    {("proxy_voting", "proxy_directed_option")},
    {("proxy_voting", "proxy_revocability")},
    {("records_access", "records_response_deadline")},
    None,
    {("records_sharing_limits", "sharing_member_list_use_restriction")},
    {("records_access", "records_document_types")},
]
DOCUMENTS = "doc_id long, text string, lang string"


def legal_rows():
    return [(i, FILLER + list(LATE)[i % 3] + " " + FILLER * (1 + i % 2), f"j{i % 2}") for i in range(24) if i % 6 != 3]


def legal_want():
    """(doc_id, jurisdiction, topic, rule type, sentence) of every rule, from the fixture alone."""
    want = set()
    for i, text, lang in legal_rows():
        sentence = list(LATE)[i % 3]
        assert text.index(sentence) > 2000
        want |= {(i, lang, *LATE[sentence], sentence)} | {(i, lang, *r, legal.PHRASES[i % 6]) for r in EARLY[i % 6]}
    return want


@pytest.fixture(scope="module")
def late_rules(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("late"))
    spark.createDataFrame(legal_rows(), DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    return d


def test_sentence_rules_reach_the_end_of_a_text(spark, late_rules):
    got = registry.QUERIES["sentence_rules"](spark, late_rules).collect()
    assert {(r["doc_id"], r["jurisdiction"], r["topic_family"], r["rule_type"], r["value_text"]) for r in got} == legal_want() and len(got) == len(legal_want())


def test_profiles_count_late_sentences(spark, late_rules):
    for r in registry.QUERIES["jurisdiction_profiles"](spark, late_rules).collect():
        own = [x for x in legal_want() if x[1] == r["jurisdiction"]]
        assert (r["n_rules"], r["rule_types"]) == (len(own), sorted({x[3] for x in own}))


def test_coverage_counts_late_sentences(spark, late_rules):
    clusters = {"permission": {"proxy_allowed", "proxy_directed_option"}, "duration": {"proxy_validity_duration"}, "records": {"records_inspection_right", "records_document_types"}}
    # a table of its own, in which only the late sentence covers the last cluster
    d = f"{late_rules}/coverage"
    spark.createDataFrame([(1, FILLER + "The board lets owners look at its annual report.", "j")], DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    for folder, seen in ((late_rules, legal_want()), (d, {(1, "j", "proxy_voting", "proxy_revocability", ""), (1, "j", "records_access", "records_document_types", "")})):
        for r in registry.QUERIES["cluster_coverage"](spark, folder).collect():
            types = {x[3] for x in seen if x[1] == r["jurisdiction"]}
            assert set(r["covered"]) == {c for c, any_of in clusters.items() if types & any_of}
            assert set(r["missing"]) == {c for c, any_of in clusters.items() if not types & any_of}


def test_review_queue_holds_late_sentences(spark, late_rules):
    got = {(r["doc_id"], r["jurisdiction"], r["topic_family"], r["rule_type"], r["value_text"]) for r in registry.QUERIES["review_queue"](spark, late_rules).collect()}
    assert got == legal_want()


def test_addresses_past_a_prefix_are_found(spark, tmp_path):
    late = "Mail for the community goes to 31 Birch Avenue, Durham, NC 27701. "
    rows = [(1, FILLER + late + late + FILLER, "en"), (2, FILLER, "en")]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["query"]): r["occurrences"] for r in registry.QUERIES["address_candidates"](spark, str(tmp_path)).collect()}
    laid = {"12 Oak Street, Raleigh, NC 27601": 2, "9 Elm Road, Cary, NC 27511": 1}
    assert got == {(i, q): n for i in (1, 2) for q, n in laid.items()} | {(1, "31 Birch Avenue, Durham, NC 27701"): 2}


def test_contexts_hold_whole_texts_up_to_the_limit(spark, tmp_path):
    rng = random.Random(3)
    size = {1: 9000, 2: 9000, 3: 5970, 4: 3000, 5: 2100, 6: 2401, 7: 10}
    texts = {i: "".join(rng.choice("abcdefgh ") for _ in range(size.get(i % 8, 1500))) for i in range(100)}
    vectors_ = {i: [1.0, rng.random(), rng.random()] for i in texts}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, v, i % 2) for i, v in vectors_.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = {}
    for r in vectors.knn(*plans_vectors.tables(spark, str(tmp_path)), 5).collect():
        hits.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = {q: "\n\n".join(f"[{n}] {texts[i]}" for n, i in sorted(v))[:6000] for q, v in hits.items()}
    got = {r["query_id"]: r["context"] for r in registry.QUERIES["retrieval_context"](spark, str(tmp_path)).collect()}
    assert any(len(t) == 6000 for t in want.values()) and got == want
    assert set(got) == {0, 20, 40, 60, 80}


def test_a_first_text_over_the_limit_is_cut_and_not_dropped(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 11, 1), (2, 10, 2), (3, 12, 1), (3, 11, 2)], "query_id long, vec_id long, rank int")
    texts = spark.createDataFrame([(10, "a" * 200), (11, "b" * 20), (12, "c" * 71)], "vec_id long, text string")
    got = {r["query_id"]: r["context"] for r in vectors.context(hits, texts, 80).collect()}
    assert got == {1: "[1] " + "a" * 76, 2: "[1] " + "b" * 20 + "\n\n[2] " + "a" * 50, 3: "[1] " + "c" * 71}


def test_crawl_starts_from_every_page(spark, tmp_path):
    a = lambda *to: "".join(f'<a href="https://{u}.example/">a page on {u}</a>' for u in to)
    rows = [(1, "https://one.example/", a("two", "far")), (2, "https://two.example/", a("three")), (50, "https://fifty.example/", a("one")), (7, "https://seven.example/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["url"]: r["depth"] for r in registry.QUERIES["crawl_frontier"](spark, str(tmp_path)).collect()}
    assert got == {u: 0 for _, u, _ in rows} | {"https://far.example/": 1, "https://three.example/": 1}
