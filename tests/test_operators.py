"""Operators on small fixtures with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from townscribe.functions import geo, names, text
from townscribe.operators import catalog, changes, chunker, legal, resolve, spatial, vectors, windows
from townscribe.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rollup_counts_entities_without_documents(spark):
    e = spark.createDataFrame([(1, "Alpha", "NC"), (2, "Beta", "NC"), (3, "Gamma", "GA"), (4, "50% Club", None)], "entity_id long, entity string, place string")
    d = spark.createDataFrame([(1, 10, 100.0, "2024-01-01"), (2, 11, 5.0, "2024-01-02")], "entity_id long, document_id long, value double, ts string")
    c = spark.createDataFrame([(10, 0), (10, 1)], "document_id long, chunk_index long")
    got = {r["entity"]: r for r in catalog.entity_rollup(e, d, c).collect()}
    assert len(got) == 4
    assert (got["Alpha"]["doc_count"], got["Alpha"]["chunk_count"]) == (1, 2)
    assert (got["50% Club"]["doc_count"], got["50% Club"]["last_ts"]) == (0, None)
    assert [r["entity"] for r in catalog.entity_rollup(e, d, c, q="50%").collect()] == ["50% Club"]
    assert {r["entity"] for r in catalog.entity_rollup(e, d, c, place="nc", with_docs=True).collect()} == {"Alpha", "Beta"}
    with pytest.raises(ValueError):
        catalog.page(e, "entity", "entity_id", -1)


def test_histogram_folds_missing_and_unknown(spark):
    d = spark.createDataFrame([("ccr",), ("ccr",), (None,), ("unknown",)], "category string")
    assert {r["category"]: r["n"] for r in catalog.histogram(d, "category").collect()} == {"ccr": 2, "unknown": 2}


@pytest.mark.parametrize("votes, want", [([], None), ([40], (1, 40, 21, "low")), ([30, 40, 50], (3, 40, 21, "medium")), ([20, 25, 30, 35, 40, 45], (6, 32, 18, "high"))])
def test_participation(spark, votes, want):
    r = spark.createDataFrame([(1, i, dt.date(2024, 1, 1 + i), 100, v) for i, v in enumerate(votes)], "entity_id long, record_id long, held date, total_units int, votes int")
    got = catalog.participation(r).collect()
    assert (not got) if want is None else (got[0]["data_points"], got[0]["average_votes_cast"], got[0]["proxies_to_swing"], got[0]["confidence"]) == want


def test_percentile_and_first_seen(spark):
    r = spark.createDataFrame([(1, float(v)) for v in range(1, 11)], "k long, v double")
    got = windows.percentiles_lower(r, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (got["p50"], got["p95"]) == (5.0, 9.0)
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, o long")
    assert {r["o"] for r in windows.first_seen(rows, ["k"], "o", keep_null_keys=True).collect()} == {1, 2, 3}


def test_limiter_does_not_count_refused(spark):
    t0 = dt.datetime(2024, 1, 1)
    seconds = [0, 10, 20, 30, 61, 62, 71, 200]
    rows = spark.createDataFrame([(7, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "ip long, id long, ts timestamp")
    got = {r["id"]: r["allowed"] for r in windows.rate_limited(rows, "ip", "ts", 3, 60, "id").collect()}
    held, want = [], {}
    for i, s in enumerate(seconds):
        held = [h for h in held if s - h < 60]
        want[i] = len(held) < 3
        if want[i]:
            held.append(s)
    assert got == want


def test_chunk_spans():
    page = "\n".join(["a" * 1000, "b" * 1000, "c" * 1000])
    compat = chunker.chunks_of([(1, page)], compat=True)
    assert [(len(t), a, b) for _, t, a, b in compat] == [(1000, 1, 1), (1201, 1, None), (1201, None, None)]
    assert [(a, b) for _, _, a, b in chunker.chunks_of([(1, page)])] == [(1, 1)] * 3
    assert chunker.chunks_of([(1, ""), (2, None)]) == []
    assert [t for _, t, _, _ in chunker.chunks_of([(1, "x" * 5000)], overlap=0)] == ["x" * 5000]
    spans = chunker.chunks_of([(1, "a" * 1500), (2, "b" * 1500)], overlap=0)
    assert [(a, b) for _, _, a, b in spans] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("name, want", [("client_list.pdf", "court"), ("template.pdf", "plat"), ("first_notice.pdf", "tax"), ("Amendment to Declaration.pdf", "ccr"), ("photo.jpg", None)])
def test_filename_rules_keep_their_order(spark, name, want):
    assert one(spark, text.classify_filename(F.lit(name))["category"]) == want


def test_pii_risks(spark):
    ssn, mails = "My number is 123-45-6789.", "a1@x.org b2@x.org c3@x.org info@x.org"
    roster = "\n".join(f"John Smith\n{i} Main" for i in range(10, 15))
    got = [one(spark, text.pii(F.lit(t))) for t in (ssn, mails, roster, "nothing", "2023-01-6789")]
    assert [g["risk"] for g in got] == ["high", "low", "high", "none", "none"]
    assert got[1]["personal_emails"] == 3


@pytest.mark.parametrize(
    "raw, want",
    [
        ("FOUNTAINWOOD CONDOMINIUM ASSOCIATION, INC.", "Fountainwood Condominium Association, Inc."),
        ("WILSON POINT PROPERTY OWNERS' ASSOCIATION, INCORPORATED, THE", "The Wilson Point Property Owners' Association, Incorporated"),
        ("PROPERTY OWNERS ASSOCIATION OF LAKE HAYWARD", "Property Owners Association of Lake Hayward"),
        ("HILL-AN-DALE VILLAGE CONDOMINIUM ASSOCIATION, INC.", "Hill-An-Dale Village Condominium Association, Inc."),
        ("GLEN OAKS CONDOMINIUM NO. 24, INC.", "Glen Oaks Condominium No. 24, Inc."),
    ],
)
def test_title_case(spark, raw, want):
    assert one(spark, names.title_case(F.lit(raw))) == want
    assert one(spark, names.title_case(F.lit(want))) == want


def test_dirty_names(spark):
    want = {
        "or the Owners HOA": "leading_conjunction", "& of The Meadows": "leading_punctuation", "2018 Exhibit A": "year_prefix", "Abc": "too_short", "Bylaws of Foo HOA": "stopword_prefix",
        "Gwinnett County OF. FAITH HOLLOW HOA": "county_prefix", "Bridgeberry Amenity and HOA": "tail_truncation", "GL-LB-BAR HOA": "garbled_acronym", "Phase II Foo HOA": "project_code_prefix",
        "Willows IV Condominium Association": "generic_single_stem", "Sunset Cove Homeowners Association": None, "Orange Park HOA": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r["name"]: r["reason"] for r in df.select("name", names.dirty_reason(F.col("name")).alias("reason")).collect()} == want


def test_recovery(spark):
    df = spark.createDataFrame([("Bylaws of the Pebble Creek Homeowners Association", None), ("and restated pebble creek farm", None), ("of", "https://x.com/Walton-Reserve-Declaration-Recorded.pdf")], "name string, source_url string")
    got = [r["cleaned"] for r in names.recover(df).collect()]
    assert got[0] == "Pebble Creek Homeowners Association"
    assert got[1] == "Pebble Creek Farm"
    assert got[2] == "Walton Reserve"


def test_slugs(spark):
    assert one(spark, names.slug(F.lit("  Alpha  HOA! "))) == "alpha-hoa"
    assert one(spark, names.identity_slug(F.lit("Reston Association, Inc."))) == "reston"
    assert one(spark, names.identity_slug(F.lit("The HOA Inc"))) == "the-hoa-inc"
    assert one(spark, names.identity_slug(F.lit("Foo & Bar's HOA!"))) == "foo-bar-s"


def test_rules(spark):
    df = spark.createDataFrame([("A proxy may be directed by the member and must be in writing. The association shall provide records within 10 business days after written request. Short.", "proxy_voting")], "text string, bucket string")
    got = [(r["topic_family"], r["rule_type"]) for r in legal.extract_rules(df).collect()]
    assert got == [("proxy_voting", "proxy_directed_option"), ("records_access", "records_response_deadline")]
    clusters = spark.createDataFrame([("permission", ["proxy_allowed"]), ("duration", ["proxy_validity_duration"])], "cluster_id string, any_of array<string>")
    rules = spark.createDataFrame([("TX", "proxy_allowed")], "jurisdiction string, rule_type string")
    assert legal.cluster_coverage(rules, clusters, ["jurisdiction"]).first()["missing"] == ["duration"]


def test_sections(spark):
    keys = lambda t: [s["section_key"] for s in one(spark, text.split_sections(F.lit(t)))]
    assert keys("Section 1. One\nbody\nSection 2. Two") == ["section_1", "section_2"]
    assert keys("no marker here") == ["section_1"]
    assert keys("x" * 100 + "\nSection 9 footer") == ["section_1"]
    assert keys("") == []


SQUARE = '{"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[3,1],[3,3],[1,3],[1,1]]]}'


def test_polygons(spark):
    p = geo.polygons(F.lit(SQUARE))
    inside = lambda x, y: one(spark, geo.in_any(F.lit(float(x)), F.lit(float(y)), p))
    assert inside(0.5, 0.5) and inside(0, 2) and not inside(2, 2) and not inside(5, 5)
    many = geo.polygons(F.lit('{"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]],[[[4,4],[6,4],[6,6],[4,6],[4,4]]]]}'))
    assert one(spark, geo.in_any(F.lit(5.0), F.lit(5.0), many))
    assert one(spark, F.size(geo.polygons(F.lit('{"type": "Polygon", "coordinates": [[[0,0],[500,0],[1,1],[0,0]]]}')))) == 0
    assert one(spark, F.size(geo.polygons(F.lit(None).cast("string")))) == 0
    area = one(spark, geo.polygon_area_m2(F.get(p, F.lit(0))))
    assert 0.7 * 16 < area / geo.METRES_A_DEGREE**2 < 12.1


def test_nearby(spark):
    square = '{"type": "Polygon", "coordinates": [[[-78.001,34.999],[-77.999,34.999],[-77.999,35.001],[-78.001,35.001],[-78.001,34.999]]]}'
    rows = spark.createDataFrame([(1, "Master", square, 35.0, -78.0), (2, "A", None, 35.005, -78.0), (3, "B", None, 35.0, -77.99), (4, "Far", None, 36.0, -79.0)], "place_id long, name string, g string, lat double, lon double").withColumn("polygons", geo.polygons(F.col("g")))
    q = spark.createDataFrame([(9, 35.0, -78.0)], "query_id long, lat double, lon double")
    got = [(r["name"], r["kind"]) for r in spatial.nearby(q, rows).orderBy("rank").collect()]
    assert got == [("Master", "inside_boundary"), ("A", "nearby_point"), ("B", "nearby_point")]


def test_knn_filters_before_k_and_takes_zero_vectors(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 0, [0.6, 0.8])], "vec_id long, partition int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0], 0)], "query_id long, vector array<float>, partition int")
    got = [(r["vec_id"], r["score"]) for r in vectors.knn(v, q, 10).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 0.6), (2, 0.0)]
    assert [r["vec_id"] for r in vectors.knn(v.where("vec_id <> 1"), q, 1).collect()] == [3]


def test_manifests_keep_the_first_and_log_conflicts(spark):
    m = spark.createDataFrame(
        [("k", 1, "Old", ["x"], "Reston", "VA", "wix", "stub", [("abc", 100)]), ("k", 2, "New", None, "Vienna", "VA", "static", "banked", [("abc", 999), ("def", 1)])],
        "key string, ord long, name string, aliases array<string>, city string, state string, platform string, status string, documents array<struct<sha256:string,size:bigint>>",
    )
    r = resolve.merge_manifests(m).first()
    assert (r["name"], r["aliases"], r["city"], r["conflicts"], r["platform"], r["status"]) == ("Old", ["New", "x"], "Reston", 1, "static", "banked")
    assert [(d["sha256"], d["size"]) for d in r["documents"]] == [("abc", 100), ("def", 1)]


def test_queue(spark):
    jobs = spark.createDataFrame([("a", "2024-01-02"), ("b", "2024-01-01")], "job_id string, enqueued_at string")
    q = changes.enqueue(changes.enqueue(jobs.limit(0).withColumns({"status": F.lit("pending"), "attempts": F.lit(0)}), jobs), jobs)
    assert q.count() == 2
    for want in ("pending", "pending", "dead"):
        q = changes.claim(q, 1)
        busy = q.where("status = 'in_progress'")
        assert [r["job_id"] for r in busy.collect()] == ["b"]
        q = changes.settle(q, busy.select("job_id", F.lit(False).alias("ok")))
        assert {r["job_id"]: r["status"] for r in q.collect()}["b"] == want
    assert {r["status"] for r in changes.revive(q).collect()} == {"pending"}


def test_bundles_and_files(spark, tmp_path):
    sha = "a" * 64
    good = f'{{"schema_version":2,"state":"NC","name":"X","source_manifest_uri":"gs://b/x","documents":[{{"sha256":"{sha}","category":"ccr","page_count":1}}]}}'
    bad = f'{{"schema_version":3,"state":"nc","name":"X","source_manifest_uri":"s3://b","documents":[{{"sha256":"{sha}","category":"tax"}},{{"sha256":"{sha}","category":"ccr"}}]}}'
    ok, errors = files.validate_bundles(spark.createDataFrame([(good,), (bad,)], "json string"), "gs://b/")
    assert ok.count() == 1
    assert set(errors.first()["errors"]) == {"schema_version", "state", "provenance", "duplicate_sha256", "category"}
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nnot json\n\n{"x": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x long").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x long", strict=True).collect()
    (tmp_path / "z.txt").write_text("ZCTA|AREA\n27601|5\n")
    assert files.read_crosswalk(spark, str(tmp_path / "z.txt"), "zip string, area long").first()["area"] == 5
    (tmp_path / "f.txt").write_text("AB  12\nCD  34\n")
    assert [tuple(r) for r in files.read_fixed(spark, str(tmp_path / "f.txt"), {"a": (0, 4), "b": (4, 2)}).collect()] == [("AB", "12"), ("CD", "34")]
    (tmp_path / "d.pdf").write_bytes(b"x")
    assert files.read_binary(spark, str(tmp_path)).first()["checksum"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    files.write_manifest(spark.range(3), str(tmp_path / "m"))
    files.write_manifest(spark.range(5), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 5


def test_streams_match_batches(spark, data):
    from townscribe.operators.windows import rate_limited
    from townscribe.plans import registry, streams, usage  # noqa: F401
    from townscribe.plans.usage import events

    got = {r["event_id"]: r["allowed"] for r in registry.QUERIES["stream_limiter"](spark, data).collect()}
    want = {r["event_id"]: r["allowed"] for r in rate_limited(events(spark, data), "user_id", "ts", 3, 86_400, "event_id").collect()}
    assert got == want


def test_rule_tables(spark):
    from townscribe.functions import rules

    want = {"Recorder of Madison County Condominium Association": True, "3025 Porter Street Condo": False, "City of Raleigh": True, "": True, "Oak Homeowners Association": False, "Raleigh": True}
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r["name"]: r["bad"] for r in df.select("name", rules.non_entity(F.col("name")).isNotNull().alias("bad")).collect()} == want
    state = lambda t, e=None, **k: one(spark, rules.verify_state(F.lit(t), F.lit(e).cast("string"), **k))
    assert tuple(state("recorded in west virginia")) == ("WV", "medium") and state("recorded in west virginia", compat=True)["state"] == "VA"
    assert tuple(state("recorded in arkansas", "AR")) == ("AR", "high") and tuple(state("nothing of note", "TX")) == ("TX", "low") and tuple(state("short")) == (None, "low")
    assert one(spark, rules.mailing_name(F.lit("PB HOA C O ALMA PROP"))) == "Pb Hoa"
    assert one(spark, rules.mailing_name(F.lit("OAKS OF THE LAKE CONDO ASSN"))) == "Oaks of the Lake Condominium Association"
    assert one(spark, rules.compact_name(F.lit("Foo & Bar Homeowners Association, Inc."))) == "Foo And Bar ,"
    assert tuple(one(spark, rules.state_county(F.lit("Wake County, North Carolina. Lake County, Ohio and Lake County, Ohio.")))) == ("OH", "Lake")
    text_ = "The community is located at 12 Oak Street, Raleigh, NC 27601. " + "x " * 90 + "Prepared by attorney, 9 Elm Road, Cary, NC 27511."
    got = rules.address_candidates(spark.createDataFrame([(1, text_)], "doc_id long, text string"), "NC").orderBy("rank").collect()
    assert [(r["query"], r["score"]) for r in got] == [("12 Oak Street, Raleigh, NC 27601", 2), ("9 Elm Road, Cary, NC 27511", -3)]


def test_percentiles_of_many_shapes(spark):
    import random

    rng = random.Random(5)
    groups = {1: [rng.random() for _ in range(3000)], 2: [3.0] * 500, 3: [rng.choice([1.0, 2.0, 2.0, 2.0, 9.0]) for _ in range(700)], 4: [5.0], None: [float(i // 7) for i in range(400)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [(1, None), (6, None)], "k long, v double")
    ps = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: tuple(r[n] for n in ps) for r in windows.percentiles_lower(df, ["k"], "v", ps).collect()}
    assert got == {k: tuple(sorted(vs)[int((len(vs) - 1) * p)] for p in ps.values()) for k, vs in groups.items()}


def test_manifests_are_replaced_whole_and_checked(spark, tmp_path):
    at = str(tmp_path / "m")
    assert files.generation(spark, at) is None
    one = files.write_manifest(spark.range(3), at, check=True)
    two = files.write_manifest(spark.range(4), at, expected=one, check=True)
    with pytest.raises(files.Stale):
        files.write_manifest(spark.range(9), at, expected=one, check=True)
    assert files.generation(spark, at) == two and spark.read.parquet(at).count() == 4
    assert [x.name for x in tmp_path.iterdir()] == ["m"]


def test_sidecars_ready_bundles_and_sinks(spark, tmp_path):
    sha = "b" * 64
    side = [(2, sha, ("m", 2), [(0, "t", 1, 1, [1.0, 2.0])]), (1, "x", ("n", 3), []), (2, sha, ("m", 2), [(0, "t", 1, 1, [1.0])])]
    df = spark.createDataFrame(side, files.SIDECAR)
    assert [set(r["e"]) for r in df.select(files.sidecar_errors("m", 2, F.lit(sha)).alias("e")).collect()] == [set(), {"schema_version", "sha256", "model", "dimensions", "chunks"}, {"embedding"}]
    pages = spark.createDataFrame([([(1, "a")],), ([(0, "a")],), ([],), (None,)], "p array<struct<number:int,text:string>>")
    assert [r["ok"] for r in pages.select(files.text_sidecar_ok(F.col("p")).alias("ok")).collect()] == [True, False, False, False]
    for name, status in (("b", "ready"), ("a", "ready"), ("c", "done")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "status.json").write_text(f'{{"status": "{status}",\n "bundle_id": "{name}"}}')
    got = files.read_ready_bundles(spark, f"{tmp_path}/in/*/status.json", 5).collect()
    assert [r["bundle_id"] for r in got] == ["a", "b"] and got[0]["prefix"].endswith("/in/a")
    files.snapshot({"x": spark.range(2), "y": spark.range(3)}, str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "dump" / "y")).count() == 3
    calls = spark.createDataFrame([("m", 3, "secret")], "model string, tokens long, prompt string")
    for _ in range(2):
        files.log_calls(calls, str(tmp_path / "calls"))
    assert spark.read.json(str(tmp_path / "calls")).columns == ["model", "tokens"] and spark.read.json(str(tmp_path / "calls")).count() == 2


def test_hidden_rows_and_blobs(spark):
    import struct

    v = spark.createDataFrame([(1, 0, [1.0, 0.0], "ocr_failed:x"), (2, 0, [0.9, 0.1], ""), (3, 0, [0.5, 0.5], None)], "vec_id long, partition int, embedding array<float>, hidden_reason string")
    q = spark.createDataFrame([(9, [1.0, 0.0], 0)], "query_id long, vector array<float>, partition int")
    assert [r["vec_id"] for r in vectors.knn(vectors.visible(v), q, 2).orderBy("rank").collect()] == [2, 3]
    assert vectors.visible(v, include_hidden=True).count() == 3
    blob = spark.createDataFrame([(bytearray(struct.pack("<2f", 1.5, -2.0)),), (None,)], "b binary")
    assert [r["x"] for r in blob.select(vectors.decode(F.col("b")).alias("x")).collect()] == [[1.5, -2.0], None]


def test_nearest_are_the_same_in_any_blocks(spark, data):
    from townscribe.operators import vector_index
    from townscribe.plans import vectors as plans

    v, q = plans.tables(spark, data)
    for s in ("cosine", "l2"):
        rows = sorted(tuple(r) for r in vectors.knn(v, q, 4, score=s).collect())
        index = vector_index.build(v, s, block=8, pivots=5)
        assert rows == sorted(tuple(r) for r in vector_index.search(index, q, 4, query_block=3).select("query_id", "partition", "vec_id", "score", "rank").collect())
        assert len(rows) == 4 * q.count()


def test_citations_stop_at_25_and_gaps_lower_confidence(spark):
    rows = [(i, "TX", "proxy_voting", "t", "v" * (300 if i == 0 else 5), f"C{i // 2}" if i % 7 else " ", "") for i in range(80)]
    r = spark.createDataFrame(rows, "ord long, j string, topic_family string, rule_type string, value_text string, citation string, citation_url string")
    p = spark.createDataFrame([("TX", "high", ["old"]), ("GA", "high", None)], "j string, profile string, known_gaps array<string>")
    scopes = spark.createDataFrame([("TX",), ("GA",), ("NC",)], "j string")
    got = {x["j"]: x for x in legal.answers(scopes, r, p, ["j"], {"proxy_voting": 12}).collect()}
    seen = list(dict.fromkeys(f"C{i // 2}" for i in range(80) if i % 7))
    assert got["TX"]["citations"] == seen[:25] and len(got["TX"]["checklist"]) == 12 and got["TX"]["confidence"] == "medium" and got["TX"]["gaps"] == ["old"]
    assert (got["GA"]["confidence"], got["GA"]["n_rules"], len(got["GA"]["gaps"])) == ("low", 0, 1) and got["NC"]["confidence"] == "low"
    cited = legal.citations(r, ["j"]).first()["citations"]
    assert [c["n"] for c in cited] == list(range(1, 26)) and cited[0]["url"] is None


def test_places_and_anchors_in_texts(spark):
    t = "Return to: Smith. The community is located at 12 Oak Street, Raleigh, NC 27601. " + "x" * 200
    got = one(spark, text.location_parts(F.lit(t)))
    assert (got["city"], got["state"], got["zip"]) == ("Raleigh", "NC", "27601") and got["street"].startswith("12 Oak Street")
    at = t.index("12 Oak")
    assert one(spark, text.anchor_score(F.lit(t), F.lit(at), "located at", "return to")) == -1
    assert one(spark, text.anchor_score(F.lit(t), F.lit(len(t) - 5), "located at", "return to")) == 0
    assert [one(spark, geo.quality_rank(F.lit(x))) for x in ("polygon", "city_only", "other")] == [0, 4, 6]


def test_drain_hands_over_each_batch_once(spark, data, tmp_path):
    from townscribe.streaming import events

    seen = []
    for _ in range(2):
        events.drain(events.stream(spark, data), lambda df, n: seen.append(df.count()), str(tmp_path / "at")).awaitTermination()
    assert sum(seen) == spark.read.parquet(f"{data}/events.parquet").count()


def test_equal_names_point_to_one(spark):
    rows = [(1, "Oak Park HOA", 1, "b"), (2, "Oak Park", 9, "b"), (3, "Oak Park Owners Association", 0, "b"), (4, "Oak Park Villas", 0, "b"), (5, "Oak Park", 3, "c"), (6, "Elm", 0, "b")]
    df = spark.createDataFrame(rows, "entity_id long, name string, weight long, block string")
    got = {(r["source_id"], r["target_id"]) for r in resolve.dedupe_pairs(df, "block").collect()}
    assert got == {(1, 3), (2, 3), (4, 3)}


def test_best_jaccard_as_all_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [f"t{int(20 * rng.random() ** 2)}" for _ in range(rng.randrange(0, 6))]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r["left_id"]: (r["right_id"], round(r["jaccard"], 9)) for r in resolve.best_jaccard(df.select(F.col("id").alias("left_id"), "tokens"), df.select(F.col("id").alias("right_id"), "tokens"), others=True).collect()}
    want = {}
    for i, a in rows:
        best = max(((len(set(a) & set(b)) / len(set(a) | set(b)), -j) for j, b in rows if j != i and set(a) & set(b)), default=None)
        if best:
            want[i] = (-best[1], round(best[0], 9))
    assert got == want
