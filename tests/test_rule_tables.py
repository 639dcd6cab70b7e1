"""What rules must say, written out by hand."""

import pytest
from pyspark.sql import functions as F

from townscribe.functions import rules


def said(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_fragments_are_deleted(spark):
    bad = [
        "Elm Stormwater Drainage Policy HOA", "ZONING UPDATE HOA", "R E S O L U T I O N HOA", "Summary of Elm HOA", "Staff Analysis HOA", "January 30, 2023 the HOA", "february 3 2020 HOA", "March 1, 1999 HOA",
        "Madison County Zoning", "SLOA BULLETIN HOA", "Board of County Commissioners HOA", "To Whom It May Concern HOA",
    ]
    good = ["Elm HOA", "April 3, 2020 HOA", "My Summary of HOA", "Madison Zoning HOA", "March HOA"]
    for state in ("HI", "NC"):
        assert said(spark, bad, "string", lambda c, s=state: rules.clear_or_delete(c, F.lit(s))) == ["delete_entity"] * len(bad)
        assert said(spark, bad, "string", lambda c, s=state: rules.restore_or_keep(c, F.lit(s))) == ["keep_deleted"] * len(bad)
        assert said(spark, good, "string", lambda c, s=state: rules.clear_or_delete(c, F.lit(s))) == ["clear_docs"] * len(good)
    assert said(spark, ["Plain Name"], "string", lambda c: rules.clear_or_delete(c, F.lit("hi"))) == ["clear_docs"]
    assert said(spark, ["Plain Name"], "string", lambda c: rules.clear_or_delete(c, F.lit("NC"))) == ["delete_entity"]


def test_lead_names(spark):
    cases = [
        (["Elm Creek"], "Elm Creek"), (["Brook Hollow Farms"], "Brook Hollow Farms"), (["godaddy association"], None), (["rackcdn Association"], None), (["wordpress owners association"], None),
        (["County Register Association"], None), (["Plain Words"], None), (["Elm Homeowners"], None), (["Oak Owners Association", "Elm Creek Association"], "Elm Creek Association"),
        (["Oak Association", "Elm Association"], "Oak Association"), (["Declaration of Elm Ridge"], "of Elm Ridge"), (["Run"], None), ([], None),
    ]
    assert said(spark, [c for c, _ in cases], "array<string>", rules.lead_name) == [w for _, w in cases]


def test_states_and_counties(spark):
    cases = [
        ("recorded in GEORGIA and georgia", ("GA", None)), ("Fulton County Georgia", ("GA", "Fulton")), ("Jeff Davis County, Georgia", ("GA", "Jeff Davis")),
        ("we mention the Big Old Fulton North County, Georgia", ("GA", "Old Fulton North")), ("Of County, Georgia", ("GA", None)), ("This County, Ohio. Lake County, Ohio", ("OH", "Lake")),
        ("St. Marys County, Maryland and Prince George's County, Maryland, Prince George's County Maryland", ("MD", "Prince George's")), ("Fulton County, GEORGIA", ("GA", None)),
        ("ohio texas Texas", ("TX", None)), ("ohio texas", ("OH", None)), ("West Virginia", ("WV", None)), ("Wake County, North Carolina. Lake County, Ohio. Lake County Ohio", ("OH", "Lake")),
        ("district of columbia", ("DC", None)), ("nothing", (None, None)), ("", (None, None)), (None, (None, None)),
    ]
    assert [tuple(r) for r in said(spark, [c for c, _ in cases], "string", rules.state_county)] == [w for _, w in cases]


def addresses(spark, text, state="NC"):
    got = rules.address_candidates(spark.createDataFrame([(1, text), (2, None), (3, "no place")], "doc_id long, text string"), state).orderBy("rank").collect()
    return [(r["query"], r["score"], r["occurrences"]) for r in got]


FAR = " filler" * 30 + " "


def test_each_occurrence_of_an_address_is_scored(spark):
    at = "12 Oak Street, Raleigh, NC 27601"
    text = f"It is located at {at}.{FAR}The attorney is at {at}.{FAR}Counsel has its place at {at}."
    assert addresses(spark, text) == [(at, 2 - 3 - 3, 3)]
    assert addresses(spark, f"premises known as {at}") == [(at, 2, 1)]  # two good anchors count once
    assert addresses(spark, f"located at {at}, by the registered agent") == [(at, -1, 1)]


def test_streets_states_and_order(spark):
    assert addresses(spark, "The site address is 9 Elm Road - building two, Cary, NC 27511-1234.") == [("9 Elm Road, Cary, NC 27511-1234", 2, 1)]
    assert addresses(spark, "1 Ash Lane, then 2 Fir Way, Apex, NC 27502") == [("2 Fir Way, Apex, NC 27502", 0, 1)]
    assert addresses(spark, "Apex, NC 27502") == [("Apex, NC 27502", 0, 1)] == addresses(spark, "Apex, NC 27502", "nc")
    assert addresses(spark, "Apex, SC 27502") == [] == addresses(spark, "")
    text = f"mail to Apex, NC 27502{FAR}Cary, NC 27511{FAR}located at Durham, NC 27701{FAR}mail to Apex, NC 27502"
    assert addresses(spark, text) == [("Apex, NC 27502", -6, 2), ("Durham, NC 27701", 2, 1), ("Cary, NC 27511", 0, 1)]
    many = FAR.join(f"City{chr(65 + i)}, NC 2750{i}" for i in range(8))
    assert [q for q, _, _ in addresses(spark, many)] == [f"City{chr(65 + i)}, NC 2750{i}" for i in range(5)]


REFUSED = [
    "CHURCH", "MINISTRY", "TEMPLE", "SYNAGOGUE", "MOSQUE", "CONGREGATION", "CATHEDRAL", "PARENT TEACHER", "PTA", "PTO", "ALUMNI", "VETERAN", "VFW", "AMERICAN LEGION", "BOOSTER", "ATHLETIC",
    "YACHT CLUB", "GOLF CLUB", "SORORITY", "MASONIC", "LODGE", "ROTARY", "KIWANIS", "LIONS CLUB", "HOSPITAL", "CHAMBER OF", "NEIGHBORHOOD IMPROVEMENT", "MUSEUM", "FOUNDATION", "SCHOLARSHIP",
    "MEDICAL ASSOC", "DENTAL ASSOC", "BAR ASSOC", "MERCHANTS ASSOC", "LANDLORDS ASSOC", "REALTORS ASSOC", "REALTY ASSOC", "BLOCK ASSOC", "TENANTS UNION", "TENANT ASSOC", "BUSINESS IMPROVEMENT DIST",
]
WRITTEN = [
    "ELM CONDOMINIUM", "ELM CONDO", "ELM HOMEOWNERS ASSOC", "ELM HOME OWNER ASSOCIATION", "ELM HOA", "ELM OWNERS ASSOCIATIONS", "ELM COMMUNITY ASSOCIATION", "ELM PROPERTY OWNERS ASSOC", "ELM TENANTS CORP",
    "ELM TENANT CO-OP", "ELM HOUSING CORPORATION", "ELM HOUSING COOPERATIVE", "ELM COOPERATIVE APARTMENTS", "ELM APARTMENT CORP", "ELM APARTMENT COOP", "ELM MUTUAL HOUSING", "ELM RESIDENTIAL ASSOCIATION",
    "ELM TOWNHOUSE ASSOC", "ELM TOWN HOUSE ASSOC", "ELM TOWNHOMES ASSOCIATION", "ELM VILLAGE ASSOCIATION", "ELM GARDEN APARTMENTS", "ELM HDFC", "12 ELM OWNERS, INC",
]
OTHERS = ["ELM HOMEOWNERS", "ELM OWNERS", "ELM COOPERATIVE", "ELM CIVIC ASSOC", "PLAIN", "ELM ASSOCIATION"]


@pytest.mark.parametrize("case", [str.upper, str.lower])
def test_registry_tables(spark, case):
    names = [f"{w} HOA" for w in REFUSED] + WRITTEN + OTHERS
    rows = spark.createDataFrame([(i, case(n), "NOT-FOR-PROFIT") for i, n in enumerate(names)], "ord long, name string, entity_type string")
    got = {r["ord"]: r["reason"] for r in rules.registry_cascade(rows, ["NOT-FOR-PROFIT"]).collect()}
    want = ["skip_rejected_pattern"] * len(REFUSED) + ["written"] * len(WRITTEN) + ["skip_no_keyword"] * len(OTHERS)
    assert {names[i]: r for i, r in got.items()} == dict(zip(names, want, strict=True))


def test_registry_with_hot_names(spark):
    """A third of all rows has no name, a third one name: neither is gathered in a window."""
    rows = spark.createDataFrame([(i, ["", "Elm Condo", f"Oak {i} HOA"][i % 3], "X") for i in range(900)], "ord long, name string, entity_type string")
    out = rules.registry_cascade(rows, ["X"])
    assert "Window" not in out._jdf.queryExecution().toString()
    assert {r["reason"]: r["rows"] for r in rules.stage_counts(out).collect()} == {"skip_empty_name": 300, "written": 301, "skip_dup_name": 299}
    first = out.where("reason = 'written' and name = 'Elm Condo'").collect()
    assert [(r["ord"], r["metadata_type"]) for r in first] == [(1, "condo")]
