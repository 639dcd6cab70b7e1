"""Structured rules from legal text: classification of sentences, coverage, profiles, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, sentences

# Terms of the rules, in lower case.
ELECTRONIC = ["electronic", "e-mail", "email", "electronic transmission", "facsimile", "fax", "remote communication", "reliable reproduction", "digital signature", "docusign"]
ACCEPT = ["shall accept", "shall be accepted", "must accept", "must be accepted", "may not reject", "is valid", "is deemed"]
RESTRICT = ["may reject", "not valid", "invalid", "reject", "doubting the validity"]
OVERLAY = ["electronic signature", "electronic record", "electronic form", "electronic means", "digital signature"]
OVERLAY_NOT = ["does not apply to", "excluded transaction", "except as otherwise provided"]
LEGAL_EFFECT = ["may not be denied legal effect", "shall not be denied legal effect", "may not be denied enforceability", "shall not be denied enforceability", "satisfies the law", "satisfy the law", "satisfies any law", "satisfy any law"]
RECORD_EQUALS = ["record satisfies", "electronic record satisfies", "requirement is satisfied by an electronic record", "if a law requires a record to be in writing", "writing, an electronic record satisfies"]
SIGNATURE_EQUALS = ["signature satisfies", "electronic signature satisfies", "requirement is satisfied by an electronic signature", "if a law requires a signature"]
PROXY_BUCKETS = ["proxy_voting", "nonprofit_corp_overlay", "business_corp_overlay"]
RECORDS = [
    "inspect", "inspection", "copy", "records", "record book", "books and records", "association records", "governing documents", "membership list", "member list", "unit owner list", "roster",
    "financial statement", "financial record", "financial document", "balance sheet", "meeting minutes", "board minutes", "annual report", "audit report", "tax return", "budget", "reserve fund",
    "examine and copy", "right to examine", "available for inspection", "available for examination", "open to inspection", "public record",
]
# Proxy rules and record rules, first match wins.
PROXY_RULES = [
    (["directed", "limited proxy"], "proxy_directed_option"),
    (["undirected", "discretion", "general proxy"], "proxy_undirected_option"),
    (["appoint", "designate", "holder", "assign"], "proxy_assignment_rule"),
    (["revok", "at the pleasure"], "proxy_revocability"),
    (["expire", "valid for", "validity", "11 month", "eleven month", "unless otherwise provided", "effective only for the specific meeting", "lawfully adjourned"], "proxy_validity_duration"),
    (["record", "retain", "minutes", "maintain"], "proxy_record_retention"),
    (["signed", "signature", "writing", "written", "electronic transmission"], "proxy_form_requirement"),
    (["deliver", "submitted"], "proxy_delivery_requirement"),
    (["quorum"], "proxy_quorum_counting"),
]
INSPECTION = ["inspect", "inspection", "available to members"]
WITHHELD = ["attorney-client", "privileged", "personnel", "private", "social security", "medical", "litigation", "executive session"]
MEMBER_LISTS = ["member list", "membership list", "unit owner list", "roster"]
LIST_USE = ["commercial", "solicit", "sale", "shall not be used", "may not be used", "limited to"]
SHARING = ["shall not be used for", "may not be used for", "may not be sold", "not be disclosed"]
DAYS = r"(?i)\b(within|not later than)\s+(\d+)\s+(business\s+)?days?\b"
REQUEST = ["written request", "request in writing", "written demand"]
FEE = r"(?i)\$\s*[\d]+(?:\.\d+)?\s*(?:per\s+(?:page|copy|hour|photo|item))?"
FEES = ["reasonable fee", "actual cost", "direct cost", "no charge", "without charge", "free of charge", "at cost", "fee", "charge", "cost of copying", "copying fee"]
DOCUMENT_TYPES = ["financial statement", "balance sheet", "income statement", "budget", "audit report", "tax return", "invoices", "receipts", "canceled check", "purchase order", "credit card statement", "meeting minutes", "board minutes", "annual report", "treasurer", "reserve fund"]
RECORDING = ["recorded", "register of deeds", "county recorder", "recording", "public record"]
RETENTION = ["shall keep", "must keep", "shall maintain", "must maintain", "retain", "retained for", "preservation of"]
DELIVERY = ["electronic transmission", "electronic format", "email", "e-mail", "digital copy", "photocopying"]
PROXY = ["proxy", "ballot", "quorum"]
TOPICS = ["proxy_voting", "records_access", "records_sharing_limits"]


def _rule(topic: str, kind: str) -> Column:
    return F.struct(F.lit(topic).alias("topic_family"), F.lit(kind).alias("rule_type"))


def _proxy(kind: str) -> Column:
    return _rule("proxy_voting", kind)


def electronic_rule(lower: Column) -> Column:
    """The rule of a sentence on electronic proxies; null if it names nothing electronic."""
    signing = any_of(lower, ["signature", "signed", "execute"])
    accept, restrict = any_of(lower, ACCEPT), any_of(lower, RESTRICT)
    pick = lambda what: F.when(accept, _proxy(f"proxy_electronic_{what}_required_acceptance")).when(restrict, _proxy(f"proxy_electronic_{what}_prohibited")).otherwise(_proxy(f"proxy_electronic_{what}_allowed"))
    return F.when(any_of(lower, ELECTRONIC), F.when(signing, pick("signature")).otherwise(pick("assignment")))


def overlay_rules(lower: Column, bucket: Column) -> Column:
    """Up to two rules that a law on electronic transactions implies for proxies."""
    applies = (F.lower(F.coalesce(bucket, F.lit(""))) == "electronic_transactions_overlay") & any_of(lower, OVERLAY) & ~any_of(lower, OVERLAY_NOT)
    accept = any_of(lower, ACCEPT) | any_of(lower, LEGAL_EFFECT)
    pick = lambda what, equals: F.when(any_of(lower, RESTRICT), _proxy(f"proxy_electronic_{what}_prohibited")).when(accept | any_of(lower, equals), _proxy(f"proxy_electronic_{what}_required_acceptance")).otherwise(_proxy(f"proxy_electronic_{what}_allowed"))
    signature = F.when(applies & any_of(lower, ["signature", "signed"]), pick("signature", SIGNATURE_EQUALS))
    record = F.when(applies & any_of(lower, ["record", "writing", "written"]), pick("assignment", RECORD_EQUALS))
    return F.filter(F.array(signature, record), lambda r: r.isNotNull())


def sentence_rule(sentence: Column, bucket: Column, lower: Column | None = None) -> Column:
    """The rule of a sentence (struct topic_family, rule_type), or null; proxies come before records. ``lower`` is the sentence in lower case, if it is at hand."""
    lower = F.lower(sentence) if lower is None else lower
    about_proxy = any_of(lower, PROXY)
    applies = lower.contains("proxy") | F.lower(F.coalesce(bucket, F.lit(""))).isin(PROXY_BUCKETS)
    by_proxy = F.coalesce(electronic_rule(lower), reduce(lambda w, r: w.when(any_of(lower, r[0]), _proxy(r[1])), PROXY_RULES[1:], F.when(any_of(lower, PROXY_RULES[0][0]), _proxy(PROXY_RULES[0][1]))).when(lower.contains("ballot") & lower.contains("proxy"), _proxy("proxy_ballot_interaction")).when(any_of(lower, INSPECTION), _proxy("proxy_inspection_right")).otherwise(_proxy("proxy_allowed")))
    records = lambda kind: _rule("records_access", kind)
    limits = lambda kind: _rule("records_sharing_limits", kind)
    by_record = (
        F.when(any_of(lower, WITHHELD), limits("sharing_privacy_redaction"))
        .when(any_of(lower, MEMBER_LISTS) & any_of(lower, LIST_USE), limits("sharing_member_list_use_restriction"))
        .when(any_of(lower, MEMBER_LISTS), records("records_member_list_access"))
        .when(any_of(lower, SHARING), limits("sharing_use_restriction"))
        .when(sentence.rlike(DAYS), records("records_response_deadline"))
        .when(any_of(lower, REQUEST), records("records_request_form"))
        .when(sentence.rlike(FEE) | any_of(lower, FEES), records("records_fee_limit"))
        .when(any_of(lower, DOCUMENT_TYPES), records("records_document_types"))
        .when(any_of(lower, RECORDING), records("records_governing_docs_public_recording"))
        .when(any_of(lower, RETENTION), records("records_retention_requirement"))
        .when(any_of(lower, DELIVERY), records("records_delivery_format"))
        .otherwise(records("records_inspection_right"))
    )
    return F.when(about_proxy, F.when(applies, by_proxy)).when(any_of(lower, RECORDS), by_record)


def extract_rules(sections: DataFrame, text: str = "text", bucket: str = "bucket") -> DataFrame:
    """A row for each rule of each sentence, with the sentence, its place, and a confidence."""
    # lower case is made once a sentence: as a column of its own it would be put in the place of each use
    both = F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("value_text"), F.lower(s).alias("lower")))
    rows = sections.select("*", F.posexplode(both).alias("sentence_no", "_sentence"))
    # few sentences hold a term without which there is no rule
    rows = rows.where(any_of(F.col("_sentence.lower"), [*PROXY, *RECORDS, *OVERLAY])).select(*sections.columns, "sentence_no", "_sentence.value_text", F.col("_sentence.lower").alias("_lower"))
    found = F.concat(overlay_rules(F.col("_lower"), F.col(bucket)), F.filter(F.array(sentence_rule(F.col("value_text"), F.col(bucket), F.col("_lower"))), lambda r: r.isNotNull()))
    rows = rows.withColumn("_rule", F.explode(found))
    high = F.length("value_text") <= 280
    return rows.select("*", "_rule.topic_family", "_rule.rule_type", F.when(high, "high").otherwise("medium").alias("confidence"), F.when(high, 0).otherwise(1).alias("needs_human_review")).drop("_rule", "_lower")


def source_quality(source_type: Column, url: Column, aggregators: list[str], official: list[str], primary: list[str]) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    kind = F.lower(F.trim(F.coalesce(source_type, F.lit(""))))
    is_official = host.isin(official) | host.endswith(".gov") | (host.contains(".state.") & (host.contains("leg") | host.contains("law") | host.contains("code")))
    return F.when((kind == "secondary_aggregator") | any_of(host, aggregators), "aggregator").when(is_official & kind.isin(primary), "official_primary").when(is_official, "official_secondary").otherwise("unknown")


#: Clusters of a requirement matrix at most.
CLUSTERS = 500


def cluster_coverage(rules: DataFrame, clusters: DataFrame, scope: list[str]) -> DataFrame:
    """For each scope: which clusters (cluster_id, any_of) its rule types cover, and which are missing."""
    seen = rules.groupBy(*scope).agg(F.collect_set(F.lower(F.trim("rule_type"))).alias("_seen"))
    # the requirement matrix is a table of some tens of rows, and becomes a constant of the plan
    asked = clusters.orderBy("cluster_id").limit(CLUSTERS + 1).collect()
    if len(asked) > CLUSTERS:
        raise ValueError(f"more than {CLUSTERS} clusters")
    matrix = F.array(*(F.struct(F.lit(r["cluster_id"]).alias("id"), F.array(*(F.lit(x.strip().lower()) for x in r["any_of"])).alias("any_of")) for r in asked))
    hit = lambda c: F.arrays_overlap(F.col("_seen"), c["any_of"])
    return seen.select(*scope, F.transform(F.filter(matrix, hit), lambda c: c["id"]).alias("covered"), F.transform(F.filter(matrix, lambda c: ~hit(c)), lambda c: c["id"]).alias("missing"))


def profile_confidence(n_rules: Column, n_flagged: Column, gaps: Column) -> Column:
    return F.when(gaps > 0, "low").when((n_rules >= 8) & (n_flagged <= 0.2 * n_rules), "high").otherwise("medium")


def answer_confidence(n_rules: Column, profile: Column, gaps: Column) -> Column:
    """No rules or no profile: low.  Gaps turn high into medium, and anything else into low."""
    known = F.coalesce(profile, F.lit("low"))
    return F.when((n_rules == 0) | profile.isNull(), "low").when((gaps > 0) & (known == "high"), "medium").when(gaps > 0, "low").otherwise(known)


def citations(rules: DataFrame, scope: list[str], most: int = 25) -> DataFrame:
    """Each scope's first ``most`` citations (citation, url, excerpt) by ord; the first of an equal pair stays, blank ones go."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    text = trimmed("value_text")
    excerpt = F.when(F.length(text) > 240, F.concat(F.rtrim(F.substring(text, 1, 237)), F.lit("..."))).otherwise(text)
    rows = rules.select(*scope, "ord", trimmed("citation").alias("citation"), trimmed("citation_url").alias("url"), excerpt.alias("excerpt")).where("citation <> ''")
    first = rows.groupBy(*scope, "citation", "url").agg(F.min(F.struct("ord", "excerpt")).alias("f"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(*scope).orderBy("f.ord", "citation", "url"))).where(F.col("n") <= most)
    one = F.struct("n", "citation", F.nullif("url", F.lit("")).alias("url"), F.col("f.excerpt").alias("excerpt"))
    return ranked.groupBy(*scope).agg(F.array_sort(F.collect_list(one)).alias("citations"))


def answers(scopes: DataFrame, rules: DataFrame, profiles: DataFrame, scope: list[str], topics: dict[str, int], missing: str = "No extracted {} rules were found for this scope.") -> DataFrame:
    """What is known for each scope of ``scopes``: a checklist of each topic's first rules, gaps, citations, confidence.

    ``rules`` has the scope, ord, topic_family, rule_type, value_text, citation, citation_url; ``profiles``
    the scope, profile (its confidence), known_gaps.  ``topics`` gives each topic's length of
    checklist: 8 for each of two, 12 for one alone.
    """
    rules = rules.where(F.col("topic_family").isin(list(topics)))
    rank = F.row_number().over(Window.partitionBy(*scope, "topic_family").orderBy("ord"))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in topics.items() for x in kv)), F.col("topic_family"))
    place = F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(topics) for x in (t, i))), F.col("topic_family"))
    top = rules.withColumns({"_n": rank, "_t": place}).where(F.col("_n") <= limit)
    item = F.struct("_t", "_n", F.concat("rule_type", F.lit(": "), "value_text").alias("item"))
    listed = top.groupBy(*scope).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.collect_set("topic_family").alias("_topics"))
    n = rules.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_rules"))
    j = scopes.select(*scope).join(listed, scope, "left").join(n, scope, "left").join(citations(rules, scope), scope, "left").join(profiles.select(*scope, "profile", "known_gaps"), scope, "left")
    known = F.coalesce("known_gaps", F.array().cast("array<string>"))
    absent = F.filter(F.array(*(F.when(~F.array_contains(F.coalesce("_topics", F.array().cast("array<string>")), t), missing.format(t)) for t in topics)), lambda x: x.isNotNull())
    # a profile's own gaps lower the confidence; topics without rules are told, but lower nothing
    sure = answer_confidence(F.coalesce("n_rules", F.lit(0)), F.col("profile"), F.size(known))
    checklist = F.coalesce(F.transform("_items", lambda x: x["item"]), F.array().cast("array<string>"))
    return j.select(*scope, F.coalesce("n_rules", F.lit(0)).alias("n_rules"), checklist.alias("checklist"), F.concat(known, absent).alias("gaps"), F.coalesce(F.transform("citations", lambda x: x["citation"]), F.array().cast("array<string>")).alias("citations"), sure.alias("confidence"))


def jurisdictions(rules: DataFrame) -> DataFrame:
    """Each jurisdiction's community types, profiles, last date and rules."""
    return rules.groupBy("jurisdiction").agg(F.countDistinct("community_type").alias("types"), F.count(F.lit(1)).alias("profiles"), F.max("last_verified").alias("last_verified"), F.sum("n_rules").alias("rules"))


def electronic_status(rule_types: Column, what: str) -> Column:
    """required, prohibited, allowed or unclear, in that order of strength."""
    has = lambda s: F.array_contains(rule_types, f"proxy_electronic_{what}_{s}")
    return F.when(has("required_acceptance"), "required").when(has("prohibited"), "prohibited").when(has("allowed"), "allowed").otherwise("unclear")


def profiles(rules: DataFrame, scope: list[str]) -> DataFrame:
    """One row a scope: counts, electronic status, confidence, checklists of at most eight entries each."""
    gaps = F.size(F.array_except(F.array(*(F.lit(t) for t in TOPICS)), F.col("topics")))
    w = Window.partitionBy(*scope, "topic_family").orderBy("rule_type", "value_text")
    top = rules.withColumn("_n", F.row_number().over(w))
    item = F.concat_ws(": ", "rule_type", "value_text")
    lists = [F.array_sort(F.collect_list(F.when((F.col("topic_family") == t) & (F.col("_n") <= 8), item))).alias(f"{t}_checklist") for t in TOPICS]
    g = top.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_rules"), F.sum("needs_human_review").alias("n_flagged"), F.array_sort(F.collect_set("rule_type")).alias("rule_types"), F.collect_set("topic_family").alias("topics"), *lists)
    g = g.withColumn("n_gaps", gaps)
    return g.withColumns({"electronic_signature": electronic_status(F.col("rule_types"), "signature"), "electronic_assignment": electronic_status(F.col("rule_types"), "assignment"), "profile_confidence": profile_confidence(F.col("n_rules"), F.col("n_flagged"), F.col("n_gaps"))}).drop("topics")


def corpus_counters(seeded: DataFrame, fetched: DataFrame, normalized: DataFrame, extracted: DataFrame, key: str = "jurisdiction") -> DataFrame:
    """Rows of each stage for each jurisdiction that any stage has, and whether it may be released."""
    out = None
    for name, df in (("seeded", seeded), ("fetched", fetched), ("normalized", normalized), ("extracted", extracted)):
        n = df.groupBy(F.upper(key).alias(key)).agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, key, "full_outer")
    out = out.na.fill(0)
    return out.withColumn("release", (F.col("seeded") > 0) & (F.col("fetched") >= F.col("seeded")) & (F.col("normalized") > 0) & (F.col("extracted") > 0))


def review_queue(rules: DataFrame, most: int = 50) -> DataFrame:
    """Rules that need a look, at most ``most`` of each jurisdiction and topic, the longest first; equal texts by the other columns, in their order."""
    others = [c for c in rules.columns if c not in ("jurisdiction", "topic_family", "value_text")]
    w = Window.partitionBy("jurisdiction", "topic_family").orderBy(F.desc(F.length("value_text")), "value_text", *others)
    return rules.where("needs_human_review = 1").withColumn("queue_no", F.row_number().over(w)).where(F.col("queue_no") <= most)


def proxy_expiry(text: Column, signed: Column, meeting: Column) -> Column:
    """When a proxy ends: after the duration its law states, or with the meeting if that is known and a duration is too."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    days = F.when(lower.contains("11 month") | lower.contains("eleven month"), 335).when(lower.contains("1 year") | lower.contains("one year"), 365).when(lower.contains("180"), 180).when(lower.contains("90"), 90)
    return F.when(days.isNotNull(), F.coalesce(meeting, F.date_add(signed, days)))
