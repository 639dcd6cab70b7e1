"""One query for each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, fingerprints, html_extract, language, lexical, line_dedup, near_dup, packing, quality, substring_dedup, token_alignment, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 5 = 0 are held out."""
    common.tune(spark)
    docs = common.read(spark, sf_dir, "documents")
    model = fit_toxicity(spark, sf_dir, docs)
    return toxicity.score(docs, model).select(
        "doc_id",
        (common.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
        F.size("passages").alias("n_passages"),
    )


def fit_toxicity(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicModel:
    """A model from the labelled rows that are not held out, at most ``toxicity.MAX_LABELLED``."""
    labels = common.bounded_labels(common.read(spark, sf_dir, "labels"), "toxic", common.crc_mod(F.col("doc_id"), 5) != 0, toxicity.MAX_LABELLED)
    return toxicity.fit(docs, labels)


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, the benchmark items of which it holds a passage, and the highest similarity."""
    return decontamination.report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    common.tune(spark)
    return packing.pack(common.read(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, its lines, how many are boilerplate of its source, and a digest of the rest."""
    kept = line_dedup.apply(common.read(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op6_line_dedup"] = line_dedup.ORACLE


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    common.tune(spark)
    return near_dup.near_duplicates(common.read(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, its words, how many an earlier document covers, and a digest of the rest."""
    common.tune(spark)
    return substring_dedup.dedup(common.read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    rows = fingerprints.edited(common.read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.text_of(F.col("v")).alias("fingerprint"),
        fingerprints.text_of(F.col("edited_v")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("v"), F.col("edited_v")).alias("near_edited"),
        F.coalesce(fingerprints.likeness(F.col("v"), F.col("next_v")), F.lit(0.0)).alias("near_next"),
    )


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    common.tune(spark)
    docs = common.read(spark, sf_dir, "documents")
    labels = common.bounded_labels(common.read(spark, sf_dir, "labels"), "quality", common.crc_mod(F.col("doc_id"), 3) != 1, quality.MAX_LABELLED)
    return quality.score(docs, quality.fit(docs, labels)).select("doc_id", (common.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "margin")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    common.tune(spark)
    docs = common.read(spark, sf_dir, "documents")
    model = language.fit_frame(docs, common.crc_mod(F.col("doc_id"), 3) != 1)
    return language.predict(docs, model).select("doc_id", (common.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    common.tune(spark)
    return html_extract.main_text(common.read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that fits each page's url, and its verdict."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(common.read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op13_url_filters"] = url_filter.ORACLE


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    common.tune(spark)
    return lexical.search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = lexical.ORACLE


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers meet in every document, with a digest of the groups."""
    common.tune(spark)
    docs = common.read(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return token_alignment.align(docs, digest=True).withColumnRenamed("groups", "groups_sha256")
