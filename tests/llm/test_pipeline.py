import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from townscribe.llm import decontamination, near_dup  # noqa: E402

from .tables import DOC, awkward, sentence  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    at = tmp_path_factory.mktemp("pipeline")
    items = [(i, sentence(rng, 30, 5000)) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        text = "\n".join(sentence(rng, 25, 5000) for _ in range(3))
        toxic = i % 10 == 0
        if toxic:
            text = " ".join(w if k % 9 else "scum" for k, w in enumerate(text.split(" ")))
        labels.append((i, 1, int(toxic)))
        rows.append((i, f"Site menu\n{text}" if i % 2 else text, "en", f"s{i % 3}", 0))
    rows += [(1000 + i, rows[101 + i][1], "en", "s1", 0) for i in range(6)]  # copies
    rows += [(2000 + i, f"{sentence(rng, 20, 5000)}\n{items[i][1]}", "en", "s2", 0) for i in range(5)]  # leaks
    spark.createDataFrame(rows, DOC).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        seen[name], docs = {r["doc_id"]: r for r in out.collect()}, out
    first = {i for i in range(300) if i % 10}
    assert first <= set(seen["toxicity"]) and not {i for i in range(300) if i % 10 == 0} & set(seen["toxicity"])
    assert all("Site menu" not in r["text"].split("\n") for r in seen["line_dedup"].values())
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].values() if r["doc_id"] < 300 and r["doc_id"] % 2)
    assert not any(1000 <= d < 1006 for d in seen["near_duplicates"]) and first <= set(seen["near_duplicates"])
    assert set(seen["decontamination"]) == first


def test_run_packs_what_is_kept(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {i for i in range(300) if i % 10}
    whole = {}
    for r in got:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in got)


def test_stage_names_and_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert near_dup.PERCENT == 75 and decontamination.SIMILARITY == 0.75


CLASHES = ("kept_text", "n_lines", "n_dropped", "words", "key", "rep", "queue", "score", "label", "item", "part", "shingle", "n", "kept", "_v")


def test_stages_with_awkward_rows(spark, folder, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, extra columns: no stage drops or renames what it should not."""
    from pyspark.sql import functions as F

    rows = awkward(11) + [(None, None, None, None, None), (None, "text without an id that is long enough to be a shingle", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(7) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.where("kept_text <> 7 or n_lines <> 7 or n <> 7 or _v <> 7").count() == 0
        if name != "near_duplicates":
            assert out.count() == docs.count()  # nothing toxic or leaked here
        else:  # empty texts are no duplicates
            empty = [{r["doc_id"] for r in x.where("text is null or text = ''").collect()} for x in (docs, out)]
            assert empty[0] == empty[1] >= {r[0] for r in rows if not r[1]}
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
