"""Files: JSON lines, delimited and fixed-width text, binary documents, bundles and their checks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import groupby, islice
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines, also gzipped; a bad line is dropped, or fails the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Delimited text with a header line, columns by name whatever their order; reads the first header while the plan is built.

    A column that the header lacks, and a value that its type can't take, are null; bytes that are no UTF-8 become U+FFFD. A file whose header
    differs from the first one's fails the read. ``multi_line`` allows line ends in quotes, and reads each file in one task.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    form = {"header": True, "sep": sep, "escape": '"', "multiLine": multi_line}  # a quote in quotes is doubled
    found = spark.read.csv(path, **form).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in found])
    rows = spark.read.schema(text).csv(path, enforceSchema=False, **form)
    at = {c.strip("\ufeff").lower(): c for c in reversed(found)}
    return rows.select(*((F.col(f"`{at[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in at else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind))


def read_crosswalk(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return read_csv(spark, path, schema, "|")


def read_fixed(spark: SparkSession, path: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Fixed-width lines in Latin-1: name -> (first byte from 0, length); values are trimmed."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).where(F.length("value") > 0)
    return lines.select(*(F.trim(F.substring("value", a + 1, n)).alias(k) for k, (a, n) in fields.items()))


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files as (path, length, modificationTime, content, checksum)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).withColumn("checksum", F.sha2("content", 256))


def literal(path: str) -> str:
    """A listed path as one that readers take as it is, not as a pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _status(spark: SparkSession, *paths: str) -> DataFrame:
    kind = "status string, bundle_id string, updated_at string"
    df = spark.read.schema(kind).option("multiLine", True).json(list(paths))
    return df.withColumn("prefix", F.regexp_replace(F.input_file_name(), "/[^/]*$", "")).where("status = 'ready'")


def write_statuses(rows: DataFrame, path: str, name: str = "status.json") -> None:
    """Each of ``rows`` (prefix, json) as a status file of its own in the folder ``prefix`` below ``path``, written by the tasks.

    A file gets its name when it is whole, so a task may run twice; no driver renames what tasks wrote. Opened through ``pyarrow.fs``.
    """
    spark = rows.sparkSession
    fs, at = _fs(spark, path)
    uri = fs.makeQualified(at).toUri().toString()

    def put(part: Iterable[Row]) -> None:
        from pyarrow import fs as arrow

        where, root = arrow.FileSystem.from_uri(uri)
        for r in part:
            folder = f"{root}/{r['prefix']}"
            draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
            where.create_dir(folder)
            with where.open_output_stream(draft) as out:
                out.write(r["json"].encode())
            where.move(draft, f"{folder}/{name}")

    rows.select("prefix", "json").repartition(spark.sparkContext.defaultParallelism, "prefix").foreachPartition(put)


def _names(spark: SparkSession, at: str, part: str) -> list[str]:
    """The paths of what matches ``part``, one name or a pattern of names, in the folder ``at``."""
    fs, pattern = _fs(spark, f"{literal(at)}/{part}")
    found = fs.globStatus(pattern)
    return [] if found is None else [p.toString() for p in spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)]


def _walk(spark: SparkSession, path: str) -> Iterator[str]:
    """The files that match a pattern in the order of their paths; a folder is listed when the walk comes to it."""

    def below(at: str, parts: list[str]) -> Iterator[str]:
        head, tail = parts[0], parts[1:]
        if tail and not re.search(r"[*?\[\]{}\\]", head):
            yield from below(f"{at.rstrip('/')}/{head}", tail)
        elif tail:
            for folder in sorted(_names(spark, at, head), key=lambda p: p + "/"):  # as in the paths of what it holds
                yield from below(folder, tail)
        else:  # as Spark's readers, which pass over hidden files
            yield from sorted(p for p in _names(spark, at, head) if not re.search(r"/(\.|_(?!.*=))[^/]*$|\._COPYING_$", p))

    def one(pattern: str) -> Iterator[str]:
        fs, at = _fs(spark, pattern)
        at, parts = fs.makeQualified(at), []
        while at.getParent() is not None:
            parts.insert(0, at.getName())
            at = at.getParent()
        return below(at.toString(), parts)

    # alternatives in braces may hold slashes
    for p, _ in groupby(merge(*map(one, spark.sparkContext._jvm.org.apache.hadoop.fs.GlobExpander.expand(path)))):
        yield p


#: Status files of a wave at most.
WAVE = 4096


def read_ready_bundles(spark: SparkSession, path: str, limit: int | None = None, wave: int | None = None) -> DataFrame:
    """Folders whose status file says ready; the first ``limit`` of them by path. Files that are no JSON are passed over.

    With a limit, folders are listed and status files are opened in waves in the order of their paths, the first of ``wave`` files (four
    times the limit), each twice as large up to WAVE, until enough are ready; those behind are neither opened nor listed, as none of them can
    come before. The result holds at most ``limit``.
    """
    if limit is None:
        return _status(spark, path)
    found: list[tuple[str, str, str, str]] = []
    size = wave or min(4 * max(1, limit), WAVE)
    walk = _walk(spark, path)
    names = list(islice(walk, size))
    if not names:
        spark.read.format("binaryFile").load(path)  # fails if nothing is there
    while names and len(found) < limit:
        ready = _status(spark, *map(literal, names)).withColumn("_at", F.input_file_name()).collect()
        found += [tuple(r)[:-1] for r in sorted(ready, key=lambda r: unquote(r["_at"]))][: limit - len(found)]
        size = min(2 * size, max(size, WAVE))
        names = list(islice(walk, size)) if len(found) < limit else []
    return spark.createDataFrame(found, "status string, bundle_id string, updated_at string, prefix string")


BUNDLE = (
    "schema_version int, bundle_id string, source_manifest_uri string, state string, county string, name string, metadata_type string, "
    "geometry struct<boundary_geojson:string,latitude:double,longitude:double>, "
    "documents array<struct<sha256:string,filename:string,text_uri:string,source_url:string,category:string,text_extractable:boolean,page_count:int,ocr_pages:int>>"
)
# Categories that a bundle may hold.
ALLOWED = ["ccr", "bylaws", "articles", "rules", "amendment", "resolution", "plat", "minutes", "financial", "insurance"]


def bundle_errors(provenance: str) -> Column:
    """What is wrong with a bundle, as an array of words; empty for a sound one."""
    docs = F.coalesce("documents", F.array().cast("array<struct<sha256:string,filename:string,text_uri:string,source_url:string,category:string,text_extractable:boolean,page_count:int,ocr_pages:int>>"))
    shas = F.transform(docs, lambda d: d["sha256"])
    bad = {
        "schema_version": ~F.coalesce(F.col("schema_version").isin(1, 2), F.lit(False)),
        "state": ~F.coalesce(F.col("state").rlike("^[A-Z]{2}$"), F.lit(False)),
        "name": F.trim(F.coalesce("name", F.lit(""))) == "",
        "provenance": ~F.coalesce(F.col("source_manifest_uri").startswith(provenance), F.lit(False)),
        "documents": F.size(docs) == 0,
        "sha256": F.exists(docs, lambda d: ~F.coalesce(d["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False))),
        "duplicate_sha256": F.size(F.array_distinct(shas)) < F.size(shas),
        "category": F.exists(docs, lambda d: ~F.coalesce(d["category"].isin(ALLOWED), F.lit(False))),
        "page_count": F.exists(docs, lambda d: F.coalesce(d["page_count"] < 0, F.lit(False)) | F.coalesce(d["ocr_pages"] < 0, F.lit(False))),
        "latitude": ~F.coalesce(F.col("geometry.latitude").between(-90, 90), F.lit(True)),
        "longitude": ~F.coalesce(F.col("geometry.longitude").between(-180, 180), F.lit(True)),
    }
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in bad.items())), lambda x: x.isNotNull())


def validate_bundles(raw: DataFrame, provenance: str) -> tuple[DataFrame, DataFrame]:
    """Sound bundles, and the others with their errors; ``raw`` has a JSON text in ``json``."""
    rows = raw.select(F.from_json("json", BUNDLE).alias("b"), "json").select("b.*", "json").withColumn("errors", bundle_errors(provenance))
    return rows.where(F.size("errors") == 0).drop("errors", "json"), rows.where(F.size("errors") > 0)


SIDECAR = "schema_version int, doc_sha256 string, embedder struct<model:string,dimensions:int>, chunks array<struct<idx:int,text:string,page_start:int,page_end:int,embedding:array<float>>>"


def sidecar_errors(model: str, dimensions: int, sha: Column) -> Column:
    """What is wrong with a chunk sidecar."""
    bad = {
        "schema_version": ~F.coalesce(F.col("schema_version") == 2, F.lit(False)),
        "sha256": ~F.coalesce(F.col("doc_sha256") == sha, F.lit(False)),
        "model": ~F.coalesce(F.col("embedder.model") == model, F.lit(False)),
        "dimensions": ~F.coalesce(F.col("embedder.dimensions") == dimensions, F.lit(False)),
        "chunks": F.coalesce(F.size("chunks"), F.lit(0)) <= 0,
        "embedding": F.exists(F.coalesce("chunks", F.array().cast("array<struct<idx:int,text:string,page_start:int,page_end:int,embedding:array<float>>>")), lambda c: ~F.coalesce(F.size(c["embedding"]) == dimensions, F.lit(False))),
    }
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in bad.items())), lambda x: x.isNotNull())


def text_sidecar_ok(pages: Column) -> Column:
    """Pages (array<struct<number, text>>): some, with positive numbers."""
    return F.coalesce((F.size(pages) > 0) & F.forall(pages, lambda p: p["number"] > 0), F.lit(False))


class Stale(Exception):
    """The table was replaced since it was read."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def generation(spark: SparkSession, path: str) -> str | None:
    """The version of a table that ``write_manifest`` wrote; None if there is none."""
    fs, at = _fs(spark, f"{path.rstrip('/')}/_generation")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_manifest(df: DataFrame, path: str, expected: str | None = None, check: bool = False) -> str:
    """Replace a table as a whole and return its new version.

    The new table is written beside the old one, which is then renamed aside, and goes only when the
    new one has its name; if that fails the old one gets its name back.  With ``check`` the table
    must still be of the ``expected`` version (None: absent), or Stale is raised.
    """
    spark, base, version = df.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    draft, aside = f"{base}.{version}", f"{base}.{version}.old"
    df.write.parquet(draft)
    fs, mark = _fs(spark, f"{draft}/_generation")
    out = fs.create(mark, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    (_, new), (_, to), (_, old) = (_fs(spark, x) for x in (draft, base, aside))
    if check and generation(spark, base) != expected:
        fs.delete(new, True)
        raise Stale(f"{path} is no longer {expected}")
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, to):
        if had:
            fs.rename(old, to)
        raise OSError(f"could not put {draft} in the place of {path}")
    if had:
        fs.delete(old, True)
    return version


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def log_calls(df: DataFrame, path: str) -> None:
    """Append call records, their metadata alone, as JSON lines."""
    write_jsonl(df.drop("prompt", "response", "text"), path, append=True)


def backfill_index(index: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with a vector that the index lacks."""
    return chunks.where(F.col("embedding").isNotNull()).join(index.select(key), key, "left_anti")


def plan_pages(pages: DataFrame, scanned_cap: int = 25, fallback_cap: int = 200) -> DataFrame:
    """Which text a page (document_id, number, text, text_extractable) gets: parser, ocr or none.

    Known to hold text: the parser alone.  Known to be scanned: OCR of the first 25 pages.  Not
    known: the parser, and OCR of the blank ones among the first 200 pages.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    how = F.when(F.col("text_extractable"), "parser").when(~F.col("text_extractable"), F.when(F.col("number") <= scanned_cap, "ocr").otherwise("none")).when(~blank, "parser").when(F.col("number") <= fallback_cap, "ocr").otherwise("none")
    return pages.withColumn("method", how)
