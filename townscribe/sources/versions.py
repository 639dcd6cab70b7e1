"""Tables that writers replace as a whole or by partition, and that readers see either before or after.

A table is a folder. Each write puts its rows into a folder of its own under ``data``, and then tries to create the
next file of ``log``, which says where every partition's rows are. A log file can be created once only, so of two
writers who saw the same version one is refused: it merges its change into the new version and tries again. A write that
fails leaves files that no log names; readers never look at them.

Creating once is a hard link on a local disk, and elsewhere a rename that refuses an existing target, as HDFS gives it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times a writer tries to get its change in.
TRIES = 3


class Stale(RuntimeError):
    """Others have changed the table each time this writer tried."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def _text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its text at one blow; False if it is there already."""
    draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs, tmp = _fs(spark, draft)
    out = fs.create(tmp, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            nio = spark.sparkContext._jvm.java.nio.file
            at = [nio.Path.of(_fs(spark, p)[1].toUri().getPath(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 0)) for p in (path, draft)]
            try:
                nio.Files.createLink(*at)
            except Exception as e:  # noqa: BLE001  py4j wraps what Java throws
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        return bool(fs.rename(tmp, _fs(spark, path)[1]))
    finally:
        fs.delete(tmp, False)


def version(spark: SparkSession, base: str) -> int:
    """The number of the table's last version; 0 before the first."""
    return max((int(n) for n in _listed(spark, f"{base}/log") if n.isdigit()), default=0)


def _state(spark: SparkSession, base: str, n: int) -> dict:
    return json.loads(_text(spark, f"{base}/log/{n:020}")) if n else {"schema": None, "keys": [], "parts": {}}


def read(spark: SparkSession, base: str, at: int | None = None, only: Callable[[str], bool] | None = None) -> DataFrame:
    """The table's rows, at a version or at the last; of those partitions whose folder names ``only`` takes."""
    state = _state(spark, base, version(spark, base) if at is None else at)
    return _rows(spark, base, state if only is None else state | {"parts": {p: f for p, f in state["parts"].items() if only(p)}})


def parts(spark: SparkSession, base: str) -> list[str]:
    """The folder names of the last version's partitions; none before the first."""
    return sorted(_state(spark, base, version(spark, base))["parts"])


def _rows(spark: SparkSession, base: str, state: dict) -> DataFrame:
    if state["schema"] is None:
        raise FileNotFoundError(f"{base} has no version yet")
    kind = StructType.fromJson(json.loads(state["schema"]))
    by: dict[str, list[str]] = {}
    for part, folder in state["parts"].items():
        by.setdefault(folder, []).append(part)
    # one scan for each write that still has rows in the table
    scans = [spark.read.schema(kind).option("basePath", f"{base}/data/{f}").parquet(*(f"{base}/data/{f}/{p}" if p else f"{base}/data/{f}" for p in parts)).select(kind.names) for f, parts in sorted(by.items())]
    return reduce(DataFrame.unionAll, scans) if scans else spark.createDataFrame([], kind)


def _written(spark: SparkSession, base: str, rows: DataFrame, keys: list[str]) -> dict[str, str]:
    """Write rows to a folder of their own; the partitions there, by folder name."""
    folder = uuid.uuid4().hex
    at = f"{base}/data/{folder}"
    if not keys:
        rows.write.parquet(at)
        return {"": folder}
    rows.write.partitionBy(*keys).parquet(at)
    parts = [""]
    for _ in keys:  # a level of folders a key
        parts = [f"{p}/{n}".lstrip("/") for p in parts for n in _listed(spark, f"{at}/{p}" if p else at) if "=" in n]
    return dict.fromkeys(parts, folder)


def _commit(spark: SparkSession, base: str, n: int, state: dict) -> bool:
    fs, log = _fs(spark, f"{base}/log")
    fs.mkdirs(log)
    return _create_once(spark, f"{base}/log/{n + 1:020}", json.dumps(state))


def merge(spark: SparkSession, base: str, change: Callable[[DataFrame | None], DataFrame], tries: int = TRIES, pause: Callable[[int], None] | None = None) -> int:
    """Replace a table by what ``change`` makes of it (None: there is none yet); returns the new version.

    If another writer was faster, ``change`` is applied to what that one left, ``tries`` times in all; then Stale is raised.
    ``pause`` is called between seeing a version and committing the next, with the number of the try.
    """
    for k in range(tries):
        n = version(spark, base)
        state = _state(spark, base, n)
        new = change(_rows(spark, base, state) if n else None)
        parts = _written(spark, base, new, [])
        if pause:
            pause(k)
        if _commit(spark, base, n, {"schema": new.schema.json(), "keys": [], "parts": parts}):
            return n + 1
    raise Stale(f"{base} was changed by others {tries} times")


def replace_partitions(rows: DataFrame, base: str, keys: list[str], emptied: list[dict[str, str]] | None = None, tries: int = TRIES) -> int:
    """Replace the partitions of which ``rows`` has rows, and drop those ``emptied``; all others stay as they are.

    The rows are written once; a writer that was slower only merges the list of partitions again. Keys must not be null and,
    as names of folders, compare as text.
    """
    spark = rows.sparkSession
    order = [*(c for c in rows.columns if c not in keys), *keys]
    rows = rows.select(order)
    parts = _written(spark, base, rows, keys)
    gone = {"/".join(f"{k}={e[k]}" for k in keys) for e in emptied or []}
    for _ in range(tries):
        n = version(spark, base)
        state = _state(spark, base, n)
        if n and state["keys"] != keys:
            raise ValueError(f"{base} is kept by {state['keys']}, not by {keys}")
        kept = {p: f for p, f in state["parts"].items() if p not in gone}
        if _commit(spark, base, n, {"schema": rows.schema.json(), "keys": keys, "parts": kept | parts}):
            return n + 1
    raise Stale(f"{base} was changed by others {tries} times")


def tidy(spark: SparkSession, base: str, keep: int = 1) -> int:
    """Delete the rows that none of the last ``keep`` versions has; returns how many folders went. Not for use beside a running writer."""
    last = version(spark, base)
    used = {f for n in range(max(1, last - keep + 1), last + 1) for f in _state(spark, base, n)["parts"].values()}
    old = [f for f in _listed(spark, f"{base}/data") if f not in used]
    for f in old:
        fs, where = _fs(spark, f"{base}/data/{f}")
        fs.delete(where, True)
    return len(old)


def numbered_sections(sections: DataFrame) -> DataFrame:
    """Sections (source_id, ordinal, section_key, heading, text) ready to replace their source's: blank ones go, the others keep their ordinals.

    A section without a key is called by its place, ``section_1`` for ordinal 0.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    key = F.when(F.coalesce("section_key", F.lit("")) == "", F.concat(F.lit("section_"), F.col("ordinal") + 1)).otherwise(F.col("section_key"))
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.regexp_replace("heading", r"(?U)^\s+|\s+$", ""))
    return sections.select("source_id", "ordinal", key.alias("section_key"), heading.alias("heading"), text.alias("text")).where("text <> ''")


def scoped_rules(rules: DataFrame) -> DataFrame:
    """Rules ready to replace their scope's: tokens of the scope in one form, those without a value or a citation go."""
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    low = {c: F.lower(trimmed(c)) for c in ("community_type", "entity_form", "topic_family")}
    return rules.withColumns(low | {"jurisdiction": F.upper(trimmed("jurisdiction")), "value_text": trimmed("value_text"), "citation": trimmed("citation")}).where("value_text <> '' and citation <> ''")
