"""A folder of Parquet files of several versions, opened as one table of the declared schema.

A contract says what the first version held and what each later one added, renamed, retyped or dropped. Every file is of the
latest version whose columns it has, and is lifted from there step by step: added columns get their defaults, so that old
files need not be written again. Files that cannot be read, or fit no version, are set aside with a reason and fail nothing.

Footers are read in tasks, files by the thousand; the driver gets what Spark's own listing gives it, a path a file, and then
reads the files of each version with one scan. Columns and filters are still pushed down to the scans.
Files are opened through ``pyarrow.fs``. A file whose footer is sound but whose pages are not fails the read,
unless it was opened with ``deep``, which decodes every file once, in batches of bounded size.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .files import literal

FOOTER = "path string, length long, schema string, reason string"
#: Rows that are decoded at once where pages are checked.
DEEP_ROWS = 4096
#: Types of a file that a declared type takes in without loss.
WIDER = {
    "smallint": {"tinyint"},
    "int": {"tinyint", "smallint"},
    "bigint": {"tinyint", "smallint", "int"},
    "double": {"float", "tinyint", "smallint", "int"},
    "timestamp": {"timestamp_ntz"},
}


@dataclass(frozen=True)
class Step:
    """What a version changes: ``rename`` (old: new), ``drop``, ``cast`` (column: type), ``add`` (column: type, SQL of the default), in this order.

    A default may name columns of the version before; a cast that a value can't take gives null.
    """

    rename: dict[str, str] = field(default_factory=dict)
    drop: tuple[str, ...] = ()
    cast: dict[str, str] = field(default_factory=dict)
    add: dict[str, tuple[str, str]] = field(default_factory=dict)

    def schema(self, old: StructType) -> StructType:
        names = set(old.names)
        unknown = ({*self.rename, *self.drop, *self.cast} - names - set(self.rename.values())) | (set(self.add) & (names - set(self.rename) - set(self.drop)))
        if unknown:
            raise ValueError(f"no such columns, or there already: {sorted(unknown)}")
        kept = [StructField(self.rename.get(f.name, f.name), f.dataType) for f in old if f.name not in self.drop]
        kept = [StructField(f.name, DataType.fromDDL(self.cast[f.name]) if f.name in self.cast else f.dataType) for f in kept]
        out = StructType(kept + [StructField(k, DataType.fromDDL(t)) for k, (t, _) in self.add.items()])
        if len(set(out.names)) < len(out.names):
            raise ValueError(f"a column twice: {out.names}")
        return out

    def lift(self, rows: DataFrame) -> DataFrame:
        added = [F.expr(default).try_cast(DataType.fromDDL(t)).alias(k) for k, (t, default) in self.add.items()]
        kept = [(c, self.rename.get(c, c)) for c in rows.columns if c not in self.drop]
        return rows.select(*((F.col(f"`{c}`").try_cast(DataType.fromDDL(self.cast[n])) if n in self.cast else F.col(f"`{c}`")).alias(n) for c, n in kept), *added)


@dataclass(frozen=True)
class Contract:
    """``first`` is the schema of version 1, ``steps`` lead to the versions after it, rows without a ``required`` column are refused."""

    first: str
    steps: tuple[Step, ...] = ()
    required: tuple[str, ...] = ()

    def schemas(self) -> list[StructType]:
        """The schema of every version, the first before all."""
        out = [StructType.fromDDL(self.first)]
        for s in self.steps:
            out.append(s.schema(out[-1]))
        missing = set(self.required) - set(out[-1].names)
        if missing:
            raise ValueError(f"required but not declared: {sorted(missing)}")
        return out

    def version(self, found: StructType) -> tuple[int, str | None]:
        """The latest version whose columns a file has, or 0 and what keeps it from the nearest one; further columns don't matter."""
        kinds = {f.name: f.dataType.simpleString() for f in found}
        best: tuple[int, str | None] = (0, None)
        fewest = None
        for n, kind in reversed(list(enumerate(self.schemas(), 1))):
            faults = [f"{f.name} missing" if f.name not in kinds else f"{f.name} is {kinds[f.name]}, not {f.dataType.simpleString()}" for f in kind if not _takes(f.dataType.simpleString(), kinds.get(f.name))]
            if not faults:
                return n, None
            if fewest is None or len(faults) < fewest:
                fewest, best = len(faults), (0, f"no version; nearest is {n}: {', '.join(faults)}")
        return best


def _takes(declared: str, found: str | None) -> bool:
    return found == declared or found in WIDER.get(declared, ())


def _scanned(declared: StructType, found: StructType) -> StructType:
    """The declared columns in the types that a file has them in; Spark's scan turns local times into instants by itself."""
    has = {f.name: f.dataType for f in found}
    return StructType([StructField(f.name, f.dataType if f.dataType.simpleString() == "timestamp" else has[f.name]) for f in declared])


@dataclass(frozen=True)
class Opened:
    """``rows`` as declared, ``refused`` the rows without a required column, ``files`` (path, length, version, reason: null for those that are read)."""

    rows: DataFrame
    refused: DataFrame
    files: DataFrame

    def set_aside(self) -> DataFrame:
        return self.files.where("reason is not null").select("path", "length", "reason")


def _footer(path: str, deep: bool) -> tuple[str | None, str | None]:
    """A file's schema as Spark's JSON, or why it can't be read. What cannot be opened at all raises."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_schema

    system, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        try:
            file = pq.ParquetFile(f)
            if deep:
                for _ in file.iter_batches(DEEP_ROWS):
                    pass
            return from_arrow_schema(file.schema_arrow.remove_metadata(), prefer_timestamp_ntz=True).json(), None
        except (pa.ArrowException, OSError, TypeError, ValueError) as e:
            return None, f"unreadable: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]


def footers(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """(path, length, schema, reason) of every file below a folder, less those whose name starts with a dot or an underscore."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [_footer(p, deep) for p in b["path"]]
            yield pd.DataFrame({"path": b["path"], "length": b["length"], "schema": [g[0] for g in got], "reason": [g[1] for g in got]})

    # contents are not among the columns, so listing opens no file
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    seen = listing.select("path", "length")
    files = seen.repartition(spark.sparkContext.defaultParallelism * 4).mapInPandas(look, FOOTER)
    # scans pass over files without a byte, the listing has them
    names = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in listing.inputFiles()], "path string")
    empty = names.join(seen.select("path"), "path", "left_anti")
    return files.unionAll(empty.select("path", F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit("unreadable: no bytes")))


def open_folder(spark: SparkSession, path: str, contract: Contract, deep: bool = False) -> Opened:
    """Open a folder by its contract; what is there now is what the frames read. Reads the footers at once.

    A folder without a file that fits gives no rows, of the declared schema.
    """
    schemas = contract.schemas()
    found = footers(spark, path, deep).collect()  # a row a file, as in Spark's own listing
    fits = {s: contract.version(StructType.fromJson(json.loads(s))) for s in {r["schema"] for r in found if r["schema"]}}
    told = [(r["path"], r["length"], *(fits[r["schema"]] if r["schema"] else (0, r["reason"])), r["schema"]) for r in found]
    lifted = []
    for n, declared in enumerate(schemas, 1):
        # one scan a version, and one more for every set of narrower types
        scans: dict[str, list[str]] = {}
        for p, _, v, _, s in told:
            if v == n:
                scans.setdefault(_scanned(declared, StructType.fromJson(json.loads(s))).json(), []).append(p)
        for kind, paths in sorted(scans.items()):
            rows = spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(*map(literal, sorted(paths)))
            rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in declared))
            lifted.append(reduce(lambda df, s: s.lift(df), contract.steps[n - 1 :], rows))
    last = schemas[-1]
    rows = reduce(DataFrame.unionAll, lifted) if lifted else spark.createDataFrame([], last)
    rows = rows.select(*last.names)
    lacking = reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in contract.required), F.lit(False))
    files = spark.createDataFrame([t[:4] for t in told], "path string, length long, version int, reason string")
    return Opened(rows.where(~lacking), rows.where(lacking), files)


def quarantine(spark: SparkSession, opened: Opened, path: str, to: str) -> int:
    """Move the files that were set aside out of a folder, each run into a folder of its own below ``to`` with the reasons beside; returns how many.

    Renames, no copies, so that a file set aside for a passing fault can go back. ``to`` must be on the same file system, and not below ``path``.
    """
    bad = opened.set_aside().orderBy("path").collect()  # a row a broken file
    if not bad:
        return 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    run = jvm.org.apache.hadoop.fs.Path(f"{to}/{uuid.uuid4().hex}")
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(conf)
    root = fs.makeQualified(base).toUri()
    if fs.makeQualified(run).toUri().getPath().startswith(root.getPath() + "/"):
        raise ValueError(f"{to} lies below {path}")
    for r in bad:
        old = jvm.org.apache.hadoop.fs.Path(r["path"])
        new = jvm.org.apache.hadoop.fs.Path(run, root.relativize(fs.makeQualified(old).toUri()).getPath())
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            raise OSError(f"{r['path']} could not be moved")
    opened.set_aside().coalesce(1).write.json(f"{run.toString()}/_reasons")
    return len(bad)
