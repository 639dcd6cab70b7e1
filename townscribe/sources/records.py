"""Fixed-width records as a data source of Spark, cut by bytes.

A file holds records of one length, each followed by the same end: CRLF, LF, CR or nothing; the last may lack it. The end is
seen at the first record's border, so where a record starts follows from its number, and a file is cut into
partitions of any size without looking for borders. Line ends inside a record are part of it. Every end is checked; a
file whose ends differ raises, unless ``ends`` is ``mixed``: then each file is one partition, read from its start in bounded
pieces. What is left at a file's end and shorter than a record is dropped.

Files are opened through ``pyarrow.fs``, by uri or local path; folders give their files, less those whose name starts with a dot or
an underscore.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and records that are decoded at once.
SPLIT_BYTES, RECORDS = 32 << 20, 10_000


@dataclass
class Stretch(InputPartition):
    """Records of a file from one number to before another; up to the end if ``stop`` is None."""

    path: str
    start: int
    stop: int | None
    end: bytes


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _end_at(data: bytes, at: int) -> bytes:
    """The record end that stands at a place."""
    return data[at : at + 2] if data[at : at + 2] == b"\r\n" else data[at : at + 1] if data[at : at + 1] in (b"\n", b"\r") else b""


class FixedWidthReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.length = options["path"], int(options["length"])
        self.fields, self.mixed = json.loads(options["fields"]), options.get("ends") == "mixed"
        self.split, self.names = int(options.get("split", SPLIT_BYTES)), names

    def partitions(self) -> list[Stretch]:
        from pyarrow import fs

        system, base = _system(self.path)
        found = system.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
            if f.size < self.length:
                continue
            if self.mixed:
                out.append(Stretch(f.path, 0, None, b""))
                continue
            with system.open_input_file(f.path) as g:
                end = _end_at(g.read_at(min(2, f.size - self.length), self.length), 0)
            stride = self.length + len(end)
            n, each = (f.size + len(end)) // stride, max(1, self.split // stride)
            if f.size < (n - 1) * stride + self.length:
                n -= 1
            out += [Stretch(f.path, i, min(n, i + each), end) for i in range(0, n, each)]
        return out or [Stretch("", 0, 0, b"")]

    def _batch(self, records: list[str]) -> pa.RecordBatch:
        cut = [self.fields[n] for n in self.names]
        return pa.RecordBatch.from_arrays([pa.array([r[a : a + n].strip() for r in records], pa.string()) for a, n in cut], names=self.names)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.path:
            system, _ = _system(self.path)
            with system.open_input_file(partition.path) as f:
                yield from self._any(f) if partition.stop is None else self._even(f, partition)

    def _even(self, f, part: Stretch) -> Iterator[pa.RecordBatch]:
        stride = self.length + len(part.end)
        for i in range(part.start, part.stop, RECORDS):
            n = min(RECORDS, part.stop - i)
            data = f.read_at(n * stride, i * stride)
            for k in range(n):
                mark = data[k * stride + self.length : (k + 1) * stride]
                if mark != part.end and (k + 1) * stride <= len(data):
                    raise ValueError(f"{part.path}: record {i + k} ends with {mark!r}, the first with {part.end!r}")
            text = data.decode("latin-1")
            yield self._batch([text[k * stride : k * stride + self.length] for k in range(n)])

    def _any(self, f) -> Iterator[pa.RecordBatch]:
        data, at, more = b"", 0, True
        while True:
            if more and len(data) - at < self.length + 2:
                piece = f.read(max(RECORDS * self.length, self.length + 2))
                more, data, at = bool(piece), data[at:] + piece, 0
            records = []
            while len(data) - at >= self.length + (2 if more else 0):
                records.append(data[at : at + self.length].decode("latin-1"))
                at += self.length
                at += len(_end_at(data, at))
            if records:
                yield self._batch(records)
            if not more:
                return


class FixedWidth(DataSource):
    """``fixed_width``: options path, length, fields (JSON: name to first byte and length), ends (mixed), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def schema(self) -> str:
        return ", ".join(f"`{k}` string" for k in json.loads(self.options["fields"]))

    def reader(self, schema) -> FixedWidthReader:
        return FixedWidthReader(dict(self.options), schema.names)


def read_records(spark: SparkSession, path: str, length: int, fields: dict[str, tuple[int, int]], ends: str = "even", split: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``length`` bytes in Latin-1 as trimmed strings: name -> (first byte from 0, length)."""
    spark.dataSource.register(FixedWidth)
    return spark.read.format("fixed_width").options(path=path, length=length, fields=json.dumps(fields), ends=ends, split=split).load()


def sifted(records: DataFrame, named: Column, refused: Column, status: str = "status", active: str = "A") -> DataFrame:
    """Records with a reason: written, or skip_status, skip_no_keyword, skip_rejected_pattern, in that order."""
    reason = F.when(F.col(status) != active, "skip_status").when(~named, "skip_no_keyword").when(refused, "skip_rejected_pattern").otherwise("written")
    return records.withColumn("reason", reason)
