"""URL filters: a sorted array of digests, mapped into memory and probed by binary search.

A rule is a host, a path and a verdict. It fits a url whose host is the rule's host or a subdomain of
it and whose path starts with the rule's path; of the rules that fit, the longest (host and path
together, then host) decides. A url that no rule fits gets the verdict of the method: it is not in
the array, so it is allowed.

The rules' strings are hashed with 64-bit xxHash and written to files: sorted digests, offsets, strings, and
the path lengths of each host. The files travel with ``SparkContext.addFile``, once a machine, and every
worker maps them, so the workers of a machine share their pages. A batch of urls is probed in two rounds, each
one vectorised binary search: all suffixes of the hosts, then, for the hosts found, the prefixes of the paths
that have the length of one of the host's rules. What a digest finds is compared with the stored string, so a
collision decides nothing.

Rules are read in blocks of bounded size (``BLOCK_RULES``), dealt by hash; the pages pass each block and the
longest rule of all blocks wins. Pages are never shuffled.

Defined results:

* host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; port and user stay part of it.
* path: from there up to ``?``, ``#`` or the end; it may be empty, and then starts with no rule's non-empty path.
* a null url or one without ``://`` has an empty host and path, which no rule fits (a rule needs a host).
* rules: A to Z of the host lower-cased; a null path is empty; null or empty hosts and unknown verdicts raise ``ValueError``.
  Of two verdicts for one host and path, ``block`` stands.
* repeated pages give a row each; an empty table gives none; other columns are not touched and stay, unless they are
  called like the new ones, which replace them.
"""

from __future__ import annotations

import atexit
import bisect
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common

#: Rules of one digest array; the driver holds one block of rules at a time.
BLOCK_RULES = 1_000_000
#: What a url gets that is in no array.
DEFAULT = "allow"


def _digest(value: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value)


class DigestArray:
    """Distinct strings behind their sorted digests, each with a small number; in memory-mapped files."""

    PARTS = ("keys", "offsets", "numbers", "blob")

    @classmethod
    def write(cls, folder: str, name: str, entries: dict[bytes, int]) -> list[str]:
        """Write the array; returns its files."""
        rows = sorted((_digest(s), s, n) for s, n in entries.items())
        parts = {
            "keys": np.array([r[0] for r in rows], dtype="<u8"),
            "offsets": np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<i8"),
            "numbers": np.array([r[2] for r in rows], dtype="<i8"),
            "blob": np.frombuffer(b"".join(r[1] for r in rows), dtype="u1"),
        }
        files = []
        for part in cls.PARTS:
            files.append(f"{folder}/{name}-{part}")
            parts[part].tofile(files[-1])
        return files

    def __init__(self, folder: str, name: str) -> None:
        kinds = {"keys": "<u8", "offsets": "<i8", "numbers": "<i8", "blob": "u1"}
        for part in self.PARTS:
            path = f"{folder}/{name}-{part}"
            mapped = np.memmap(path, dtype=kinds[part], mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kinds[part])
            setattr(self, part, mapped)

    def string(self, i: int) -> bytes:
        return self.blob[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """For each probe its place in the array, or -1."""
        out = np.full(len(probes), -1, dtype=np.int64)
        if not len(self.keys) or not probes:
            return out
        wanted = np.fromiter(map(_digest, probes), dtype=np.uint64, count=len(probes))
        first, last = (np.searchsorted(self.keys, wanted, side=s) for s in ("left", "right"))
        for i in np.flatnonzero(first < last):
            # digests may collide: the stored string decides
            out[i] = next((j for j in range(first[i], last[i]) if self.string(j) == probes[i]), -1)
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [rest.find(c) for c in "/?#"]
    host = rest[: min((e for e in ends if e >= 0), default=len(rest))]
    path = rest[len(host) :]
    path = path[: min((e for e in (path.find("?"), path.find("#")) if e >= 0), default=len(path))]
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def suffixes(host: str) -> list[str]:
    """The host and the domains above it, the longest first."""
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        if at + 1 < len(host):
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


class Block:
    """The digest arrays of one block of rules, as a worker sees them."""

    def __init__(self, folder: str, name: str) -> None:
        self.hosts, self.rules = DigestArray(folder, f"{name}h"), DigestArray(folder, f"{name}r")
        path = f"{folder}/{name}-lengths"
        self.lengths = np.memmap(path, dtype="<i8", mode="r") if os.path.getsize(path) else np.zeros(0, dtype="<i8")

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[int, int, str, str] | None]:
        """For each host and path the longest rule that fits: (length, host length, rule, verdict)."""
        rows, names = [], []
        for i, (host, _) in enumerate(parts):
            for s in suffixes(host):
                rows.append(i)
                names.append(s)
        found = self.hosts.find([s.encode("utf-8", "surrogatepass") for s in names])
        owner, probes, made = [], [], []
        for k in np.flatnonzero(found >= 0):
            i, at = rows[k], int(self.hosts.numbers[found[k]])
            path = parts[i][1]
            for n in self.lengths[at + 1 : at + 1 + self.lengths[at]].tolist():
                if n > len(path):
                    break  # lengths stand in order
                owner.append(i)
                made.append((n + len(names[k]), len(names[k]), names[k] + path[:n]))
                probes.append(f"{names[k]}\0{path[:n]}".encode("utf-8", "surrogatepass"))
        best: list[tuple[int, int, str, str] | None] = [None] * len(parts)
        for i, m, at in zip(owner, made, self.rules.find(probes).tolist(), strict=True):
            if at >= 0 and (best[i] is None or best[i][:2] < m[:2]):
                best[i] = (*m, "block" if self.rules.numbers[at] else "allow")
        return best


def write_block(folder: str, rules: list[tuple[str, str, str]]) -> tuple[str, list[str]]:
    """The files of a block of (host, path, verdict); returns its name and the files."""
    name, by_host, verdicts = uuid.uuid4().hex, {}, {}
    for host, path, verdict in rules:
        if not host or verdict not in ("allow", "block"):
            raise ValueError(f"a rule needs a host and the verdict allow or block: {host!r}, {path!r}, {verdict!r}")
        host, path = host.translate(_LOWER), path or ""
        lengths = by_host.setdefault(host, [])
        if len(path) not in lengths:
            bisect.insort(lengths, len(path))
        key = f"{host}\0{path}".encode("utf-8", "surrogatepass")
        verdicts[key] = max(verdicts.get(key, 0), int(verdict == "block"))
    flat, places = [], {}
    for host, lengths in by_host.items():
        places[host.encode("utf-8", "surrogatepass")] = len(flat)
        flat += [len(lengths), *lengths]
    files = DigestArray.write(folder, f"{name}h", places) + DigestArray.write(folder, f"{name}r", verdicts)
    np.array(flat, dtype="<i8").tofile(f"{folder}/{name}-lengths")
    return name, [*files, f"{folder}/{name}-lengths"]


def publish(rules: DataFrame, block_rules: int = BLOCK_RULES) -> list[str]:
    """Write the arrays of all rules (host, path, verdict), a block at a time, and give them to the executors; returns the blocks' names."""
    spark = rules.sparkSession
    folder = tempfile.mkdtemp(prefix="rules-")  # the driver serves the files from here until it ends
    atexit.register(shutil.rmtree, folder, True)
    rules = common.materialize(rules.select(*(F.col(c).cast("string") for c in ("host", "path", "verdict"))), "rules")
    blocks = max(1, -(-rules.count() // block_rules))
    names = []
    for b in range(blocks):
        # equal rules meet in one block, so that the verdicts of one rule are settled there
        own = rules.where(F.pmod(F.xxhash64(F.lower("host"), F.coalesce("path", F.lit(""))), F.lit(blocks)) == b)
        name, files = write_block(folder, [tuple(r) for r in own.distinct().collect()])
        for f in files:
            spark.sparkContext.addFile(f)
        names.append(name)
    common.discard(rules)
    return names


def judge(pages: DataFrame, rules: DataFrame, block_rules: int = BLOCK_RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    blocks = publish(rules, block_rules)
    names = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in names]
    schema = StructType([*(pages.schema[c] for c in kept), *(StructField(n, StringType()) for n in names)])
    place = len(pages.columns)
    # the url goes along under a name of its own, as it may be one of the columns that are replaced
    given = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{url}`").cast("string").alias(f"_url{place}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, folder = common.worker_state("rules"), SparkFiles.getRootDirectory()
        for b in blocks:
            if b not in state:
                state[b] = Block(folder, b)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            best: list[tuple | None] = [None] * len(parts)
            for b in blocks:
                best = [max((x for x in pair if x is not None), key=lambda x: x[:2], default=None) for pair in zip(best, state[b].judge(parts), strict=True)]
            new = [[p[0] for p in parts], [p[1] for p in parts], [None if x is None else x[2] for x in best], [DEFAULT if x is None else x[3] for x in best]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, pa.string()) for v in new)], names=[*kept, *names])

    return given.mapInArrow(run, schema)


ORACLE = """
with rules(r_host, r_path, r_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest as (select page_id, url, row_number() over () as no, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, no, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from rest),
fit as (
  select no, arg_max(r_host || r_path, length(r_host || r_path)) as rule, arg_max(r_verdict, length(r_host || r_path)) as verdict
  from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
  group by no)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fit using (no)
"""
