"""Point files as a data source that splits: a partition is a range of a file's records, read by itself.

``spark.read.format("points").load(path)`` gives (path, id, x, y, z, problem). Listing and headers are read where the query is planned, with
a few bytes a file; points are read by the tasks, from wherever Arrow can open the path (local, HDFS, S3, GCS). A file that can't be read is
one row with the problem and nulls elsewhere; it stops no other. A file that ends early gives the records it has and a row that says so.
Options: block (records a partition), recursive. ASCII files have no records of fixed size: each is one partition, read line by line.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.session import ship

from . import pointfiles as P

SCHEMA = "path string, id long, x double, y double, z double, problem string"
BLOCK = 1_000_000
#: Bytes in which a header must end.
HEAD = 1 << 20
_FAULTS = (P.BadFile, ValueError, KeyError, IndexError, OverflowError, OSError, P.struct.error)


@dataclass
class Range(InputPartition):
    path: str
    kind: str  # las, binary, ascii; "" for a problem
    first: int = 0
    last: int = 0
    offset: int = 0
    record: int = 0
    layout: object = None
    short: int = 0  # records that the header promises and the file lacks, told by the last range
    problem: str = ""


def _opened(path: str):
    at, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return at, inner


def _rows(path: str, first: int, xyz: np.ndarray) -> pa.RecordBatch:
    n = len(xyz)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n)), *(pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3)), pa.nulls(n, pa.string())], names=["path", "id", "x", "y", "z", "problem"])


def _trouble(path: str, what: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.float64()) for _ in "xyz"), pa.array([what])], names=["path", "id", "x", "y", "z", "problem"])


def ranges(path: str, size: int, head: bytes, block: int) -> list[Range]:
    """The partitions of a file."""
    try:
        if path.lower().endswith(".ply"):
            h = P.ply_header(head)
            if h["version"] == "ascii":
                return [Range(path, "ascii", 0, h["point_count"], h["offset"], 0, [[n for n, _ in h["names"]].index(c) for c in "xyz"])]
            order = ">" if h["version"] == "binary_big_endian" else "<"
            kind = np.dtype([(n, P._PLY_TYPES[t].replace("<", order)) for n, t in h["names"]])
            [kind.fields[c] for c in "xyz"]
            form, record, layout = "binary", kind.itemsize, [(n, kind.fields[n][0].str, kind.fields[n][1]) for n in "xyz"]
        else:
            h = P.las_header(head)
            if h["packed"]:
                raise P.BadFile("compressed points")
            if h["fmt"] not in (0, 1, 2, 3, 6, 7, 8):
                raise P.BadFile(f"point format {h['fmt']}")
            form, record, layout = "las", h["record"], (h["scale"], h["shift"])
            if record < 12:
                raise P.BadFile("records are too short")
        have = max(0, min(h["point_count"], (size - h["offset"]) // record))
        out = [Range(path, form, i, min(i + block, have), h["offset"], record, layout) for i in range(0, have, block)] or [Range(path, form, 0, 0, h["offset"], record, layout)]
        out[-1].short = h["point_count"] - have
        return out
    except _FAULTS as e:
        return [Range(path, "", problem=str(e) or type(e).__name__)]


class PointReader(DataSourceReader):
    def __init__(self, path: str, block: int, recursive: bool):
        self.path, self.block, self.recursive = path, block, recursive

    def partitions(self) -> list[Range]:
        at, inner = _opened(self.path)
        wild = re.search(r"[*?\[]", inner)
        base = inner[: wild.start()].rpartition("/")[0] or "." if wild else inner
        info = at.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in at.get_file_info(fs.FileSelector(base, recursive=self.recursive)) if f.is_file]
        files = [f for f in files if f.extension.lower() in P.EXTENSIONS and (not wild or fnmatch.fnmatch(f.path, inner) or fnmatch.fnmatch(f.path, f"{inner}/*"))]
        files.sort(key=lambda f: f.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""

        def one(f) -> list[Range]:
            name = scheme + f.path
            try:
                with at.open_input_file(f.path) as s:
                    return ranges(name, f.size, s.read(HEAD), self.block)
            except OSError as e:
                return [Range(name, "", problem=str(e))]

        with ThreadPoolExecutor(16) as pool:
            return [r for rs in pool.map(one, files) for r in rs]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        if not r.kind:
            yield _trouble(r.path, r.problem)
            return
        try:
            yield from self._points(r)
            if r.short:
                yield _trouble(r.path, f"{r.short} points are missing")
        except _FAULTS as e:
            yield _trouble(r.path, str(e) or type(e).__name__)

    def _points(self, r: Range) -> Iterator[pa.RecordBatch]:
        at, inner = _opened(r.path)
        with at.open_input_file(inner) as s:
            if r.kind == "ascii":
                yield from self._lines(r, s)
                return
            step = max(1, (8 << 20) // r.record)
            for i in range(r.first, r.last, step):
                n = min(step, r.last - i)
                raw = np.frombuffer(s.read_at(n * r.record, r.offset + i * r.record), np.uint8).reshape(n, r.record)
                if r.kind == "las":
                    scale, shift = r.layout
                    xyz = np.ascontiguousarray(raw[:, :12]).view("<i4").astype(float) * np.array(scale) + np.array(shift)
                else:
                    xyz = np.stack([np.ascontiguousarray(raw[:, o : o + np.dtype(t).itemsize]).view(t)[:, 0].astype(float) for _, t, o in r.layout], 1)
                yield _rows(r.path, i, xyz)

    def _lines(self, r: Range, s) -> Iterator[pa.RecordBatch]:
        s.seek(r.offset)
        held, done, rest = [], 0, b""
        while done + len(held) < r.last:
            b = s.read(4 << 20)
            lines = (rest + b).split(b"\n")
            rest = lines.pop() if b else b""
            held += [x for x in lines if x.strip()]
            if held and (not b or len(held) > 100_000):
                now = held[: r.last - done]
                yield _rows(r.path, done, np.array([[float(v) for v in x.split()] for x in now], float)[:, r.layout])
                done, held = done + len(now), []
            if not b:
                break
        if held:
            yield _rows(r.path, done, np.array([[float(v) for v in x.split()] for x in held[: r.last - done]], float)[:, r.layout])
            done += len(held)
        if done < r.last:
            yield _trouble(r.path, f"{r.last - done} points are missing")


class PointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PointReader:
        return PointReader(self.options["path"], int(self.options.get("block", BLOCK)), str(self.options.get("recursive", "true")).lower() == "true")


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(path, id, x, y, z, problem) of the files at the path."""
    ship(spark)
    spark.dataSource.register(PointSource)
    return spark.read.format("points").option("block", block).load(path)
