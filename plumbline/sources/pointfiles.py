"""Point-cloud files: headers and points of LAS 1.2 to 1.4 (formats 0-3 and 6-8), and of ASCII and binary PLY.

Files come through Spark's ``binaryFile`` reader, so any store will do; headers and points are decoded in Arrow
batches. Compressed LAS (LAZ) has its header read, its points are out of scope: no decompressor is at hand.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship

EXTENSIONS = ("las", "laz", "ply")
#: Bytes before these many are searched for the end of a PLY header.
PLY_HEADER = 64 * 1024
HEADER = "path string, format string, version string, point_count long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, crs string, sha256 string, bytes long, problems array<string>, warnings array<string>"
_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}


class BadFile(ValueError):
    pass


def las_header(b: bytes) -> dict:
    if len(b) < 227 or b[:4] != b"LASF":
        raise BadFile("not a LAS file")
    major, minor = b[24], b[25]
    size, offset, vlrs = struct.unpack_from("<HII", b, 94)
    fmt, length, count = struct.unpack_from("<BHI", b, 104)
    scale, shift = struct.unpack_from("<3d", b, 131), struct.unpack_from("<3d", b, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", b, 179)
    if (major, minor) >= (1, 4) and len(b) >= 255:
        count = struct.unpack_from("<Q", b, 247)[0] or count
    out = {"version": f"{major}.{minor}", "point_count": count, "x0": x0, "y0": y0, "z0": z0, "x1": x1, "y1": y1, "z1": z1}
    return out | {"offset": offset, "record": length, "fmt": fmt & 0x3F, "packed": bool(fmt & 0x80), "scale": scale, "shift": shift, "crs": _las_crs(b, size, vlrs)}


def _las_crs(b: bytes, at: int, n: int) -> str:
    """EPSG code from the WKT record, else from the projected key of the GeoTIFF directory, else UNKNOWN."""
    key = None
    for _ in range(n):
        if at + 54 > len(b):
            break
        record, size = struct.unpack_from("<HH", b, at + 18)
        body = b[at + 54 : at + 54 + size]
        if record == 2112:
            codes = re.findall(r'(?:AUTHORITY\["EPSG","?|ID\["EPSG",)(\d+)', body.decode("utf-8", "replace"))
            if codes:
                return f"EPSG:{codes[-1]}"
        elif record == 34735 and size >= 8:
            keys = np.frombuffer(body[: size // 2 * 2], "<u2")
            for k in range(4, len(keys) - 3, 4):
                if keys[k] == 3072 and keys[k + 1] == 0:
                    key = int(keys[k + 3])
        at += 54 + size
    return f"EPSG:{key}" if key and key != 32767 else "UNKNOWN"


def ply_header(b: bytes) -> dict:
    end = re.search(rb"end_header\r?\n", b[:PLY_HEADER])
    if b[:3] != b"ply" or not end:
        raise BadFile("not a PLY file, or its header is too long")
    lines = b[: end.start()].decode("ascii", "replace").splitlines()
    kind, count, names, where, crs = "", 0, [], None, "UNKNOWN"
    for x in map(str.split, lines[1:]):
        if x[:1] == ["format"]:
            kind = x[1]
        elif x[:1] == ["element"]:
            where = x[1]
            count = int(x[2]) if where == "vertex" else count
        elif x[:1] == ["property"] and where == "vertex":
            names.append((x[-1], x[1]))
        elif x[:1] == ["comment"]:
            m = re.match(r"(?:crs|coordinate_reference_system|srs|proj)\b[\s:=]*(.+)", " ".join(x[1:]), re.I)
            crs = m[1].strip() if m else crs
    return {"version": kind, "point_count": count, "names": names, "offset": end.end(), "crs": crs}


def las_points(b: bytes) -> np.ndarray:
    h = las_header(b)
    if h["packed"]:
        raise BadFile("compressed points")
    if h["fmt"] not in (0, 1, 2, 3, 6, 7, 8):
        raise BadFile(f"point format {h['fmt']}")
    n = min(h["point_count"], (len(b) - h["offset"]) // h["record"])
    raw = np.frombuffer(b, np.uint8, n * h["record"], h["offset"]).reshape(n, h["record"])
    xyz = np.ascontiguousarray(raw[:, :12]).view("<i4").astype(float)
    return xyz * np.array(h["scale"]) + np.array(h["shift"])


def ply_points(b: bytes) -> np.ndarray:
    h = ply_header(b)
    at = [[n for n, _ in h["names"]].index(c) for c in "xyz"]
    if h["version"] == "ascii":
        rows = b[h["offset"] :].decode("ascii").split("\n")[: h["point_count"]]
        return np.array([[float(v) for v in r.split()] for r in rows if r.strip()], float).reshape(-1, len(h["names"]))[:, at]
    order = ">" if h["version"] == "binary_big_endian" else "<"
    kind = np.dtype([(n, _PLY_TYPES[t].replace("<", order)) for n, t in h["names"]])
    p = np.frombuffer(b, kind, h["point_count"], h["offset"])
    return np.stack([p[c].astype(float) for c in "xyz"], 1)


def _files(spark: SparkSession, path: str, most_bytes: int | None) -> DataFrame:
    ship(spark)
    f = spark.read.format("binaryFile").load(path).withColumn("ext", F.lower(F.element_at(F.split("path", r"\."), -1))).where(F.col("ext").isin(*EXTENSIONS))
    return f if most_bytes is None else f.where(F.col("length") <= most_bytes)


def headers(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """One row per file: format, version, count, extent, CRS, hash, and what is wrong with it. Files beyond a given limit are left out;
    ``ingest.refused`` names them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for p, ext, b, digest in zip(d.path, d.ext, d.content, d.sha256):
                r = {"path": p, "format": ext.upper(), "sha256": digest, "bytes": len(b), "problems": [], "warnings": []}
                try:
                    h = ply_header(b) if ext == "ply" else las_header(b)
                    if ext == "ply" and h["point_count"]:
                        x = ply_points(b)
                        h |= dict(zip(("x0", "y0", "z0"), x.min(0))) | dict(zip(("x1", "y1", "z1"), x.max(0)))
                    r |= {k: v for k, v in h.items() if k in ("version", "point_count", "x0", "y0", "z0", "x1", "y1", "z1", "crs")}
                    if not h["point_count"]:
                        r["problems"].append("no points")
                    if h["crs"] == "UNKNOWN":
                        r["warnings"].append("no coordinate reference system")
                except (BadFile, ValueError, KeyError, struct.error) as e:
                    r["problems"].append(str(e))
                out.append(r)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEADER.split(", ")], dtype=object)

    return _files(spark, path, most_bytes).select("path", "ext", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(run, HEADER)


def points(spark: SparkSession, path: str, block: int = 1_000_000) -> DataFrame:
    """(path, id, x, y, z) of every point of the readable files, each read whole by one task; ``pointsource`` splits them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for p, ext, b in zip(d.path, d.ext, d.content):
                try:
                    xyz = ply_points(b) if ext == "ply" else las_points(b)
                except (BadFile, ValueError, KeyError, IndexError, struct.error):
                    continue  # headers() says what is wrong with it
                for i in range(0, len(xyz), block):
                    x = xyz[i : i + block]
                    yield pd.DataFrame({"path": pd.Series([p] * len(x), dtype=object), "id": np.arange(i, i + len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    return _files(spark, path, None).select("path", "ext", "content").mapInPandas(run, "path string, id long, x double, y double, z double")


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: how many features it has, and the CRS it declares (none means WGS 84)."""
    f = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    g = F.from_json("value", "features array<string>, crs struct<properties: struct<name: string>>")
    return f.select("file", F.coalesce(F.size(g["features"]), F.lit(0)).alias("features"), F.when(F.get_json_object("value", "$.crs").isNull(), "EPSG:4326").otherwise(F.coalesce(g["crs"]["properties"]["name"], F.lit("UNKNOWN"))).alias("crs"))


#: Extension -> kind of source.
KINDS = {"geojson": "GEOJSON", "json": "FLOOR_PLAN", "csv": "CSV", "las": "POINT_CLOUD", "laz": "POINT_CLOUD", "ply": "POINT_CLOUD", "tif": "RASTER", "tiff": "RASTER", "pdf": "DOCUMENT"}


def sources(spark: SparkSession, path: str) -> DataFrame:
    """Any files as sources: name, kind by extension, bytes and hash; contents aren't parsed."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.coalesce(kinds[ext], F.lit("OTHER")).alias("source_type"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def density(headers_: DataFrame) -> DataFrame:
    """Points a square metre of a metric header's extent; null where that is undefined."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    from plumbline.functions.crs import is_metric

    return headers_.withColumn("density", F.when(is_metric(F.col("crs")) & (area > 0), F.col("point_count") / area))
