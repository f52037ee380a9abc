"""Chunked exchange between documents and hash buckets.

Operators that must know something about every n-gram of a corpus would shuffle a row for each.
Here a *chunk* of some megabytes of documents sends each hash bucket one row whose blob holds all
its keys for that bucket; the bucket's task answers each such row with a blob in the same order.
Every key goes to the bucket that its hash names, so the load is even however often a text is
repeated, and a hot key costs eight bytes for each occurrence and no row of its own.

A row is (chunk, bucket, blob). Rows for chunks carry bucket -1, -2, ... for the chunk's own headers.
Chunk numbers derive from the scan's partition and the order in it, so a retried task repeats them.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship

SCHEMA = "chunk long, bucket int, blob binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
CHUNK_BYTES = 6 << 20


BUCKET_BYTES = 64 << 20


def settle(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Makes the session ready for Python workers with bounded Arrow batches; gives the number of buckets: the session's
    shuffle partitions, or more, so that a bucket answers for at most ``BUCKET_BYTES`` of the stored input."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key)) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, "8m")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if docs is None:
        return n
    return max(n, -(-input_bytes(docs) // BUCKET_BYTES))


def input_bytes(docs: DataFrame) -> int:
    """Spark's estimate of the stored size; 0 if it has none."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


#: Stands for a null id within an operator, so that numbers stay whole; the largest, so that it is never the least of a class.
NO_ID = (1 << 63) - 1


def ids_of(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    c, b, x = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], schema=_ARROW)


def batched(out: Iterator[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in out:
        held.append(x)
        size += len(x[2]) + 32
        if size >= most:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(chunk number, its documents): runs of neighbouring rows, each up to the first row with which it has ``most`` bytes of text,
    however the rows come in batches."""
    n, base, held, size = 0, TaskContext.get().partitionId() << 24, [], 0
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        offs = np.zeros(len(b) + 1, np.int64)
        lens = col.cast(pa.binary()).fill_null(b"") if col.null_count else col.cast(pa.binary())
        np.cumsum(pa.compute.binary_length(lens).to_numpy(zero_copy_only=False), out=offs[1:])
        i = 0
        while i < len(b):
            j = min(len(b), max(i + 1, int(np.searchsorted(offs, offs[i] + max(1, most - size), "left"))))
            held.append(b.slice(i, j - i))
            size += int(offs[j] - offs[i])
            i = j
            if size >= most:
                yield base + n, pa.Table.from_batches(held)
                n, held, size = n + 1, [], 0
    if held:
        yield base + n, pa.Table.from_batches(held)


def release() -> None:
    """Gives back to the system what a worker has freed: it is kept for the next stages, beside whose workers it would count."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def deal(chunk: int, bucket: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
    """Rows with the arrays' parts for each bucket, and the order in which the answers' items come."""
    order = np.argsort(bucket, kind="stable")
    ids, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), order.size]
    parts = [a[order] for a in arrays]
    return order, [(chunk, int(b), b"".join([struct.pack("<q", e - f), *(p[f:e].tobytes() for p in parts)])) for b, f, e in zip(ids.tolist(), first.tolist(), ends)]


def parts(blob: bytes, *dtypes) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<q", blob)[0], 8, []
    for d in dtypes:
        out.append(np.frombuffer(blob, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def fields(*items: bytes) -> bytes:
    return b"".join([struct.pack("<q", len(items)), *(struct.pack("<q", len(x)) for x in items), *items])


def unfields(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<q", blob)[0]
    lens = struct.unpack_from(f"<{n}q", blob, 8)
    at, out = 8 + 8 * n, []
    for x in lens:
        out.append(blob[at : at + x])
        at += x
    return out


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        c, k, x = (b.column(i) for i in range(3))
        for i in range(len(b)):
            yield c[i].as_py(), k[i].as_py(), x[i].as_py()


def by_bucket(sent: DataFrame, buckets: int, answer: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """Answers the rows of each bucket together; chunks' headers (bucket < 0) pass through. Numbers from ``buckets``
    on are further kinds of keys in the same partitions."""

    def run(batches):
        held: dict[int, list[tuple[int, bytes]]] = {}
        for c, k, x in _loose(batches):
            if k < 0:
                yield rows([(c, k, x)])
            else:
                held.setdefault(k, []).append((c, x))
        for k in sorted(held):
            own = sorted(held.pop(k), key=lambda r: r[0])
            yield from batched((c, k, x) for (c, _), x in zip(own, answer(k, [x for _, x in own])))
            del own
            release()

    where = F.when(F.col("bucket") < 0, F.pmod(F.hash("chunk"), F.lit(buckets))).otherwise(F.pmod("bucket", F.lit(buckets)))
    return sent.repartitionById(buckets, where.cast("int")).mapInArrow(run, SCHEMA)


def by_chunk(answered: DataFrame, parts_: int, finish: Callable[[int, dict[int, bytes], list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the answers back: ``finish(chunk, headers by their bucket number, [(bucket, blob), ...])``, buckets in order."""

    def run(batches):
        now, heads, got = None, {}, []
        for c, k, x in _loose(batches):
            if c != now:
                if now is not None:
                    yield from finish(now, heads, got)
                now, heads, got = c, {}, []
            if k < 0:
                heads[k] = x
            else:
                got.append((k, x))
        if now is not None:
            yield from finish(now, heads, got)

    return answered.repartition(parts_, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, schema)
