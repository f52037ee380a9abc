"""NumPy kernels over Arrow text buffers, shared by the operators that run in Python workers.

All of them work on whole record batches: bytes of many documents lie in one buffer, and ``offs``
(n_docs + 1) tells where each begins. Hashes are polynomial in 2**64 over randomised symbols and
are mixed before use; memory per call is bounded by ``BLOCK`` symbols plus the batch itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd value for each byte.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to words: ``space`` = all but space and \\t..\\r; ``alnum`` = 0-9, a-z (after
    lower-casing) and everything from 0x80."""
    t = np.ones(256, bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:0x80] = False
        t[0x30:0x3A] = True
        t[0x61:0x7B] = True
        t[0x41:0x5B] = True
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    wide = pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 4 << 20):
    """Runs of documents [i, j) of at most ``most`` bytes each, or a single longer document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split_words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n_docs + 1)."""
    n = data.size
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    isw = table[data]
    full = np.flatnonzero(offs[1:] > offs[:-1])
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = isw[:-1]
    prev[offs[:-1][full]] = False
    starts = np.flatnonzero(isw & ~prev)
    prev[-1] = False
    prev[:-1] = isw[1:]
    prev[offs[1:][full] - 1] = False
    ends = np.flatnonzero(isw & ~prev) + 1
    return starts, ends, np.searchsorted(starts, offs)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse."""
    if _powers[0].size < n:
        size = 1 << max(10, int(n - 1).bit_length())
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(vals: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of vals[i:j] times the base's powers."""
    p, _ = powers(vals.size + 1)
    out = np.zeros(vals.size + 1, np.uint64)
    np.cumsum(vals * p[: vals.size], dtype=np.uint64, out=out[1:])
    return out


def ranged(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges [start, end) under ``prefix``; ranges of other lengths differ."""
    _, inv = powers(h.size)
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are in order and don't overlap."""
    out = np.empty(starts.size, np.uint64)
    i, most = 0, BLOCK
    while i < starts.size:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a > most:  # a single very long range: by pieces
            h = np.zeros(1, np.uint64)
            for c in range(a, b, most):
                d = min(b, c + most)
                h = mix(h * np.uint64(31) + ranged(prefix(BYTE_VALUES[data[c:d]]), np.array([0]), np.array([d - c])))
            out[i] = h[0]
        else:
            out[i:j] = ranged(prefix(BYTE_VALUES[data[a:b]]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def window_hashes(vals: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all windows of k values (len - k + 1 of them)."""
    n = vals.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        h = prefix(vals[a : b + k - 1])
        _, inv = powers(h.size)
        out[a:b] = mix((h[k:] - h[:-k]) * inv[: b - a] + np.uint64(k))
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: x.size - w + 1], out[w - have : w - have + x.size - w + 1])
    return out[: x.size - w + 1]


def sequences(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if counts.size else 0) - np.repeat(ends - counts, counts)


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in a range [start, start + length)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d[:-1]) > 0


def pack(x: np.ndarray | bytes, level: int = 1) -> bytes:
    """zstd with the length in front."""
    b = x if isinstance(x, bytes) else x.tobytes()
    return len(b).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(b, asbytes=True)


def unpack(b: bytes, dtype=None):
    raw = pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    return raw if dtype is None else np.frombuffer(raw, dtype)
