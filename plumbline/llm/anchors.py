"""Where a passage can be repeated: stretches of documents around shared anchors.

A rolling hash over ``k`` symbols runs along each document, and the smallest in each window of ``least`` symbols (leftmost
on a tie) is its anchor. Neighbouring windows with one anchor form a stretch. Equal windows have their anchor
at the same place, so a window belongs to exactly one stretch and can recur only in stretches with the same
anchor hash. A stretch reaches ``reach`` symbols from its last window's start, or to the document's end.

1. *Counting.* Anchor and stretch hashes meet in hash buckets (``exchange``). An anchor that occurs once rules its
   stretch out. Equal stretches are repeated as a whole, however many there are, and one stands for all.
2. *Blocks.* Different stretches with a common anchor, where repeats begin or end, meet as texts in the bucket of their anchor,
   in blocks of bounded size. ``resolve``, the operator's own method, says for each of their windows
   whether it also starts elsewhere in the block.
3. *Hot anchors.* An anchor with more than ``HOT`` different stretches would make a group without a bound. The windows
   of such stretches are dealt by 64-bit keys instead, and sorted keys give the same answer.

Each occurrence is judged on the input. The text travels with its chunk, compressed, so that documents are
read once. Hash keys are 64 bits under an anchor of 64 more. Cost grows with the input only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import kernels as K

#: What counting says of a stretch: bits for repeated as a whole, sent as text, sent as window keys.
WHOLE, TEXT, KEYS = 1, 2, 4
HOT = 2048
BLOCK_BYTES = 2 << 20


def stretches(vals: np.ndarray, offs: np.ndarray, least: int, k: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash, stretch hash) of all stretches, in order; windows are
    positions in vals and never cross the documents that offs bounds."""
    w, n = least - k + 1, vals.size
    out: list[list[np.ndarray]] = [[], [], [], []]
    low = np.uint64((1 << 20) - 1)
    doc_end = offs[1:]
    for a in range(0, max(0, n - least + 1), K.BLOCK):
        b = min(n - least + 1, a + K.BLOCK)  # windows that start in [a, b)
        h = K.prefix(vals[a : min(n, b + reach - 1)])
        seen = b - a + least - 1
        _, inv = K.powers(h.size)
        kh = K.mix((h[k : seen + 1] - h[: seen + 1 - k]) * inv[: seen + 1 - k])
        at = np.arange(kh.size, dtype=np.uint64)
        pick = (K.sliding_min((kh & ~low) | at, w) & low).astype(np.int64)  # of each window
        s = np.arange(a, b)
        owner = np.searchsorted(doc_end, s, "right")
        fits = s + least <= doc_end[owner]
        new = np.empty(b - a, bool)
        new[0] = True
        new[1:] = (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        ends = np.append(first[1:], b - a)
        # windows that don't fit lie at the end of a document: cut them off
        good = np.concatenate([[0], np.cumsum(fits)])
        count = good[ends] - good[first]
        first, count = first[count > 0], count[count > 0]
        p = pick[first]
        to = np.minimum(first + count - 1 + reach, doc_end[owner[first]] - a)
        out[0].append(first + a)
        out[1].append(count)
        out[2].append(kh[p])
        out[3].append(K.mix(K.ranged(h, first, to) + (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64)))
    if not out[0]:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in out)


def consult(blobs: list[bytes], hot: int = HOT) -> list[bytes]:
    """What counting says of each stretch of a bucket."""
    got = [X.parts(b, np.uint64, np.uint64) for b in blobs]
    a, s = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
    order = np.lexsort((s, a))
    a, s = a[order], s[order]
    new_a = np.r_[True, a[1:] != a[:-1]]
    new_s = new_a | np.r_[True, s[1:] != s[:-1]]
    group, kind = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
    kinds = np.bincount(group, weights=new_s)[group]
    again = np.bincount(kind)[kind] > 1
    send = np.where(kinds > hot, KEYS, TEXT) * (new_s & (kinds > 1))
    out = np.empty(a.size, np.uint8)
    out[order] = again * WHOLE + send
    ends = np.cumsum([x.size for x, _ in got])
    return [K.pack(x) for x in np.split(out, ends[:-1])]


def sorted_keys(blobs: list[bytes]) -> list[bytes]:
    """For each key of a bucket whether it is there twice: the keys put in order, neighbours compared."""
    got = [X.parts(b, np.uint64)[0] for b in blobs]
    x = np.concatenate(got)
    order = np.argsort(x, kind="stable")
    y = x[order]
    same = np.zeros(x.size + 1, bool)
    same[1:-1] = y[1:] == y[:-1]
    out = np.empty(x.size, bool)
    out[order] = same[1:] | same[:-1]
    ends = np.cumsum([g.size for g in got])
    return [K.pack(np.packbits(g)) for g in np.split(out, ends[:-1])]


def in_blocks(blobs: list[bytes], resolve: Callable[[bytes, np.ndarray, np.ndarray], np.ndarray], lengths: int, block_bytes: int = BLOCK_BYTES) -> list[bytes]:
    """Bits of all windows of a bucket's stretches. resolve(texts, their offsets, windows of each) -> (lengths, windows) booleans."""
    anchor, count, size, text = [], [], [], []
    for b in blobs:
        a, c, s, t = X.unfields(b)
        anchor.append(np.frombuffer(a, np.uint64))
        count.append(K.unpack(c, np.int32).astype(np.int64))
        size.append(K.unpack(s, np.int32).astype(np.int64))
        text.append(K.unpack(t))
    cuts = np.cumsum([c.sum() for c in count])
    anchor, count, size, data = np.concatenate(anchor), np.concatenate(count), np.concatenate(size), np.frombuffer(b"".join(text), np.uint8)
    order = np.argsort(anchor, kind="stable")
    new = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
    bytes_to = np.cumsum(size[order])
    at, win = np.cumsum(size) - size, np.cumsum(count) - count
    out = np.zeros((lengths, int(count.sum())), bool)
    i = 0
    while i < new.size:  # groups of one anchor stay together
        base = bytes_to[new[i] - 1] if new[i] else 0
        j = max(i + 1, int(np.searchsorted(bytes_to[np.r_[new[1:], anchor.size] - 1], base + block_bytes, "right")))
        own = order[new[i] : new[j] if j < new.size else anchor.size]
        i = j
        place = np.repeat(at[own], size[own]) + K.sequences(size[own])
        offs = np.concatenate([[0], np.cumsum(size[own])])
        out[:, np.repeat(win[own], count[own]) + K.sequences(count[own])] = resolve(data[place], offs, count[own])
    return [K.pack(np.packbits(x, axis=1)) for x in np.split(out, cuts[:-1], axis=1)]


def window_keys(vals: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Keys of the windows that start at the given ascending positions."""
    out = np.empty(at.size, np.uint64)
    i = 0
    while i < at.size:
        a = int(at[i])
        j = int(np.searchsorted(at, a + K.BLOCK, "left"))
        h = K.prefix(vals[a : min(vals.size, a + K.BLOCK + length)])
        out[i:j] = K.ranged(h, at[i:j] - a, at[i:j] - a + length)
        i = j
    return out


def _order(bucket: np.ndarray) -> np.ndarray:
    return np.argsort(bucket, kind="stable")


def repeated(docs: DataFrame, id_col: str, text_col: str, lengths: tuple[int, ...], k: int, symbols: Callable, resolve: Callable, finish: Callable, schema: str, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lengths ascend. symbols(data, offs) -> (values, offsets of the documents in values, starts and ends in bytes or None if
    symbols are bytes); finish(ids, data, offs, symbol offsets, starts and ends, covered) -> RecordBatches, where
    covered[i] is the mask of the symbols in a window of lengths[i] that also starts elsewhere."""
    spark = docs.sparkSession
    n = X.settle(spark, docs)
    least, reach, kinds = lengths[0], lengths[-1], len(lengths)
    shipped = np.int32

    def scan(batches):
        def made():
            for c, t in X.chunks(batches, "text"):
                data, offs = K.text_buffer(t.column("text"))
                vals, vo, _ = symbols(data, offs)
                s0, count, anchor, span = stretches(vals, vo, least, k, reach)
                bucket = X.bucket_of(K.mix(anchor), n)  # least hashes are small numbers
                _, sent = X.deal(c, bucket, anchor, span)
                ids = X.ids_of(t.column("id"))
                yield c, -1, X.fields(K.pack(data.tobytes(), 3), K.pack(np.diff(offs)), ids.tobytes(), K.pack(np.diff(s0, prepend=0).astype(shipped)), K.pack(count.astype(shipped)), K.pack(bucket))
                yield from sent

        yield from X.batched(made())

    def look(c, heads, got):
        text, sizes, ids, s0, count, bucket = X.unfields(heads[-1])
        s0, count, bucket = np.cumsum(K.unpack(s0, shipped).astype(np.int64)), K.unpack(count, shipped).astype(np.int64), K.unpack(bucket, np.int32)
        say = np.zeros(bucket.size, np.uint8)
        if bucket.size:
            say[_order(bucket)] = np.concatenate([K.unpack(x, np.uint8) for _, x in got])
        live = say > 0
        s0, count, say, bucket = s0[live], count[live], say[live], bucket[live]
        sent: list[tuple[int, int, bytes]] = []
        kb = np.zeros(0, np.int32)
        if (say & (TEXT | KEYS)).any():
            data = np.frombuffer(K.unpack(text), np.uint8)
            offs = np.concatenate([[0], np.cumsum(K.unpack(sizes, np.int64))])
            vals, vo, se = symbols(data, offs)
            own = np.flatnonzero(say & TEXT)
            own = own[_order(bucket[own])]
            if own.size:
                a, b = s0[own], np.minimum(s0[own] + count[own] - 1 + reach, vo[np.searchsorted(vo, s0[own], "right")])
                lo, hi = (a, b) if se is None else (se[0][a], se[1][b - 1])
                place = np.repeat(lo, hi - lo) + K.sequences(hi - lo)
                body, at = data[place], np.concatenate([[0], np.cumsum(hi - lo)])
                anchor = _anchors(vals, s0[own], least, k)
                ks, f = np.unique(bucket[own], return_index=True)
                for x, i, j in zip(ks.tolist(), f.tolist(), [*f[1:].tolist(), own.size]):
                    sent.append((c, x, X.fields(anchor[i:j].tobytes(), K.pack(count[own[i:j]].astype(shipped)), K.pack((hi - lo)[i:j].astype(shipped)), K.pack(body[at[i] : at[j]].tobytes(), 3))))
            hot = np.flatnonzero(say & KEYS)
            if hot.size:
                at = np.repeat(s0[hot], count[hot]) + K.sequences(count[hot])
                end = vo[np.searchsorted(vo, at, "right")]
                keys = np.concatenate([K.mix(window_keys(vals, at[at + m <= end], m) + np.uint64(m)) for m in lengths])
                kb = X.bucket_of(keys, n)
                sent += [(x, n + y, z) for x, y, z in X.deal(c, kb, keys)[1]]
        yield from X.batched(iter([(c, -1, X.fields(text, sizes, ids, K.pack(s0), K.pack(count), K.pack(say), K.pack(bucket), K.pack(kb))), *sent]))

    def answer(bucket, blobs):
        return sorted_keys(blobs) if bucket >= n else in_blocks(blobs, resolve, kinds, block_bytes)

    def end(c, heads, got):
        text, sizes, ids, s0, count, say, bucket, kb = X.unfields(heads[-1])
        s0, count, say, bucket, kb = K.unpack(s0, np.int64), K.unpack(count, np.int64), K.unpack(say, np.uint8), K.unpack(bucket, np.int32), K.unpack(kb, np.int32)
        data = np.frombuffer(K.unpack(text), np.uint8)
        offs = np.concatenate([[0], np.cumsum(K.unpack(sizes, np.int64))])
        vals, vo, se = symbols(data, offs)
        to = vo[np.searchsorted(vo, s0, "right")] if s0.size else s0
        marks = [[np.zeros(0, np.int64)] for _ in lengths]
        bounds = [np.zeros(vals.size + 1, np.int32) for _ in lengths]
        for i, m in enumerate(lengths):
            fit = np.minimum(count, to - m - s0 + 1)
            own = ((say & WHOLE) > 0) & (fit > 0)
            np.add.at(bounds[i], s0[own], 1)
            np.add.at(bounds[i], s0[own] + fit[own] - 1 + m, -1)
        own = np.flatnonzero(say & TEXT)
        if own.size:
            own = own[_order(bucket[own])]
            at = np.repeat(s0[own], count[own]) + K.sequences(count[own])
            sizes_ = np.add.reduceat(count[own], np.unique(bucket[own], return_index=True)[1])
            bits = [np.unpackbits(K.unpack(x, np.uint8).reshape(kinds, -1), axis=1, count=m) for (b, x), m in zip([g for g in got if g[0] < n], sizes_.tolist())]
            for i, x in enumerate(np.concatenate(bits, axis=1).astype(bool)):
                marks[i].append(at[x])
        hot = np.flatnonzero(say & KEYS)
        if hot.size:
            at = np.repeat(s0[hot], count[hot]) + K.sequences(count[hot])
            doc_end = vo[np.searchsorted(vo, at, "right")]
            fit = [at[at + m <= doc_end] for m in lengths]
            yes = np.zeros(kb.size, bool)
            num = np.bincount(kb)
            yes[_order(kb)] = np.concatenate([np.unpackbits(K.unpack(x, np.uint8), count=int(num[b - n])) for b, x in got if b >= n]).astype(bool)
            for i, (f, y) in enumerate(zip(fit, np.split(yes, np.cumsum([f.size for f in fit])[:-1]))):
                marks[i].append(f[y])
        for i, m in enumerate(lengths):
            at = np.concatenate(marks[i])
            np.add.at(bounds[i], at, 1)
            np.add.at(bounds[i], at + m, -1)
        yield from finish(np.frombuffer(ids, np.int64), data, offs, vo, se, [np.cumsum(x[:-1]) > 0 for x in bounds])

    src = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
    sent = src.mapInArrow(scan, X.SCHEMA)
    asked = X.by_chunk(X.by_bucket(sent, n, lambda _, blobs: consult(blobs, hot)), n, look, X.SCHEMA)
    return X.by_chunk(X.by_bucket(asked, n, answer), n, end, schema)


def _anchors(vals: np.ndarray, s0: np.ndarray, least: int, k: int) -> np.ndarray:
    """Anchor hashes of the stretches that start at s0 (ascending in no order)."""
    out = np.empty(s0.size, np.uint64)
    w = least - k + 1
    step = max(1, (K.BLOCK // 4) // least)
    for i in range(0, s0.size, step):
        own = s0[i : i + step]
        at = (own[:, None] + np.arange(least)[None, :]).reshape(-1)
        h = K.prefix(vals[at])
        starts = (np.arange(own.size)[:, None] * least + np.arange(w)[None, :]).reshape(-1)
        _, inv = K.powers(h.size)
        kh = K.mix((h[starts + k] - h[starts]) * inv[starts]).reshape(own.size, w)
        low = np.uint64((1 << 20) - 1)
        pick = np.argmin((kh & ~low) | np.arange(w, dtype=np.uint64)[None, :], axis=1)
        out[i : i + step] = kh[np.arange(own.size), pick]
    return out


def runs(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of maximal runs of True in each document."""
    prev = np.r_[False, mask[:-1]] if mask.size else mask
    prev = prev.copy()
    prev[offs[:-1][offs[:-1] < offs[1:]]] = False
    c = np.concatenate([[0], np.cumsum(mask & ~prev)])
    return c[offs[1:]] - c[offs[:-1]]


def binary_array(data: bytes, lens: np.ndarray) -> pa.Array:
    o = np.zeros(lens.size + 1, np.int32)
    np.cumsum(lens, out=o[1:])
    return pa.Array.from_buffers(pa.binary(), lens.size, [None, pa.py_buffer(o.tobytes()), pa.py_buffer(data)])
