"""Operator 9, benchmark decontamination by suffix arrays of the training text.

1. *Shards.* Each shard (some megabytes of documents) gets a suffix array over its words: the places whose first
   ``window`` words a bitmap of the benchmark does not rule out, in the lexicographic order of their suffixes by
   the hashes of words (``suffix_array``). What the bitmap rules out can hold no match, so none is lost.
2. *Search.* Every test suffix, in its own order, is looked up in it by binary search over words (``insert``). Its neighbours there
   share the longest prefix with it, and the suffixes that share ``window`` words with it lie together: their words are hit.
3. *Longest match.* A shard suffix shares most with the test suffix just before or after it, so one
   comparison with each gives its longest verbatim match.

Hits are marked by runs of the suffix array and items by the runs that they reach, so a passage that many items and many
documents share is never listed in pairs.

An item of fewer words than the window is one window of its own length. The benchmark is the stated query
set: it goes to the workers in blocks of at most ``block_bytes`` of text, one at a time on the driver, and with more than
one block the documents pass through them in turn, so no size is assumed. Nothing is shuffled.

Null texts and items have no words; an item without words never occurs; repeated rows are judged each;
repeated item ids count once; ids may be of any type and are given as strings, a null id as ''; of equally long matches the earliest in the
document is given; an empty table gives no rows; extra columns are ignored. A very long text is a shard by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import kernels as K

OUT = "doc_id long, n_words long, n_hit long, items array<string>, longest long, longest_at long"
_STATE = "id long, text string, hit binary, items array<string>, longest long, longest_at long"
_BITS = 22


def _hashed(data: np.ndarray, offs: np.ndarray):
    data = K.lower_ascii(data)
    s, e, wo = K.split_words(data, offs, K.word_table("alnum"))
    return K.hash_spans(data, s, e), wo


def suffix_array(h: np.ndarray, at: np.ndarray, ends: np.ndarray, depth: int, step: int = 10) -> np.ndarray:
    """Order of the suffixes [at, ends) by their first ``depth`` words; the end of a text is before every word."""
    order = np.arange(at.size)
    tied, group = np.arange(at.size), np.zeros(at.size, np.int64)
    done = 0
    while tied.size > 1 and done < depth:
        own = order[tied]
        cols = []
        for i in range(done, done + step):
            x = np.zeros(own.size, np.uint64)
            ok = at[own] + i < ends[own]
            x[ok] = h[at[own][ok] + i]
            cols.append(x)
        by = np.lexsort((*reversed(cols), group))
        order[tied] = own[by]
        new = np.r_[True, group[by][1:] != group[by][:-1]]
        for x in cols:
            new[1:] |= x[by][1:] != x[by][:-1]
        kind = np.cumsum(new) - 1
        more = np.bincount(kind)[kind] > 1
        tied, group = tied[more], kind[more]
        done += step
    return order


def common(h: np.ndarray, a: np.ndarray, ea: np.ndarray, g: np.ndarray, b: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """How many words the suffixes [a, ea) of h and [b, eb) of g have in common at their start."""
    room = np.minimum(ea - a, eb - b)
    out = np.zeros(a.size, np.int64)
    left, i = np.flatnonzero(room > 0), 0
    while left.size:
        left = left[h[a[left] + i] == g[b[left] + i]]
        i += 1
        out[left] = i
        left = left[room[left] > i]
    return out


def insert(h: np.ndarray, at: np.ndarray, ends: np.ndarray, g: np.ndarray, q: np.ndarray, eq: np.ndarray) -> np.ndarray:
    """For each test suffix [q, eq) of g the number of suffixes [at, ends) of h, given in order, that are less."""
    lo, hi = np.zeros(q.size, np.int64), np.full(q.size, at.size)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not open_.size:
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        a, ea, b, eb = at[mid], ends[mid], q[open_], eq[open_]
        k = common(h, a, ea, g, b, eb)
        less = (b + k < eb) & (a + k == ea)
        both = np.flatnonzero((b + k < eb) & (a + k < ea))
        less[both] = h[a[both] + k[both]] < g[b[both] + k[both]]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


class Block:
    """The suffixes of some items, by window length in lexicographic order, with the keys of their first windows."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, offs = K.text_buffer(pa.array(texts, pa.string()))
        self.words, wo = _hashed(data, offs)
        self.ids = ids
        self.by_length: dict[int, tuple] = {}
        lens = np.diff(wo)
        for n in sorted({int(min(x, window)) for x in lens if x}):
            own = np.flatnonzero(lens >= window if n == window else lens == n)
            count = lens[own] - n + 1
            at = np.repeat(wo[own], count) + K.sequences(count)
            ends, item = np.repeat(wo[own + 1], count), np.repeat(own, count)
            depth = int(lens[own].max())
            order = suffix_array(self.words, at, ends, depth)
            at = at[order]
            keys = K.window_hashes(self.words, n)[at]
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[keys >> np.uint64(64 - _BITS)] = True
            self.by_length[n] = keys, item[order], at, ends[order], depth, bitmap


def _search(block: Block, h: np.ndarray, wo: np.ndarray):
    """(hit words, [(document, class of items)], classes, longest match by word)."""
    hit, best = np.zeros(h.size, bool), np.zeros(h.size, np.int64)
    pairs, classes, number = [], [], {}
    for n, (keys, item, q, eq, depth, bitmap) in block.by_length.items():
        w = K.window_hashes(h, n)
        at = np.flatnonzero(bitmap[w >> np.uint64(64 - _BITS)])
        ends = wo[np.searchsorted(wo, at, "right")]
        fits = at + n <= ends
        at, ends = at[fits], ends[fits]
        may = np.isin(keys, w[at])
        item, q, eq = item[may], q[may], eq[may]
        if not q.size:
            continue
        order = suffix_array(h, at, ends, depth)
        at, ends = at[order], ends[order]
        pos = insert(h, at, ends, block.words, q, eq)
        # runs of suffixes with the same first n words
        key = w[at]
        new = np.r_[True, key[1:] != key[:-1]]
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        reached = np.full(q.size, -1)
        for near in (pos, pos - 1):
            ok = np.flatnonzero((near >= 0) & (near < at.size) & (reached < 0))
            ok = ok[common(h, at[near[ok]], ends[near[ok]], block.words, q[ok], eq[ok]) >= n]
            reached[ok] = run[near[ok]]
        found = reached >= 0
        is_hit = np.zeros(first.size, bool)
        is_hit[reached[found]] = True
        mine = np.flatnonzero(is_hit[run])
        hit |= K.covered(h.size, at[mine], n) if mine.size else False
        # classes: runs with the same items
        r, i = np.unique(np.stack([reached[found], item[found]], 1), axis=0).T if found.any() else (np.zeros(0, np.int64),) * 2
        cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if r.size else r
        cls = np.full(first.size, -1)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), r.size]):
            k = i[a:b].tobytes()
            if k not in number:
                number[k] = len(classes)
                classes.append(i[a:b])
            cls[r[a]] = number[k]
        doc = np.searchsorted(wo, at[mine], "right") - 1
        pairs.append(np.stack([doc, cls[run[mine]]], 1))
        # the test suffixes just before and after each suffix
        after = np.searchsorted(pos, mine, "right")
        for k in (after - 1, after):
            ok = (k >= 0) & (k < q.size)
            x, y = mine[ok], k[ok]
            size = common(h, at[x], ends[x], block.words, q[y], eq[y])
            size[size < n] = 0
            best[at[x]] = np.maximum(best[at[x]], size)
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return hit, pairs, classes, best


def _judge(block: Block, batch: pa.RecordBatch, last: bool):
    data, offs = K.text_buffer(batch.column("text"))
    names = np.array(block.ids, object)
    for i, j in K.slices(offs):
        b = batch.slice(i, j - i)
        a = offs[i]
        h, wo = _hashed(data[a : offs[j]], offs[i : j + 1] - a)
        mask, pairs, classes, best = _search(block, h, wo)
        lists: list = [()] * (j - i)
        known: dict[bytes, list] = {}
        cuts = np.searchsorted(pairs[:, 0], np.arange(j - i + 1))
        for x in np.flatnonzero(np.diff(cuts)).tolist():
            c = pairs[cuts[x] : cuts[x + 1], 1]
            if c.tobytes() not in known:
                known[c.tobytes()] = sorted(set(names[np.unique(np.concatenate([classes[k] for k in c]))].tolist()))
            lists[x] = known[c.tobytes()]
        longest, where = np.zeros(j - i, np.int64), np.full(j - i, -1, np.int64)
        at = np.flatnonzero(best)
        doc = np.searchsorted(wo, at, "right") - 1
        by = np.lexsort((-at, best[at]))
        longest[doc[by]], where[doc[by]] = best[at[by]], at[by] - wo[doc[by]]
        for x, (y, more, size_, at_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("hit", "items", "longest", "longest_at")))):
            if y is not None:
                mask[wo[x] : wo[x + 1]] |= np.unpackbits(np.frombuffer(y, np.uint8), count=int(wo[x + 1] - wo[x])).astype(bool)
                if more:
                    lists[x] = sorted({*lists[x], *more})
                if (size_, -at_) > (longest[x], -where[x]):
                    longest[x], where[x] = size_, at_
        tail = [pa.array(lists, pa.list_(pa.string())), pa.array(longest), pa.array(where)]
        if last:
            c = np.concatenate([[0], np.cumsum(mask)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(wo)), pa.array(c[wo[1:]] - c[wo[:-1]]), *tail], names=["doc_id", "n_words", "n_hit", "items", "longest", "longest_at"])
        else:
            bits = [np.packbits(mask[p:q]).tobytes() for p, q in zip(wo[:-1], wo[1:])]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(bits, pa.binary()), *tail], names=["id", "text", "hit", "items", "longest", "longest_at"])


def blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """The benchmark block by block; only one is on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in items.selectExpr(f"coalesce(cast(`{item_col}` as string), '') id", f"cast(`{text_col}` as string) text").toLocalIterator():
        if ids and size + len(r.text or "") > block_bytes:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r.id)
        texts.append(r.text)
        size += len(r.text or "")
    yield Block(ids, texts, window)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words within occurring windows), items (ids with an
    occurring window, as strings in order), longest (words of the longest verbatim match), longest_at (its first word, or -1)."""
    spark = docs.sparkSession
    X.settle(spark)
    df = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text", "cast(null as binary) hit", "cast(null as array<string>) items", "cast(null as long) longest", "cast(null as long) longest_at")
    # a broadcast block lies in the workers' files, so the driver keeps a reference to each and no content
    held = [spark.sparkContext.broadcast(x) for x in blocks(items, item_col, item_text_col, window, block_bytes)]
    for k, sent in enumerate(held):

        def run(batches, sent=sent, last=k == len(held) - 1):
            for b in batches:
                yield from _judge(sent.value, b, last)

        df = df.mapInArrow(run, OUT if k == len(held) - 1 else _STATE)
    return df
