"""Operator 2, substring dedup over words by relative Lempel-Ziv parsing.

The corpus is its own reference, indexed in blocks. Sending every document past every block would cost the square of the
corpus, so ``anchors`` brings each stretch of a document to the one block that can hold a match of ``window`` words of
it: stretches that no other place shares never travel, and one that recurs as a whole is one factor. In a block:

1. *Index.* A suffix array over the words of all its stretches (``suffixes``).
2. *Factors.* Each stretch is factored greedily from left to right: the longest prefix of what is left that also
   starts elsewhere in the block is the next factor, or one word if there is none (``factor``).
3. *Boundaries.* A factor of ``window`` words or more is a duplicate span. Windows that straddle the boundary
   of two factors lie in neither; each is looked up in the index, and those found widen the spans.

So a word is removed exactly if it is in a window of ``window`` consecutive words that also starts anywhere else, in
the same document or another; no occurrence is spared, and windows are judged on the input.

Nulls and texts without words have no words and nothing removed; a null id stays null; repeated rows repeat each other
whatever their ids; an empty table gives no rows; extra columns are ignored. A very long text is one chunk by itself and
is hashed block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import kernels as K
from . import suffixes as S
from .anchors import binary_array, repeated, runs

SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept binary"


def _words(data, offs):
    s, e, wo = K.split_words(data, offs, K.word_table("space"))
    return K.hash_spans(data, s, e), wo, (s, e)


def longest(words: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of ``starts`` the longest match, within its stretch, that begins at another of them."""
    sizes = np.diff(offs)
    ends = np.repeat(offs[1:], sizes)
    ranks = S.levels(words, ends, int(sizes.max(initial=1)))
    order = np.argsort(ranks[-1][starts], kind="stable")  # the suffix array
    lcp = np.zeros(starts.size + 1, np.int64)
    lcp[1:-1] = S.common(ranks, ends, starts[order[:-1]], starts[order[1:]]) if starts.size > 1 else 0
    out = np.empty(starts.size, np.int64)
    out[order] = np.maximum(lcp[1:], lcp[:-1])
    return out


def factor(match: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of all stretches: (first place, length), places counted through all of match. match: longest match
    at each place, count: places of each stretch."""
    last = np.cumsum(count)
    at, end = last - count, last
    first, length = [], []
    while at.size:
        go = at < end
        at, end = at[go], end[go]
        step = np.maximum(1, match[at])
        first.append(at)
        length.append(step)
        at = at + step
    return np.concatenate(first), np.concatenate(length)


def _resolve(window: int):
    def resolve(data: np.ndarray, offs: np.ndarray, count: np.ndarray) -> np.ndarray:
        words, wo, _ = _words(data, offs)
        starts = np.repeat(wo[:-1], count) + K.sequences(count)
        match = longest(words, wo, starts)
        first, length = factor(match, count)
        end = np.repeat(np.cumsum(count), count)  # of each place's stretch
        found = np.zeros(starts.size, bool)
        # within a long factor every window that fits it recurs
        long = length >= window
        inside = np.minimum(length[long] - window + 1, end[first[long]] - first[long])
        found[np.repeat(first[long], inside) + K.sequences(inside)] = True
        # the others straddle the boundary to the next factor, or lie in short ones
        left = np.flatnonzero(~found)
        found[left] = match[left] >= window
        return found[None, :]

    return resolve


def _finish(ids, data, offs, wo, extra, covered):
    gone, (s, e) = covered[0], extra
    kept = np.flatnonzero(~gone)
    # kept words and one space after each but a document's last
    n_kept = np.diff(np.searchsorted(kept, wo))
    lens = (e - s)[kept]
    last = np.zeros(kept.size, bool)
    last[(np.cumsum(n_kept) - 1)[n_kept > 0]] = True
    size = lens + ~last
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    src = np.zeros(data.size + 1, np.int8)
    src[s[kept]] += 1
    src[e[kept]] -= 1
    take = np.cumsum(src[:-1], dtype=np.int8).astype(bool)
    fill = np.ones(out.size, bool)
    fill[(at + lens)[~last]] = False
    out[fill] = data[take]
    c = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(kept, wo)]
    n = np.diff(wo)
    yield pa.RecordBatch.from_arrays([X.id_array(ids), pa.array(n), pa.array(n - n_kept), pa.array(runs(gone, wo)), binary_array(out.tobytes(), np.diff(c))], names=["doc_id", "n_words", "n_removed", "n_spans", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, **bounds) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_spans (maximal removed runs), kept (UTF-8)."""
    return repeated(docs, id_col, text_col, (window,), max(1, window * 2 // 7), _words, _resolve(window), _finish, SCHEMA, **bounds)
