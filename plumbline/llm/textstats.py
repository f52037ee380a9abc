"""Vectorised document statistics for the quality operators."""

from __future__ import annotations

import numpy as np

from . import kernels as K

FEATURES = ["log_words", "upper", "symbols", "marks", "digits", "pipes", "distinct", "same_as_last", "word_len", "long_words", "short_words", "new_lines", "again5", "other"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_OTHER = np.zeros(256, bool)
_OTHER[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_OTHER &= ~_SYMBOL & ~_MARK
_OTHER[[ord(c) for c in ".,"]] = False


def count_by(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(mask.size + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def repeated_windows(h: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place) of every window of k words found twice or more in its document, and windows per document."""
    n = np.diff(wo)
    count = np.maximum(0, n - k + 1)
    doc = np.repeat(np.arange(n.size), count)
    at = np.repeat(wo[:-1], count) + K.sequences(count)
    keys = K.window_hashes(h, k)[at] if at.size else np.zeros(0, np.uint64)
    order = np.lexsort((keys, doc))
    a, d = keys[order], doc[order]
    same = np.zeros(a.size + 1, bool)
    same[1:-1] = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
    twice = order[same[1:] | same[:-1]] if a.size else order
    return doc[twice], at[twice], count


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document."""
    s, e, wo = K.split_words(data, offs, K.word_table("space"))
    h = K.hash_spans(data, s, e)
    n, size = np.diff(wo), np.maximum(1, np.diff(offs))
    w = np.maximum(1, n)
    doc = np.repeat(np.arange(n.size), n)
    order = np.lexsort((h, doc))
    a, d = h[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])] if a.size else np.zeros(0, bool)
    distinct = np.bincount(d[new], minlength=n.size)
    last = np.zeros(h.size, bool)
    last[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    twice, _, windows = repeated_windows(h, wo, 5)
    upper = _UPPER[data]
    lead = np.r_[0, data[:-1]] if data.size else data
    upper |= (lead == 0xC3) & (data >= 0x80) & (data <= 0x9E)
    lens = e - s
    by = lambda m: count_by(m, offs) / size
    return np.stack([
        np.log1p(n), by(upper), by(_SYMBOL[data]), by(_MARK[data]), by(_DIGIT[data]), by(data == 0x7C), distinct / w, count_by(last, wo) / w,
        np.bincount(doc, weights=lens, minlength=n.size) / w, count_by(lens > 24, wo) / w, count_by(lens <= 3, wo) / w, by(data == 0x0A), np.bincount(twice, minlength=n.size) / np.maximum(1, windows), by(_OTHER[data]),
    ], 1)
