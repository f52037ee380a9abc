"""Word bigram model with interpolated modified Kneser-Ney smoothing, each document judged without its own counts.

A document is <s> w1 .. wn </s>. c(v w) counts a pair of its language over the whole corpus, T(v) the pairs that begin with v,
n1, n2, n3(v) the different pairs that begin with v and occur once, twice and more often, N(w) the different
pairs that end with w, and N all different pairs. With all of them less what only this document contributes,

    p(w | v) = max(c(v w) - D(c), 0) / T(v) + g(v) q(w),   g(v) = (D1 n1(v) + D2 n2(v) + D3 n3(v)) / T(v),   q(w) = max(N(w), NEW) / N

and p(w | v) = q(w) where T(v) = 0. D1 to D3 follow from how many pairs of the language occur one to four times.
A word found nowhere else counts as ``NEW`` pairs. Without its own counts, invented words and random order cost a
document what they should, and copies of it elsewhere make it cheap.
"""

from __future__ import annotations

import numpy as np

NEW = 0.5
_EDGES = np.array([0x3C733E, 0x3C2F733E], np.uint64)


def tokens(h: np.ndarray, wo: np.ndarray, salt: np.ndarray, mix) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document between <s> and </s>, told apart by language (salt), and the documents' offsets in them;
    a document without words has none."""
    n = np.diff(wo)
    size = np.where(n > 0, n + 2, 0)
    o = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(o[-1]), np.uint64)
    inside = np.ones(out.size, bool)
    has = np.flatnonzero(n)
    for e, at in zip(_EDGES, (o[:-1][has], o[1:][has] - 1)):
        inside[at] = False
        out[at] = e
    out[inside] = h
    return mix(out ^ np.repeat(salt, size)), o


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0) to D(3) of each row of counts of counts n1..n4."""
    n = n.astype(float).reshape(-1, 4)
    out = np.tile(np.array([0, 0.5, 0.75, 1.0]), (len(n), 1))
    ok = (n[:, 0] > 0) & (n[:, 1] > 0)
    y = np.where(ok, n[:, 0] / np.maximum(n[:, 0] + 2 * n[:, 1], 1), 0)
    for k in (1, 2, 3):
        d = np.where(n[:, k - 1] > 0, k - (k + 1) * y * n[:, k] / np.maximum(n[:, k - 1], 1), k * 0.5)
        out[ok, k] = np.clip(d[ok], 0.05, k - 0.05)
    return out


def log_likelihoods(doc: np.ndarray, v: np.ndarray, w: np.ndarray, times: np.ndarray, count: np.ndarray, words: np.ndarray, lang: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Sum of log p over each document.

    A row for each document's different pairs: doc, v, w (indices of words), times (in the document), count (in the corpus).
    words: T, n1, n2, n3, N of each word; lang: language index of each document; langs: n1..n4, N of each language."""
    n_docs, m = lang.size, words.shape[0]
    d = discounts(langs[:, :4])[lang[doc]]
    left = count - times
    i = np.arange(doc.size)
    own = left == 0
    # what only the document contributes, by (document, word)
    kv, fv = np.unique(doc * m + v, return_inverse=True)
    kw, fw = np.unique(doc * m + w, return_inverse=True)
    total = words[v, 0] - np.bincount(fv, weights=times, minlength=kv.size)[fv]
    mass = np.zeros(doc.size)
    for k in (1, 2, 3):
        now = np.bincount(fv, weights=(np.minimum(left, 3) == k).astype(float) - (np.minimum(count, 3) == k), minlength=kv.size)[fv]
        mass += d[:, k] * (words[v, k] + now)
    ends = words[w, 4] - np.bincount(fw, weights=own, minlength=kw.size)[fw]
    kinds = np.maximum(1, langs[lang, 4] - np.bincount(doc, weights=own, minlength=n_docs))[doc]
    q = np.maximum(ends, NEW) / kinds
    t = np.maximum(total, 1)
    p = np.where(total > 0, np.maximum(left - d[i, np.minimum(left, 3)], 0) / t + mass / t * q, q)
    return np.bincount(doc, weights=times * np.log(np.maximum(p, 1e-300)), minlength=n_docs)
