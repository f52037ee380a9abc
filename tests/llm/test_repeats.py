import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.op02_substring_dedup import substring_dedup
from plumbline.llm import kernels as K
from plumbline.llm.op02_substring_dedup import factor, longest
from plumbline.llm.op06_suffix_dedup import corpus_order, suffix_dedup

from .common import SCHEMA, awkward, frame, words


def removed(seqs, length):
    seen = Counter(tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length] for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        m = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length]] > 1:
                m[i : i + length] = [True] * length
        out.append(m)
    return out


def spans(m):
    return sum(b and not a for a, b in zip([False, *m], m))


@pytest.mark.parametrize("seed,length", [(1, 35), (2, 35), (3, 5), (4, 1), (5, 12)])
def test_words_against_brute_force(spark, seed, length):
    rows = awkward(seed)
    seqs = [words(r[1]) for r in rows]
    want = {r[0]: (len(s), sum(m), spans(m), b" ".join(w for w, x in zip(s, m) if not x)) for r, s, m in zip(rows, seqs, removed(seqs, length))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup(frame(spark, rows), window=length).collect()}
    assert got == want


@pytest.mark.parametrize("seed,length", [(1, 400), (2, 400), (3, 50), (4, 7), (5, 1)])
def test_bytes_against_brute_force(spark, seed, length):
    rows = [(i, t and t[:4000], *x) for i, t, *x in awkward(seed, 40)]
    seqs = [(r[1] or "").encode() for r in rows]
    want = {r[0]: (len(s), sum(m), spans(m), hashlib.sha256(bytes(w for w, x in zip(s, m) if not x)).hexdigest()) for r, s, m in zip(rows, seqs, removed(seqs, length))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in suffix_dedup(frame(spark, rows), window=length).select("*", F.sha2("kept", 256).alias("h")).collect()}
    assert got == want


@pytest.mark.parametrize("hot,block_bytes", [(1, 1 << 20), (4, 300)])
def test_hot_anchors_and_small_blocks(spark, hot, block_bytes):
    rows = awkward(7, 40)
    for op, more in ((substring_dedup, {"window": 12}), (suffix_dedup, {"window": 80, "least": 50})):
        a, b = (sorted(map(str, op(frame(spark, rows), **more, **x).collect())) for x in ({}, {"hot": hot, "block_bytes": block_bytes}))
        assert a == b


def test_repeats_across_hash_blocks_and_chunks(spark):
    """Texts longer than a kernel block (2 ** 19 symbols) and than a chunk, with repeats at the edges."""
    r = np.random.default_rng(5)
    text = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    a, b = text(700), text(500)
    edge = K.BLOCK
    long = text(edge - 350) + a + text(edge - 700 - 100) + b + text(6 << 20)
    rows = [(1, long), (2, "x" + a), (3, b + "y"), (4, text(300))]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.n_repeated) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1200, 2, 1200), 2: (700, 1, 700), 3: (500, 1, 500), 4: (0, 0, 0)}


def test_factors_are_greedy_and_longest():
    r = np.random.default_rng(1)
    words = r.integers(0, 3, 400).astype(np.uint64)
    offs = np.array([0, 90, 200, 200, 400])
    starts = np.concatenate([np.arange(a, b) for a, b in zip(offs, offs[1:])])
    ends = np.repeat(offs[1:], np.diff(offs))
    got = longest(words, offs, starts)

    def lcp(i, j):
        k = 0
        while i + k < ends[i] and j + k < ends[j] and words[i + k] == words[j + k]:
            k += 1
        return k

    assert got.tolist() == [max(lcp(i, j) for j in starts if j != i) for i in starts]
    want = []
    for a, b in zip(offs, offs[1:]):
        while a < b:
            want.append((a, max(1, got[a])))
            a += max(1, got[a])
    first, length = factor(got, np.diff(offs))
    assert sorted(zip(first.tolist(), length.tolist())) == want


@pytest.mark.parametrize("letters", [2, 26])
def test_corpus_order_is_lexicographic(letters):
    r = np.random.default_rng(letters)
    piece = r.integers(97, 97 + letters, 500, dtype=np.uint8)
    data = np.concatenate([piece, r.integers(97, 97 + letters, 700, dtype=np.uint8), piece, piece[:77], np.zeros(5, np.uint8)])
    offs = np.array([0, 600, 601, 601, data.size - 300, data.size])
    ends = np.repeat(offs[1:], np.diff(offs))
    order = corpus_order(data, offs, np.arange(data.size))
    suffix = [data[i : ends[i]].tobytes() for i in order]
    assert suffix == sorted(suffix)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_empty_and_clashing_columns(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = frame(spark, [(1, "a b " * 300), (1, "a b " * 300), (2, None)], "doc_id long, text string", 1)
    for c in ("chunk", "bucket", "blob", "id", "kept", "n_removed"):
        rows = rows.withColumn(c, F.lit(7))
    got = sorted((r.doc_id, r.n_removed) for r in op(rows).collect())
    assert [x[0] for x in got] == [1, 1, 2] and got[0][1] == got[1][1] > 0 and got[2][1] == 0
