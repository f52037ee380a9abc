import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import op11_search as S
from plumbline.llm.op11_search import cut_blocks, index, search, sql, vocabulary

from .common import SCHEMA, awkward, frame

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return [] if t is None else TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))


def brute(docs, items, k=10):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for x in set(b):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, t in items:
        scored = []
        for d, b in bags:
            m = 25 + 75 * len(b) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * b.count(x) // (1000 * b.count(x) + 8 * m)) for x in terms(t) if x in df)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(shards, items, **kw):
    return sorted(map(tuple, search(shards, items, **kw).collect()), key=str)


DOCS = [r[:2] for r in awkward(9, 90)] + [(None, "the of nobody"), (None, "the of nobody"), (500, "tie tie"), (499, "tie tie"), (499, "tie tie"), (600, "ÉCOLE école 7seven " * 40000)]
ITEMS = [("a", "the of THE x"), ("b", " ".join(t.split(" ")[0] for _, t in DOCS if t)), ("c", None), ("d", ""), ("e", "notthere!"), ("f", "tie"), ("g", "École, 7SEVEN."), ("h", "nobody"), ("i", (DOCS[30][1] or "x")[:300])]


@pytest.fixture(scope="module")
def items(spark):
    return frame(spark, ITEMS, "item_id string, text string", 2)


@pytest.mark.parametrize("chunk,known", [(6 << 20, True), (3000, True), (3000, False)])
def test_against_brute_force(spark, items, monkeypatch, chunk, known):
    monkeypatch.setattr(S.X.chunks, "__defaults__", (chunk,))
    docs = frame(spark, DOCS, "doc_id long, text string")
    shards = index(docs, vocabulary(items) if known else None)
    want = brute(DOCS, ITEMS)
    assert got(shards, items) == want
    assert got(shards, items, block_bytes=200, most=4, price=1.0) == want
    assert got(shards, items, k=3) == brute(DOCS, ITEMS, 3)


def test_blocks_are_the_best_cut():
    rng = np.random.default_rng(4)
    for most, price in ((4, 1.0), (128, 8.0), (7, 0.2)):
        sizes = rng.integers(0, 13, 9)
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        x = rng.integers(1, 60, ptr[-1])
        first = cut_blocks(x, ptr, most, price)
        for a, b in zip(ptr[:-1], ptr[1:]):
            own = [*first[(first >= a) & (first < b)].tolist(), b]
            cost = lambda c: sum((q - p) * x[p:q].max() + price * x[a:b].mean() for p, q in zip(c, c[1:]))  # noqa: E731, B023
            if b > a:
                assert own[0] == a and max(np.diff(own)) <= most
                best = math.inf
                for bits in range(1 << (b - a - 1)):
                    c = [a, *(a + i + 1 for i in range(b - a - 1) if bits >> i & 1), b]
                    if max(np.diff(c)) <= most:
                        best = min(best, cost(c))
                assert cost(own) == pytest.approx(best)


def test_blocks_are_skipped():
    rng = random.Random(6)
    n = 3000
    tf = [[1 + (rng.random() < 0.002) * 40 for _ in range(n)] for _ in range(3)]
    docs, tfs = np.tile(np.arange(n, dtype=np.int32), 3), np.array(tf, np.int32).ravel()
    words = np.array([5, 6, 7], np.uint64)
    lens = np.full(n, 50, np.int64)

    def made(price):
        return S.Shard(words.view(np.int64), [n] * 3, docs.tobytes(), tfs.tobytes(), np.arange(n).tobytes(), lens.tobytes(), words, n, 50 * n, 32, price)

    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = made(8.0)
    score, ids = s.search(np.arange(3), np.array([9, 4, 2]), none, 10)
    total = (s.impact.reshape(3, n) * np.array([9, 4, 2])[:, None]).sum(0)
    want = np.lexsort((np.arange(n), -total))[:10]
    assert ids.tolist() == want.tolist() and score.tolist() == total[want].tolist()
    assert s.scored < 0.3 * docs.size
    # once better ones are known, the shard is passed over
    before = s.scored
    assert s.search(np.arange(3), np.array([9, 4, 2]), (np.full(10, 10**12), np.arange(10)), 10)[0].min() == 10**12 and s.scored == before


def test_empty_and_clashing(spark, items):
    none = spark.createDataFrame([], SCHEMA)
    assert got(index(none, vocabulary(items)), items) == []
    assert got(index(frame(spark, DOCS[:20], "doc_id long, text string")), items.limit(0)) == []
    df, few = frame(spark, DOCS, "doc_id long, text string"), items
    for c in ("id", "terms", "score", "rank", "q", "item", "shard"):
        df, few = df.withColumn(c, F.lit("x")), few.withColumn(c, F.lit("x"))
    assert got(index(df, vocabulary(few)), few) == brute(DOCS, ITEMS)


def test_sql():
    documents = pa.table(dict(zip(("doc_id", "text"), map(list, zip(*(d for d in DOCS if d[0] is not None))))))  # noqa: F841
    benchmark = pa.table(dict(zip(("item_id", "text"), map(list, zip(*ITEMS)))))  # noqa: F841
    assert sorted(duckdb.sql(sql()).fetchall(), key=str) == brute([d for d in DOCS if d[0] is not None], ITEMS)
