import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.components import components
from plumbline.llm.op10_jaccard_join import jaccard_join, prefix_keys

from .common import SCHEMA, awkward, frame, words


def sets(rows, k=5):
    out = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t) if t else t)
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def classes(s, threshold):
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            c = len(s[a] & s[b])
            if c and 100 * c >= threshold * (len(s[a]) + len(s[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in ids}


@pytest.mark.parametrize("seed,threshold,rare,block", [(1, 75, 64, 1 << 20), (2, 75, 1, 60), (3, 50, 2, 200), (4, 90, 0, 1 << 20), (5, 75, 0, 10)])
def test_against_brute_force(spark, seed, threshold, rare, block):
    r = random.Random(seed)
    rows = [x[:2] for x in awkward(seed, 70)]
    base = " ".join(r.choices("abcdefghijklmnop", k=120)).split()
    for i in range(60):  # one group of near copies, at and beside the threshold
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = r.choice("QRS")
        rows.append((1000 + i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join(frame(spark, rows, "doc_id long, text string"), threshold=threshold, rare=rare, block_tokens=block).collect()}
    assert got == classes(sets(rows), threshold)


def test_prefixes_meet():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        universe = rng.choice(1 << 40, 400, replace=False).astype(np.uint64)
        df = dict(zip(universe.tolist(), rng.integers(2, 9, 400).tolist()))
        a = rng.choice(universe, n, replace=False)
        b = a[rng.random(n) > rng.random() * 0.25]
        b = np.unique(np.concatenate([b, rng.choice(universe, int(rng.integers(0, n // 5 + 1)))]))
        c = np.intersect1d(a, b).size
        if c and 100 * c >= 75 * (a.size + b.size - c):
            for rare in (0, 3, 9):
                ka, kb = (prefix_keys(x, np.array([df[t] for t in x.tolist()], np.uint16), x.size, 75, rare) for x in (a, b))
                assert np.intersect1d(ka, kb).size


def test_components(spark):
    r = random.Random(5)
    e = [(i, i + 1) for i in range(200, 240)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)] + [(500, x) for x in range(400, 460)] + [(7, 7)]
    root = {x: x for p in e for x in p}
    for _ in root:
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.label for x in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in e)}


def test_empty_repeated_and_clashing(spark):
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    df = frame(spark, [(4, "a b"), (4, "a b"), (3, "A B"), (2, None), (1, " ")], "doc_id long, text string", 2)
    for c in ("rep", "label", "comp", "d1", "toks", "live"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted(tuple(x) for x in jaccard_join(df).collect()) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3)]
