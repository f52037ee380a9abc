import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import op13_chosen_path as C
from plumbline.llm.op13_chosen_path import near_dedup

from .common import SCHEMA, awkward, frame
from .test_jaccard_join import classes, sets


def got(df, **kw):
    rows = near_dedup(df, **kw).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def crowd(seed, n=60, words=120, most=7):
    """One group of near copies, at and beside the threshold."""
    r = random.Random(seed)
    base = r.choices("abcdefghijklmnop", k=words)
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = r.choice("QRS")
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,threshold,limit,block,depth", [(1, 85, 256, 1 << 20, 4), (2, 85, 3, 60, 2), (3, 60, 4, 200, 3), (4, 85, 1, 10, 1)])
def test_against_brute_force(spark, seed, threshold, limit, block, depth):
    rows = [x[:2] for x in awkward(seed, 70)] + crowd(seed)
    want = classes(sets(rows), threshold)
    assert got(frame(spark, rows, "doc_id long, text string"), threshold=threshold, limit=limit, block_tokens=block, depth=depth) == want


def test_trees_reach_the_recall():
    """Pairs at the threshold, followed down the branches to the last level."""
    rng = np.random.default_rng(2)
    pairs, together = 400, 0
    trees = C.trees_for(0.99, 85, 3)
    second = C._second(np.arange(trees, dtype=np.uint64), 85)
    for _ in range(pairs):
        u = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        keys = np.concatenate([np.sort(u[:185]), np.sort(u[15:])])  # 170 of 200
        v = C.least_values(keys, np.array([0, 185, 370]))
        sig = (v >> np.uint64(32)).astype(np.uint64)
        paths = [(C.K.mix(v[0, c] + np.uint64(c)),) for c in (2 * t + b for t in range(trees) for b in range(2) if b == 0 or second[t]) if v[0, c] == v[1, c]]
        for _ in range(2):
            nxt = []
            for (p,) in paths:
                for branch in range(1 + int(C._second(np.array([p]), 85)[0])):
                    q = C.K.mix(np.array([p + np.uint64(branch + 1)]))[0]
                    c = int(q % np.uint64(C.COORDINATES))
                    if sig[0, c] == sig[1, c]:
                        nxt.append((C.K.mix(np.array([q ^ sig[0, c]]))[0],))
            paths = nxt
        together += bool(paths)
    assert together / pairs > 0.97


def test_bar():
    assert C.least_equal(85) == pytest.approx(42, abs=2)
    assert 0.6 < C.meeting(85, 4) < 0.67 and C.trees_for(0.999, 85, 4) == 7


def test_large_groups_and_a_shared_passage(spark):
    """A passage at the head of all documents, many copies, two large groups of near ones: no link is lost."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    head = " ".join(word() for _ in range(30))
    rows = [(i, head + " " + " ".join(word() for _ in range(40))) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]
    for g in range(2):
        base = [word() for _ in range(150)]
        for i in range(200):
            w = list(base)
            for _ in range(r.randint(0, 1)):
                w[r.randrange(150)] = word()
            rows.append((2000 + 1000 * g + i, head + " " + " ".join(w)))
    want = classes(sets(rows), 85)
    assert got(frame(spark, rows, "doc_id long, text string"), limit=16, depth=3, block_tokens=5000) == want


def test_repeated_ids_and_nulls(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    rows = [(5, a), (5, b), (9, a), (7, b), (8, b), (8, b), (None, "x y"), (None, "z"), (None, None), (3, "z"), (4, ""), (2, "q r s")]
    df = frame(spark, rows, "doc_id long, text string", 2)
    for c in ("rep", "label", "comp", "d1", "path", "class", "lead"):
        df = df.withColumn(c, F.lit("x"))
    want = [(5, 3, 5), (5, 3, 5), (9, 3, 5), (7, 3, 5), (8, 3, 5), (8, 3, 5), (None, 1, 3), (None, 1, 3), (None, 0, None), (3, 1, 3), (4, 0, 4), (2, 1, 2)]
    assert sorted((tuple(r)[:3] for r in near_dedup(df).collect()), key=str) == sorted(want, key=str)
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    r = random.Random(1)
    w = [str(r.randrange(10**6)) for _ in range(1_200_000)]
    rows = [(2, " ".join(w)), (1, " ".join(w[:1_150_000])), (3, " ".join(w[:900_000]))]
    assert got(frame(spark, rows, "doc_id long, text string")) == {1: (1_149_996, 1), 2: (1_199_996, 1), 3: (899_996, 3)}
