import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.op09_decontamination import common, decontaminate, insert, suffix_array

from .common import SCHEMA, awkward, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return [] if t is None else WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))


def brute(rows, items, window=10):
    out = {}
    for d, t in rows:
        w = split(t)
        hit, ids = set(), set()
        for i, x in items:
            x = split(x)
            n = min(window, len(x))
            keys = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in keys:
                    hit.update(range(k, k + n))
                    ids.add(i)
        out[d] = (len(w), len(hit), sorted(map(str, ids)))
    return out


@pytest.mark.parametrize("seed,block", [(1, 4 << 20), (2, 1500), (3, 1)])
def test_against_brute_force(spark, seed, block):
    rows = awkward(seed)
    texts = [r[1] for r in rows if r[1]]
    items = [(i, " ".join(texts[i * 3].split()[4:40]).upper()) for i in range(12)] + [(90, None), (91, ""), (92, "--"), (93, "naïve"), (94, "the of é"), (95, texts[5][:300]), (95, texts[5][:300])]
    got = decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == brute([r[:2] for r in rows], items)


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    doc = "x y " + " ".join(f"w{i}" for i in range(3, 27)) + " z " + " ".join(f"w{i}" for i in range(12))
    r = decontaminate(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r.longest, r.longest_at, r.n_hit) == (24, 2, 36)


def test_empty_and_clashing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    for c in ("id", "hit", "items", "longest"):
        df = df.withColumn(c, F.lit(1))
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in decontaminate(df, items).collect()) == [(1, 2, 0), (1, 2, 0), (2, 0, 0)]
    assert decontaminate(spark.createDataFrame([], SCHEMA), items.union(spark.createDataFrame([(1, "a")]))).count() == 0


def test_suffix_array_and_search():
    r = np.random.default_rng(2)
    h = r.integers(1, 4, 300).astype(np.uint64)
    text_end = np.where(np.arange(300) < 140, 140, 300)
    at = np.sort(r.choice(300, 200, replace=False))
    order = suffix_array(h, at, text_end[at], 300)
    suffix = [tuple(h[i : text_end[i]].tolist()) for i in at[order]]
    assert suffix == sorted(suffix)
    g = r.integers(0, 4, 60).astype(np.uint64)
    q, eq = np.arange(60), np.full(60, 60)
    tests = [tuple(g[i:].tolist()) for i in q]
    pos = insert(h, at[order], text_end[at[order]], g, q, eq)
    assert pos.tolist() == [sum(s < t for s in suffix) for t in tests]
    prefix = lambda s, t: next((k for k, (x, y) in enumerate(zip(s, t)) if x != y), min(len(s), len(t)))
    k = np.full(60, at[order][0])
    assert common(h, k, text_end[k], g, q, eq).tolist() == [prefix(suffix[0], t) for t in tests]


def test_ids_of_any_type_ties_and_common_preambles(spark):
    pre = " ".join(f"p{i}" for i in range(14))
    items = spark.createDataFrame([(f"b{i}", f"{pre} q{i} r{i}") for i in range(400)], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"u{i} {pre} v {pre}") for i in range(50)], "doc_id long, text string")
    want = sorted(f"b{i}" for i in range(400))
    for r in decontaminate(docs, items).collect():
        assert (r.n_hit, r["items"], r.longest, r.longest_at) == (28, want, 14, 1)
