"""Quality classifier, perplexity rules, licences and toxicity."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.op01_quality import quality
from plumbline.llm.op03_perplexity import quality_rules
from plumbline.llm.op04_licenses import KNOWN, license_scan
from plumbline.llm.op08_toxicity import toxicity

from .common import SCHEMA, awkward, frame, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=3):
    """Clean texts, junk of three kinds, toxic texts; with labels for all."""
    r = random.Random(seed)
    vocab = ["".join(r.choices(["th", "er", "on", "an", "re", "in"], k=r.randint(1, 4))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(30, 200))
        junk, toxic = i % 8 == 0, i % 8 == 1
        if junk:
            w = [[x.upper() + "!!" for x in w], [x for x in w[:8] for _ in range(12)], [x + "###" for x in w]][i % 3]
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vileword", "nastyword", "awfulword"])
        rows.append((i, " ".join(w), "en", f"s{i % 3}" if i < n - 3 else "rare", 0))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = corpus()
    known = [x for x in labels if x[0] % 2]  # half the labels; junk has even ids, so keep some of those
    known += [x for x in labels if x[0] % 16 == 0]
    got = {r.doc_id: r for r in quality(frame(spark, rows), spark.createDataFrame(known, LABELS)).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].kept == bool(q) for i, q, _ in labels if (i, q, _) not in known]) > 0.97


def test_sparse_sites_shrink(spark):
    rows, labels = corpus()
    got = quality(frame(spark, rows), spark.createDataFrame(labels, LABELS)).toPandas()
    mean = got.groupby(["host", "path"]).agg(m=("evidence", "mean"), s=("site", "first"), n=("site", "size"))
    off = (mean.m - got.evidence.mean()).abs()
    assert ((mean.s - got.evidence.mean()).abs() <= off + 1e-6).all()


def base(t):
    w = words(t)
    text = t or ""
    seen, dup = set(), 0
    for x in text.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    wins = {}
    for i in range(len(w) - 7):
        wins.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for v in wins.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_base_rules_against_brute_force(spark):
    rows = awkward(6) + [(900, "a b\n\na b\n \na b ", "en", "s", 0), (901, "x" * 50, None, None, None)]
    for r in quality_rules(frame(spark, rows)).collect():
        want = base(next(x[1] for x in rows if x[0] == r.doc_id))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def slow_scores(rows):
    """Log perplexities by the model's definition: all counts are taken again without the document."""
    from collections import Counter, defaultdict

    seqs = {i: (lang or "", ["<s>", *words(t), "</s>"] if words(t) else []) for i, t, lang, *_ in rows}
    all_ = defaultdict(Counter)
    for lang, s in seqs.values():
        all_[lang].update(zip(s, s[1:]))
    out = {}
    for i, (lang, s) in seqs.items():
        if not s:
            continue
        n = [sum(c == k for c in all_[lang].values()) for k in (1, 2, 3, 4)]
        d = [0, 0.5, 0.75, 1.0]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2, 0.05), k - 0.05) for k in (1, 2, 3)]
        rest = +Counter({k: c for k, c in (all_[lang] - Counter(zip(s, s[1:]))).items()})
        starts, ends = defaultdict(list), Counter()
        for (v, w), c in rest.items():
            starts[v].append(c)
            ends[w] += 1
        total = 0.0
        for v, w in zip(s, s[1:]):
            q = max(ends[w], 0.5) / max(1, len(rest))
            c, row = rest[v, w], starts[v]
            total += np.log(max(c - d[min(c, 3)], 0) / sum(row) + sum(d[min(x, 3)] for x in row) / sum(row) * q if row else q)
        out[i] = -total / (len(s) - 1)
    return out


def test_model_and_verdicts_against_definition(spark):
    rows = awkward(2)
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows), below=1.0, above=1.5, spread=0.5).collect()}
    want = slow_scores(rows)
    for i, x in want.items():
        assert np.log(got[i].perplexity) == pytest.approx(x, rel=1e-9)
    by = {}
    for r in got.values():
        if not r.base_failed:
            by.setdefault(r.lang, []).append(want[r.doc_id])
    rejected = 0
    for r in got.values():
        if not r.base_failed:
            v = sorted(by[r.lang])
            low, mid, high = (v[max(0, int(np.ceil(p * len(v))) - 1)] for p in (0.25, 0.5, 0.75))
            off, dev, room = want[r.doc_id] - mid, (high - low) / 2, 0.5 / np.sqrt(r.n_words + 1)
            assert r.kept == (-dev - room <= off <= 1.5 * dev + room)
            rejected += not r.kept
    assert rejected


def test_chunks_and_buckets_change_nothing(spark):
    rows = awkward(4)
    a = {r.doc_id: r.perplexity for r in quality_rules(frame(spark, rows)).collect()}
    b = {r.doc_id: r.perplexity for r in quality_rules(frame(spark, rows, parts=9)).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_chunks_do_not_depend_on_batches(monkeypatch):
    import pyarrow as pa

    from plumbline.llm import exchange as X

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(X.TaskContext, "get", staticmethod(Task))
    r = np.random.default_rng(3)
    texts = [None if n == 0 else "x" * (n - 1) for n in r.integers(0, 9, 400).tolist()]
    seen = set()
    for step in (1, 7, 64, 400):
        b = (pa.RecordBatch.from_arrays([pa.array(texts[i : i + step], pa.string())], names=["text"]) for i in range(0, 400, step))
        seen.add(tuple((c, t.num_rows) for c, t in X.chunks(b, "text", 40)))
    assert len(seen) == 1


def test_bands_keep_clean_and_reject_noise(spark):
    rows, labels = corpus()
    noise = "".join(random.Random(1).choices("qzxjk#@{}^~", k=900))
    rows.append((9000, " ".join(noise[i : i + 7] for i in range(0, 900, 7)), "en", "s0", 0))
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows)).collect()}
    assert not got[9000].base_failed and not got[9000].kept
    assert np.mean([got[i].kept for i, q, _ in labels if q]) > 0.98


def test_licenses(spark):
    mit = dict(KNOWN)["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\n" + mit.upper()), (2, mit + " more"), (3, "LICENSED under CC-BY-NC 4.0"), (4, "Released under the MIT Licence!"), (5, None), (6, "")]
    df = frame(spark, rows, "doc_id long, text string", 1).withColumns({"digest": F.lit(1), "license_id": F.lit(2)})
    got = {r.doc_id: r.license_id for r in license_scan(df).collect()}
    assert got == {1: "MIT", 2: None, 3: "CC-BY-NC-4.0-notice", 4: "MIT-notice", 5: None, 6: None}


def test_installed_license_texts(spark):
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = [n for n in names if os.path.exists(f"{folder}/{n}")]
    if not there:
        pytest.skip("no licence texts here")
    rows = [(k, "(c) 2020 x\n" + " ".join(open(f"{folder}/{n}").read().upper().split(" "))) for k, n in enumerate(there)]
    got = {r.doc_id: r.license_id for r in license_scan(frame(spark, rows, "doc_id long, text string", 1)).collect()}
    assert got == {k: names[n] for k, n in enumerate(there)}


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    known = [x for x in labels if x[0] % 3]
    got = {r.doc_id: r for r in toxicity(frame(spark, rows), spark.createDataFrame(known, LABELS)).collect()}
    held = [(i, t) for i, _, t in labels if i % 3 == 0]
    assert all(got[i].toxic == bool(t) for i, t in held)
    severe = [got[i].expected_severity for i, t in held if t]
    assert min(severe) > max(got[i].expected_severity for i, t in held if not t)
    assert all(r.grade in range(4) and 0 <= r.expected_severity <= 3 for r in got.values())


@pytest.mark.parametrize("op", [lambda s, d: quality(d, s.createDataFrame([], LABELS)), lambda s, d: toxicity(d, s.createDataFrame([], LABELS)), lambda s, d: quality_rules(d), lambda s, d: license_scan(d)])
def test_empty_null_and_clashing(spark, op):
    assert op(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    df = frame(spark, [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a " * 5000, "en", "s", 0)], parts=1)
    for c in ("evidence", "host", "path", "id", "x", "p_toxic", "n_words", "mid", "dev", "digest", "y"):
        df = df.withColumn(c, F.lit("z"))
    assert sorted(r.doc_id for r in op(spark, df).collect()) == [1, 2, 2, 3]


def test_base_counts_by_slices():
    """Counts are the same however few documents are looked at at once, and a slice's memory is small."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from plumbline.llm import kernels as K
    from plumbline.llm.op03_perplexity import base_counts

    texts = ["a b c d e f g h\n" * 3, "", "x # é\nx # é\n\n", None, "one two", " \n\t"] * 5
    data, offs = K.text_buffer(pa.array(texts, pa.string()))
    for most in (1, 40):
        assert all((a == b).all() for a, b in zip(base_counts(data, offs), base_counts(data, offs, most=most)))
    data, offs = K.text_buffer(pa.array(["some words of a text, again and again\n" * 25] * 4000))
    tracemalloc.start()
    base_counts(data, offs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * data.size and np.diff(offs).max() < 1000


def test_totals_are_not_sent_by_the_buckets(spark, monkeypatch):
    """The pairs' counts go straight to the chunks that score: what is sent to the buckets holds no more than that a chunk is there."""
    from plumbline.llm import op03_perplexity as O

    sent, by_bucket = [], O.X.by_bucket
    monkeypatch.setattr(O.X, "by_bucket", lambda df, *a: sent.append(df) or by_bucket(df, *a))
    assert quality_rules(frame(spark, awkward(4))).count() == len(awkward(4))
    assert len(sent) == 2 and all(r.bucket >= 0 or not r.n for df in sent for r in df.selectExpr("bucket", "length(blob) n").collect())
