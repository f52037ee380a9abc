"""The pipeline on a small corpus, each stage against brute force on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from plumbline.llm.op01_quality import quality

from .test_decontamination import brute as hits
from .test_jaccard_join import classes, sets
from .test_line_dedup import brute as lines
from .test_packing import ids_of
from .test_scores import corpus


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus(200)
    r = random.Random(4)
    texts = [x[1] for x in rows]
    rows = [(i, t.replace(" on", "\non") if i % 5 else t, *x) for (i, _, *x), t in zip(rows, texts)]
    rows += [(1000 + k, rows[k * 7 + 3][1], "en", "s0", 1) for k in range(10)]  # copies
    for k in range(10):  # near copies
        w = rows[k * 7 + 5][1].split(" ")
        w[r.randrange(len(w))] = "changed"
        rows.append((2000 + k, " ".join(w), "en", "s1", 1))
    item = " ".join(f"bench{i}" for i in range(14))
    rows.append((3000, rows[3][1][:200] + " " + item + " " + rows[6][1][:150], "en", "s2", 1))
    rows.append((3001, None, "en", None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "no such words at all in any of these documents here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, sf)
        before, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
        got.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
            after = {r.doc_id: r for r in out.collect()}
        if k == 0:
            kept = {r.doc_id for r in quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
            assert set(after) == kept and 0 < len(kept) < len(before)
            assert all(after[i] == before[i] for i in after)
        elif k == 1:
            keep = lines([(i, r.text) for i, r in before.items()])
            left = lambda i, t: "\n".join(x for j, x in enumerate(t.split("\n")) if keep.get((i, j), (i, j)) == (i, j))
            want = {i: r.text and left(i, r.text) for i, r in before.items()}
            same = sum(after[i].text == want[i] for i in want)
            assert set(after) == set(before) and same >= 0.98 * len(want)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.values())
        elif k == 2:
            want = {i for i, (_, c) in classes(sets([(i, r.text) for i, r in before.items()]), 75).items() if c == i}
            assert set(after) == want
        elif k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = {i for i, (_, n, _) in hits([(i, r.text) for i, r in before.items()], items).items() if not n}
            assert set(after) == want and len(want) < len(before)
        else:
            total = {r.doc_id: r.doc_tokens for r in out.collect()}
            assert total == dict(zip(before, map(len, ids_of([r.text for r in before.values()]))))
        docs = out


def test_run_is_its_stages(spark, sf):
    """run() gives the rows of the stages applied in turn, each from its predecessor's rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:4]:
        rows = stage(spark, docs, sf).collect()
        docs = spark.createDataFrame(rows, docs.schema)
    want = {r.doc_id: n for r, n in zip(docs.collect(), map(len, ids_of([r.text for r in docs.collect()])))}
    got = P.run(spark, sf).collect()
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == want and {r.doc_id: r.doc_tokens for r in got} == want
    room = {}
    for r in got:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= 2048


def test_null_repeated_and_clashing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(12)
    rows = docs.collect()
    text = rows[1].text
    more = [(None, text, "en", "s0", 1), (None, "some other words " * 30, "en", "s0", 1), (rows[1].doc_id, text, "en", "s0", 1), (9000, "", "en", "s0", 0), (9001, None, None, None, None)]
    df = spark.createDataFrame([tuple(r) for r in rows] + more, docs.schema)
    for c in ("kept_id", "gone_id", "gone_", "id_", "key", "class", "first"):
        df = df.withColumn(c, F.lit(c))
    for name, stage in P.STAGES[:4]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        got = out.collect()
        if name == "n-gram Jaccard join":
            assert sum(r.doc_id == rows[1].doc_id for r in got) == 1 and {9000, 9001} <= {r.doc_id for r in got}
        else:
            assert all(r.key == "key" for r in got)


def test_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, df, sf).count() == 0
