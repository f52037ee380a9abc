import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.op05_packing import Encoder, default_tokenizer, first_fit, pack_documents

from .common import SCHEMA, awkward, frame


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_ids_equal_the_tokenizers():
    texts = ["It's  DON'T\tnaïve x y <|endoftext|> a<|startoftext|>b", "Ｆｕｌｌ é ́x İI ΑΣ ", "日本語 한국어 \x00 \x1c x\x85y", "", "a" * 3000]
    enc = Encoder(open(default_tokenizer(), encoding="utf-8").read(), most=3)
    for _ in range(3):  # also when words are known, and when the memory is dropped
        raw = [x.encode() for x in texts]
        ids, o = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == [x[:-1] for x in ids_of(texts)]


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300):
        sizes = sorted(rng.integers(1, 2049, n).tolist(), reverse=True)
        rooms, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(rooms) if r >= s), len(rooms))
            if k == len(rooms):
                rooms.append(2048)
            rooms[k] -= s
            want.append(k)
        assert first_fit(sizes, 2048) == want


@pytest.mark.parametrize("group,length", [(8192, 2048), (10, 64)])
def test_round_trip(spark, group, length):
    rows = awkward(2)
    got = pack_documents(frame(spark, rows), length=length, group_pieces=group).toPandas()
    want = dict(zip([r[0] for r in rows], ids_of([r[1] for r in rows])))
    for d, g in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in g.ids])
        assert ids.tolist() == want[d] and (g.doc_tokens == len(want[d])).all()
        assert g.start.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist()
        assert [zlib.crc32(x) for x in g.ids] == g.ids_crc32.tolist()
    assert set(got.doc_id) == set(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist() and g.length.sum() <= length
    if group > 100:
        assert got.sequence_id.nunique() * length < 1.1 * got.length.sum() + 2 * length


def test_empty_repeated_and_clashing(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    df = frame(spark, [(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string", 1)
    for c in ("grp", "start", "length", "ids", "sequence_id", "offset"):
        df = df.withColumn(c, F.lit("x"))
    got = pack_documents(df).toPandas()
    assert sorted(got.length) == [1, 3, 3] and sorted(got.offset) == [0, 3, 6]
