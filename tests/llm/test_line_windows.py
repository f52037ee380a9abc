import random

import pytest

from plumbline.llm.op07_line_dedup import near_lines
from plumbline.llm.queries import queries

from . import test_line_dedup as words
from .common import frame

WIDTH = 24


def windows(line):
    return {line[i : i + WIDTH] for i in range(max(1, len(line) - WIDTH + 1))}


def test_query_looks_at_every_position(spark, tmp_path):
    """Two lines whose many characters in few words are the same, and whose few characters in many words aren't."""
    r = random.Random(5)
    word = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    same = " ".join(word(20) for _ in range(40))
    a, b = (same + " " + " ".join(word(2) for _ in range(30)) for _ in range(2))
    x, y = windows(a), windows(b)
    assert 100 * len(x & y) >= 75 * len(x | y) and 100 * len(words.shingles(a) & words.shingles(b)) < 75 * len(words.shingles(a) | words.shingles(b))
    frame(spark, [(1, a), (2, "other\n" + b), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {q.doc_id: q.removed_lines for q in queries()["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [1], 3: []}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_position_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(words, "shingles", windows)
    rows = words.corpus(seed)
    base = "\U0001f600" + "天地玄黄 宇宙洪荒\U0001f601" * 3 + "".join(random.Random(seed).choices("abcdé  \U0001f602", k=300))
    rows += [(100, base), (101, base[:-1] + "x"), (102, "x" + base), (103, base[:150] + "?" * 150), (104, "short"), (105, "short\nshort ")]
    want = words.brute(rows)
    got = {(r.doc_id, r.line_no): (r.keep_doc, r.keep_line) for r in near_lines(frame(spark, rows, "doc_id long, text string"), every=True).collect()}
    gone = {at for at, keep in want.items() if at != keep}
    assert set(got) <= gone and len(gone - set(got)) <= 0.03 * len(gone)
    assert {(101, 0), (102, 0), (105, 0)} <= set(got) and not {(103, 0), (105, 1)} & set(got)
