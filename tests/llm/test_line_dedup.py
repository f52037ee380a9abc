import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm.op07_line_dedup import line_dedup, near_lines

from .common import SCHEMA, frame

WIDTH = 24


def shingles(line):
    starts = [i for i, c in enumerate(line) if c not in " \t" and (i == 0 or line[i - 1] in " \t")]
    return {line[i : i + WIDTH] for i in starts}


def brute(rows, threshold=75):
    """(links between lines, all lines) by exact Jaccard."""
    lines = [((d, i), x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\f\x0b")]
    first = {}
    for at, x in sorted(lines):
        first.setdefault(x, at)
    texts = list(first)
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: shingles(x) for x in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= threshold * (len(sets[a]) + len(sets[b]) - c):
                p, q = find(a), find(b)
                if p != q:
                    root[max(p, q, key=first.get)] = min(p, q, key=first.get)
    return {at: first[find(x)] for at, x in lines}


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghé", k=r.randint(1, 8))) for _ in range(400)]
    base = [" ".join(r.choices(vocab, k=r.randint(1, 60))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t\n"), (3, "x\nx\n\nx y\n" + " ".join(r.choices(vocab, k=3000)))]
    for d in range(4, 60):
        out = []
        for _ in range(r.randint(1, 8)):
            w = r.choice(base).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
        rows.append((d, "\n".join(out)))
    return rows


def test_against_brute_force(spark):
    missed = total = 0
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute(rows)
        got = {(r.doc_id, r.line_no): (r.keep_doc, r.keep_line) for r in near_lines(frame(spark, rows, "doc_id long, text string")).collect()}
        for at, keep in want.items():
            total += at != keep
            missed += at != keep and at not in got
            if at == keep:  # nothing clean goes
                assert at not in got
    assert missed <= 0.03 * total


def test_texts(spark):
    line = " ".join(f"word{i}" for i in range(40))
    near = line.replace("word39", "other")
    rows = [(1, line + "\nalone"), (2, "start\n" + near + "\n\nend"), (3, near), (4, None)]
    df = frame(spark, rows, "doc_id long, text string", 2).withColumns({c: F.lit(c) for c in ("h", "g", "sig", "gone", "line", "line_no", "id")})
    out = {r.doc_id: r for r in line_dedup(df).collect()}
    assert {k: v.text for k, v in out.items()} == {1: line + "\nalone", 2: "start\n\nend", 3: "", 4: None}
    assert out[2].line == "line" and len(out[1]) == 9


def test_empty_and_repeated(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_lines(frame(spark, [(1, "a\nb"), (2, "")], "doc_id long, text string", 1)).count() == 0
    got = line_dedup(frame(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string", 1)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c"), (1, "a b c"), (2, "")]


def test_every_character_counts(spark):
    r = random.Random(3)
    tail = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    clean = ["https://www.example.org/archive/" + tail(60) for _ in range(30)]
    clean += ["天地玄黄宇宙洪荒日月盈昃辰宿列張寒来暑往秋収冬蔵閏余" + "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(60)) for _ in range(30)]
    clean += ["one word of old files\r" + tail(60) for _ in range(5)]
    body = tail(400)
    near = [tail(24) + body for _ in range(10)]  # other first characters, the same hundreds after them
    rows = [(i, x) for i, x in enumerate(clean + near)]
    got = {r.doc_id: r.keep_doc for r in near_lines(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {i: len(clean) for i in range(len(clean) + 1, len(rows))}


def test_crowded_bands(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=5))

    def noisy(words, k):
        w = list(words)
        for _ in range(k):
            w[r.randrange(len(w))] = word()
        return w

    opening, base = [word() for _ in range(45)], [word() for _ in range(60)]
    template = []
    for _ in range(700):  # of one opening, each with an own end and a near copy
        end = [word() for _ in range(30)]
        template += [opening + end, opening + noisy(end, 2)]
    lines = [[" ".join(w) for w in g] for g in (template, [noisy(base, r.choice([1, 2, 2, 3, 3, 4])) for _ in range(1500)])]
    for g in lines:
        r.shuffle(g)
        rows = list(enumerate(g))
        want = {at[0]: keep[0] for at, keep in brute(rows).items()}
        got = {x.doc_id for x in near_lines(frame(spark, rows, "doc_id long, text string")).collect()}
        gone = {d for d, keep in want.items() if d != keep}
        assert len(gone) > 500 and got <= gone
        assert len(gone - got) <= 0.03 * len(gone)


@pytest.mark.parametrize("share", [20, 26])
def test_templates(spark, share):
    """250 templates of three near lines each, of which half or 65 % is the same text in all: no near line is lost, none goes without cause."""
    r = random.Random(share)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(5000)]
    common, rows = r.choices(vocab, k=share), []
    for _ in range(250):
        base = common + r.choices(vocab, k=40 - share)
        for _ in range(3):
            w = list(base)
            w[share + r.randrange(40 - share)] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    gone = {at for at, keep in brute(rows).items() if at != keep}
    got = {(x.doc_id, x.line_no) for x in near_lines(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got <= gone and len(got) >= 0.98 * len(gone)
