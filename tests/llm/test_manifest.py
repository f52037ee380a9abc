import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm.op12_manifest import folded, manifest, proof_text, sql

from .common import SCHEMA, awkward, frame


def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(xs, arity):
    """Root, and the siblings (left, right) level by level of each."""
    proofs, at = [[] for _ in xs], list(range(len(xs)))
    while len(xs) > 1:
        for p, i in zip(proofs, at):
            run = xs[i // arity * arity : i // arity * arity + arity]
            p.append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        xs, at = [digest(*xs[i : i + arity]) for i in range(0, len(xs), arity)], [i // arity for i in at]
    return xs[0], proofs


def brute(rows, arity=2):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    subs = {x: tree([y[2] for y in groups[x]], arity) for x in order}
    root, ups = tree([subs[x][0] for x in order], arity) if order else (None, [])
    out = []
    for x, up in zip(order, ups):
        for (_, _, own, r), p in zip(groups[x], subs[x][1]):
            acc = own
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                acc = leaf((*r[:3], r[3] + 1, r[4]))
            for a, b in p + up:
                acc = digest(a, acc, b)
            out.append((r[0], own, subs[x][0], root, digest(*(a + b for a, b in p + up)), acc, acc == root))
    return sorted(out, key=str)


def got(df, **kw):
    m = manifest(df, F.expr("crc32(string(doc_id)) % 7 = 0"), **kw)
    return sorted((tuple(r) for r in m.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256), "folded_root", "verified").collect()), key=str)


def as_fields(rows):
    return [(d, s, g, n, t) for d, t, g, s, n in rows]


ROWS = awkward(3, 50) + [(None, "x", None, "s", 1), (None, "y", None, None, None), (7, "again", "en", "s0", 5), (7, "again", "en", "s0", 5), (8, "lone", "zz", None, None), (9, "é" * 3_000_000, "ü", "s", 3_000_000)]


@pytest.mark.parametrize("arity,height", [(2, 8), (2, 1), (3, 2)])
def test_against_brute_force(spark, arity, height):
    assert got(frame(spark, ROWS), arity=arity, height=height) == brute(as_fields(ROWS), arity)


def test_sizes_about_powers(spark):
    for n in (1, 2, 5, 9):
        rows = [(i, f"t{i}", "en", "s", i) for i in range(n)]
        assert got(frame(spark, rows), height=2) == brute(as_fields(rows))


def test_empty_and_clashing(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    df = frame(spark, ROWS[:30])
    want = brute(as_fields(ROWS[:30]))
    for c in ("key", "pos", "m", "digest", "part", "i", "tie", "other", "leaf", "proof", "group"):
        df = df.withColumn(c, F.lit("x"))
    assert got(df) == want


def test_one_changed_field_breaks_the_fold(spark):
    df = frame(spark, [r for r in ROWS if r[0] is not None and r[0] < 40])
    m = manifest(df, F.col("doc_id") == 11)
    assert {r.doc_id for r in m.where("not verified").collect()} == {11}
    assert m.where(folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_sql():
    rows = [r for r in ROWS if r[0] != 9]
    documents = pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*rows)))))  # noqa: F841
    assert sorted(duckdb.sql(sql()).fetchall(), key=str) == brute(as_fields(rows))
