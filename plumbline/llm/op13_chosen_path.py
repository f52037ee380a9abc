"""Operator 13, MinHash near-dedup by a chosen-path similarity join; classes of linked documents.

A document's set is its distinct word shingles (``k`` words; with fewer words the whole sequence; without words empty).
Two documents link when 100 * intersection >= threshold * union.

1. *Sets.* One scan gives each document its set's size, a digest of 128 bits and the least values of ``COORDINATES`` hash
   functions. Documents with equal sets collapse to the least id, first in their chunk, then in all.
2. *Chosen paths.* In every tree a set goes from the root down by its least token under a hash function that the node names,
   and with the chance that makes 1 / threshold branches a node on average by a second one. A pair at the threshold stays together in
   one branch a node on average. Nodes of one set end, small ones (``limit``) are compared exhaustively, larger ones branch again.
3. *Small nodes.* Nodes with the same sets, from any tree, count once. All pairs of a node are compared by sizes and by how many least
   values are equal; the bar loses one pair in 10,000 at the threshold. A spanning forest of what passes leaves the node.
4. *What stays large* after ``depth`` levels, a group of true copies, is not compared here but goes on whole, as a star.
5. *Confirmation.* Candidate components are searched with full sets (``verified`` of operator 10: blocks of bounded size, a document's
   common shingles with all unvisited ones at once), which finds every link within them, whether its pair met in a tree or not.

``recall`` of a single pair at the threshold, down to the last level, sets the number of trees; pairs that are nearer, in small nodes, or
linked through others are missed far less often. There is no cap on nodes, partners or depth of confirmation. Rows that
share an id, or have none, are one document: links of any of them count for all. A null id stays null. Nulls and texts without words give
n_shingles 0 and their own class. Equal rows are one class. Very long texts are a chunk by themselves. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.components import components
from plumbline.operators.store import written

from . import exchange as X
from . import kernels as K
from .op10_jaccard_join import _six, _sum_by, shingle_sets, verified

COORDINATES = 64
_ROWS = "doc_id long, n_shingles long, d1 long, d2 long, first long, lead boolean, roots binary, sig binary"
_KEY = ["d1", "d2", "n_shingles"]
_rng = np.random.Generator(np.random.PCG64(13))
_SEEDS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def meeting(threshold: int, depth: int) -> float:
    """The chance that a pair at the threshold is together in some node of a tree's last level."""
    j, second, p = threshold / 100, 100 / threshold - 1, 1.0
    for _ in range(depth):
        p = 1 - (1 - j * p) * (1 - second * j * p)
    return p


def trees_for(recall: float, threshold: int, depth: int) -> int:
    p = meeting(threshold, depth)
    return 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))


def least_equal(threshold: int, missed: float = 1e-4) -> int:
    """How many coordinates must be equal, so that of pairs at the threshold this share is missed."""
    j, total = threshold / 100, 0.0
    for c in range(COORDINATES + 1):
        total += math.comb(COORDINATES, c) * j**c * (1 - j) ** (COORDINATES - c)
        if total > missed:
            return c
    return COORDINATES


def _digests(keys: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sum_by(K.mix(keys), o).view(np.int64), _sum_by(K.mix(keys ^ np.uint64(0xA5A5A5A5)), o).view(np.int64)


def least_values(keys: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Of each non-empty set the least value under every hash function."""
    at = o[:-1][np.diff(o) > 0]
    out = np.empty((at.size, COORDINATES), np.uint64)
    for c in range(COORDINATES if at.size else 0):
        out[:, c] = np.minimum.reduceat((keys ^ _SEEDS[c]) * _FACTORS[c], at)
    return out


def _firsts(ids: np.ndarray, n: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the least id with the same set, which rows are that one)."""
    order = np.lexsort((ids, n, d2, d1))
    a, b, c = d1[order], d2[order], n[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])] if ids.size else np.zeros(0, bool)
    first = np.empty(ids.size, np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first, first == np.arange(ids.size)


def scanned(src: DataFrame, k: int, roots: int) -> DataFrame:
    """Every document with size and digest of its set; the first of equal ones in a chunk with its least values."""

    def run(batches):
        for _, t in X.chunks(batches, "text"):
            keys, o = shingle_sets(*K.text_buffer(t.column("text")), k)
            ids, n = X.ids_of(t.column("id")), np.diff(o)
            d1, d2 = _digests(keys, o)
            first, lead = _firsts(ids, n, d1, d2)
            lead &= n > 0
            own = np.repeat(lead, n)
            least = least_values(keys[own], np.concatenate([[0], np.cumsum(n[lead])]))
            a, b = [None] * ids.size, [None] * ids.size
            for i, row in zip(np.flatnonzero(lead).tolist(), least):
                a[i], b[i] = row[:roots].tobytes(), (row >> np.uint64(32)).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(d1), pa.array(d2), pa.array(ids[first]), pa.array(lead), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "first", "lead", "roots", "sig"])

    return written(src.mapInArrow(run, _ROWS))


def _second(path: np.ndarray, threshold: int) -> np.ndarray:
    """Whether a node has a second branch."""
    return (K.mix(path ^ np.uint64(0x5EED)) >> np.uint64(11)).astype(np.float64) / 2.0**53 < 100 / threshold - 1


def roots_of(sets: DataFrame, trees: int, threshold: int) -> DataFrame:
    """(path, d1): the first nodes of all trees."""
    two = _second(np.arange(trees, dtype=np.uint64), threshold)
    used = np.flatnonzero(np.stack([np.ones(trees, bool), two], 1).ravel())

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(len(b), -1)[:, used]
            path = K.mix(x + used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), used.size))], names=["path", "d1"])

    return sets.select("d1", "roots").mapInArrow(run, "path long, d1 long")


def branched(large: DataFrame, threshold: int) -> DataFrame:
    """(path, d1) of the next level. large: path, d1, sig."""

    def run(batches):
        for b in batches:
            path, d1 = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(len(b), -1)
            for branch in (0, 1):
                on = np.ones(path.size, bool) if branch == 0 else _second(path, threshold)
                p = K.mix(path[on] + np.uint64(branch + 1))
                c = (p % np.uint64(COORDINATES)).astype(np.int64)
                token = sig[on][np.arange(c.size), c].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(K.mix(p ^ K.mix(token + np.uint64(1))).view(np.int64)), pa.array(d1[on])], names=["path", "d1"])

    return large.select("path", "d1", "sig").mapInArrow(run, "path long, d1 long")


def forest(n: np.ndarray, sig: np.ndarray, threshold: int, bar: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected by pairs that may be near."""
    todo, out = np.ones(n.size, bool), []
    while todo.any():
        stack = [int(np.argmax(todo))]
        todo[stack[0]] = False
        while stack:
            i = stack.pop()
            may = np.flatnonzero(todo & (100 * np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i])))
            near = may[(sig[may] == sig[i]).sum(1) >= bar]
            todo[near] = False
            out += [(i, j) for j in near.tolist()]
            stack += near.tolist()
    return out


def compared(nodes: DataFrame, sets: DataFrame, threshold: int, parts: int) -> DataFrame:
    """(a, b) by d1: edges of small nodes. nodes: members."""
    bar = least_equal(threshold)

    def run(batches):
        def tested(d, n, s):
            d, n = np.array(d, np.int64), np.array(n, np.int64)
            e = forest(n, np.frombuffer(b"".join(s), "<u4").reshape(d.size, -1), threshold, bar)
            return d[[i for i, _ in e]], d[[j for _, j in e]]

        now, held = None, ([], [], [])
        for b in batches:
            a, c = [], []
            for node, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if node != now:
                    if len(held[0]) > 1:
                        x, y = tested(*held)
                        a.append(x)
                        c.append(y)
                    now, held = node, ([], [], [])
                for h, x in zip(held, row):
                    h.append(x)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "b"])
        if len(held[0]) > 1:
            x, y = tested(*held)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    each = nodes.select(F.xxhash64("members").alias("node"), F.explode("members").alias("d1"))
    each = each.join(sets.select("d1", "n_shingles", "sig"), "d1").select("node", "d1", "n_shingles", "sig")
    return each.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def candidates(sets: DataFrame, trees: int, depth: int, limit: int, threshold: int, parts: int) -> DataFrame:
    """(a, b) by d1: edges between sets that may be near. sets: d1, n_shingles, roots, sig."""
    active, nodes, edges = roots_of(sets, trees, threshold), [], []
    for level in range(1, depth + 1):
        active = written(active)
        size = active.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        sized = written(active.join(size, "path"))
        nodes.append(sized.where(F.col("c") <= limit).groupBy("path").agg(F.array_sort(F.collect_set("d1")).alias("members")).select("members"))
        large = sized.where(F.col("c") > limit)
        if large.isEmpty():
            break
        if level == depth:
            hub = large.groupBy("path").agg(F.min("d1").alias("a"))
            edges.append(large.join(hub, "path").select("a", F.col("d1").alias("b")).where("a <> b").distinct())
        else:
            active = branched(large.join(sets.select("d1", "sig"), "d1"), threshold)
    every = nodes[0]
    for x in nodes[1:]:
        every = every.unionAll(x)
    out = compared(every.distinct(), sets, threshold, parts)
    for e in edges:
        out = out.unionAll(e)
    return out


def token_sets(src: DataFrame, k: int) -> DataFrame:
    """(doc_id, d1, d2, n_shingles, toks) of the first of equal sets in each chunk."""

    def run(batches):
        for _, t in X.chunks(batches, "text"):
            keys, o = shingle_sets(*K.text_buffer(t.column("text")), k)
            ids, n = X.ids_of(t.column("id")), np.diff(o)
            d1, d2 = _digests(keys, o)
            _, lead = _firsts(ids, n, d1, d2)
            own = np.flatnonzero(lead & (n > 0))
            keys &= np.uint64((1 << 48) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(d1[own]), pa.array(d2[own]), pa.array(n[own]), pa.array([_six(keys[o[i] : o[i + 1]]).tobytes() for i in own.tolist()], pa.binary())], names=["doc_id", *_KEY, "toks"])

    return src.mapInArrow(run, "doc_id long, d1 long, d2 long, n_shingles long, toks binary")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 85, recall: float = 0.999, depth: int = 4, limit: int = 256, block_tokens: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id that links lead to), kept (it is that one)."""
    n = X.settle(docs.sparkSession, docs)
    trees = trees_for(recall, threshold, depth)
    if 2 * trees > COORDINATES:
        raise ValueError("more trees than hash functions: lower recall or depth")
    src = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
    rows = scanned(src, k, 2 * trees)
    leads = rows.where("lead")
    sets = written(leads.groupBy(*_KEY).agg(F.min("doc_id").alias("rep"), F.first("roots").alias("roots"), F.first("sig").alias("sig")))
    comp = components(candidates(sets.select("d1", "n_shingles", "roots", "sig"), trees, depth, limit, threshold, n))
    named = sets.select(F.col("rep").alias("doc_id"), *_KEY).join(comp.select(F.col("node").alias("d1"), F.col("label").alias("comp")), "d1")
    members = token_sets(src, k).join(named, ["doc_id", *_KEY]).select("comp", "doc_id", "n_shingles", "toks")
    links = verified(members, threshold, block_tokens, n)
    # an id with several sets is one document
    mixed = rows.where("n_shingles > 0").groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("doc_id")
    reps = sets.select("rep", *_KEY)
    same = rows.join(mixed, "doc_id", "left_semi").select("doc_id", *_KEY).distinct().join(reps, _KEY).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    label = components(links.unionAll(same))
    own = leads.select("first", *_KEY).join(reps, _KEY).join(label.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.groupBy("first", *_KEY).agg(F.min(F.coalesce("label", "rep")).alias("class"))
    out = rows.where("n_shingles > 0").join(own, ["first", *_KEY]).select("doc_id", "n_shingles", "class").unionAll(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    null = F.lit(X.NO_ID).cast("long")
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif("class", null).alias("component_id"), (F.col("doc_id") == F.col("class")).alias("kept"))
