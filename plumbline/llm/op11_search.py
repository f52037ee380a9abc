"""Operator 11, exact ranked lexical search with variable block-max indexes.

1. *Index.* A shard is some megabytes of documents; its row in the index table holds, for each term, the documents that hold it
   and how often, and the documents' ids and lengths. Counts over the whole corpus (documents, terms, documents of a term) are
   sums over these rows.
2. *Blocks.* A posting's score but for the term's weight is its impact. Dynamic programming cuts every list where the bound
   error, the sum of block maximum less impact, plus a price a block is least (``cut_blocks``, all lists of a shard abreast).
3. *Search.* Where no block of a query's terms begins or ends, the sum of their maxima bounds all scores. Such intervals are
   taken from the highest bound down; only blocks that reach into them are scored; those whose bound is below the k-th best score so
   far are skipped. That score goes on to the next shard of the task, and may be tied, so nothing is lost.

Given a vocabulary, postings of other terms are not kept: all documents are indexed and counted, for the terms that are
asked for. It travels as a bitmap of fixed size; what it lets through too much is dropped by the join on the term. Queries
go to the workers in blocks of ``block_bytes`` of text; each block is one pass over the index, never over the texts. The
best of a task leave it, and a window with a limit a partition takes the best of all.

A term is a run of letters, digits and bytes from 0x80, A-Z lower-cased, told apart by 64 bits of a hash. Null and empty
texts have no terms and are not counted. Equal rows are ranked each; a null id stays null and loses ties. Equal items count once;
items of one id with other texts are answered each. A very long text is a shard by itself. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.store import written

from . import exchange as X
from . import kernels as K

_SHARD = "shard long, n_docs long, n_terms long, terms array<long>, counts array<int>, docs binary, tfs binary, ids binary, lens binary"
_BITS = 24


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and where each document's begin."""
    data = K.lower_ascii(data)
    s, e, wo = K.split_words(data, offs, K.word_table("alnum"))
    return K.hash_spans(data, s, e), wo


def vocabulary(items: DataFrame, text_col: str = "text") -> np.ndarray:
    """A bitmap of 2**24 bits with those of the items' terms set."""

    def slots(batches):
        for b in batches:
            h, _ = terms_of(*K.text_buffer(b.column(0)))
            at = np.unique(h >> np.uint64(64 - _BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).view(pa.int64())], names=["word", "bits"])

    X.settle(items.sparkSession)
    words = items.selectExpr(f"cast(`{text_col}` as string)").mapInArrow(slots, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << _BITS - 6, np.uint64)
    for r in words.toLocalIterator():
        out[r.word] = np.uint64(r.bits & (1 << 64) - 1)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def index(docs: DataFrame, only: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index table, a row for each shard."""
    X.settle(docs.sparkSession)
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(np.packbits(only))

    def run(batches):
        keep = None if sent is None else np.unpackbits(sent.value).astype(bool)
        for c, t in X.chunks(batches, "text"):
            h, wo = terms_of(*K.text_buffer(t.column("text")))
            n = np.diff(wo)
            doc = np.repeat(np.arange(n.size), n)
            if keep is not None:
                own = keep[h >> np.uint64(64 - _BITS)]
                h, doc = h[own], doc[own]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if h.size else np.zeros(0, np.int64)
            tf = np.diff(np.r_[first, h.size]).astype(np.int32)
            h, doc = h[first], doc[first]
            there, local = np.unique(doc, return_inverse=True)
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if h.size else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, h.size]).astype(np.int32)
            ids = X.ids_of(t.column("id"))[there]
            cols = [[c], [int((n > 0).sum())], [int(n.sum())], [h[new].view(np.int64)], [count], [local.astype(np.int32).tobytes()], [tf.tobytes()], [ids.tobytes()], [n[there].tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["shard", "n_docs", "n_terms", "terms", "counts", "docs", "tfs", "ids", "lens"])

    src = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
    return written(src.mapInArrow(run, _SHARD))


def cut_blocks(impact: np.ndarray, ptr: np.ndarray, most: int = 128, price: float = 8.0) -> np.ndarray:
    """First postings of the blocks of all lists [ptr[i], ptr[i + 1]): of all ways to cut a list into blocks of up to ``most``
    postings, the one with the least sum of block length * maximum + price * the list's mean impact a block."""
    size = np.diff(ptr)
    lists = np.argsort(-size, kind="stable")
    lists = lists[size[lists] > 0]
    if not lists.size:
        return np.zeros(0, np.int64)
    start, length = ptr[lists], size[lists]
    x = impact.astype(np.float64)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    fee = price * (sums[ptr[lists + 1]] - sums[start]) / length
    best = np.zeros(lists.size)
    came = np.zeros(impact.size, np.int32)  # the length of the last block of the best cut that ends here
    base = np.full((lists.size, most), np.inf)
    high = np.zeros((lists.size, most))
    began = np.zeros(most, np.int64)
    for i in range(int(length[0])):
        n = int(np.searchsorted(-length, -i, "left"))  # lists longer than i
        now = x[start[:n] + i]
        slot = i % most
        base[:n, slot], high[:n, slot], began[slot] = best[:n], now, i
        top = np.maximum(high[:n], now[:, None], out=high[:n])
        cost = base[:n] + top * (i + 1 - began)
        at = np.argmin(cost, 1)
        best[:n] = cost[np.arange(n), at] + fee[:n]
        came[start[:n] + i] = i + 1 - began[at]
    out = []
    end = start + length
    while start.size:  # back from the ends
        end = end - came[end - 1]
        out.append(end)
        more = end > start
        start, end = start[more], end[more]
    return np.sort(np.concatenate(out))


class Shard:
    """A shard's postings with impacts and blocks, for the terms that the queries ask for."""

    def __init__(self, terms, counts, docs, tfs, ids, lens, wanted: np.ndarray, n_docs: int, n_terms: int, most: int, price: float):
        terms = np.asarray(terms, np.int64).view(np.uint64)
        counts = np.asarray(counts, np.int64)
        docs, tfs = np.frombuffer(docs, np.int32), np.frombuffer(tfs, np.int32).astype(np.int64)
        own = np.isin(terms, wanted)
        post = np.repeat(own, counts)
        self.terms, self.docs, tfs = terms[own], docs[post].astype(np.int64), tfs[post]
        self.ptr = np.concatenate([[0], np.cumsum(counts[own])])
        self.ids = np.frombuffer(ids, np.int64)
        m = 25 + 75 * np.frombuffer(lens, np.int64) * n_docs // n_terms
        self.impact = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[self.docs])
        self.first = cut_blocks(self.impact, self.ptr, most, price)
        self.last = np.r_[self.first[1:], self.docs.size] - 1 if self.first.size else self.first
        self.bound = np.maximum.reduceat(self.impact, self.first) if self.first.size else self.impact
        self.blocks = np.searchsorted(self.first, self.ptr)
        self.scored = 0  # postings looked at

    def search(self, at: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of those so far and this shard's, for a query of terms (places in self.terms) with weights."""
        score, ids = best
        least = max(1, int(score[-1])) if score.size == k else 1
        count = self.blocks[at + 1] - self.blocks[at]
        b = np.repeat(self.blocks[at], count) + K.sequences(count)
        w = np.repeat(weight, count)
        lo, hi, bound = self.docs[self.first[b]], self.docs[self.last[b]] + 1, self.bound[b] * w
        edge = np.concatenate([lo, hi])
        order = np.argsort(edge, kind="stable")
        edge, sums = edge[order], np.cumsum(np.concatenate([bound, -bound])[order])
        ends = np.r_[edge[1:] != edge[:-1], True]
        edge, sums = edge[ends], sums[ends]  # [edge[i], edge[i + 1]) has no higher score than sums[i]
        wide = np.diff(edge)
        left = np.flatnonzero(sums[:-1] >= least)
        left = left[np.argsort(-sums[left], kind="stable")]
        step = 4 * k
        while left.size:
            n = int(np.searchsorted(np.cumsum(wide[left]), step)) + 1
            now, left = left[:n], left[n:]
            inside = K.covered(self.ids.size, edge[now], wide[now])
            reach = np.concatenate([[0], np.cumsum(inside)])
            hit = reach[hi] > reach[lo]
            size = self.last[b[hit]] + 1 - self.first[b[hit]]
            post = np.repeat(self.first[b[hit]], size) + K.sequences(size)
            self.scored += post.size
            mine = inside[self.docs[post]]
            total = np.zeros(self.ids.size, np.int64)
            np.add.at(total, self.docs[post[mine]], (self.impact[post] * np.repeat(w[hit], size))[mine])
            good = np.flatnonzero(total >= least)
            score, ids = np.concatenate([score, total[good]]), np.concatenate([ids, self.ids[good]])
            order = np.lexsort((ids, -score))[:k]
            score, ids = score[order], ids[order]
            if score.size == k:
                least = max(1, int(score[-1]))
                left = left[sums[left] >= least]
            step *= 4
        return score, ids


def weight_of(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_blocks(items: DataFrame, block_bytes: int):
    """(ids, texts) block by block; one is on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        if ids and size + len(r.text) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield ids, texts


def search(shards: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 10, most: int = 128, price: float = 8.0, block_bytes: int = 4 << 20) -> DataFrame:
    """item (of the type of item_col), rank, doc_id, score: the k best documents of the index for every item."""
    spark = shards.sparkSession
    kind = items.select(item_col).schema[0].dataType
    kept = f"item {kind.simpleString()}, rank int, doc_id long, score long"
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = shards.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("df"))
    df = written(df)
    asked = items.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    out = None
    for ids, texts in _item_blocks(asked, block_bytes):
        h, wo = terms_of(*K.text_buffer(pa.array(texts, pa.string())))
        words, inv = np.unique(h, return_inverse=True)
        there = df.join(spark.createDataFrame(pa.table({"terms": words.view(np.int64)})), "terms").toArrow()
        weight = np.zeros(words.size, np.int64)
        at = np.searchsorted(words, there["terms"].to_numpy().view(np.uint64))
        weight[at] = [weight_of(x, n_docs) for x in there["df"].to_pylist()]
        queries = []
        for a, b in zip(wo[:-1], wo[1:]):
            t, c = np.unique(inv[a:b], return_counts=True)
            queries.append((t[weight[t] > 0], (c * weight[t])[weight[t] > 0]))
        sent = spark.sparkContext.broadcast((words, queries))

        def run(batches, sent=sent):
            words, queries = sent.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
            for b in batches:
                for row in zip(*(b.column(c) for c in ("terms", "counts", "docs", "tfs", "ids", "lens"))):
                    t, c, *blobs = row
                    s = Shard(t.values.to_numpy(), c.values.to_numpy(), *(x.as_py() for x in blobs), words, n_docs, n_terms, most, price)
                    place = np.full(words.size, -1)
                    place[np.searchsorted(words, s.terms)] = np.arange(s.terms.size)
                    for q, (t, w) in enumerate(queries):
                        own = place[t] >= 0
                        if own.any():
                            best[q] = s.search(place[t[own]], w[own], best[q], k)
            n = [x.size for x, _ in best]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n).astype(np.int32)), pa.array(np.concatenate([x for _, x in best])), pa.array(np.concatenate([x for x, _ in best]))], names=["q", "doc_id", "score"])

        found = shards.select("terms", "counts", "docs", "tfs", "ids", "lens").mapInArrow(run, "q int, doc_id long, score long")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(ids)), pa.int32()), "item": pa.array(ids, pa.string())}))
        found = found.join(names, "q").select(F.col("item").cast(kind).alias("item"), "rank", F.nullif("doc_id", F.lit(X.NO_ID).cast("long")).alias("doc_id"), "score")
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], kept) if out is None else out


def sql() -> str:
    """The registered query in DuckDB."""
    terms = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms("text")} AS ts FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS big_n, sum(len(ts))::bigint AS big_l FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({terms("text")}) AS term FROM benchmark) GROUP BY 1, 2),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) SEMI JOIN q USING (term) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM p, st GROUP BY term),
m AS (SELECT r, doc_id, 25 + (75 * len(ts) * big_n) // big_l AS m FROM d, st WHERE len(ts) > 0),
s AS (SELECT item_id, doc_id, r, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10"""
