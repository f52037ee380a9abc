"""Operator 10, exact n-gram Jaccard join with token-combination prefixes; classes of linked documents.

A document's set is its distinct word shingles (``k`` words; with fewer words the whole sequence; without
words empty). Two documents link when 100 * intersection >= threshold * union.

1. Every document frequency is counted over all documents (``exchange``), in hash buckets. A document
   fewer than threshold percent of whose shingles occur elsewhere links with nothing and leaves.
2. Documents with equal sets collapse to the one with the least id.
3. Shingles are ordered by frequency, rarest first. Let a document have n of them and need at least
   o = ceil(threshold * n / 100) in common. Its prefix of n - o + c shingles shares at least c with the
   prefix of any partner. Rare shingles (frequency up to ``rare``) index the document singly. Frequent
   ones fall into c - 1 classes by hash: if no rare one is shared, then c frequent ones are, of which two
   are of one class. So combinations of two frequent shingles of one class index the document. c follows
   the size class of the pair, so that combinations grow with the prefix and not with its square; sets
   too small to share two are indexed by single shingles.
4. Documents under one key form a star around the least id, which joins them to candidate components.
5. Each candidate component is verified with whole sets: a breadth-first search counts one document's
   common shingles with all unvisited ones at once, and takes out those it reaches; copies leave at the
   first count, so no pair is listed. A component of more than ``block_tokens`` shingles is split into
   blocks (``verified``); the links found in them are united.

Nothing is capped. Nulls and texts without words give n_shingles 0 and their own class. Rows with a null id share one; a class of them alone has a null component_id. Repeated rows are one
class; rows of one id with other texts are judged each. Shingles are told apart by 48 bits of a hash, of which
collisions cost a wrong count of one in some 10**8 pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from plumbline.operators.components import components
from plumbline.operators.store import cut

_SETS = "doc_id long, n_shingles long, d1 long, d2 long, live boolean, first long, toks binary, dfs binary"
_M48 = np.uint64((1 << 48) - 1)


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted in each, and the documents' offsets."""
    data = K.lower_ascii(data)
    s, e, wo = K.split_words(data, offs, K.word_table("space"))
    h = K.hash_spans(data, s, e)
    n = np.diff(wo)
    count = np.where(n >= k, n - k + 1, 0)
    doc = np.repeat(np.arange(n.size), count)
    keys = K.window_hashes(h, k)[np.repeat(wo[:-1], count) + K.sequences(count)] if count.sum() else np.zeros(0, np.uint64)
    few = np.flatnonzero((n > 0) & (n < k))
    if few.size:
        p = K.prefix(h)
        keys = np.concatenate([keys, K.ranged(p, wo[few], wo[few + 1])])
        doc = np.concatenate([doc, few])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])] if keys.size else np.zeros(0, bool)
    return keys[new], np.searchsorted(doc[new], np.arange(n.size + 1))


def _sum_by(x: np.ndarray, o: np.ndarray) -> np.ndarray:
    c = np.zeros(x.size + 1, np.uint64)
    np.cumsum(x, dtype=np.uint64, out=c[1:])
    return c[o[1:]] - c[o[:-1]]


def counted(docs: DataFrame, k: int, threshold: int, n: int) -> DataFrame:
    """Every document with the size and digest of its set; those that may have partners with the
    shingles that occur elsewhere and their frequencies (up to 65535)."""

    def scan(batches):
        def made():
            for c, t in X.chunks(batches, "text"):
                keys, o = shingle_sets(*K.text_buffer(t.column("text")), k)
                ids = X.ids_of(t.column("id"))
                yield c, -1, X.fields(ids.tobytes(), np.diff(o).tobytes(), _sum_by(K.mix(keys), o).tobytes(), _sum_by(K.mix(keys ^ np.uint64(0xA5A5A5A5)), o).tobytes())
                doc = np.repeat(np.arange(o.size - 1, dtype=np.int64), np.diff(o))
                bucket = X.bucket_of(keys, n)
                order = np.argsort(bucket, kind="stable")
                b, first = np.unique(bucket[order], return_index=True)
                for x, i, j in zip(b.tolist(), first.tolist(), [*first[1:].tolist(), order.size]):
                    own = order[i:j]
                    yield c, x, X.fields(_six(keys[own] & _M48).tobytes(), K.pack(np.bincount(doc[own], minlength=o.size - 1).astype(np.uint32)))

        yield from X.batched(made())

    def frequencies(blobs):
        got = [X.unfields(b) for b in blobs]
        toks = [_from_six(t) for t, _ in got]
        x = np.concatenate(toks)
        order = np.argsort(x, kind="stable")
        y = x[order]
        new = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
        df = np.empty(x.size, np.uint16)
        size = np.diff(np.r_[new, x.size])
        df[order] = np.repeat(np.minimum(size, 65535).astype(np.uint16), size)
        out, at = [], 0
        for t, (_, counts) in zip(toks, got):
            own = df[at : at + t.size]
            at += t.size
            counts = K.unpack(counts, np.uint32)
            more = own > 1
            doc = np.repeat(np.arange(counts.size), counts)[more]
            out.append(X.fields(_six(t[more]).tobytes(), K.pack(own[more]), K.pack(np.bincount(doc, minlength=counts.size).astype(np.uint32))))
        return out

    def finish(c, heads, got):
        ids, size, d1, d2 = (np.frombuffer(x, np.int64) for x in X.unfields(heads[-1]))
        parts = [X.unfields(x) for _, x in got]
        counts = [K.unpack(x[2], np.uint32) for x in parts]
        toks = np.concatenate([_from_six(x[0]) for x in parts]) if parts else np.zeros(0, np.uint64)
        dfs = np.concatenate([K.unpack(x[1], np.uint16) for x in parts]) if parts else np.zeros(0, np.uint16)
        doc = np.concatenate([np.repeat(np.arange(ids.size), x) for x in counts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(doc, kind="stable")
        toks, dfs = _six(toks[order]), dfs[order].astype("<u2")
        o = np.searchsorted(doc[order], np.arange(ids.size + 1))
        live = (size > 0) & (100 * np.diff(o) >= threshold * size)
        # of equal sets in the chunk only the one of the least id goes on
        first, seen, t, d = ids.copy(), {}, [None] * ids.size, [None] * ids.size
        for i in np.argsort(ids, kind="stable").tolist():
            if live[i]:
                first[i] = seen.setdefault((d1[i], d2[i], size[i]), i)
                if first[i] == i:
                    t[i], d[i] = toks[o[i] : o[i + 1]].tobytes(), dfs[o[i] : o[i + 1]].tobytes()
                first[i] = ids[first[i]]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(d1), pa.array(d2), pa.array(live), pa.array(first), pa.array(t, pa.binary()), pa.array(d, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "live", "first", "toks", "dfs"])

    return X.by_chunk(X.by_bucket(docs.mapInArrow(scan, X.SCHEMA), n, lambda _, blobs: frequencies(blobs)), n, finish, _SETS)


def prefix_keys(toks: np.ndarray, dfs: np.ndarray, size: int, threshold: int, rare: int) -> np.ndarray:
    """Index keys of one document. toks, dfs: what occurs elsewhere; the other size - len(toks) shingles
    come first in the order and are in no other prefix."""
    order = np.lexsort((toks, dfs))
    toks, dfs = toks[order], dfs[order]
    alone, need = size - toks.size, -(-threshold * size // 100)
    # size classes: partners are at most 100 / threshold times as large
    z = int(np.log(size) / np.log(100 / threshold) + 1e-9) if threshold < 100 else size
    out = []
    most = 0
    for cls in (z, z + 1):
        largest = (100 / threshold) ** (cls + 1) if threshold < 100 else cls
        least = threshold / 100 * (100 / threshold) ** (cls - 1) if threshold < 100 else cls - 1  # any pair's overlap
        classes = min(max(2, int((100 - threshold) * largest / 400) + 1), int(least - 1e-9) - 1)
        own = toks[: max(0, size - need + max(classes, 0) + 1 - alone)]
        most = max(most, own.size)
        own = own[dfs[: own.size] > rare]
        if classes < 1:  # sets too small to be sure of two
            out.append(K.mix(own ^ np.uint64(cls + 1 << 50)))
            continue
        if own.size < 2:
            continue
        g = (K.mix(own) % np.uint64(classes)).astype(np.int64)
        by = np.lexsort((own, g))
        own, g = own[by], g[by]
        left = np.searchsorted(g, g, "right") - np.arange(g.size) - 1  # later ones of the same class
        a = np.repeat(np.arange(g.size), left)
        b = a + 1 + K.sequences(left)
        out.append(K.mix(K.mix(own[a] * np.uint64(3) + np.uint64(cls)) + own[b]))
    single = toks[:most]
    out.append(K.mix(single[dfs[: single.size] <= rare]))
    return np.concatenate(out)


def candidates(sets: DataFrame, threshold: int, rare: int, n: int) -> DataFrame:
    """Edges from each document to the least one that shares a key with it."""

    def index(batches):
        def made():
            keys, ids, size = [], [], 0
            for b in batches:
                for d, m, t, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_shingles", "toks", "dfs"))):
                    x = prefix_keys(_from_six(t), np.frombuffer(f, "<u2"), m, threshold, rare)
                    keys.append(x)
                    ids.append(np.full(x.size, d, np.int64))
                    size += x.size
                    if size > 1 << 18:
                        yield from flush(keys, ids)
                        keys, ids, size = [], [], 0
            if size:
                yield from flush(keys, ids)

        def flush(keys, ids):
            k = np.concatenate(keys)
            return X.deal(0, X.bucket_of(k, n), k, np.concatenate(ids))[1]

        yield from X.batched(made())

    def stars(batches):
        held: dict[int, list] = {}
        for _, k, x in X._loose(batches):
            held.setdefault(k, []).append(X.parts(x, np.uint64, np.int64))
        for got in held.values():
            k, d = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            new = np.r_[True, k[1:] != k[:-1]]
            first = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            e = np.unique(np.stack([first, d], 1)[first != d], axis=0)
            yield from X.batched(iter(X.deal(0, X.bucket_of(K.mix(e[:, 1].astype(np.uint64)), n), e[:, 0], e[:, 1])[1]))

    def distinct(batches):  # a document's edges from all keys meet here
        held = [np.stack(X.parts(x, np.int64, np.int64), 1) for _, _, x in X._loose(batches)]
        if held:
            e = np.unique(np.concatenate(held), axis=0)
            for i in range(0, len(e), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(e[i : i + 100_000, 0]), pa.array(e[i : i + 100_000, 1])], names=["a", "b"])

    keyed = sets.select("doc_id", "n_shingles", "toks", "dfs").mapInArrow(index, X.SCHEMA).repartitionById(n, "bucket")
    return keyed.mapInArrow(stars, X.SCHEMA).repartitionById(n, "bucket").mapInArrow(distinct, "a long, b long")


def search(ids: np.ndarray, sizes: np.ndarray, toks: list[np.ndarray], threshold: int) -> np.ndarray:
    """For each document the least id that links lead to, within these documents."""
    n = ids.size
    lens = np.array([t.size for t in toks])
    o = np.concatenate([[0], np.cumsum(lens)])
    uniq, flat = np.unique(np.concatenate(toks), return_inverse=True)

    def postings(keep):
        at = np.flatnonzero(np.repeat(keep, lens))
        f = flat[at]
        by = np.argsort(f, kind="stable")
        return np.repeat(np.arange(n), lens)[at[by]], np.concatenate([[0], np.cumsum(np.bincount(f, minlength=uniq.size))])

    waiting = np.ones(n, bool)
    post, ptr = postings(waiting)
    left = built = n
    label = ids.copy()
    for start in np.argsort(ids, kind="stable").tolist():
        if not waiting[start]:
            continue
        waiting[start] = False
        left -= 1
        stack = [start]
        while stack and left:
            x = stack.pop()
            own = flat[o[x] : o[x + 1]]
            c = ptr[own + 1] - ptr[own]
            common = np.bincount(post[np.repeat(ptr[own], c) + K.sequences(c)], minlength=n)
            near = np.flatnonzero(waiting & (common > 0) & (100 * common >= threshold * (sizes[x] + sizes - common)))
            waiting[near] = False
            label[near] = ids[start]
            left -= near.size
            stack += near.tolist()
            if left and left < built // 2:
                post, ptr = postings(waiting)
                built = left
    return label


def _searched(m: DataFrame, threshold: int, n: int) -> DataFrame:
    """Links (a, b) that connect what is connected within each (comp, i, j). m: comp, i, j, doc_id, n_shingles, toks."""

    def run(batches):
        def tested(rows):
            if len(rows) < 2:
                return
            ids = np.array([r[0] for r in rows], np.int64)
            label = search(ids, np.array([r[1] for r in rows], np.int64), [_from_six(r[2]) for r in rows], threshold)
            e = label != ids
            if e.any():
                yield pa.RecordBatch.from_arrays([pa.array(label[e]), pa.array(ids[e])], names=["a", "b"])

        now, rows = None, []
        for b in batches:
            for c, i, j, *r in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (c, i, j) != now:
                    yield from tested(rows)
                    now, rows = (c, i, j), []
                rows.append(r)
        yield from tested(rows)

    return m.select("comp", "i", "j", "doc_id", "n_shingles", "toks").repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(run, "a long, b long")


def verified(members: DataFrame, threshold: int, block_tokens: int, n: int, leaders: int = 64) -> DataFrame:
    """Links (a, b), enough to connect what is connected. members: comp, doc_id, n_shingles, toks.

    A component of one block is searched as it is. In a larger one, each block is searched together with
    some ``leaders``, which unites nearly all of a group of near copies. Then the documents that are still
    outside the component's largest class, in blocks of their own, are searched with every block; two
    documents of the largest class need no look at each other. So copies cost their number, not its square."""
    members = cut(members)
    size = members.groupBy("comp").agg(F.ceil(F.sum(F.length("toks")) / (6 * block_tokens)).cast("int").alias("blocks"), F.greatest(F.lit(1).cast("long"), (F.count(F.lit(1)) / leaders).cast("long")).alias("every"))
    m = members.join(size, "comp").withColumn("j", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).otherwise(0).cast("int"))
    lead = m.where("blocks > 1").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("every")) == 0)
    lead = lead.withColumn("own", F.col("j")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> j").drop("own")
    first = cut(_searched(m.unionByName(lead).withColumn("i", F.lit(-1)), threshold, n))
    if m.where("blocks > 1").isEmpty():
        return first
    label = components(first).withColumnRenamed("node", "doc_id")
    large = m.where("blocks > 1").join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    main = large.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("comp").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    rest = large.join(main, "comp").where("label <> main").drop("main", "label", "every")
    parts = rest.groupBy("comp").agg(F.ceil(F.sum(F.length("toks")) / (6 * block_tokens)).cast("int").alias("parts"))
    rest = rest.join(parts, "comp").withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts")).cast("int"))
    rest = rest.drop("j").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = m.where("blocks > 1").join(parts, "comp").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["comp", "i", "j", "doc_id", "n_shingles", "toks"]
    return first.unionAll(_searched(every.select(*cols).unionAll(rest.select(*cols)), threshold, n))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 75, rare: int = 64, block_tokens: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id that links lead to)."""
    n = X.settle(docs.sparkSession, docs)
    src = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
    rows = cut(counted(src, k, threshold, n))
    firsts = rows.where("toks is not null")
    key = ["d1", "d2", "n_shingles"]
    reps = firsts.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    sets = firsts.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", *key], "left_semi").select("doc_id", "n_shingles", "toks", "dfs")
    cand = components(candidates(sets, threshold, rare, n))
    members = sets.join(cand.withColumnsRenamed({"node": "doc_id", "label": "comp"}), "doc_id").select("comp", "doc_id", "n_shingles", "toks")
    links = components(verified(members, threshold, block_tokens, n))
    # copies find their class by the first of their chunk, so a key has as many rows as chunks at one join, and as a chunk at the other
    own = firsts.join(reps, key).join(links.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.groupBy("first", *key).agg(F.min(F.coalesce("label", "rep")).alias("class"))
    out = rows.where("live").join(own, ["first", *key]).select("doc_id", "n_shingles", "class").unionAll(rows.where("not live").select("doc_id", "n_shingles", "doc_id"))
    null = F.lit(X.NO_ID).cast("long")
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif("class", null).alias("component_id"))
