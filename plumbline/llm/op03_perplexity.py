"""Operator 3, quality rules with perplexity bands of a word bigram model counted over the whole corpus.

Base rules count words, symbols, repeated lines and repeated 8-word windows of each whole text. The model
(``wordlm``) is modified Kneser-Ney over the words of each language. Its table grows with the corpus, so it is never in one place:

1. *Pairs.* Each chunk of documents counts its different word pairs and sends their hashes, sorted and as differences, to
   hash buckets (``exchange``). A bucket sums them in one sorted array, and answers each chunk with the pairs' counts in the
   corpus; the first chunk that has a pair accounts for it below.
2. *Words.* Each chunk sends what it knows of its words: pairs that begin with the word, how many of these occur once,
   twice, more often, and how many different ones end with it. A word's bucket adds up and answers with the sums. A
   language is one more key, with its counts of counts.
3. *Scores.* With both answers a chunk holds all that the model says of its documents, and scores each without its
   own counts.

The texts meet the answers twice, each time in the partition of the scan that asked: the scan runs again and is zipped with the
answers, so that no text is shuffled or written. If the documents' plan has a shuffle, which could deal the rows out otherwise the next
time, they are written once before.

A language's bands lie around its median log perplexity: ``below`` and ``above`` times half its interquartile
range, and ``spread`` / sqrt(words) for short texts. A document outside them, or that fails the base
rules, is not kept. Null texts have no words and fail; a null language is a language; repeated rows are
counted and judged each; an empty table gives no rows; extra columns are ignored. A very long text is a chunk by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.store import cut, written

from . import exchange as X
from . import kernels as K
from . import wordlm as W
from .textstats import _SYMBOL, count_by, repeated_windows

_ROWS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, log_ppl double"
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_CHUNK = 7 << 19
_PIECES = 16


def base_counts(data: np.ndarray, offs: np.ndarray, window: int = 8, most: int = 1 << 19) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document; ``most`` bytes of documents at a time."""
    each = [_base_counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window) for i, j in K.slices(offs, most)]
    return [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*each)] if each else [np.zeros(0, np.int64)] * 5


def _base_counts(data: np.ndarray, offs: np.ndarray, window: int) -> list[np.ndarray]:
    table = K.word_table("space")
    s, e, wo = K.split_words(data, offs, table)
    first = (data & 0xC0) != 0x80
    chars = count_by(table[data] & first, offs)
    ls, le, lo = K.split_words(data, offs, _LINE)
    c = np.concatenate([[0], np.cumsum(table[data])])
    h = K.hash_spans(data, ls, le)
    doc = np.repeat(np.arange(offs.size - 1), np.diff(lo))
    has = c[le] > c[ls]
    h, doc = h[has], doc[has]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if h.size else np.zeros(0, bool)
    _, at, _ = repeated_windows(K.hash_spans(data, s, e), wo, window)
    again = K.covered(s.size, at, window) if s.size else np.zeros(0, bool)
    return [np.diff(wo), chars, count_by(_SYMBOL[data], offs), np.bincount(doc[same], minlength=offs.size - 1), count_by(again, wo)]


def _planes(x: np.ndarray) -> bytes:
    """Integers as planes of their bytes, so that high bytes of zero cost nothing."""
    return K.pack(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(K.unpack(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def _apart(x: np.ndarray) -> bytes:
    """As ``_planes``, but each plane by itself: low bytes of keys are noise, and high ones are coded better without them."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = np.flatnonzero(planes.any(1)).max(initial=0) + 1
    return X.fields(*(K.pack(p) for p in planes[:used]))


def _unapart(b: bytes) -> np.ndarray:
    planes = [K.unpack(p, np.uint8) for p in X.unfields(b)]
    out = np.zeros((planes[0].size, 8), np.uint8)
    for k, p in enumerate(planes):
        out[:, k] = p
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _counts(x: np.ndarray) -> bytes:
    """Counts from 1 on, most of them 1: a bit for each, and those of 2 and more."""
    return X.fields(len(x).to_bytes(8, "little"), K.pack(np.packbits(x > 1)), _planes(x[x > 1] - 2))


def _uncounts(b: bytes) -> np.ndarray:
    n, more, rest = X.unfields(b)
    out = np.unpackbits(K.unpack(more, np.uint8), count=int.from_bytes(n, "little")).astype(np.int64) + 1
    out[out > 1] += _unplanes(rest)
    return out


def _columns(cols: list[np.ndarray]) -> list[bytes]:
    """Five columns of words, each in the order of those before it, and the last less the three before: rare words leave little."""
    rest = cols[4] - cols[1] - cols[2] - cols[3]
    cols = [*cols[:4], rest << 1 ^ rest >> 63]
    return [_planes(x[np.lexsort(cols[:k][::-1])] if k else x) for k, x in enumerate(cols)]


def _uncolumns(blobs: list[bytes]) -> list[np.ndarray]:
    cols = []
    for b in blobs:
        x = _unplanes(b)
        if cols:
            back = np.empty_like(x)
            back[np.lexsort(cols[::-1])] = x
            x = back
        cols.append(x)
    rest = cols[4] >> 1 ^ -(cols[4] & 1)
    return [*cols[:4], rest + cols[1] + cols[2] + cols[3]]


def _lang_keys(langs: list[str]) -> np.ndarray:
    data, offs = K.text_buffer(pa.array(langs, pa.string()))
    return K.mix(np.concatenate([K.hash_spans(data[a:b], np.array([0]), np.array([b - a])) if b > a else np.ones(1, np.uint64) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])) if langs else np.zeros(0, np.uint64)


class Chunk:
    """Word pairs of a chunk's documents. A pair's key has ``bits`` bits."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lang: list[str], bits: int):
        names, self.lang = np.unique(np.array(lang, dtype=object), return_inverse=True) if lang else (np.zeros(0, object), np.zeros(0, np.int64))
        self.lang_keys = _lang_keys(names.tolist())
        s, e, wo = K.split_words(data, offs, K.word_table("space"))
        t, o = W.tokens(K.hash_spans(data, s, e), wo, self.lang_keys[self.lang] if lang else np.zeros(0, np.uint64), K.mix)
        self.words, index = np.unique(t, return_inverse=True)
        index = index.astype(np.int32)
        del s, e
        inner = np.ones(t.size, bool)
        inner[o[1:][np.diff(o) > 0] - 1] = False
        at = np.flatnonzero(inner)
        key = K.mix(t[at] * np.uint64(3) + K.mix(t[at + 1])) >> np.uint64(64 - bits) if at.size else np.zeros(0, np.uint64)
        del t, inner
        self.keys, first, pair = np.unique(key, return_index=True, return_inverse=True)
        self.count = np.bincount(pair, minlength=self.keys.size)
        self.v, self.w = index[at[first]], index[at[first] + 1]
        self._of_token, self._doc_of_token = pair.astype(np.int32), (np.searchsorted(o, at, "right") - 1).astype(np.int32)
        self.pair_lang = np.zeros(self.keys.size, np.int64)
        self.pair_lang[pair] = self.lang[self._doc_of_token]
        self.n_tokens = np.maximum(np.diff(o) - 1, 0)


    def by_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of each document's different pairs."""
        n = max(1, self.keys.size)
        both, times = np.unique(self._doc_of_token.astype(np.int64) * n + self._of_token, return_counts=True)
        return *np.divmod(both, n), times


def _deal(chunk: int, keys: np.ndarray, bits: int, n: int, *columns: np.ndarray):
    """Rows for the buckets of ascending keys, which are cut where the bucket changes."""
    bucket = X.bucket_of(keys << np.uint64(64 - bits), n)
    ids, first = np.unique(bucket, return_index=True)
    for b, i, j in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), keys.size]):
        yield chunk, b, X.fields(_apart(np.diff(keys[i:j], prepend=np.uint64(0))), *(_columns([c[i:j] for c in columns]) if len(columns) > 1 else [_counts(columns[0][i:j])]))


def _add_up(blobs: list[bytes]) -> list[bytes]:
    """Of pairs: twice their count in the rest of the corpus, and 1 more for the first chunk that has it."""
    got = [X.unfields(b) for b in blobs]
    keys = [np.cumsum(_unapart(k), dtype=np.uint64) for k, _ in got]
    own = np.concatenate([_uncounts(c) for _, c in got])
    x = np.concatenate(keys)
    order = np.argsort(x, kind="stable")
    new = np.r_[True, x[order][1:] != x[order][:-1]]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=own[order]).astype(np.int64)
    out = np.empty(x.size, np.int64)
    out[order] = 2 * (total[group] - own[order]) + new
    return [_planes(y) for y in np.split(out, np.cumsum([k.size for k in keys])[:-1])]


def _sums(blobs: list[bytes]) -> list[bytes]:
    """Of words and languages: the sums of all columns."""
    got = [X.unfields(b) for b in blobs]
    keys = [np.cumsum(_unapart(g[0]), dtype=np.uint64) for g in got]
    told = [np.concatenate(c) for c in zip(*(_uncolumns(g[1:]) for g in got))]
    _, group = np.unique(np.concatenate(keys), return_inverse=True)
    cols = [np.bincount(group, weights=c).astype(np.int64)[group] for c in told]
    cuts = np.cumsum([k.size for k in keys])[:-1]
    return [X.fields(*_columns(row)) for row in zip(*(np.split(c, cuts) for c in cols))]


def _knowledge(c: Chunk, answer: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ascending keys of the chunk's words and languages, and five columns of what it adds to each."""
    total, mine = (answer >> 1) + c.count, (answer & 1) > 0
    m, k = c.words.size, c.lang_keys.size
    by = lambda at, n, which, weights=None: np.bincount(at[which], weights=None if weights is None else weights[which], minlength=n).astype(np.int64)
    every = np.ones(total.size, bool)
    cols = [by(c.v, m, every, c.count), *(by(c.v, m, mine & (np.minimum(total, 3) == x)) for x in (1, 2, 3)), by(c.w, m, mine)]
    of_lang = [*(by(c.pair_lang, k, mine & (total == x)) for x in (1, 2, 3, 4)), by(c.pair_lang, k, mine)]
    keys = np.concatenate([c.words, c.lang_keys])
    order = np.argsort(keys, kind="stable")
    return order, [keys[order], *(np.concatenate([a, b])[order] for a, b in zip(cols, of_lang))]


def _pieces(chunk: int, blob: bytes):
    """A chunk's bytes as ``_PIECES`` rows, so that rows stay small and every chunk has as many on each side of a zip."""
    size = -(-len(blob) // _PIECES)
    for k in range(_PIECES):
        yield chunk, k, blob[k * size : (k + 1) * size]


def scored(src: DataFrame, n: int, bits: int) -> DataFrame:
    """Base counts and log perplexity of each document of (id, lang, text)."""
    spark = src.sparkSession
    parts = src.rdd.getNumPartitions()
    if not parts or src.isEmpty():
        return spark.createDataFrame([], _ROWS)

    def pairs(batches):
        def made():
            for c, t in X.chunks(batches, "text", _CHUNK):
                x = Chunk(*K.text_buffer(t.column("text")), t.column("lang").to_pylist(), bits)
                yield c, -1, b""  # every chunk is there, without words too
                yield from _deal(c, x.keys, bits, n, x.count)
                del x, t
                X.release()

        yield from X.batched(made())

    def texts(rows):
        """The scan's rows in the same chunks again, as pieces; plain rows, so that a task needs one Python worker less."""

        def batches():
            held, size = [], 0
            for r in rows:
                held.append(r)
                size += len(r[2] or "")
                if size > 1 << 20:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

        def batch(held):
            i, x, t = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(x, pa.string()), pa.array(t, pa.string())], names=["id", "lang", "text"])

        for c, t in X.chunks(batches(), "text", _CHUNK):
            data, offs = K.text_buffer(t.column("text"))
            head = pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), t.column("lang").combine_chunks()], names=["id", "lang"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            blob = X.fields(K.pack(data.tobytes()), K.pack(np.diff(offs)), sink.getvalue().to_pybytes())
            del t, data, offs, head, sink
            yield from _pieces(c, blob)
            X.release()

    def gathered(answers: DataFrame):
        """The answers back in the partitions of the scan that asked, in its order of chunks."""

        def run(rows):
            now, got = None, []
            for c, k, x in rows:
                if c != now and now is not None:
                    yield from _pieces(now, X.fields(*got))
                    got = []
                    X.release()
                now = c
                if k != -1:
                    got.append(bytes(x))
            if now is not None:
                yield from _pieces(now, X.fields(*got))

        return answers.repartitionById(parts, F.shiftright("chunk", 24).cast("int")).sortWithinPartitions("chunk", "bucket").rdd.mapPartitions(run)

    def opened(text: bytes):
        text, sizes, head = X.unfields(text)
        data, offs = np.frombuffer(K.unpack(text), np.uint8), np.concatenate([[0], np.cumsum(K.unpack(sizes, np.int64))])
        head = pa.ipc.open_stream(head).read_next_batch()
        return data, offs, head, Chunk(data, offs, head.column(1).to_pylist(), bits)

    def chunks(rows):
        """(chunk, its text, its answers) of zipped pieces."""
        held = []
        for (c, _, t), (d, _, x) in rows:
            if c != d:
                raise RuntimeError("the scan dealt its rows out otherwise the second time")
            held.append((t, x))
            if len(held) == _PIECES:
                yield c, b"".join(t for t, _ in held), X.unfields(b"".join(x for _, x in held))
                held = []

    def look(rows):
        for c, t, got in chunks(rows):
            *_, x = opened(t)
            answer = np.concatenate([np.zeros(0, np.int64), *map(_unplanes, got)])
            _, (keys, *cols) = _knowledge(x, answer)
            yield c, -1, b""
            del x, t, got, answer
            yield from _deal(c, keys >> np.uint64(64 - bits), bits, n, *cols)
            del keys, cols
            X.release()

    def totals(rows):
        """The pairs' counts again, for the scores; straight to their chunks, with no text beside them."""
        got = []
        for c, _, x in rows:
            got.append(x)
            if len(got) == _PIECES:
                answer = np.concatenate([np.zeros(0, np.int64), *map(_unplanes, X.unfields(b"".join(got)))])
                yield c, -2, _planes(answer >> 1)
                del answer
                got = []
                X.release()

    def end(rows):
        for _, t, (total, *got) in chunks(rows):
            data, offs, head, x = opened(t)
            total = _unplanes(total) + x.count
            order = np.argsort(np.concatenate([x.words, x.lang_keys]), kind="stable")
            known = np.empty((order.size, 5), np.int64)
            known[order] = np.stack([np.concatenate(col) for col in zip(*(_uncolumns(X.unfields(b)) for b in got))], 1) if got else 0
            words, langs = known[: x.words.size], known[x.words.size :]
            doc, pair, times = x.by_document()
            score = W.log_likelihoods(doc, x.v[pair], x.w[pair], times, total[pair], words, x.lang, langs)
            ppl = np.where(x.n_tokens > 0, -score / np.maximum(x.n_tokens, 1), 0.0)
            del t, got, known, words, langs, doc, pair, times, total
            X.release()
            yield from zip(head.column(0).to_pylist(), head.column(1).to_pylist(), *(v.tolist() for v in base_counts(data, offs)), x.n_tokens.tolist(), ppl.tolist())

    text = src.rdd.mapPartitions(texts)
    counts = gathered(X.by_bucket(src.mapInArrow(pairs, X.SCHEMA), n, lambda _, b: _add_up(b)))
    asked = spark.createDataFrame(text.zip(counts).mapPartitions(look), X.SCHEMA, verifySchema=False)
    kept = spark.createDataFrame(counts.mapPartitions(totals), X.SCHEMA, verifySchema=False)
    sums = gathered(X.by_bucket(asked, n, lambda _, b: _sums(b)).unionAll(kept))
    return spark.createDataFrame(text.zip(sums).mapPartitions(end), _ROWS, verifySchema=False)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 10.0, above: float = 3.0, spread: float = 2.0) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, perplexity (per word), lang."""
    n = X.settle(docs.sparkSession, docs)
    src = docs.selectExpr(f"cast(`{id_col}` as long) id", f"coalesce(cast(`{lang_col}` as string), '') lang", f"cast(`{text_col}` as string) text")
    if "Exchange" in src._jdf.queryExecution().executedPlan().toString():
        src = written(src)
    bits = min(60, max(40, X.input_bytes(src).bit_length() + 10))  # false meetings stay as rare at any size
    rows = cut(scored(src, n, bits)).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    fit = rows.where("not base_failed")
    q = fit.groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 100_000).alias("q"))
    dev = q.select("lang", F.col("q")[1].alias("mid"), ((F.col("q")[2] - F.col("q")[0]) / 2).alias("dev"))
    room = F.lit(spread) / F.sqrt(F.greatest(F.lit(1), "n_tokens"))
    off = F.col("log_ppl") - F.col("mid")
    inside = (off >= -below * F.col("dev") - room) & (off <= above * F.col("dev") + room)
    return rows.join(dev, "lang", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), F.exp("log_ppl").alias("perplexity"), "lang")
