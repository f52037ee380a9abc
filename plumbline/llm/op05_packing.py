"""Operator 5, packing by first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised, an end id is added, and each is cut into pieces of ``length`` ids and a rest.
Pieces are dealt at random (a hash of document and start) to groups of about ``group_pieces``; each group
is packed on its own, largest piece first, each into the first sequence with room. The tree's root holds
the largest room left and a descent finds the first sequence that fits in log(n) steps. Only the last few
sequences of a group have much padding, so it does not grow with the corpus; no group depends on another.

Tokenising is by white-space word: no pre-token of this vocabulary crosses ASCII white space, so the ids
of a text are those of its words in turn. Each worker keeps the ids of words it has seen (bounded; dropped
when full). New words are encoded many at a time with a special token between them. A vocabulary whose
pre-tokens cross white space is recognised by a probe, and then whole texts are encoded.

Null text counts as empty and gives the end id alone; a null id stays null. Repeated rows are packed each. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from plumbline.operators.store import cut

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
OUT = PIECES.replace(", ids binary", "") + ", sequence_id long, offset long"
_cached: dict[int, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of texts, with a bounded memory of words."""

    PROBE = "It's  a\tnaïve l'été 12 don't\r\nx!! (y) "

    def __init__(self, spec: str, most: int = 1 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t, self.most = Tokenizer.from_str(spec), most
        whole = self.t.encode(self.PROBE, add_special_tokens=False).ids
        self.by_word = [i for w in self.PROBE.split() for i in self.t.encode(w, add_special_tokens=False).ids] == whole
        special = [(i, a.content) for i, a in self.t.get_added_tokens_decoder().items() if a.special and not a.lstrip and not a.rstrip]
        self.sep_id, self.sep = special[-1] if special else (-1, None)
        self.by_word &= self.sep is not None
        self.clear()

    def clear(self):
        self.keys, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.size = 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        out, lens = [], []
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            if any(self.sep in w for w in part):
                got = [np.array(self.t.encode(w, add_special_tokens=False).ids, np.int64) for w in part]
                out += got
                lens += [g.size for g in got]
                continue
            ids = np.array(self.t.encode(self.sep.join(part), add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(ids == self.sep_id)
            out.append(ids[ids != self.sep_id])
            lens += np.diff(np.r_[-1, cuts, ids.size] if len(part) else []).__sub__(1).tolist()
        lens = np.array(lens, np.int64)
        at = self.size + np.cumsum(lens) - lens
        self.ids.append(np.concatenate(out).astype(np.uint32))
        self.size += int(lens.sum())
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.len = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.len, lens])[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets of the documents in them)."""
        if not self.by_word:
            raw = data.tobytes()
            got = [self.t.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            o = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)
            return np.array([i for g in got for i in g], np.uint32), o
        s, e, wo = K.split_words(data, offs, K.word_table("space"))
        keys, first, back = np.unique(K.hash_spans(data, s, e), return_index=True, return_inverse=True)
        if self.keys.size > self.most:
            self.clear()
        new = np.ones(keys.size, bool)
        if self.keys.size:
            p = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
            new = self.keys[p] != keys
        if new.any():
            raw, f = data.tobytes(), first[new]
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[f].tolist(), e[f].tolist())])
        if not self.keys.size:
            return np.zeros(0, np.uint32), wo * 0
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        p = np.searchsorted(self.keys, keys)[back]
        n = self.len[p]
        ids = self.ids[0][np.repeat(self.at[p] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return ids, np.concatenate([[0], np.cumsum(n)])[wo]


def encoder(spec: str) -> Encoder:
    """One for each worker process and vocabulary."""
    k = hash(spec)
    if k not in _cached:
        _cached.clear()
        _cached[k] = Encoder(spec)
    return _cached[k]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int, end_id: int, keep_ids: bool) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()

    def run(batches):
        enc = encoder(spec)
        for b in batches:
            all_ids, col = X.ids_of(b.column(0)), b.column(1)
            data, offs = K.text_buffer(col)
            for i, j in K.slices(offs):
                a = offs[i]
                ids, o = enc.encode(data[a : offs[j]], offs[i : j + 1] - a)
                ids = np.insert(ids, o[1:], np.uint32(end_id)).astype("<u4")
                o = o + np.arange(o.size)
                total = np.diff(o)
                n = -(-total // length)
                start = K.sequences(n) * length
                at = np.repeat(o[:-1], n) + start
                size = np.minimum(length, np.repeat(total, n) - start)
                raw = memoryview(ids.tobytes())
                cuts = [raw[4 * x : 4 * (x + y)] for x, y in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [X.id_array(np.repeat(all_ids[i:j], n)), pa.array(start), pa.array(size), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(np.repeat(total, n)), pa.array([bytes(c) for c in cuts] if keep_ids else [None] * len(cuts), pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    X.settle(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text").mapInArrow(run, PIECES)


def first_fit(sizes: list[int], room: int) -> list[int]:
    """The bin of each size, given in decreasing order."""
    n = 1
    while n < max(1, len(sizes)):
        n *= 2
    tree = [room] * (2 * n)
    out = []
    for s in sizes:
        k = 1
        while k < n:
            k *= 2
            if tree[k] < s:
                k += 1
        out.append(k - n)
        tree[k] -= s
        k //= 2
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a >= b else b
            if tree[k] == m:
                break
            tree[k] = m
            k //= 2
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = 2048, end_id: int = 1, group_pieces: int = 8192, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``keep_ids``, the ids themselves (little-endian unsigned 32-bit). ``sequence_id`` names the group in
    its upper bits."""
    got = pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), length, end_id, keep_ids)
    got = cut(got if keep_ids else got.drop("ids"))
    groups = max(1, -(-got.count() // group_pieces))
    with_group = got.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(17)), F.lit(groups)))
    extra = [("ids", pa.binary())] if keep_ids else []

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        size = t.column("length").to_numpy()
        bins = np.array(first_fit(size.tolist(), length), np.int64)
        order = np.argsort(bins, kind="stable")
        s = size[order]
        run_up = np.cumsum(s) - s
        lead = np.r_[True, np.diff(bins[order]) != 0] if s.size else np.zeros(0, bool)
        offset = np.empty(s.size, np.int64)
        offset[order] = run_up - np.repeat(run_up[lead], np.diff(np.r_[np.flatnonzero(lead), s.size]))
        g = int(t.column("grp")[0].as_py())
        keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(n for n, _ in extra)]
        return t.select(keep).append_column("sequence_id", pa.array(bins + (g << 32))).append_column("offset", pa.array(offset))

    schema = (PIECES if keep_ids else PIECES.replace(", ids binary", "")) + ", sequence_id long, offset long"
    return with_group.groupBy("grp").applyInArrow(run, schema)
