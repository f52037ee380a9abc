"""Operator 6, dedup over bytes by prefix-free parsing and suffix arrays.

``anchors`` brings together, in blocks, the stretches of documents that can share a string of ``least`` bytes; stretches that
no other place shares never travel, and equal ones are counted once, however many copies there are. In a block:

1. *Parse.* Each stretch is cut at triggers, ``_TRIGGER``-byte strings whose rolling hash is divisible by ``_EVERY``. A phrase
   runs from one trigger through the next, so phrases overlap by a trigger and no proper suffix of one, longer than
   a trigger, is a prefix of another's.
2. *Dictionary.* The different phrases get a suffix array; a phrase that recurs is in it once.
3. *Parse order.* Each stretch, as the ranks of its phrases, gets a suffix array of its own kind, over a few symbols.
4. *Corpus order.* A place is ordered by the rank of what is left of its phrase in the dictionary, and
   then by the rank of what follows in the parse. That is the lexicographic order of the block's suffixes.
5. Neighbours are compared byte by byte; a place whose first ``window`` bytes equal a neighbour's is repeated.

Blocks are cut by anchors (smallest rolling hashes of windows), since hashes divisible by some number leave
strings without any trigger; within a block such strings are long phrases only.

A byte is removed if a string of ``window`` bytes that also starts anywhere else covers it. ``n_repeated`` counts in the same way,
without removing them, the bytes in repeated strings of ``least`` bytes. Nulls count as empty, a null id stays null; nothing crosses documents;
repeated rows repeat each other; an empty table gives no rows; extra columns are ignored. A very long text is one chunk
by itself and is hashed block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import kernels as K
from . import suffixes as S
from .anchors import binary_array, repeated, runs

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary"
_TRIGGER, _EVERY = 8, 16
_DEEP = 7  # bytes of nine bits that one integer holds


def _bytes(data, offs):
    return K.BYTE_VALUES[data], offs, None


def _first_symbols(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first ``_DEEP`` bytes of each suffix as an integer; an end is less than every byte."""
    n = data.size
    x = np.r_[data.astype(np.int64) + 1, np.zeros(_DEEP, np.int64)]
    room = ends - np.arange(n)
    out = np.zeros(n, np.int64)
    for i in range(_DEEP):
        out = (out << 9) | np.where(i < room, x[i : i + n], 0)
    return out


def parse(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, string) of all phrases of the strings that offs bounds."""
    n = data.size
    cut = np.zeros(n, bool)
    cut[: max(0, n - _TRIGGER + 1)] = K.window_hashes(K.BYTE_VALUES[data], _TRIGGER) % np.uint64(_EVERY) == 0
    ends = np.repeat(offs[1:], np.diff(offs))
    cut &= np.arange(n) + _TRIGGER <= ends
    cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    first = np.flatnonzero(cut)
    string = np.searchsorted(offs, first, "right") - 1
    nxt = np.r_[first[1:], n]
    same = np.r_[string[1:] == string[:-1], False]
    return first, np.where(same, nxt + _TRIGGER, offs[1:][string]), string


def corpus_order(data: np.ndarray, offs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The given places in the lexicographic order of their suffixes, from the suffix arrays of dictionary and parse."""
    first, end, string = parse(data, offs)
    size = end - first
    h = np.empty(first.size, np.uint64)
    p = K.prefix(K.BYTE_VALUES[data])
    h = K.ranged(p, first, end)
    _, which, phrase = np.unique(h, return_index=True, return_inverse=True)
    # dictionary: its phrases one after the other
    d_size = size[which]
    d_offs = np.concatenate([[0], np.cumsum(d_size)])
    body = data[np.repeat(first[which], d_size) + K.sequences(d_size)]
    d_ends = np.repeat(d_offs[1:], d_size)
    in_dictionary = S.last_level(_first_symbols(body, d_ends), d_ends, int(d_size.max(initial=1)), _DEEP)
    # parse: ranks of phrases, each string's own end
    symbol = in_dictionary[d_offs[phrase]]
    p_ends = np.searchsorted(string, string, "right")
    in_parse = S.last_level(symbol, p_ends, int(np.bincount(string).max(initial=1))) + 1
    follows = np.r_[in_parse[1:], 0]
    follows[p_ends == np.arange(1, first.size + 1)] = 0
    own = np.searchsorted(first, places, "right") - 1
    left = in_dictionary[d_offs[phrase[own]] + places - first[own]]
    return places[np.lexsort((follows[own], left))]


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, start: int = 0) -> np.ndarray:
    """Which pairs of strings of ``size`` bytes agree, from byte ``start`` on; eight bytes at a time."""
    buf = np.r_[data, np.zeros(8, np.uint8)].tobytes()
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    left = np.arange(a.size)
    for i in range(start, size, 8):
        x, y = eight[a[left] + i], eight[b[left] + i]
        if size - i < 8:
            m = np.uint64((1 << 8 * (size - i)) - 1)
            x, y = x & m, y & m
        left = left[x == y]
    out = np.zeros(a.size, bool)
    out[left] = True
    return out


def _resolve(lengths: tuple[int, ...]):
    def resolve(data: np.ndarray, offs: np.ndarray, count: np.ndarray) -> np.ndarray:
        places = np.repeat(offs[:-1], count) + K.sequences(count)
        ends = np.repeat(offs[1:], count)
        order = corpus_order(data, offs, places)
        room = (ends - places)[np.searchsorted(places, order)]
        out = np.zeros((len(lengths), places.size), bool)
        a, b, least = order[:-1], order[1:], np.minimum(room[:-1], room[1:])
        pairs, done = np.arange(a.size), 0
        for i, m in enumerate(lengths):
            pairs = pairs[least[pairs] >= m]
            pairs = pairs[_equal(data, a[pairs], b[pairs], m, done)]
            out[i, np.searchsorted(places, a[pairs])] = True
            out[i, np.searchsorted(places, b[pairs])] = True
            done = m
        return out

    return resolve


def _finish(ids, data, offs, vo, extra, covered):
    gone = covered[-1]
    c = [np.concatenate([[0], np.cumsum(x)])[offs] for x in (~gone, covered[0])]
    n, kept = np.diff(offs), np.diff(c[0])
    yield pa.RecordBatch.from_arrays([X.id_array(ids), pa.array(n), pa.array(n - kept), pa.array(runs(gone, offs)), pa.array(np.diff(c[1])), binary_array(data[~gone].tobytes(), kept)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, least: int = 240, **bounds) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), n_repeated (bytes in
    repeated strings of ``least`` bytes), kept (bytes)."""
    lengths = tuple(sorted({min(least, window), window}))
    return repeated(docs, id_col, text_col, lengths, max(1, lengths[0] * 4 // 15), _bytes, _resolve(lengths), _finish, SCHEMA, **bounds)
