"""Operator 8, toxicity by cumulative-link ordinal regression over sparse text features.

P(severity <= k) = logistic(threshold_k - w . x) with one weight vector for all thresholds, which are kept in
order by fitting their gaps. x holds the words of a document (0-9, A-Z folded, a-z and all beyond ASCII)
and their first four bytes, each once. The expected severity is the sum of P(severity > k).

Labels say only toxic or not, so grades for training are derived from them: 0 for not toxic, and for toxic
documents 1 to ``grades`` by how many words with strong log odds for toxicity they hold (one, two, ... or
more). A table with a severity column can be given instead. The fit takes at most ``train_rows`` labelled
documents, those with the least hash of their id, and of the words in at least ``least_docs`` of them the
``most_words`` whose log odds stand out most, by three deviations at least; scoring takes every word of every document.

Null and empty texts have no words and get the severity of the thresholds alone; without labels all is
severity 0; repeated rows are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K

_BITS = 20
_STEM = 4


def doc_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their first ``_STEM`` bytes, and the document of each (not distinct)."""
    data = K.lower_ascii(data)
    s, e, wo = K.split_words(data, offs, K.word_table("alnum"))
    out = np.empty((s.size, 2), np.uint64)
    out[:, 0] = K.hash_spans(data, s, e)
    out[:, 1] = K.mix(K.hash_spans(data, s, np.minimum(e, s + _STEM)) ^ np.uint64(0x5354454D))
    return out.reshape(-1), np.repeat(np.arange(offs.size - 1), 2 * np.diff(wo))


class Ordinal:
    """Sorted word hashes with weights, and ordered thresholds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.keys, self.weights, self.thresholds = keys, weights, thresholds
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[keys >> np.uint64(64 - _BITS)] = True

    def score(self, h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """P(severity > k) for each document and k."""
        total = np.zeros(n)
        at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITS)])
        if at.size and self.keys.size:
            p = np.minimum(np.searchsorted(self.keys, h[at]), self.keys.size - 1)
            hit = self.keys[p] == h[at]
            pair = np.unique(np.stack([doc[at[hit]], p[hit]], 1), axis=0)
            total = np.bincount(pair[:, 0], weights=self.weights[pair[:, 1]], minlength=n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - total[:, None], -40, 40)))


def fit(docs: list[np.ndarray], toxic: np.ndarray, severity: np.ndarray | None, grades: int, most_words: int, least_docs: int, least_z: float = 3.0, rounds: int = 600, ridge: float = 1e-4) -> Ordinal:
    """docs: distinct word hashes of each document."""
    n = len(docs)
    far = np.full(grades, 30.0)
    if not n or not toxic.any() or toxic.all():
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), far if not toxic.any() else -far)
    doc = np.repeat(np.arange(n), [d.size for d in docs])
    uniq, word, df = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    pos = np.bincount(word, weights=toxic[doc], minlength=uniq.size)
    p, q = toxic.sum(), n - toxic.sum()
    odds = np.log((pos + 0.5) / (p - pos + 0.5)) - np.log((df - pos + 0.5) / (q - df + pos + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (df - pos + 0.5))
    own = np.flatnonzero((df >= least_docs) & (z >= least_z))
    own = np.sort(own[np.argsort(-z[own], kind="stable")[:most_words]])
    rank = np.full(uniq.size, -1)
    rank[own] = np.arange(own.size)
    keep = rank[word] >= 0
    doc, word = doc[keep], rank[word[keep]]
    if severity is None:
        strong = (odds[own] > 2) & (z[own] > 4)
        severity = np.where(toxic, np.clip(np.bincount(doc, weights=strong[word], minlength=n), 1, grades), 0)
    severity = severity.astype(int)
    above = (severity[:, None] > np.arange(grades)[None, :]).astype(float)
    w = np.zeros(own.size)
    gap = np.zeros(grades)  # first threshold, then logs of gaps
    rate = np.clip(above.mean(0), 1 / (2 * n), 1 - 1 / (2 * n))
    start = np.log((1 - rate) / rate)
    gap[0], gap[1:] = start[0], np.log(np.maximum(np.diff(start), 0.05))
    m = [np.zeros(own.size), np.zeros(grades)]
    v = [np.zeros(own.size), np.zeros(grades)]
    for step in range(1, rounds + 1):
        t = gap[0] + np.r_[0, np.cumsum(np.exp(gap[1:]))]
        s = np.bincount(doc, weights=w[word], minlength=n)
        # likelihood of P(y = k) = P(y > k - 1) - P(y > k)
        g = np.c_[np.ones(n), 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -30, 30))), np.zeros(n)]
        d = g * (1 - g)
        i = np.arange(n)
        prob = np.maximum(g[i, severity] - g[i, severity + 1], 1e-9)
        gs = (d[i, severity] - d[i, severity + 1]) / prob
        gt = np.zeros(grades)
        for k in range(grades):
            gt[k] = (d[:, k + 1] / prob * ((severity == k).astype(float) - (severity == k + 1))).sum()
        dw = -np.bincount(word, weights=gs[doc], minlength=own.size) / n + ridge * w
        dt = -gt / n
        up = np.r_[dt.sum(), np.cumsum(dt[::-1])[::-1][1:] * np.exp(gap[1:])]
        for x, grad, a, b in ((w, dw, m[0], v[0]), (gap, up, m[1], v[1])):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            x -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Ordinal(uniq[own], w, gap[0] + np.r_[0, np.cumsum(np.exp(gap[1:]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, severity_col: str | None, grades: int, train_rows: int, most_words: int, least_docs: int) -> Ordinal:
    own = labels.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{label_col}` as int) y", f"cast({severity_col or 'null'} as int) g").where("y is not null and doc_id is not null")
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("g").alias("g")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def run(batches):
        for b in batches:
            data, offs = K.text_buffer(b.column("text"))
            h, doc = doc_words(data, offs)
            cuts = np.searchsorted(doc, np.arange(1, len(b)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("g"), pa.array([np.unique(x).tobytes() for x in np.split(h, cuts)], pa.binary())], names=["doc_id", "y", "g", "h"])

    # train_rows bounds the broadcast side
    src = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").join(F.broadcast(own), "doc_id").select("doc_id", "y", "g", "text")
    # of repeated ids the least row
    t = src.mapInArrow(run, "doc_id long, y int, g int, h binary").groupBy("doc_id").agg(F.min(F.struct("h", "y", "g")).alias("r")).select("r.*").toPandas()
    toxic = t.y.to_numpy(int) > 0
    severity = np.clip(t.g.fillna(0).to_numpy(int), 0, grades) if severity_col else None
    return fit([np.frombuffer(x, np.uint64) for x in t.h], toxic, severity, grades, most_words, least_docs)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", severity_col: str | None = None, grades: int = 3, train_rows: int = 10_000, most_words: int = 4096, least_docs: int = 5, least: float = 0.3) -> DataFrame:
    """One row per document: doc_id, expected_severity, grade (most probable), p_toxic, toxic."""
    spark = docs.sparkSession
    X.settle(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, severity_col, grades, train_rows, most_words, least_docs))

    def run(batches):
        for b in batches:
            data, offs = K.text_buffer(b.column("text"))
            for i, j in K.slices(offs):
                h, doc = doc_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                p = model.value.score(h, doc, j - i)
                each = np.c_[np.ones(j - i), p] - np.c_[p, np.zeros(j - i)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= least)], names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    src = docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text")
    return src.mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")
