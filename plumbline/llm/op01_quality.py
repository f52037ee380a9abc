"""Operator 1, quality classifier with hierarchical empirical Bayes over hosts and paths.

1. A logistic classifier over document statistics (``textstats``) gives each document's evidence, the log
   odds of being good. It is fitted on at most ``train_rows`` labelled documents, those with the least hash
   of their id.
2. Grouped sums over all documents give each host's and each path's mean evidence. The variances between
   hosts, between paths of a host and within paths are estimated from the same sums; the prior's weight in
   documents is their ratio. A path's posterior is its mean shrunk toward its host's, which is shrunk toward
   the global one, so sparse sites stay near the prior.
3. A document's posterior log odds are its evidence plus ``site_weight`` times what its path's posterior
   adds to the global mean. It is kept if its posterior is at least ``least``.

Statistics travel as one narrow row per document; sites are joined by hash and may be as many as they like.
A null host or path is a site of its own, an unlabelled corpus keeps everything but is scored 0.5, null and
empty texts are judged by their (zero) statistics, repeated rows each count, extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from plumbline.operators.store import cut
from .textstats import FEATURES, features

CLIP = 8.0


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, weights) of a ridge logistic regression on standardised features and squares."""
    if not y.size or y.min() == y.max():
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(2 * x.shape[1] + 1)
    mean, dev = x.mean(0), x.std(0) + 1e-6
    z = expand(x, mean, dev)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(w.size), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, dev, w


def expand(x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / dev, -CLIP, CLIP)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], 1)


def statistics(docs: DataFrame, id_col: str, text_col: str, host: str, path: str) -> DataFrame:
    X.settle(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offs = K.text_buffer(b.column("text"))
            for i, j in K.slices(offs):
                f = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                x = pa.FixedSizeListArray.from_arrays(pa.array(f.reshape(-1).astype(np.float32)), f.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("id", "host", "path")), x], names=["doc_id", "host", "path", "x"])

    src = docs.selectExpr(f"cast(`{id_col}` as long) id", f"coalesce(cast({host} as string), '') host", f"coalesce(cast({path} as string), '') path", f"cast(`{text_col}` as string) text")
    return src.mapInArrow(run, "doc_id long, host string, path string, x array<float>")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", host: str = "source", path: str = "lang", train_rows: int = 20_000, site_weight: float = 0.5, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, site, posterior, kept. host and path are SQL expressions."""
    stats = cut(statistics(docs, id_col, text_col, host, path))
    own = labels.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{label_col}` as double) y").where("y is not null and doc_id is not null")
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    train = stats.join(own, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).toPandas()  # at most train_rows; of repeated ids the least
    x = np.stack(train.x.to_list()).astype(float) if len(train) else np.zeros((0, len(FEATURES)))
    mean, dev, w = fit(x, train.y.to_numpy(float))
    # the linear form as a column expression: 1, z, z * z
    z = [F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col("x")[k] - F.lit(float(mean[k]))) / F.lit(float(dev[k])))) for k in range(len(FEATURES))]
    e = F.lit(float(w[0]))
    for k, c in enumerate(z):
        e = e + c * (F.lit(float(w[1 + k])) + c * F.lit(float(w[1 + len(z) + k])))
    scored = stats.select("doc_id", "host", "path", F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), e)).alias("evidence"))

    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("q"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("s") ** 2 / F.col("n")).alias("hp"), F.count(F.lit(1)).alias("k"))
    t = hosts.agg(F.sum("hn"), F.sum("hs"), F.sum(F.col("hs") ** 2 / F.col("hn")), F.sum("hp"), F.sum("k"), F.count(F.lit(1)), F.sum(F.col("hn") ** 2)).first()
    q = paths.agg(F.sum("q"), F.sum(F.col("n") ** 2)).first()
    n, s, between, by_path, k, m, n2 = (float(v or 0) for v in t)
    total, p2 = (float(v or 0) for v in q)
    if not n:
        n = 1.0
    mu = s / n
    # moments of a nested random-effects model
    within = max(1e-9, (total - by_path) / max(1.0, n - k))
    v_path = max(1e-9, ((by_path - between) / max(1.0, k - m) - within) / max(1.0, p2 / n if p2 else 1.0))
    v_host = max(1e-9, ((between - n * mu * mu) / max(1.0, m - 1) - within) / max(1.0, (n - n2 / n) / max(1.0, m - 1)))
    a_host, a_path = within / v_host, within / v_path
    hosts = hosts.select("host", ((F.col("hs") + F.lit(a_host * mu)) / (F.col("hn") + F.lit(a_host))).alias("h"))
    site = paths.join(hosts, "host").select("host", "path", ((F.col("s") + F.lit(a_path) * F.col("h")) / (F.col("n") + F.lit(a_path))).alias("site"))
    out = scored.join(site, ["host", "path"])
    logit = F.col("evidence") + F.lit(site_weight) * (F.col("site") - F.lit(mu))
    return out.select("doc_id", "host", "path", "evidence", "site", (1 / (1 + F.exp(-logit))).alias("posterior")).withColumn("kept", F.col("posterior") >= least)
