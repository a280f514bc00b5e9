"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are needed. With class prior
``pi``, losses l+ and l- of a linear scorer over the positives P and the
unlabelled U, training minimises ::

    pi * E_P[l+]  +  max(0, E_U[l-] - pi * E_P[l-])

The maximum is the non-negative correction: a step in which the second term falls
below zero follows the first alone (``ascent`` above 0 would also climb back). Features are hashed whole words and word
beginnings, as a density damped for long texts, so that a chance occurrence in a
long document weighs little.

Defined edge cases: a null or empty text has no features and scores by the bias
(below the threshold); without confirmed examples every score is 0; repeated
rows are scored alike; an empty document table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filter_rows, read_documents
from ._kernels import buffer, prefix_hash, span_hash, words
from .quality import bounded_texts, held_out, score_documents

BITS = 18
PREFIXES = (4, 5, 6)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document index) of every word and word beginning, and words per document.

    A word is a run of letters (ASCII letters and all non-ASCII bytes), A-Z
    lower-cased; beginnings are cut after 4, 5 and 6 bytes of longer words."""
    data, offsets = buffer(arr)
    start, end, doc = words(data, offsets, _WORD)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    if not len(start):
        return np.empty(0, np.int64), doc, counts
    prefix = prefix_hash(data, lower=True)
    ids, docs = [span_hash(prefix, start, end)], [doc]
    for k in PREFIXES:
        long = end - start > k
        ids.append(span_hash(prefix, start[long], start[long] + k) ^ np.uint64(0xABCDEF0123456789 + k))
        docs.append(doc[long])
    return (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs), counts


def value(count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A feature seen ``count`` times in ``n_words`` words."""
    return 4.0 * count / (count + 1.0 + n_words / 250.0)


@dataclass(frozen=True)
class ToxicityModel:
    """Log-odds = bias + sum of weights[slot[bucket]] * value; slot 0 is no feature."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, arr: pa.Array) -> np.ndarray:
        ids, doc, n_words = features(arr)
        s = self.slot[ids]
        hit = s > 0
        key, count = np.unique(doc[hit] * len(self.weights) + s[hit], return_counts=True)
        d, k = key // len(self.weights), key % len(self.weights)
        z = self.bias + np.bincount(d, weights=self.weights[k] * value(count, n_words[d]), minlength=len(arr))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text."""
    out = []
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        ids, doc, n_words = features(pa.array(part, pa.string()))
        key, count = np.unique(doc * (1 << BITS) + ids, return_counts=True)
        d = key >> BITS
        v = value(count, n_words[d])
        edges = np.searchsorted(d, np.arange(len(part) + 1))
        bucket, v = (key & ((1 << BITS) - 1)).astype(np.int32), v.astype(np.float32)
        out += [(bucket[a:b].copy(), v[a:b].copy()) for a, b in zip(edges, edges[1:])]
    return out


def fit(positive: list[str], unlabelled: list[str], prior: float, n_features: int = 192, epochs: int = 600, rate: float = 0.3, decay: float = 1e-4, ascent: float = 0.0, seed: int = 11) -> ToxicityModel:
    """Non-negative PU training of a logistic scorer on the features most lifted in P over U."""
    none = ToxicityModel(np.zeros(1 << BITS, np.int32), np.zeros(1), -30.0)
    if not positive or not unlabelled:
        return none
    p, u = _matrix(positive), _matrix(unlabelled)
    mass = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for m, rows in zip(mass, (p, u)):
        for ids, v in rows:
            m[ids] += v
        m /= len(rows)
    lift = (mass[0] - mass[1]) / np.sqrt(mass[1] + 1.0 / len(u))
    chosen = np.argsort(-np.abs(lift), kind="stable")[:n_features]
    chosen = chosen[np.abs(lift[chosen]) > 0]
    slot = np.zeros(1 << BITS, np.int32)
    slot[chosen] = np.arange(1, len(chosen) + 1)
    m = len(chosen) + 1

    def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(rows), m), np.float32)
        for i, (ids, v) in enumerate(rows):
            s = slot[ids]
            x[i, s[s > 0]] = v[s > 0]
        return x

    xp, xu = dense(p), dense(u)
    w, b = np.zeros(m), np.log(prior / (1 - prior))
    g2, gb2 = np.full(m, 1e-8), 1e-8
    rng = np.random.default_rng(seed)
    half = 256
    for _ in range(epochs):
        ip = rng.integers(0, len(xp), min(half, len(xp)))
        iu = rng.integers(0, len(xu), min(4 * half, len(xu)))
        sp = 1 / (1 + np.exp(-np.clip(xp[ip] @ w + b, -30, 30)))
        su = 1 / (1 + np.exp(-np.clip(xu[iu] @ w + b, -30, 30)))
        # logistic losses: l+ has gradient s - 1, l- has gradient s
        gp_plus, gp_minus, gu = (sp - 1) / len(sp), sp / len(sp), su / len(su)
        rest = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
        if rest >= 0:
            cp, cu = prior * (gp_plus - gp_minus), gu
        else:
            cp, cu = prior * (gp_plus + ascent * gp_minus), -ascent * gu
        gw = xp[ip].T @ cp + xu[iu].T @ cu + decay * w
        gb = cp.sum() + cu.sum()
        g2 += gw * gw
        gb2 += gb * gb
        w -= rate * gw / np.sqrt(g2)
        b -= rate * gb / np.sqrt(gb2)
    w[0] = 0
    return ToxicityModel(slot, w, float(b))


def training_texts(documents: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int, max_bytes: int, usable=None) -> tuple[list[str], list[str], float]:
    """At most ``max_positive`` confirmed toxic texts, at most ``max_unlabelled`` further
    texts, none of over ``max_bytes`` bytes (the documented bounds, both chosen by a hash of
    the id among the rows that ``usable`` admits), and the class prior, the toxic share of the labelled rows."""
    usable = F.lit(True) if usable is None else usable
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    n, n_pos = rows.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    prior = min(max(n_pos / n if n else 0.05, 1e-3), 0.9)
    positive = rows.where("toxic = 1").select("doc_id").distinct()
    chosen = positive.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).withColumn("y", F.lit(1))
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & usable)
    other = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled).dropDuplicates(["doc_id"]).withColumn("y", F.lit(0))
    texts, y = bounded_texts(documents, chosen.unionByName(other), max_bytes)
    return [t for t, k in zip(texts, y) if k == 1], [t for t, k in zip(texts, y) if k == 0], prior


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, max_positive: int = 1200, max_unlabelled: int = 4000, max_bytes: int = 1 << 15, usable=None) -> DataFrame:
    """doc_id, score, predicted for every row of ``documents``."""
    model = fit(*training_texts(documents, labels, max_positive, max_unlabelled, max_bytes, usable))
    return score_documents(documents, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, max_positive: int = 1200, max_unlabelled: int = 4000, max_bytes: int = 1 << 15) -> DataFrame:
    """The rows of ``documents``, all columns, that score below the threshold."""
    model = fit(*training_texts(documents, labels, max_positive, max_unlabelled, max_bytes))
    held = documents.sparkSession.sparkContext.broadcast(model)
    return filter_rows(documents, lambda texts: held.value.score(texts) < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = ~held_out("doc_id", 3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learn)
    out = toxicity(read_documents(spark, sf_dir), labels, usable=learn)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
