"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to buckets, each bucket has a learned
vector, a document is the mean of its vectors and a softmax layer gives the
label; both layers are trained together by numpy stochastic gradient descent on
a bounded sample of labelled rows (``max_per_class`` rows of a class, none of them of over
``max_bytes`` bytes, all whole). Since the output layer is
linear, scoring needs only one number per bucket (the vector times the difference
of the class weights), so the shipped model is ``2**bits`` floats whatever the corpus.

Defined edge cases: a null or empty text has no features and scores by the bias
alone; rows repeat as often as they come; a label of null is not learned from;
an empty label table (or one with a single class) gives the constant score 0.5
(or a bias of that class); an empty document table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, read_documents, select_documents, slices
from ._kernels import buffer, prefix_hash, span_hash, words

ORDERS = (3, 4)
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def _codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, starts[offsets] if len(points) == starts[-1] else np.minimum(starts[offsets], len(points))


def feature_blocks(arr: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (bucket of each feature, begin, end of each document's run in the block)."""
    data, offsets = buffer(arr)
    n_docs = len(offsets) - 1
    start, end, doc = words(data, offsets)
    h = span_hash(prefix_hash(data), start, end) if len(start) else np.empty(0, np.uint64)
    edge = np.searchsorted(doc, np.arange(n_docs + 1))
    yield (h >> np.uint64(64 - bits)).astype(np.int64), edge[:-1], edge[1:]
    points, off = _codepoints(data, offsets)
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        g = np.full(n, order, dtype=np.uint32)
        for j in range(order):
            g = (g ^ points[j : n + j]) * _MULT[j]
        g ^= g >> np.uint32(15)
        g *= _MULT[4]
        begin = np.minimum(off[:-1], n)
        yield (g >> np.uint32(32 - bits)).astype(np.int64), begin, np.clip(off[1:] - order + 1, begin, n)


@dataclass(frozen=True)
class QualityModel:
    """``weights[bucket]`` and ``bias`` give the log-odds of label 1."""

    weights: np.ndarray
    bias: float
    bits: int

    def score(self, arr: pa.Array) -> np.ndarray:
        n = len(arr)
        total, count = np.zeros(n), np.zeros(n)
        for ids, begin, end in feature_blocks(arr, self.bits):
            c = np.concatenate(([0.0], np.cumsum(self.weights[ids], dtype=np.float64)))
            total += c[end] - c[begin]
            count += end - begin
        z = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, bits: int = 16, dim: int = 16, epochs: int = 6, rate: float = 8.0, seed: int = 7) -> QualityModel:
    """Train embeddings and softmax layer by SGD, one document a step; classes weigh alike."""
    labels = np.asarray(labels, dtype=np.int64)
    seen = np.unique(labels)
    if len(seen) < 2:
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0 if len(seen) == 0 else (2.0 if seen[0] else -2.0), bits)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        ids = [b[s[0] : e[0]] for b, s, e in feature_blocks(pa.array([text]), bits)]
        u, c = np.unique(np.concatenate(ids), return_counts=True)
        docs.append((u.astype(np.uint16 if bits <= 16 else np.int64), (c / max(c.sum(), 1)).astype(np.float32)))
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = 0.5 / share
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            u, c = docs[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = c @ vectors[u] if len(u) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= min(weight[labels[i]], 4.0)
            back = p @ out
            out -= 0.1 * lr * np.outer(p, mean)
            bias -= 0.01 * lr * p
            if len(u):
                vectors[u] -= lr * np.outer(c, back)
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def bounded_texts(documents: DataFrame, chosen: DataFrame, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """Whole texts and y of the chosen ids (doc_id, y), a bounded number, ordered by id. Texts
    of over ``max_bytes`` bytes are left out, so that the driver's share is bounded."""
    found = select_documents(documents).where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    return found.column("text").to_pylist(), found.column("y").to_numpy().astype(np.int64)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_per_class: int, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """At most ``max_per_class`` labelled texts of each class, each of at most ``max_bytes``
    bytes (the documented bounds), chosen by a hash of the id; whole texts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null")
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    return bounded_texts(documents, picked, max_bytes)


def score_documents(documents: DataFrame, model, score_column: str = "score") -> DataFrame:
    """(doc_id, score) for every row of ``documents``; the model travels as a broadcast
    of fixed size."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(m.score(column(part, "text")), pa.float64())], ["doc_id", score_column])

    return select_documents(documents).mapInArrow(run, f"doc_id long, {score_column} double")


def quality_classifier(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, max_per_class: int = 1500, max_bytes: int = 1 << 15) -> DataFrame:
    """doc_id, score, predicted for every row of ``documents``, learned from the given labels."""
    model = fit(*labelled_sample(documents, labels, "quality", max_per_class, max_bytes))
    return score_documents(documents, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 4, 2))
    out = quality_classifier(read_documents(spark, sf_dir), labels)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
