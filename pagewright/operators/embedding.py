"""Embeddings: a native hash embedding and pluggable providers."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import rounded
from pagewright.functions.text import clean


def hash_embedding(text: Column, dim: int) -> Column:
    """``dim`` numbers in [-1, 1) from sha256 digests of the text and a counter, JVM-side."""
    if dim <= 0:
        return F.array().cast("array<double>")
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")

    def numbers(counter: int) -> Column:
        digest = F.sha2(F.concat(data, F.lit(counter.to_bytes(4, "big"))), 256)
        word = lambda d, i: F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("double") / 2147483648.0 - 1.0
        # one element array: the digest is computed once, not once a number
        return F.flatten(F.transform(F.array(digest), lambda d: F.array(*[word(d, i) for i in range(8)])))

    words = [numbers(c) for c in range(-(-dim // 8))]
    return F.slice(F.concat(*words), 1, dim)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the unmasked token vectors, scaled to length one."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    pairs = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    zero = F.transform(F.get(vectors, 0), lambda x: F.lit(0.0))
    total = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b * p["m"]))
    mean = F.transform(total, lambda x: x / n)
    norm = F.greatest(F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(mean, lambda x: rounded(x / norm, 6))


class EmbeddingProvider(ABC):
    """A model behind an Arrow-batched UDF; it is loaded once in each Python worker."""

    provider: str
    model: str
    dim: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider(EmbeddingProvider):
    provider, model = "hash", "sha256"

    def __init__(self, dim: int = 32) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for t in texts:
            v: list[float] = []
            for c in range(-(-self.dim // 8)):
                d = hashlib.sha256(t.encode("utf-8") + c.to_bytes(4, "big")).digest()
                v += [int.from_bytes(d[i : i + 4], "big") / 2147483648.0 - 1.0 for i in range(0, 32, 4)]
            out.append(v[: self.dim])
        return out


def in_index_order(data: list[dict]) -> list[list[float]]:
    """The vectors of a remote response by the ``index`` of each, which the response's order
    need not follow."""
    return [list(map(float, d["embedding"])) for d in sorted(data, key=lambda d: int(d["index"]))]


class RemoteProvider(EmbeddingProvider):
    """A service that embeds lists of texts: ``post(url, body, key)`` sends JSON and returns JSON.
    The transport is given by the caller; a key is required."""

    provider = "remote"

    def __init__(self, post: Callable[[str, dict, str], dict], url: str, model: str, key: str, dim: int = 0) -> None:
        if not key:
            raise ValueError("the remote embedding provider needs a key")
        self.post, self.url, self.model, self.key, self.dim = post, url.rstrip("/"), model, key, dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        vectors = in_index_order(self.post(f"{self.url}/embeddings", {"model": self.model, "input": texts}, self.key)["data"])
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors


class PooledProvider(EmbeddingProvider):
    """A token model behind ``encode(texts)``, which gives token vectors and masks; vectors are
    the masked means, scaled to length one."""

    provider = "pooled"

    def __init__(self, encode: Callable[[list[str]], tuple], model: str, dim: int) -> None:
        self.encode, self.model, self.dim = encode, model, dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        vectors, mask = (np.asarray(x, float) for x in self.encode(texts))
        mean = (vectors * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)
        unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        return [[round(x, 6) for x in v] for v in unit.tolist()]


PROVIDERS: dict[str, Callable[..., EmbeddingProvider]] = {"hash": HashProvider, "remote": RemoteProvider, "pooled": PooledProvider}
_made: dict[tuple, EmbeddingProvider] = {}


def provider(name: str, **options) -> EmbeddingProvider:
    """A provider by name, made once in each process for the same options."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}; known: {sorted(PROVIDERS)}")
    key = (name, *sorted((k, repr(v)) for k, v in options.items()))
    if key not in _made:
        _made[key] = PROVIDERS[name](**options)
    return _made[key]


def embed_blocks(blocks: DataFrame, dim: int = 32) -> DataFrame:
    """One embedding row for each block, by the native hash embedding."""
    return blocks.select(
        F.concat(F.lit("emb-"), F.col("block_id")).alias("embedding_id"), "job_id", "block_id", F.lit("hash").alias("provider"), F.lit("sha256").alias("model"),
        F.lit(dim).alias("dim"), hash_embedding(clean(F.col("text")), dim).alias("vector"),
    )


def embed_with(blocks: DataFrame, factory: Callable[[], EmbeddingProvider]) -> DataFrame:
    """One embedding row for each block, by a provider made once in each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = factory()
        for b in batches:
            vectors = p.embed([" ".join((t or "").split()) for t in b["text"]])
            if len(vectors) != len(b):
                raise ValueError("the provider returned another number of vectors than texts")
            yield pd.DataFrame({"embedding_id": "emb-" + b["block_id"], "job_id": b["job_id"], "block_id": b["block_id"], "provider": p.provider, "model": p.model, "dim": p.dim, "vector": vectors})

    return blocks.select("job_id", "block_id", "text").mapInPandas(run, "embedding_id string, job_id string, block_id string, provider string, model string, dim int, vector array<double>")


def blocks_with_embeddings(blocks: DataFrame, embeddings: DataFrame, job_id: str | None = None) -> DataFrame:
    """Blocks of a job (or all) with their vectors, in reading order."""
    b = blocks if job_id is None else blocks.where(F.col("job_id") == job_id)
    e = embeddings if job_id is None else embeddings.where(F.col("job_id") == job_id)
    return b.join(e.select("block_id", "provider", "model", "dim", "vector"), "block_id", "left").orderBy("job_id", "page_index", "block_index")
