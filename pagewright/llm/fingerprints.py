"""Document fingerprints: one-permutation MinHash.

The hashes of a text's distinct five-word shingles fall once into ``BINS`` bins by
their high bits; a bin keeps its smallest hash. Empty bins are filled by optimal
densification: bin j tries the bins ``universal(j, 1), universal(j, 2), ...`` until a
filled one is found, the same way for every document. Stored are the lowest ``BITS``
bits of each bin, packed and base64-encoded; the likeness of two fingerprints is
their share of equal bins with the chance matches of short codes taken out.

Defined edge cases: texts of fewer than five words have one shingle, their whole word
sequence; texts without words (null and empty ones too) have the empty fingerprint
``""``, whose likeness is 1 to itself and 0 to any other; repeated rows are
fingerprinted alike; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, read_documents, select_documents, slices
from ._kernels import mix, shingles

BINS = 256
BITS = 8
#: Text of a range of documents, which one task fingerprints in order.
RANGE_BYTES = 16 << 20


@lru_cache(maxsize=4096)
def _sources(attempt: int, bins: int) -> np.ndarray:
    """The bin that each bin tries at this attempt."""
    return (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)


def signatures(arr: pa.Array, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(codes by document and bin, whether the document has any shingle)."""
    h, doc = shingles(arr)
    n = len(arr)
    log = bins.bit_length() - 1
    low = np.uint64((1 << (64 - log)) - 1)
    best = np.full(n * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    if len(h):
        key = doc * bins + (h >> np.uint64(64 - log)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, val = key[order], (h & low)[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        best[key[edge]] = np.minimum.reduceat(val, edge)
    best = best.reshape(n, bins)
    empty = best == np.iinfo(np.uint64).max
    some = ~empty.all(axis=1)
    out = best.copy()
    rows, cols = np.nonzero(empty & some[:, None])  # the bins still empty, fewer at each attempt
    attempt = 0
    while len(rows):
        attempt += 1
        source = _sources(attempt, bins)[cols]
        hit = ~empty[rows, source]
        out[rows[hit], cols[hit]] = best[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint8), some


def pack(codes: np.ndarray, bits: int = BITS) -> bytes:
    """The low-order bits of one document's codes, without gaps."""
    return np.packbits(np.unpackbits(codes[:, None], axis=1)[:, 8 - bits :]).tobytes()


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """Bias-corrected resemblance of two code rows, clipped to 0..1."""
    chance = 1.0 / (1 << bits)
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


class Fingerprint:
    """Codes of one document; ``None`` for a text without words."""

    __slots__ = ("codes",)

    def __init__(self, codes: np.ndarray | None) -> None:
        self.codes = codes

    def __str__(self) -> str:
        return "" if self.codes is None else base64.b64encode(pack(self.codes)).decode("ascii")

    def likeness(self, other: Fingerprint) -> float:
        if self.codes is None or other.codes is None:
            return 1.0 if self.codes is other.codes else 0.0
        return likeness(self.codes, other.codes)


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    codes, some = signatures(pa.array(texts, pa.string()))
    return [Fingerprint(c if s else None) for c, s in zip(codes, some)]


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = fingerprints(column(part, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([str(f) for f in found])], ["doc_id", "fingerprint"])

    return select_documents(documents).mapInArrow(run, "doc_id long, fingerprint string")


@dataclass(frozen=True)
class Ranges:
    """Inner bounds of ranges of (doc_id, text hash); a row equal to a bound lies below it."""

    ids: np.ndarray
    hashes: np.ndarray

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for i in np.flatnonzero(low < high):  # rows of an id that is a bound's
            low[i] += np.searchsorted(self.hashes[low[i] : high[i]], hashes[i], "left")
        return low


#: Sorts null ids first; an id of the same value sorts with them, by its text.
_FIRST = -(1 << 63)


def range_bounds(ids: DataFrame, n_ranges: int) -> Ranges:
    """(o, h) -> bounds of about ``n_ranges`` ranges of equally many rows, found by Spark's
    range partitioning of these narrow rows. One row for each range reaches the driver."""
    parts = ids.repartitionByRange(max(1, n_ranges), "o", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("o", "h")).alias("b"))
    found = sorted((r.b.o, r.b.h) for r in parts.collect())[:-1]
    return Ranges(np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64))


def with_successor(documents: DataFrame, n_ranges: int) -> DataFrame:
    """Rows (range, doc_id, text, ahead) so partitioned and sorted that each document is
    followed by the next one of the whole table: ranges of (doc_id, text hash), each closed
    by a copy (``ahead``) of the first document of the next range that has one; the last
    range is closed by the table's first document. Text moves once."""
    docs = select_documents(documents).select(F.coalesce("doc_id", F.lit(_FIRST)).alias("o"), F.xxhash64("text").alias("h"), "doc_id", "text")
    bounds = range_bounds(docs.select("o", "h"), n_ranges)
    held = documents.sparkSession.sparkContext.broadcast(bounds)  # 16 bytes a range

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = held.value.of(*(column(batch, c).to_numpy(zero_copy_only=False) for c in ("o", "h")))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], ["range", *batch.schema.names])

    firsts = docs.select("o", "h").mapInArrow(ranges, "range int, o long, h long").groupBy("range").agg(F.min(F.struct("o", "h")).alias("f"))
    low = sorted((r.range, r.f.o, r.f.h) for r in firsts.collect())  # a row for each range
    closes = {(o, h): low[i - 1][0] for i, (_, o, h) in enumerate(low)}  # the first range's first row closes the last range
    closing = documents.sparkSession.sparkContext.broadcast(closes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                o, h = (column(part, c).to_numpy(zero_copy_only=False) for c in ("o", "h"))
                names = ["range", "o", "h", "doc_id", "text", "ahead"]
                columns = [column(part, c) for c in names[1:5]]
                yield pa.RecordBatch.from_arrays([pa.array(held.value.of(o, h).astype(np.int32)), *columns, pa.array(np.zeros(len(o), bool))], names)
                also = [(i, closing.value[k]) for i, k in enumerate(zip(o.tolist(), h.tolist())) if k in closing.value]
                if also:
                    rows = pa.array([i for i, _ in also])
                    yield pa.RecordBatch.from_arrays([pa.array([c for _, c in also], pa.int32()), *(c.take(rows) for c in columns), pa.array([True] * len(also))], names)

    placed = docs.mapInArrow(place, "range int, o long, h long, doc_id long, text string, ahead boolean")
    return placed.repartitionById(len(bounds.ids) + 1, F.col("range")).sortWithinPartitions("range", "ahead", "o", "h", "text").select("range", "doc_id", "text", "ahead")


def edited_text(text: str, successor: str) -> str:
    """``text`` with its last floor(n/4) code points replaced by the first as many (or all) of ``successor``."""
    k = len(text) // 4
    return text[: len(text) - k] + successor[:k]


def fingerprint_edits(documents: DataFrame, n_ranges: int) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness of its
    fingerprint to the edited text's and to the next document's."""

    def block(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        edits = [edited_text(t, n) for t, n in zip(texts, [*texts[1:], following])]
        own = fingerprints([*texts, following])
        changed = fingerprints(edits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edits]),
                pa.array([str(f) for f in own[:-1]]),
                pa.array([str(f) for f in changed]),
                pa.array([a.likeness(b) for a, b in zip(own, changed)], pa.float64()),
                pa.array([a.likeness(b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size = 0
        for batch in batches:
            for d, t, ahead in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if ahead and not held:  # a copy of a closing row that has done its work
                    continue
                if held and (ahead or size > 1 << 20):
                    yield block(held, t)
                    held, size = [], 0
                if not ahead:
                    held.append((d, t))
                    size += len(t)
        if held:  # not reached: each range ends with a row ahead
            yield block(held, "")

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(documents, n_ranges).mapInArrow(run, schema)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_documents(spark, sf_dir)
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return fingerprint_edits(documents, max(1, total // RANGE_BYTES))
