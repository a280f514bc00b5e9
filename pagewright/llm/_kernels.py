"""Vectorised text kernels on the byte buffers of Arrow string columns.

Hashes are polynomial over 64-bit words: ``H(s, e) = sum(value[b_i] * P**(i - s))``
modulo 2**64, read off prefix sums, then passed through a finaliser. Equal byte
strings always have equal hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_FIVE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (in place on a copy)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    x &= _M64
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUES = _VALUES[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of the base and of its inverse, kept up to the longest buffer seen (bounded)."""

    def __init__(self) -> None:
        self.p = np.ones(1, dtype=np.uint64)
        self.q = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            size = max(n, 1 << 16)
            p = np.full(size, _P, dtype=np.uint64)
            p[0] = 1
            q = np.full(size, _P_INV, dtype=np.uint64)
            q[0] = 1
            p, q = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
            if size > 1 << 22:  # a huge text: not kept
                return p, q
            self.p, self.q = p, q
        return self.p, self.q


_POWERS = _Powers()


def buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = pa.compute.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums S with H(s, e) = (S[e] - S[s]) * P**-s."""
    p, _ = _POWERS.upto(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((_LOWER_VALUES if lower else _VALUES)[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Finalised hashes of the spans [start, end)."""
    _, q = _POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start])


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of the maximal runs of word bytes; a document's
    edges end a run. Default word bytes: all but ``\\x20\\x09-\\x0D``."""
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    inside = ~_SPACE[data] if word_byte is None else word_byte[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingles(arr: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word shingle, A-Z lower-cased, in text order
    and with repeats. A text of fewer words gives its whole word sequence as one
    shingle, a text without words none."""
    data, offsets = buffer(arr)
    start, end, doc = words(data, offsets)
    if len(start) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = span_hash(prefix_hash(data, lower=True), start, end)
    return combine_words(word, doc, len(offsets) - 1, size)


def combine_words(word: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(doc, minlength=n_docs)
    n = len(word) - size + 1
    if n > 0:
        h = word[:n].copy()
        for j in range(1, size):
            h *= _FIVE
            h += word[j : n + j]
        keep = doc[:n] == doc[size - 1 :]
        h, d = mix(h)[keep], doc[:n][keep]
    else:
        h, d = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))
        extra = np.empty(len(short), np.uint64)
        for k, s in enumerate(short):
            x = 0
            for w in word[begin[s] : begin[s + 1]]:
                x = (x * int(_FIVE) + int(w)) & _M64
            extra[k] = mix_int(x + 0x51ED2701 * int(counts[s]))
        h, d = np.concatenate((h, extra)), np.concatenate((d, short))
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def distinct(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) pairs sorted by document then hash, and offsets by document."""
    out, sizes = [], np.zeros(n_docs, np.int64)
    edges = np.searchsorted(d, np.arange(n_docs + 1))
    for i in range(n_docs):
        u = np.unique(h[edges[i] : edges[i + 1]])
        sizes[i] = len(u)
        out.append(u)
    off = np.concatenate(([0], np.cumsum(sizes)))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.repeat(np.arange(n_docs), sizes), off


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window of ``width`` values, by doubling."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = op(out[:-step], out[step:])
        done += step
    return out
