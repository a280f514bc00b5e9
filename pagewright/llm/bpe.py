"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved down to leaves that the merge library encodes; neighbouring
results are joined by re-encoding a window around the seam. The window grows
outwards until both its edges are *stable cuts*: a visible ASCII sign or word
character followed by a blank, tab or line break. No alternative of the splitting
pattern matches white space after anything else, so every tokenisation of any text
that holds these two characters has a match boundary between them; the pattern
looks only forward, and what it looks at from the left of the cut (the character
after a run of white space) is never beyond a cut. Tokens outside the window are
therefore those of the whole text, and joining is associative: the tree may be cut
anywhere. Decoding concatenates the leaves' bytes up the same kind of tree.

Defined edge cases: null and empty texts have no tokens; a text without any stable
cut is re-encoded whole at each join; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from ._common import column, read_documents, select_documents, slices

LEAF_CHARS = 4096
LEAF_IDS = 8192
_CUT = re.compile(r"[!-~\w](?=[ \t\n\r])")
RANKS = "byte_bpe_multi_50k.tiktoken"


class TreeCodec:
    """Encoder and decoder for one rank file (``{bytes: rank}``) and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS) -> None:
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.leaf_chars = max(2, leaf_chars)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf_chars:
            return self.encoding.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._encode(text, a, mid), self._encode(text, mid, b))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        lo, hi = self._left_edge(text, a, mid), self._right_edge(text, mid, b)
        if lo == hi:
            return left + right
        keep, skip = len(left), 0
        gone = len(text[lo:mid].encode("utf-8"))
        while gone > 0:
            keep -= 1
            gone -= int(self.width[left[keep]])
        gone = len(text[mid:hi].encode("utf-8"))
        while gone > 0:
            gone -= int(self.width[right[skip]])
            skip += 1
        return left[:keep] + self.encoding.encode_ordinary(text[lo:hi]) + right[skip:]

    @staticmethod
    def _left_edge(text: str, a: int, mid: int) -> int:
        """The last stable cut at or before ``mid``, else ``a``; looked for in growing windows."""
        size = 32
        while True:
            lo = max(a, mid - size)
            last = -1
            for m in _CUT.finditer(text, lo, min(mid + 1, len(text))):
                last = m.end()
            if last >= 0:
                return last
            if lo == a:
                return a
            size *= 4

    @staticmethod
    def _right_edge(text: str, mid: int, b: int) -> int:
        """The first stable cut at or after ``mid``, else ``b``."""
        m = _CUT.search(text, max(mid - 1, 0), b)
        return m.end() if m else b

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.encoding.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(name: str = RANKS, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """The codec of a vocabulary file of the installed ``public_tokenizers`` package."""
    return TreeCodec(load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN, leaf_chars)


def bpe_encode(documents: DataFrame, ranks: str = RANKS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, leaf_chars)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [c.encode(t) for t in column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return select_documents(documents).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, data binary): the decoded bytes of every row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                data = [c.decode(x or []) for x in column(part, "ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def bpe_round_trip(documents: DataFrame, ranks: str = RANKS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass,
    so that neither ids nor decoded bytes leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, leaf_chars)
        for batch in batches:
            for part in slices(batch, "text"):
                n, a, b = [], [], []
                for text in column(part, "text").to_pylist():
                    ids = c.encode(text)
                    n.append(len(ids))
                    a.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return select_documents(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_documents(spark, sf_dir))
