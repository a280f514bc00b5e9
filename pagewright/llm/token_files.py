"""Token files: independent zstandard frames with a trailing seek table.

File layout (all integers little-endian)::

    frame of document 0 | frame of document 1 | ... | seek table | footer

Each frame is one document's ids (uint16 or uint32 by ``id_bytes``), compressed by
itself and with zstandard's content checksum. The seek table is one zstandard frame
over arrays of doc_id (int64), frame length (uint32), token count (uint32), the crc32 of
the ids as uint32 (uint32) and whether the doc_id is null (uint8). The footer is ``table length u64 | documents
u64 | tokens u64 | id_bytes u32 | magic u32``. A reader fetches the footer, the
table and then only the frames of the documents that it wants.

Documents lie in ascending doc_id order within and across files; the files are ranges
of (doc_id, text hash, row number) holding about ``file_bytes`` of text each, so that even
rows of one id are dealt to several files. Every file is written under an attempt's own
name and then moved, so a retried task replaces it whole.

Defined edge cases: a null or empty text gives the end id alone; equal doc_ids lie
next to one another, ordered by a hash of their texts; null doc_ids come first and are
marked in the seek table; strings of the vocabulary's special tokens get their ids, as
the library gives them; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import column, cut, read_documents, select_documents, shared_dir, slices
from ._kernels import buffer, prefix_hash, span_hash, words

VOCABULARY = "word_bpe_49k.json"
_FOOTER = struct.Struct("<QQQII")
_MAGIC = 0x325A4B54


class WordEncoder:
    """The library's encoding, with the ids of white-space separated chunks remembered.

    The vocabulary's pipeline (canonical composition, white space to blanks, lower
    case, a splitting pattern that drops white space) treats chunks between ASCII
    white space independently, so the ids of a text are those of its chunks in
    order. A full stop or comma that ends a chunk after a letter is a piece of its
    own for the pattern and so a chunk here. Chunks are known by the 64-bit hash of
    their bytes, A-Z lower-cased; unknown ones are encoded together, with a mark
    between them that no such chunk holds. The memory (sorted arrays of hashes and places,
    the latest apart until they are many) is emptied when full. Texts that hold the string
    of a special token go to the library whole."""

    MARK = "\ue000"

    def __init__(self, path: str, capacity: int = 1_000_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode("utf-8") for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.capacity = capacity
        self.mark = np.array(self._ids(self.MARK), dtype="<u4")
        self._forget()

    def _forget(self) -> None:
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.known, self.latest = none, none
        self.size = 0
        self.flat = np.empty(1 << 16, dtype="<u4")
        self.begin = np.zeros(1 << 14, dtype=np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_many(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets by text) of a string column without nulls."""
        data, offsets = buffer(arr)
        apart = self._with_special(data, offsets)
        if not len(apart):
            return self._encode_chunks(data, offsets)
        texts = arr.to_pylist()
        flat, at = self._encode_chunks(*buffer(pa.array(["" if i in set(apart.tolist()) else t for i, t in enumerate(texts)], pa.string())))
        ids = [flat[a:b] for a, b in zip(at, at[1:])]
        for i in apart.tolist():
            ids[i] = np.array(self._ids(texts[i]), dtype="<u4")
        return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))

    def _with_special(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold the string of a special token."""
        raw, found = data.tobytes(), []
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
        return np.unique(np.searchsorted(offsets, np.array(found, np.int64), side="right") - 1)

    def _encode_chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offsets) - 1
        start, end, doc = _chunks(data, offsets)
        if not len(start):
            return np.empty(0, "<u4"), np.zeros(n_docs + 1, np.int64)
        keys, first, which = np.unique(span_hash(prefix_hash(data, lower=True), start, end), return_index=True, return_inverse=True)
        if self.size + len(keys) > self.capacity:
            self._forget()
        slots = np.full(len(keys), -1, np.int64)
        for held, place in (self.known, self.latest):
            if len(held):
                i = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[i] == keys
                slots[hit] = place[i[hit]]
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            raw = data.tobytes()
            at = first[missing]
            chunks = [raw[a:b].decode("utf-8") for a, b in zip(start[at].tolist(), end[at].tolist())]
            slots[missing] = self._learn(keys[missing], chunks)
        s = slots[which]
        base = self.begin[s]
        size = self.begin[s + 1] - base
        after = np.cumsum(size)
        ids = self.flat[np.repeat(base - after + size, size) + np.arange(after[-1])]
        return ids, np.concatenate(([0], after))[np.searchsorted(doc, np.arange(n_docs + 1))]

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> np.ndarray:
        first = self.size
        for i in range(0, len(chunks), 64):
            self._append(self._encode(chunks[i : i + 64]))
        places = np.arange(first, self.size)
        self.latest = self._merged(self.latest, (keys, places))
        if len(self.latest[0]) > 1 << 16:
            self.known, self.latest = self._merged(self.known, self.latest), (np.empty(0, np.uint64), np.empty(0, np.int64))
        return places

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, places = (np.concatenate(x) for x in zip(a, b))
        order = np.argsort(keys, kind="stable")
        return keys[order], places[order]

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        if any(self.MARK in c for c in chunks):
            return [np.array(self._ids(c), dtype="<u4") for c in chunks]
        ids = np.array(self._ids(f" {self.MARK} ".join(chunks)), dtype="<u4")
        at = np.ones(max(len(ids) - len(self.mark) + 1, 0), dtype=bool)
        for j, m in enumerate(self.mark):
            at &= ids[j : j + len(at)] == m
        seams = np.flatnonzero(at).tolist()
        if len(seams) != len(chunks) - 1:
            return [np.array(self._ids(c), dtype="<u4") for c in chunks]
        return [ids[a:b] for a, b in zip([0, *(x + len(self.mark) for x in seams)], [*seams, len(ids)])]

    def _append(self, ids: list[np.ndarray]) -> None:
        k = self.size
        ends = self.begin[k] + np.cumsum([len(x) for x in ids])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while len(self.begin) < k + len(ids) + 1:
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
        self.flat[self.begin[k] : ends[-1]] = np.concatenate(ids)
        self.begin[k + 1 : k + 1 + len(ids)] = ends
        self.size = k + len(ids)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated chunks, a closing full stop or comma after a letter apart."""
    start, end, doc = words(data, offsets)
    if not len(start):
        return start, end, doc
    last, before = data[end - 1], data[np.maximum(end - 2, 0)] | 0x20
    stop = ((last == 0x2E) | (last == 0x2C)) & (end - start > 1) & (before >= 0x61) & (before <= 0x7A)
    shift = np.cumsum(stop) - stop
    at = np.arange(len(start)) + shift
    n = len(start) + int(stop.sum())
    s, e, d = (np.empty(n, np.int64) for _ in range(3))
    s[at], e[at], d[at] = start, end - stop, doc
    s[at[stop] + 1], e[at[stop] + 1], d[at[stop] + 1] = end[stop] - 1, end[stop], doc[stop]
    return s, e, d


@lru_cache(maxsize=1)
def encoder(name: str) -> WordEncoder:
    return WordEncoder(public_tokenizers.path(name))


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def encode_frames(texts: pa.Array, end_id: int, id_bytes: int, vocabulary: str) -> Iterator[tuple[int, int, bytes]]:
    """(number of ids, their crc32, frame) of each text of a column without nulls."""
    enc, pack = encoder(vocabulary), zstandard.ZstdCompressor(level=1, write_checksum=True)
    tail = np.array([end_id], dtype="<u4")
    flat, at = enc.encode_many(texts)
    for a, b in zip(at.tolist(), at[1:].tolist()):
        ids = np.concatenate((flat[a:b], tail))
        yield len(ids), zlib.crc32(ids.tobytes()), pack.compress(ids.astype(f"<u{id_bytes}").tobytes())


class FileWriter:
    """Appends frames to one file and closes it with its seek table."""

    def __init__(self, folder: str, name: str, id_bytes: int) -> None:
        self.fs, root = _fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temporary = f"{root}/{name}", f"{root}/_{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.id_bytes = id_bytes
        self.rows: list[tuple[int, int, int, int, bool]] = []

    def add(self, doc_id: int | None, n: int, crc: int, frame: bytes) -> None:
        self.out.write(frame)
        self.rows.append((doc_id or 0, len(frame), n, crc, doc_id is None))

    def close(self) -> tuple[int, int]:
        ids, lengths, counts, crcs, nulls = zip(*self.rows)
        tokens = int(np.sum(counts, dtype=np.int64))
        table = np.array(ids, "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + np.array(counts, "<u4").tobytes() + np.array(crcs, "<u4").tobytes() + np.array(nulls, "u1").tobytes()
        packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(table)
        self.out.write(packed)
        self.out.write(_FOOTER.pack(len(packed), len(ids), tokens, self.id_bytes, _MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return len(ids), tokens


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        self.fs, path = _fs(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        table_len, n, self.n_tokens, self.id_bytes, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is not a token file")
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(table_len, size - _FOOTER.size - table_len))
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.nulls = np.frombuffer(raw, "u1", n, 20 * n).astype(bool)
        lengths, self.counts, self.crcs = (np.frombuffer(raw, "<u4", n, 8 * n + 4 * n * k).astype(np.int64) for k in range(3))
        self.begin = np.concatenate(([0], np.cumsum(lengths)))
        self.unpack = zstandard.ZstdDecompressor()

    def frames(self, index: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids) of the given documents; the frame's and the table's checksums are verified."""
        for i in index:
            frame = self.file.read_at(int(self.begin[i + 1] - self.begin[i]), int(self.begin[i]))
            yield i, self._ids(i, frame)

    def all(self, block: int = 8 << 20) -> Iterator[np.ndarray]:
        """Ids of every document in order, read in large blocks."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.begin, self.begin[i] + block, side="right")) - 1)
            data = self.file.read_at(int(self.begin[j] - self.begin[i]), int(self.begin[i]))
            for k in range(i, j):
                yield self._ids(k, data[self.begin[k] - self.begin[i] : self.begin[k + 1] - self.begin[i]])
            i = j

    def _ids(self, i: int, frame: bytes) -> np.ndarray:
        ids = np.frombuffer(self.unpack.decompress(frame), f"<u{self.id_bytes}").astype("<u4")
        if len(ids) != self.counts[i] or zlib.crc32(ids.tobytes()) != self.crcs[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return ids

    def close(self) -> None:
        self.file.close()


def write_token_files(documents: DataFrame, folder: str, end_id: int, file_bytes: int = 64 << 20, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the files and return their manifest (file, n_docs, n_tokens, start), where
    ``start`` is the number of ids in all files before; one row a file."""
    docs = select_documents(documents)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    ordered = named.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        writer = None
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, made in zip(column(part, "doc_id").to_pylist(), encode_frames(column(part, "text"), end_id, 2, vocabulary)):
                    writer = writer or FileWriter(folder, f"tokens-{file:06d}.tkz", 2)
                    writer.add(doc_id, *made)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["file", "n_docs", "n_tokens"])

    written = cut(ordered.select("doc_id", "text").mapInArrow(run, "file int, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, start in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist()):
                t = TokenFile(f"{folder}/tokens-{f:06d}.tkz")
                n, crc = [], []
                for ids in t.all():
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                t.close()
                n = np.array(n, np.int64)
                at = start + np.cumsum(n) - n
                ids = pa.array(t.doc_ids, pa.int64(), mask=t.nulls)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartitionById(n, F.col("file")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    return read_token_files(write_token_files(read_documents(spark, sf_dir), folder, end_id=2, file_bytes=32 << 20), folder)
