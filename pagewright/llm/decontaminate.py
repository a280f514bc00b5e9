"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND.

Test items are indexed by their words; the impact of a word on an item is its BM25
weight divided by the item's score against itself, so a passage that holds the whole
item scores 1 and one threshold (``RETRIEVE``) serves all items. Every training
text is cut into overlapping passages long enough to hold any item of the index whole,
and every passage is a query:

* postings are kept in blocks of items with their greatest impact. For a whole slice
  of texts at once, the block-max bounds of all passages are summed (words too common
  to matter alone enter by their greatest sum over a block); a passage none of whose
  blocks can reach the threshold is done;
* the others are run through the block-max WAND loop on the blocks that can, which
  returns every item at or above the threshold.

A retrieved item is verified part by part: at least ``CONTAINED`` of the five-word shingles
of its question must lie in the passage, and at least ``ANSWER`` of the words of its answer
(the last sentence, or the last fifth of a single one). A question alone, or an answer
alone, is no contamination; a part without words asks for nothing.

Items are indexed by classes of similar length. Indexes of at most ``INDEX_ITEMS`` items and
``INDEX_BYTES`` bytes together share one pass over the texts and their hashed words, so a
large benchmark needs more passes, not more memory.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Defined edge
cases: null and empty texts are clean; items without words are never found; an item of
fewer than five words, and a question of fewer, has to occur as its word sequence; repeated
rows get the same verdict each; an empty benchmark leaves every text clean; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, cut, filter_rows, keyed, read_documents, slices
from ._kernels import buffer, combine_words, prefix_hash, span_hash, words

RETRIEVE = 0.5
CONTAINED = 0.8
ANSWER = 0.5
INDEX_ITEMS = 20_000
INDEX_BYTES = 32 << 20
ENTRIES = 1 << 21
ITEM_BLOCK = 2
K1, B = 1.2, 0.75
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffer(arr)
    start, end, doc = words(data, offsets, _WORD)
    return (span_hash(prefix_hash(data, lower=True), start, end) if len(start) else np.empty(0, np.uint64)), doc


def _by_text(texts) -> list[np.ndarray]:
    """The word hashes of each text, in order."""
    hashes, doc = _hashes(pa.array(list(texts), pa.string()))
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [hashes[a:b] for a, b in zip(edge, edge[1:])]


def _occurs(words: np.ndarray, passage: np.ndarray) -> bool:
    """Whether a word sequence occurs in the passage; one without words does."""
    if not len(words):
        return True
    same = np.ones(max(len(passage) - len(words) + 1, 0), dtype=bool)
    for j, w in enumerate(words):
        same &= passage[j : j + len(same)] == w
    return bool(same.any())


def split_answer(text: str) -> tuple[str, str]:
    """(question, answer) of an item."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    tokens = text.split()
    k = max(1, len(tokens) // 5)
    return " ".join(tokens[:-k]), " ".join(tokens[-k:])


@dataclass
class ItemIndex:
    """Inverted index of some items with block maxima; built from (item_id, text)."""

    item_ids: list[int]
    texts: list[str]
    span: int = 0
    vocabulary: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.texts)
        hashes, doc = _hashes(pa.array(self.texts, pa.string()))
        length = np.bincount(doc, minlength=n)
        self.span = int(length.max()) * 5 // 4 + 1 if len(hashes) else 1
        self.vocabulary, term = np.unique(hashes, return_inverse=True)
        v = len(self.vocabulary)
        key, tf = np.unique(term * n + doc, return_counts=True)
        t, item = key // n, key % n
        df = np.bincount(t, minlength=v)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        mean = length.mean() if n else 1.0
        weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
        own = np.bincount(item, weights=weight, minlength=n)
        impact = weight / np.maximum(own[item], 1e-12)
        self.first = np.searchsorted(t, np.arange(v + 1))
        self.items, self.impacts = item, impact
        # words that no item can be retrieved by: the commonest, while their sum stays below the threshold everywhere
        common = np.zeros(v, dtype=bool)
        total = np.zeros(n)
        for x in np.argsort(-df, kind="stable"):
            a, b = self.first[x], self.first[x + 1]
            if df[x] * 50 < n or (total[item[a:b]] + impact[a:b]).max() >= 0.5 * RETRIEVE:
                break
            total[item[a:b]] += impact[a:b]
            common[x] = True
        self.common = common
        self.n_blocks = -(-n // ITEM_BLOCK)
        self.common_bound = np.zeros(self.n_blocks)
        np.maximum.at(self.common_bound, np.arange(n) // ITEM_BLOCK, total)
        bkey, at = np.unique(t * self.n_blocks + item // ITEM_BLOCK, return_index=True)
        top = np.maximum.reduceat(impact, at) if len(at) else np.empty(0)
        self.block_first = np.searchsorted(bkey // self.n_blocks, np.arange(v + 1))
        self.blocks, self.block_top = bkey % self.n_blocks, top
        self.term_top = np.maximum.reduceat(impact, self.first[:-1]) if v else np.empty(0)
        # direct addressing by 16 bits before the binary search
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        questions, answers = zip(*map(split_answer, self.texts)) if n else ((), ())
        self.questions = [q if len(w) >= 5 else w for q, w in zip(_by_text(questions), _by_text(self.texts))]
        self.answers = [np.unique(a) for a in _by_text(answers)]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        near = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(near) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == hashes[near]
            out[near[hit]] = at[hit]
        return out

    def search(self, terms: np.ndarray, threshold: float = RETRIEVE, block: int | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) with score >= threshold for a set of distinct
        terms, among all items or those of one block."""
        items, impacts = self.items, self.impacts
        cursors = [[int(self.first[t]), int(self.first[t + 1]), float(self.term_top[t]), int(t)] for t in terms]
        if block is not None:
            lo, hi = block * ITEM_BLOCK, (block + 1) * ITEM_BLOCK
            for c in cursors:
                part = items[c[0] : c[1]]
                c[0], c[1], c[2] = c[0] + int(part.searchsorted(lo)), c[0] + int(part.searchsorted(hi)), self._block_top(c[3], block)
        found = []
        while True:
            cursors = [c for c in cursors if c[0] < c[1]]
            cursors.sort(key=lambda c: items[c[0]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                return found
            at = int(items[cursors[pivot][0]])
            while pivot + 1 < len(cursors) and items[cursors[pivot + 1][0]] == at:
                pivot += 1
            block = at // ITEM_BLOCK
            limit = sum(self._block_top(c[3], block) for c in cursors[: pivot + 1])
            if limit < threshold - 1e-9:
                after = min((block + 1) * ITEM_BLOCK, int(items[cursors[pivot + 1][0]]) if pivot + 1 < len(cursors) else len(self.texts))
                for c in cursors[: pivot + 1]:
                    c[0] += int(np.searchsorted(items[c[0] : c[1]], max(after, at + 1)))
                continue
            if items[cursors[0][0]] == at:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += float(impacts[c[0]])
                    c[0] += 1
                if score >= threshold - 1e-9:
                    found.append((at, score))
            else:
                for c in cursors[:pivot]:
                    if items[c[0]] < at:
                        c[0] += int(np.searchsorted(items[c[0] : c[1]], at))

    def _block_top(self, term: int, block: int) -> float:
        a, b = self.block_first[term], self.block_first[term + 1]
        i = a + self.blocks[a:b].searchsorted(block)
        return float(self.block_top[i]) if i < b and self.blocks[i] == block else 0.0

    def verify(self, item: int, passage: np.ndarray) -> bool:
        """Whether the words of a passage hold the item's question and its answer."""
        question, answer = self.questions[item], self.answers[item]
        if len(question) < 5:
            if not _occurs(question, passage):
                return False
        else:
            shingles, held = (np.unique(combine_words(x, np.zeros(len(x), np.int64), 1)[0]) for x in (question, passage))
            if np.isin(shingles, held, assume_unique=True).sum() < CONTAINED * len(shingles):
                return False
        return not len(answer) or np.isin(answer, passage).mean() >= ANSWER

    def hits(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> list[tuple[int, int, float]]:
        """(text index, item index, score) of every verified item of each of n texts, from the
        hashes of their words and the text of each."""
        if not len(hashes) or not len(self.vocabulary):
            return []
        step = self.span
        begin = np.searchsorted(doc, np.arange(n + 1))
        count = np.diff(begin)
        n_windows = np.maximum(1, -(-count // step) - 1) * (count > 0)
        base = np.concatenate(([0], np.cumsum(n_windows)))
        term = self.terms(hashes)
        at = np.flatnonzero(term >= 0)
        rare = at[~self.common[term[at]]]
        slot = (rare - begin[doc[rare]]) // step
        d = doc[rare]
        window = np.concatenate((base[d] + slot, base[d] + slot - 1))
        valid = np.concatenate((slot < n_windows[d], slot > 0))
        t = np.concatenate((term[rare], term[rare]))
        window, t = window[valid], t[valid]
        pair = np.unique(window * len(self.vocabulary) + t)
        window, t = pair // len(self.vocabulary), pair % len(self.vocabulary)
        size = self.block_first[t + 1] - self.block_first[t]
        if not size.sum():
            return []
        cells = self._promising(window, t, size)
        out: dict[tuple[int, int], float] = {}
        for cell in cells.tolist():
            w, block = divmod(cell, self.n_blocks)
            i = int(np.searchsorted(base, w, side="right")) - 1
            a = begin[i] + (w - base[i]) * step
            b = min(a + 2 * step, begin[i + 1])
            inside = term[a:b]
            for item, score in self.search(np.unique(inside[inside >= 0]), RETRIEVE, block):
                if self.verify(item, hashes[a:b]):
                    out[i, item] = max(score, out.get((i, item), 0.0))
        return [(i, item, s) for (i, item), s in out.items()]

    def _promising(self, window: np.ndarray, t: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(window, block) cells whose bound reaches the threshold, from the sorted (window,
        term) pairs and the blocks of each term; windows are taken together up to ENTRIES."""
        first = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        upto = np.cumsum(np.add.reduceat(size, first))
        out, done = [], 0
        while done < len(first):
            last = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + ENTRIES, side="right")))
            pairs = slice(first[done], first[last] if last < len(first) else len(window))
            w, x, k = window[pairs], t[pairs], size[pairs]
            after = np.cumsum(k)
            entry = np.repeat(self.block_first[x] - after + k, k) + np.arange(after[-1])
            cells, which = np.unique(np.repeat(w, k) * self.n_blocks + self.blocks[entry], return_inverse=True)
            bound = np.bincount(which, weights=self.block_top[entry], minlength=len(cells)) + self.common_bound[cells % self.n_blocks]
            out.append(cells[bound >= RETRIEVE - 1e-9])
            done = last
        return np.concatenate(out)


def item_indexes(benchmark: DataFrame) -> Iterator[list[ItemIndex]]:
    """Indexes of items of lengths within a factor of four, those of one pass together."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("size", F.greatest(F.floor(F.log(4.0, F.greatest(F.length("text"), F.lit(1)) / 400.0)).cast("int"), F.lit(0)))
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).orderBy("size").collect()
    held, items, size = [], 0, 0
    for s in sizes:
        parts = max(-(-s.n // INDEX_ITEMS), -(-(s.b or 0) // INDEX_BYTES))
        for p in range(parts):
            block = rows.where((F.col("size") == s["size"]) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p))
            found = block.select("item_id", "text").orderBy("item_id", "text").collect()  # about INDEX_ITEMS rows, INDEX_BYTES bytes
            more = sum(len(r.text) for r in found)
            if held and (items + len(found) > INDEX_ITEMS or size + more > INDEX_BYTES):
                yield held
                held, items, size = [], 0, 0
            held, items, size = [*held, ItemIndex([r.item_id for r in found], [r.text for r in found])], items + len(found), size + more
    if held:
        yield held


def _hits(indexes: list[ItemIndex], texts: pa.Array) -> Iterator[tuple[int, int, float]]:
    """(text index, item id, score) of every verified item of the indexes."""
    hashes, doc = _hashes(texts)
    for x in indexes:
        for i, item, score in x.hits(hashes, doc, len(texts)):
            yield i, x.item_ids[item], score


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, score): the verified items of every text."""
    docs, spark = keyed(documents), documents.sparkSession
    found = []
    for indexes in item_indexes(benchmark):
        held = spark.sparkContext.broadcast(indexes)
        found.append(cut(docs.select("key", "text").mapInArrow(_scan(held), "key binary, item_id long, score double"), "contamination"))
        held.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "key binary, item_id long, score double")


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hits = list(_hits(held.value, column(part, "text")))
                if hits:
                    rows, items, scores = zip(*hits)
                    yield pa.RecordBatch.from_arrays([column(part, "key").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(scores, pa.float64())], ["key", "item_id", "score"])

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, items (sorted item ids), best_score for every row; no items: clean."""
    hits = contamination(documents, benchmark)
    by_doc = hits.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("score").alias("best_score"))
    rows = keyed(documents).select("key", "doc_id")
    return rows.join(by_doc, "key", "left").select("key", "doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, in which no item is found."""
    for indexes in item_indexes(benchmark):
        held = documents.sparkSession.sparkContext.broadcast(indexes)

        def clean(texts: pa.Array, held=held) -> np.ndarray:
            keep = np.ones(len(texts), dtype=bool)
            keep[[h[0] for h in _hits(held.value, texts)]] = False
            return keep

        documents = filter_rows(documents, clean)
    return documents


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), "items", "best_score", (F.size("items") == 0).alias("kept"))
