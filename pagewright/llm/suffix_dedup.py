"""Suffix-array dedup by distributed prefix doubling.

Two positions are repeats when their suffixes agree on ``length`` bytes. Spark sorts
(position, rank pair) rows at growing offsets: with ``u = length * 6 // 25`` a position's
first rank names its first u bytes, the pair of ranks at offsets 0 and u is sorted and
reranked for 2u bytes, the pair at offsets 0 and 2u for 4u bytes, and the last step passes
the threshold. After each step a position whose pair is unique leaves.

Sorting every byte position would move tens of times the input, so positions that need
no rank are taken out before, without losing a repeat:

1. *Anchors.* In every run of ``gram`` consecutive gram starts the smallest gram hash is
   picked; which one depends on those bytes alone, so two equal strings of ``length`` bytes
   hold the same picks. Spark counts the picked grams; a start whose string holds a unique
   pick is itself unique.
2. *Pieces.* Neighbouring starts that share their pick form a piece, named by its whole span
   (up to ``length`` and more bytes, 96 bits). Equal pieces are repeats throughout and one
   of them stands for all; a piece whose pick no other piece shares is unique.
3. *Grid.* Of the starts left, those at the same distance from their anchor modulo
   ``step = length - 4u`` agree on a grid that equal strings share; a start's string holds
   the 4u bytes behind the next grid position, so only grid positions are ranked.
4. *Last step.* A rank shared by blocks that are equal in all their strings marks these as
   repeats; the starts of the other blocks are compared by (rank, distance, the bytes
   around the ranked ones), which are whole strings.

First ranks are 64-bit hashes, pieces have 96-bit and blocks 128-bit names; ranks and starts
are compared by value. All counting is pre-aggregated, and ranks come back by equi-joins that Spark may
split, so a passage in a third of all documents forms no group.

Defined edge cases: null and empty texts and texts shorter than ``length`` lose
nothing; every row of equal texts of at least ``length`` bytes loses all its bytes
(each copy has another); overlapping occurrences in one text count; null ids and
repeated ids are kept apart by their texts; a very long text is worked on in stretches;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, cut, discard, keyed, numbered, read_documents, slices, with_row
from ._kernels import prefix_hash, sliding, span_hash

LENGTH = 400
STRETCH = 1 << 18
_PIECE = "array<struct<start:int,len:int,owner:long,s1:long,s2:int,again:boolean>>"
_ROW = np.dtype([("start", np.int32), ("len", np.int32), ("owner", np.int64), ("s1", np.int64), ("s2", np.int32), ("again", bool)])
_POSITION = "rid long, at int, a long, b long, grid boolean, blocks array<struct<near:int,far:int,known:boolean,edge:binary>>"


def gram_of(length: int) -> int:
    """Anchor gram and window length: window + gram - 1 <= length, short enough that
    the picks of a string cover its middle."""
    return max(1, length * 8 // 25)


def unit_of(length: int) -> int:
    """Bytes of the first ranks; four of them are at most ``length``."""
    if length < 5:
        raise ValueError("repeats of fewer than five bytes are not sought")
    return max(1, length * 6 // 25)


class _Text:
    """Gram hashes of a stretch of a text and the smallest of each window of gram starts."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        k = gram_of(length)
        self.k, self.length, self.n = k, length, len(data)
        self.prefix = prefix_hash(data)
        starts = np.arange(self.n - k + 1)
        self.hash = span_hash(self.prefix, starts, starts + k)
        self.low = sliding(self.hash, k, np.minimum)

    def picks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct picked gram names, and whether each occurs at several positions here."""
        names = np.unique(self.low)
        at = np.searchsorted(names, self.hash)
        at[at == len(names)] = 0
        count = np.bincount(at[names[at] == self.hash], minlength=len(names))
        return names, count > 1

    def places(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(base of each owner, sorted keys): the keys from an owner's base on are its base plus
        the starts where its gram occurs."""
        names, which = np.unique(owner, return_inverse=True)
        at = np.searchsorted(names, self.hash)
        at[at == len(names)] = 0
        here = np.flatnonzero(names[at] == self.hash)
        return which * (self.n + 1), np.sort(at[here] * (self.n + 1) + here)

    def pieces(self, repeated: np.ndarray) -> np.ndarray:
        """Pieces (``_ROW``) of the starts all of whose picks are among the repeated names."""
        names = np.unique(self.low)
        keep = np.isin(names, repeated)
        fine = keep[np.searchsorted(names, self.low)]
        inside = self.length - 2 * self.k + 2
        fine = sliding(fine, inside, np.minimum) if inside > 1 else fine
        starts = np.flatnonzero(fine)
        if not len(starts):
            return np.empty(0, _ROW)
        own = self.low[starts]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > 1) | (own[1:] != own[:-1]))))
        last = np.concatenate((first[1:], [len(starts)])) - 1
        s, e = starts[first], starts[last]
        base, keys = self.places(own[first])
        out = np.empty(len(s), _ROW)
        out["start"], out["len"], out["owner"] = s, e - s + 1, own[first].view(np.int64)
        out["s1"] = span_hash(self.prefix, s, e + self.length).view(np.int64)
        out["s2"] = (span_hash(self.prefix, s + 1, e + self.length - 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        out["again"] = np.searchsorted(keys, base + e + self.k) - np.searchsorted(keys, base + s) > 1
        return out


def _stretches(text: str | bytes, length: int, stretch: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of stretches that share no start and hold each start's string whole."""
    data = np.frombuffer(text if isinstance(text, bytes) else text.encode("utf-8"), np.uint8)
    for at in range(0, len(data) - length + 1, stretch):
        yield at, data[at : at + stretch + length - 1]


def _anchors(docs: DataFrame, length: int, stretch: int) -> DataFrame:
    """(rid, name, n): the picked names of each text; n is 2 for one that occurs again in it
    (or is picked in two stretches, which only keeps it in)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rid, names, counts = [], [], []
                for r, t in zip(column(part, "rid").to_pylist(), column(part, "text").to_pylist()):
                    for _, data in _stretches(t, length, stretch):
                        x, again = _Text(data, length).picks()
                        names.append(x)
                        counts.append(again)
                        rid.append(np.full(len(x), r, np.int64))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rid)), pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int8) + np.int8(1))], ["rid", "name", "n"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, name long, n byte")


def _candidates(docs: DataFrame, length: int, stretch: int, texts_too: bool) -> DataFrame:
    """(rid, doc_id, key, repeated, text) -> rid, doc_id, key, n_bytes, kept_sha256, text, pieces;
    without pieces the digest is final and the text is carried on only with ``texts_too``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                size, sha, texts, found, ends = [], [], [], [np.empty(0, _ROW)], [0]
                lists = column(part, "repeated")
                names, edge = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
                for i, t in enumerate(column(part, "text").to_pylist()):
                    data, n = t.encode("utf-8"), 0
                    if edge[i + 1] > edge[i]:
                        known = np.sort(names[edge[i] : edge[i + 1]])
                        for at, some in _stretches(data, length, stretch):
                            pieces = _Text(some, length).pieces(known)
                            pieces["start"] += at
                            found.append(pieces)
                            n += len(pieces)
                    ends.append(ends[-1] + n)
                    size.append(len(data))
                    sha.append(None if n else hashlib.sha256(data).hexdigest())
                    texts.append(t if n or texts_too else None)
                rows = np.concatenate(found)
                held = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[k])) for k in _ROW.names], list(_ROW.names))
                made = [pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("rid", "doc_id", "key")), *made], ["rid", "doc_id", "key", "n_bytes", "kept_sha256", "text", "pieces"])

    return docs.select("rid", "doc_id", "key", "repeated", "text").mapInArrow(run, f"rid long, doc_id long, key binary, n_bytes long, kept_sha256 string, text string, pieces {_PIECE}")


def _anchor_of(text: _Text, start: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The first occurrence at or after each start of the gram that the start's window picks."""
    base, keys = text.places(owner)
    return keys[np.searchsorted(keys, base + start)] - base


def grid_positions(data: np.ndarray, length: int, start: np.ndarray, size: np.ndarray, owner: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
    """The grid positions of the starts of some pieces of a stretch, and the blocks of starts
    that each stands for: at, near and far (distances of its last and first start), known, edge
    (the bytes around the ranked ones)."""
    unit = unit_of(length)
    step = length - 4 * unit
    text = _Text(data, length)
    piece = np.repeat(np.arange(len(start)), size)
    s = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    anchor = _anchor_of(text, s, owner[piece])
    g = anchor - (anchor - s) // step * step
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (piece[1:] != piece[:-1]))))
    last = np.concatenate((first[1:], [len(s)])) - 1
    at, far, near = g[first], g[first] - s[first], g[first] - s[last]
    padded = np.concatenate((np.zeros(step, np.uint8), data, np.zeros(step, np.uint8)))
    around = np.concatenate((np.arange(1, step), np.arange(step + 4 * unit, 2 * step + 4 * unit)))
    return {"at": at, "near": near, "far": far, "known": known[piece[first]], "edge": padded[at[:, None] + around[None, :]]}


def _positions(todo: DataFrame, length: int, stretch: int) -> DataFrame:
    """(rid, text, todo) -> the rows of the first sort: rid, at, a, b (names of the first and
    second unit), whether ``at`` is a grid position, and its blocks of starts."""
    unit = unit_of(length)

    def block_array(made: dict[str, np.ndarray], order: np.ndarray) -> pa.StructArray:
        edge = made["edge"][order]
        ends = (np.arange(len(edge) + 1) * edge.shape[1]).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends), pa.py_buffer(edge.tobytes())])
        return pa.StructArray.from_arrays([pa.array(made["near"][order], pa.int32()), pa.array(made["far"][order], pa.int32()), pa.array(made["known"][order]), held], ["near", "far", "known", "edge"])

    def rows(rid: int, text: str, todo: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = {"at": np.empty(0, np.int64), "near": np.empty(0, np.int64), "far": np.empty(0, np.int64), "known": np.empty(0, bool), "edge": np.empty((0, 2 * (length - 4 * unit) - 1), np.uint8)}
        ahead = np.empty(0, np.int64)  # positions of the second units
        parts = list(_stretches(text, length, stretch))
        for i, (base, data) in enumerate(parts):
            part = np.sort(todo[(todo["start"] >= base) & (todo["start"] < base + stretch)], order="start")
            if len(part):
                made = grid_positions(data, length, part["start"] - base, part["len"], part["owner"].view(np.uint64), part["known"])
                made["at"] += base
                held = {k: np.concatenate((held[k], made[k])) for k in held}
                ahead = np.concatenate((ahead, np.unique(made["at"]) + 2 * unit))
            # a position is given out once, by the stretch that it lies in
            ready, near = (x < base + stretch if i + 1 < len(parts) else np.ones(len(x), bool) for x in (held["at"], ahead))
            grid, count = np.unique(held["at"][ready], return_counts=True)
            further = np.setdiff1d(ahead[near], grid)
            at = np.concatenate((grid, further))
            if len(at):
                order = np.flatnonzero(ready)[np.argsort(held["at"][ready], kind="stable")]
                offsets = np.concatenate(([0], np.cumsum(count), np.full(len(further), len(order)))).astype(np.int32)
                prefix = prefix_hash(data)
                a, b = (span_hash(prefix, at - base + x, at - base + x + unit).view(np.int64) for x in (0, unit))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), rid, np.int64)), pa.array(at.astype(np.int32)), pa.array(a), pa.array(b), pa.array(np.arange(len(at)) < len(grid)), pa.ListArray.from_arrays(pa.array(offsets), block_array(held, order))],
                    ["rid", "at", "a", "b", "grid", "blocks"],
                )
            held, ahead = {k: v[~ready] for k, v in held.items()}, ahead[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.dtype([("start", np.int64), ("len", np.int64), ("owner", np.int64), ("known", bool)])
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lists = column(part, "todo")
                flat, edge = lists.values, lists.offsets.to_numpy()
                fields = np.empty(len(flat), kinds)
                for k in kinds.names:
                    fields[k] = flat.field(k).to_numpy(zero_copy_only=False)
                held: list[pa.RecordBatch] = []
                for i, (r, t) in enumerate(zip(column(part, "rid").to_pylist(), column(part, "text").to_pylist())):
                    held += rows(r, t, fields[edge[i] : edge[i + 1]])
                if held:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return todo.select("rid", "text", "todo").mapInArrow(run, _POSITION)


def rerank(pairs: DataFrame) -> DataFrame:
    """(rid, at, a, b, ...) -> the rows whose pair (a, b) is not unique, with ``rank``, the
    place of the pair in sorted order, instead of it."""
    again = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1")
    ranks = cut(again.select("a", "b").sort("a", "b").withColumn("rank", F.monotonically_increasing_id()), "ranks")
    out = cut(pairs.join(ranks, ["a", "b"]).drop("a", "b"), "ranked")
    discard(ranks)
    return out


def doubled(positions: DataFrame, length: int) -> DataFrame:
    """The rows of ``_positions`` -> rid, at, rank of the grid positions whose 4 * unit bytes
    are not unique; two have equal ranks when these bytes are equal."""
    two = rerank(positions.select("rid", "at", "grid", "a", "b"))
    ahead = two.select("rid", (F.col("at") - 2 * unit_of(length)).alias("at"), F.col("rank").alias("b"))
    pairs = cut(two.where("grid").select("rid", "at", F.col("rank").alias("a")).join(ahead, ["rid", "at"]), "pairs")
    four = rerank(pairs)
    discard(two, pairs)
    return four


def _repeats(positions: DataFrame, length: int) -> DataFrame:
    """(rid, start, len): the runs of repeated starts of the ranked blocks, but for those
    known before."""
    step = length - 4 * unit_of(length)
    ranked = doubled(positions, length)
    blocks = cut(positions.where("grid").select("rid", "at", F.inline("blocks")).join(ranked, ["rid", "at"]), "blocks")
    inside = F.expr(f"substring(edge, {step} - far, far - near + {step})")
    shaped = blocks.select("rid", "at", "near", "far", "known", "edge", "rank", F.xxhash64("near", "far", inside).alias("h"), F.xxhash64(F.lit(1), inside, "near", "far").alias("k"))
    ranks = shaped.groupBy("rank").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.count("*").alias("c"))
    ranks = cut(ranks.where("c > 1").select("rank", ((F.col("h0") == F.col("h1")) & (F.col("k0") == F.col("k1"))).alias("even")), "even")
    joined = cut(shaped.drop("h", "k").join(ranks, "rank"), "joined")
    whole = joined.where("even and not known").select("rid", (F.col("at") - F.col("far")).alias("start"), (F.col("far") - F.col("near") + 1).alias("len"))
    starts = joined.where("not even").select("rid", "at", "known", "rank", "edge", F.explode(F.sequence("near", "far")).alias("off"))
    starts = starts.select("rid", (F.col("at") - F.col("off")).alias("start"), "known", "rank", "off", F.expr(f"substring(edge, {step} - off, {step})").alias("bytes"))
    name = ["rank", "off", "bytes"]
    twice = cut(starts.groupBy(*name).agg(F.count("*").alias("c")).where("c > 1").select(*name), "twice")
    single = starts.where("not known").join(twice, name, "left_semi").select("rid", "start", F.lit(1).alias("len"))
    out = cut(whole.unionByName(single), "repeats")
    discard(ranked, blocks, ranks, joined, twice)
    return out


def merged(start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (begin, end) of the bytes of the strings at runs of starts."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order], (start + size - 1 + length)[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return begin[first], reach[np.concatenate((first[1:], [len(begin)])) - 1]


def _removal(docs: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, n_bytes, text, runs) -> key, doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept_text: removed bytes are those of a string at a repeated start, and the
    text loses what is left of characters that a cut divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lists = column(part, "runs")
                flat, edge = lists.values, lists.offsets.to_numpy()
                start, size = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "len"))
                removed, spans, shas, kepts = [], [], [], []
                for i, t in enumerate(column(part, "text").to_pylist()):
                    gone, count, data = 0, 0, t.encode("utf-8")
                    a, b = edge[i], edge[i + 1]
                    if lists[i].is_valid and b > a:
                        begin, end = merged(start[a:b], size[a:b], length)
                        gone, count = int((end - begin).sum()), len(begin)
                        data = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
                    for c, v in zip((removed, spans, shas, kepts), (gone, count, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "ignore"))):
                        c.append(v)
                made = [pa.array(c, x) for c, x in zip((removed, spans, shas, kepts), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("key", "doc_id", "n_bytes")), *made], ["key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return docs.select("key", "doc_id", "n_bytes", "text", "runs").mapInArrow(run, "key binary, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def repeated_spans(documents: DataFrame, length: int = LENGTH, stretch: int = STRETCH, texts_too: bool = False) -> DataFrame:
    """key, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text for every row; the
    remaining text may be null where nothing is removed, but for ``texts_too``. ``key`` is the
    row key of ``keyed``. Texts are worked on in stretches of ``stretch`` starts."""
    docs = numbered(keyed(documents))
    anchors = cut(_anchors(docs, length, stretch), "anchors")
    # counts are written before rows are joined with them: Spark splits the rows of a hot name
    # only where the join stands alone
    repeated = cut(anchors.groupBy("name").agg(F.sum("n").alias("c")).where("c > 1").select("name"), "repeated")
    by_doc = anchors.select("rid", "name").join(repeated, "name", "left_semi").groupBy("rid").agg(F.collect_set("name").alias("repeated"))  # bounded by one text
    found = cut(_candidates(docs.join(by_doc, "rid", "left"), length, stretch, texts_too), "candidates")
    discard(anchors, repeated)

    pieces = found.select("rid", F.inline("pieces"))
    name = ["owner", "s1", "s2"]
    # any member of a class may stand for it; all three values are of the same row
    classes = cut(pieces.groupBy(*name).agg(F.count("*").alias("c"), F.max("again").alias("again"), *[F.first(k).alias(k) for k in ("rid", "start", "len")]), "classes")
    several = classes.groupBy("owner").agg(F.count("*").alias("k"), F.max("again").alias("m")).where("k > 1 or m").select("owner")
    todo = classes.join(several, "owner", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("start", "len", "owner", (F.col("c") > 1).alias("known"))).alias("todo"))  # bounded by one text
    texts = found.where("size(pieces) > 0").select("rid", "text")
    positions = cut(_positions(todo.join(texts, "rid"), length, stretch), "positions")
    single = _repeats(positions, length)
    discard(positions)
    whole = pieces.join(classes.where("c > 1").select(*name), name, "left_semi").select("rid", "start", "len")
    runs = cut(whole.unionByName(single).groupBy("rid").agg(F.collect_list(F.struct("start", "len")).alias("runs")), "runs")  # bounded by one text
    discard(single, classes)
    # texts without pieces stay where they are
    fine = found.where("size(pieces) = 0").select("key", "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.col("text").alias("kept_text"))
    out = _removal(found.where("size(pieces) > 0").drop("pieces").join(runs, "rid", "left"), length).unionByName(fine)
    out.sources = (found, runs)
    return out


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents``, all columns, without the repeated bytes; characters that a cut divides
    go too, and a column n_chars follows the new text."""
    found = repeated_spans(documents, length)
    spans = found.where("n_removed > 0").select("key", "kept_text")
    changed = cut(spans.groupBy("key").agg(F.first("kept_text").alias("new_text")).withColumn("hit", F.lit(True)), "changed")
    discard(*found.sources)
    joined = with_row(documents).hint("merge").join(changed, "key", "left")
    columns = []
    for c in documents.columns:
        old = F.col(f"row.`{c}`")
        new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(documents.schema[c].dataType)}.get(c)
        columns.append((old if new is None else F.when(F.col("hit"), new).otherwise(old)).alias(c))
    return joined.select(*columns)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and the remaining text."""
    found = repeated_spans(read_documents(spark, sf_dir), texts_too=True)
    out = cut(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text")), "suffix-dedup")
    discard(*found.sources)
    return out


#: A well-formed character in bytes written as hexadecimal numbers, a blank before each.
_TAIL = " [89AB][0-9A-F]"
_CHARACTER = "|".join([" [0-7][0-9A-F]", f" (?:C[2-9A-F]|D[0-9A-F]){_TAIL}", f" E0 [AB][0-9A-F]{_TAIL}", f" E[1-9A-CEF]{_TAIL * 2}", f" ED [89][0-9A-F]{_TAIL}", f" F0 [9AB][0-9A-F]{_TAIL * 2}", f" F[1-3]{_TAIL * 3}", f" F4 8[0-9A-F]{_TAIL * 2}"])
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
  p AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
  r AS (SELECT doc_id, i FROM p WHERE m IN (SELECT m FROM p GROUP BY m HAVING count(*) > 1)),
  b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
  g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
  s AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, run),
  k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last FROM s GROUP BY doc_id),
  o AS (SELECT s.doc_id, s.a, coalesce(lag(s.z) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) AS y FROM s),
  t AS (SELECT o.doc_id, string_agg(substr(d.h, 2 * o.y + 1, 2 * (o.a - o.y)), '' ORDER BY o.a) AS kept FROM o JOIN d ON d.doc_id = o.doc_id GROUP BY o.doc_id),
  f AS (SELECT d.doc_id, d.n, d.x, k.n_removed, k.n_spans, CASE WHEN k.doc_id IS NULL THEN d.h ELSE t.kept || substr(d.h, 2 * k.last + 1) END AS h FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id)
  SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256,
    CASE WHEN n_removed IS NULL THEN x ELSE decode(unhex(replace(array_to_string(regexp_extract_all(regexp_replace(h, '(..)', ' \1', 'g'), '{_CHARACTER}'), ''), ' ', ''))) END AS text FROM f"""
