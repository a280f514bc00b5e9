"""MinHash near-dedup with an LSH forest.

1. Every text gets the set of its five-word shingles and a signature of ``HASHES``
   minimum hashes. Texts with equal sets are one *node* from here on.
2. *Forest.* ``TREES`` different orders of the signature each sort all nodes; nodes
   that share a prefix of ``DEPTH`` values in an order meet there and all their pairs
   are compared by signature. Where more than ``CROWD`` nodes share a prefix, the region
   is first sorted by a longer one, its depth adapted to the crowd, and the neighbours
   with the longest common prefix meet in overlapping blocks of the sorted run, which
   ties the crowd together cheaply. The nodes that this leaves outside of the region's
   largest group are then compared with all of the region, block by block, so that the
   longer prefix misses no pair. Nodes whose signatures agree closely enough become
   provisionally linked, by links to one node of each group only.
3. *Confirmation.* The provisional groups hold every link with near certainty (see
   README). A group of at most ``BLOCK`` nodes is compared on the full shingle sets, all
   pairs at once. Of a larger one, first each block and its links to the group's first
   block are, then the nodes that remain outside of the largest part with all nodes, in
   pairs of blocks: a pair within one part needs no comparison. Only links to one
   node of each group leave a unit of work. No pair is dropped, and no pairs are listed.
4. Components of the confirmed links give each node, and so each document, its group.

Defined edge cases: fewer words than five give one shingle, the whole sequence; null,
empty and wordless texts have an empty set and stay alone, with their own id as
component; repeated rows belong to one node; a null id counts as the smallest and is
returned as null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, cut, discard, id_order, keyed, read_documents, slices, with_row
from ._components import components
from ._kernels import distinct, mix, mix_int, shingles

HASHES = 128
TREES = 24
DEPTH = 4
CROWD = 1024
BLOCK = 512
SWEEP = 64
_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_ORDERS = np.array([np.argsort(mix(np.arange(HASHES, dtype=np.uint64) + np.uint64(7919 * (t + 1)))) for t in range(TREES)])


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minima of HASHES functions over each document's (non-empty) run of shingle hashes."""
    n = len(offsets) - 1
    out = np.zeros((n, HASHES), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        x = (h >> np.uint64(32)).astype(np.uint32)
        for j in range(HASHES):
            out[full, j] = (np.minimum.reduceat(x * _A[j] + _B[j], offsets[full]) & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def _node(s: np.ndarray) -> int:
    """64-bit name of a set of shingle hashes, as a signed integer."""
    x = mix_int(int(s.sum(dtype=np.uint64)) ^ mix_int(int(np.bitwise_xor.reduce(s)) + len(s)))
    return x - (1 << 64) if x >> 63 else x


def _meetings(nodes: DataFrame) -> DataFrame:
    """(node, sig) -> node, tree, root for every tree; a root is the name of an order and the
    prefix of DEPTH values in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint16).reshape(n, HASHES)
            for t in range(TREES):
                root = mix(np.ascontiguousarray(sig[:, _ORDERS[t][:DEPTH]]).view(np.uint64).ravel() + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(np.full(n, t, np.int32)), pa.array(root.view(np.int64))], ["node", "tree", "root"])

    return nodes.select("node", "sig").mapInArrow(run, "node long, tree int, root long")


def sketches(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) -> key, doc_id, n_shingles, node, sig (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                u, _, off = distinct(*shingles(column(part, "text")), n)
                sig = signatures(u, off)
                size = np.diff(off)
                nodes = [_node(u[a:b]) if b > a else 0 for a, b in zip(off.tolist(), off[1:].tolist())]
                packed = [s.tobytes() if k else None for s, k in zip(sig, size)]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "key"), column(part, "doc_id"), pa.array(size, pa.int64()), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["key", "doc_id", "n_shingles", "node", "sig"]
                )

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key binary, doc_id long, n_shingles long, node long, sig binary")


def _span(n: int, close, first: int = 1) -> np.ndarray:
    """The group of each row in the graph in which each i >= first is tied to each j < i of
    ``close(i)``; a group is named by one of its rows."""
    label = np.arange(n)
    for i in range(first, n):
        for c in np.unique(label[close(i)]):
            if c != label[i]:
                label[label == c] = label[i]
    return label


def _stars(names: list[int], label: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of each name to the smallest one of its group."""
    order = np.lexsort((np.array(names, np.int64), label))
    first = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))
    size = np.diff(np.concatenate((first, [len(order)])))
    hub = np.repeat(order[first], size)
    tied = np.flatnonzero(hub != order)
    return [names[i] for i in order[tied]], [names[i] for i in hub[tied]]


def close_groups(sig: np.ndarray, agree: float, first: int = 1) -> np.ndarray:
    """Groups of the signatures that agree in the share ``agree`` of their values, each row
    from ``first`` on being compared with the rows before it."""
    need = int(np.ceil(agree * sig.shape[1]))
    return _span(len(sig), lambda i: np.flatnonzero((sig[:i] == sig[i]).sum(axis=1) >= need), first)


def exact_groups(sets: list[np.ndarray], percent: int, first: int = 1) -> np.ndarray:
    """Groups of sets of hashes with 100 * intersection >= percent * union, each set from
    ``first`` on being compared with the sets before it; from bit rows over the hashes that
    at least two of the sets hold."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    held = np.bincount(which, minlength=len(values)) > 1
    slot = np.cumsum(held) - 1
    width = (int(held.sum()) + 63) // 64
    bits = np.zeros((n, max(width, 1)), dtype=np.uint64)
    keep = held[which]
    s, o = slot[which[keep]], owner[keep]
    np.bitwise_or.at(bits, (o, s // 64), np.uint64(1) << (s % 64).astype(np.uint64))

    def close(i: int) -> np.ndarray:
        may = np.flatnonzero((100 * size[:i] >= percent * size[i]) & (100 * size[i] >= percent * size[:i]))
        both = np.bitwise_count(bits[may] & bits[i]).sum(axis=1, dtype=np.int64)
        return may[100 * both >= percent * (size[may] + size[i] - both)]

    return _span(n, close, first)


def _links(units: DataFrame, groups) -> DataFrame:
    """(unit, side, node, data), the units' rows together, side 0 first -> links (a, b) of the
    nodes of each unit to the smallest one of their group by ``groups(data, first)``, where the
    rows from ``first`` on are of side 1 (with no row of side 0 or none of side 1, all meet)."""
    ordered = units.repartition("unit").sortWithinPartitions("unit", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names, held, first, last = None, [], [], 0, None

        def found() -> pa.RecordBatch:
            a, b = _stars(names, groups(held, first if first < len(held) else 1)) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for u, side, node, data in zip(*(column(batch, c).to_pylist() for c in ("unit", "side", "node", "data"))):
                if u != unit:
                    yield found()
                    unit, names, held, first, last = u, [], [], 0, None
                if (side, node) == last:  # a row that repeats
                    continue
                last = (side, node)
                if side == 0:
                    first += 1
                names.append(node)
                held.append(data)
        yield found()

    return ordered.select("unit", "side", "node", "data").mapInArrow(run, "a long, b long")


def _by_signature(agree: float):
    return lambda data, first: close_groups(np.frombuffer(b"".join(data), np.uint16).reshape(len(data), HASHES), agree, max(first, 1))


def _by_sets(percent: int):
    return lambda data, first: exact_groups([np.frombuffer(d, np.uint64) for d in data], percent, max(first, 1))


def _outside(rows: DataFrame, size: int) -> DataFrame:
    """(region, node, part, data), the parts that cheaper comparisons found in each region ->
    units that compare the nodes outside of a region's largest part with all of its nodes, each
    pair of different parts at least once. With one part there is no unit."""
    parts = rows.groupBy("region", "part").agg(F.count("*").alias("n"))
    best = parts.groupBy("region").agg(F.max_by("part", F.struct("n", "part")).alias("best"), F.sum("n").alias("all"), F.max("n").alias("most"))
    best = best.where("all > most").select("region", "best", F.ceil(F.col("all") / size).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / size).cast("int").alias("outer"))
    dealt = rows.join(cut(best, "best"), "region").withColumn("x", F.xxhash64("node"))
    every = dealt.select("region", "node", "data", F.pmod("x", "blocks").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), F.lit(0).alias("side"))
    outer = dealt.where("part <> best").select("region", "node", "data", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.pmod("x", "outer").cast("int").alias("i"), F.lit(1).alias("side"))
    return every.unionByName(outer).select(F.struct("region", "i", "j").alias("unit"), "side", "node", "data")


def _forest_links(nodes: DataFrame, agree: float) -> DataFrame:
    """(node, sig), one row a node -> provisional links (a, b)."""
    met = _meetings(nodes)
    crowds = cut(met.groupBy("root").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowds")
    live = met.join(crowds, "root").join(nodes.select("node", "sig"), "node")
    close = _by_signature(agree)
    plain = live.where(F.col("crowd") <= CROWD).select(F.col("root").alias("unit"), F.lit(0).alias("side"), "node", F.col("sig").alias("data"))
    links = cut(_links(plain, close).distinct(), "links")
    if crowds.where(F.col("crowd") > CROWD).isEmpty():
        discard(crowds)
        return links
    crowded = cut(live.where(F.col("crowd") > CROWD), "crowded")
    deep = cut(_deep_links(crowded, agree).unionByName(links).distinct(), "links")
    near = components(deep)
    rows = crowded.join(near, "node", "left").select(F.col("root").alias("region"), "node", F.coalesce("component", "node").alias("part"), F.col("sig").alias("data"))
    out = cut(deep.unionByName(_links(_outside(rows, CROWD), close)).distinct(), "links")
    discard(links, deep, near, crowded, crowds)
    return out


def _deep_links(crowded: DataFrame, agree: float) -> DataFrame:
    """(node, tree, root, crowd, sig) of crowded regions -> links of neighbours in sorted order."""

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint16).reshape(batch.num_rows, HASHES)
            tree, crowd = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("tree", "crowd"))
            # one more value of the order for each factor 0.8 by which the region is too crowded
            depth = np.minimum(DEPTH + np.ceil(np.log(crowd / CROWD) / np.log(1.25)), HASHES // 4).astype(int)
            order = [sig[i, _ORDERS[t][: HASHES // 4]].astype(">u2").tobytes() for i, t in enumerate(tree)]
            yield pa.RecordBatch.from_arrays([column(batch, "root"), pa.array([x[: 2 * d] for x, d in zip(order, depth)], pa.binary()), pa.array(order, pa.binary()), column(batch, "node"), column(batch, "sig")], ["root", "bucket", "label", "node", "sig"])

    made = crowded.select("root", "tree", "crowd", "node", "sig").mapInArrow(labels, "root long, bucket binary, label binary, node long, sig binary")
    live = made.repartition("root", "bucket").sortWithinPartitions("root", "bucket", "label", "node").select("root", "bucket", "node", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sigs = None, [], []
        out: tuple[list[int], list[int]] = ([], [])

        def flush() -> None:
            if len(names) > 1:
                for held, found in zip(out, _stars(names, close_groups(np.array(sigs), agree))):
                    held.extend(found)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

        for batch in batches:
            for root, bucket, node, sig in zip(*(column(batch, c).to_pylist() for c in ("root", "bucket", "node", "sig"))):
                if (root, bucket) != key:
                    flush()
                    key, names, sigs = (root, bucket), [], []
                elif len(names) >= 2 * CROWD:
                    flush()
                    names, sigs = names[-SWEEP:], sigs[-SWEEP:]
                names.append(node)
                sigs.append(np.frombuffer(sig, np.uint16))
            if len(out[0]) > 4096:
                yield packed()
                out[0].clear(), out[1].clear()
        flush()
        yield packed()

    return live.mapInArrow(run, "a long, b long")


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """(component, size, node, text) -> component, size, node, data (the hashes of its set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                u, _, off = distinct(*shingles(column(part, "text")), part.num_rows)
                sets = [u[a:b].tobytes() for a, b in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("component", "size", "node")), pa.array(sets, pa.binary())], ["component", "size", "node", "data"])

    return rows.select("component", "size", "node", "text").mapInArrow(run, "component long, size long, node long, data binary")


def _confirmed_links(groups: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(node, component, key), the provisional groups with a document for each node
    -> confirmed links (a, b)."""
    sizes = cut(groups.groupBy("component").agg(F.count("*").alias("size")), "sizes")  # apart, so that the join may split a hot group
    texts = docs.select("key", "text").hint("merge").join(groups.join(sizes, "component"), "key")
    sets = cut(_shingle_sets(texts), "sets")  # rows that repeat share a key and so come again
    discard(sizes)
    exact = _by_sets(percent)
    large = F.col("size") > BLOCK
    small = sets.where(~large).select(F.struct("component", F.lit(0).alias("i")).alias("unit"), F.lit(0).alias("side"), "node", "data")
    blocks = sets.where(large).withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    own = blocks.select(F.struct("component", "i").alias("unit"), F.lit(1).alias("side"), "node", "data")
    # the group's smallest nodes, one block of each group, meet every block
    hub = blocks.where("i = 0 and n > 1").select("component", F.explode(F.expr("sequence(1, n - 1)")).alias("i"), "node", "data").select(F.struct("component", "i").alias("unit"), F.lit(0).alias("side"), "node", "data")
    links = cut(_links(small.unionByName(own).unionByName(hub), exact), "confirmed")
    if sets.where(large).isEmpty():
        discard(sets)
        return links
    found = components(links)
    rows = sets.where(large).join(found.withColumnRenamed("component", "part"), "node", "left").select(F.col("component").alias("region"), "node", F.coalesce("part", "node").alias("part"), "data")
    out = cut(links.unionByName(_links(_outside(rows, BLOCK), exact)), "confirmed")
    discard(sets, links, found)
    return out


def near_duplicates(documents: DataFrame, percent: int = 80) -> DataFrame:
    """key, doc_id, n_shingles, component, cluster for every row: documents are linked when
    100 * intersection >= percent * union of their shingle sets, ``component`` is the
    smallest doc_id that links reach (null first) and ``cluster`` names the group (null for
    an empty set, which is linked with nothing)."""
    docs = keyed(documents)
    all_rows = cut(sketches(docs), "sketches")
    some = all_rows.where("n_shingles > 0")
    # any row of a node may stand for it; the smallest id is taken apart, nulls first
    nodes = some.groupBy("node").agg(F.first("key").alias("key"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none"), F.first("sig").alias("sig"))
    nodes = cut(nodes.select("node", "key", F.when(~F.col("none"), F.col("least")).alias("doc_id"), "sig"), "nodes")
    j = percent / 100
    agree = j - 4 * (j * (1 - j) / HASHES) ** 0.5
    forest = _forest_links(nodes, agree)
    near = components(forest)
    groups = cut(near.join(nodes.select("node", "key"), "node"), "groups")
    links = _confirmed_links(groups, docs, percent)
    parts = components(links)
    discard(forest, near, groups, links)
    first = parts.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none"))
    of_part = first.select("component", F.when(~F.col("none"), F.col("least")).alias("least"))
    of_node = parts.join(of_part, "component").select("node", "least", F.col("component").alias("cluster"))
    lone = nodes.select("node", "doc_id").join(of_node, "node", "left").select("node", F.when(F.col("cluster").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component"), F.coalesce("cluster", "node").alias("cluster"))
    lone = cut(lone, "near-groups")
    discard(nodes, parts)
    joined = all_rows.select("key", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(lone, "node", "left")
    out = joined.select("key", "doc_id", "n_shingles", F.when(F.col("cluster").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component"), "cluster")
    out = cut(out, "near-duplicates")
    discard(all_rows, lone)
    return out


def keep_one(documents: DataFrame, percent: int = 80) -> DataFrame:
    """``documents``, all columns, with one row of each group of near duplicates: one of the
    smallest id. Texts without words all stay."""
    rows = near_duplicates(documents, percent)
    grouped = rows.where("cluster is not null").groupBy("cluster").agg(F.min(F.struct(id_order(), "key")).alias("k")).select("k.key")
    kept = grouped.unionByName(rows.where("cluster is null").select("key").distinct())
    out = with_row(documents).hint("merge").join(kept, "key", "left_semi")
    copies = rows.where("cluster is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    if not copies.isEmpty():  # whole rows that repeat: one stays
        wordless = F.size(F.filter(F.split(F.coalesce("row.text", F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")) == 0
        out = out.where(~wordless).dropDuplicates(["key"]).unionByName(out.where(wordless))
    return out.select("row.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_documents(spark, sf_dir), 85)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i + 1, i + 5), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
  l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
  r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
  c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
