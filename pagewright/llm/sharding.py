"""Sharding by Hilbert-curve ordering.

Several metadata dimensions are quantised to ``2**bits`` steps each (by quantiles of
the data, so that the steps hold about equally many rows), rows are ordered by the
index of their cell on a Hilbert curve, and the order is cut into runs. Rows of a shard
are then close in every dimension, and file statistics prune on any of them. Strings
are quantised by the rank of the whole string among the rows' values.

Rows of equal texts (equal size and 64-bit hash) form a group that takes the smallest
lang and source of its rows, so it lies in one cell and together in the order; only the
cuts between shards, which the law fixes, divide groups.

The law is ``rows``: shard sizes differ by one row at most. The rank of a row is found
without a global sort: rows are counted by cell, part of the hash, and group; a group of
over ``CROWD`` rows is divided by row number; and a row's rank is the sum of the counts
before its division and its number in it.

Everything is DataFrame functions. Defined edge cases: null lang, source or text
quantise as the smallest value, a null text has size 1 and checksum 0; repeated rows
get ranks of their own; fewer rows than shards leave shards empty; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, discard, read_documents

BITS = 4
CROWD = 10_000


def quantise(x: Column, bounds: list) -> Column:
    """How many of the bounds lie below x (for null: none)."""
    return reduce(lambda a, b: a + b, [F.coalesce((x > F.lit(b)).cast("int"), F.lit(0)) for b in bounds], F.lit(0))


def quantile_bounds(df: DataFrame, column: str, bits: int) -> list:
    """At most 2**bits - 1 distinct inner bounds that cut the rows of ``df`` into runs of about
    equally many by the order of a column, from the counts of its distinct values: these
    are sorted by range, and only a sum for each range and the bounds are gathered."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    dealt = cut(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "distinct-values")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = dealt.groupBy("p").agg(F.sum("n").alias("n"))
    bases = sums.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    steps = dealt.withColumn("upto", F.sum("n").over(inside)).join(bases, "p").withColumn("step", F.expr(f"cast(((base + upto - 1) * {1 << bits}) div total as int)"))
    top = steps.groupBy("step").agg(F.max("v").alias("v")).orderBy("step").collect()  # at most 2**bits rows
    discard(dealt)
    return [r.v for r in top[:-1]]


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell, by the transposition of its coordinates."""
    n = len(axes)
    names = [f"x{i}" for i in range(n)]
    state = F.struct(*[a.cast("int").alias(k) for a, k in zip(axes, names)])

    def untangle(acc: Column, q: Column) -> Column:
        p = q - 1
        x = [acc[k] for k in names]
        for i in range(n):
            has = x[i].bitwiseAND(q) != 0
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            head = F.when(has, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(t))
            if i:
                x[i] = F.when(has, x[i]).otherwise(x[i].bitwiseXOR(t))
                x[0] = head
            else:
                x[0] = F.when(has, x[0].bitwiseXOR(p)).otherwise(x[0])
        return F.struct(*[v.alias(k) for v, k in zip(x, names)])

    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    s = F.aggregate(steps, state, untangle)

    def finish(s: Column) -> Column:
        g = [s["x0"]]
        for k in names[1:]:
            g.append(s[k].bitwiseXOR(g[-1]))
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = F.when(g[-1].bitwiseAND(F.lit(1 << b)) != 0, t.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(t)
        g = [x.bitwiseXOR(t) for x in g]
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for x in g:
                out = out * 2 + F.shiftright(x, b).bitwiseAND(F.lit(1))
        return out

    return F.element_at(F.transform(F.array(s), finish), 1)


def hilbert_shards(documents: DataFrame, n_shards: int = 8, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard, slot for every row of (doc_id, text, lang, source)."""
    data = F.encode(F.col("text").cast("string"), "UTF-8")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(rows, "shard-rows")  # narrow: no text
    dims = {"a": "lang", "b": "source", "c": "size"}
    group = ["size", "h"]
    bounds = {k: quantile_bounds(rows, c, bits) for k, c in dims.items()}
    axes = {k: F.coalesce(quantise(F.col(c), bounds[k]), F.lit(0)) for k, c in dims.items()}
    cells = rows.groupBy(*group).agg(*[F.min(x).alias(k) for k, x in axes.items()], F.ceil(F.count("*") / CROWD).cast("int").alias("salts"), F.count("*").alias("n"))
    cells = cut(cells.withColumn("part", F.pmod("h", F.lit(4096)).cast("int")).withColumn("cell", hilbert_index([F.col(k) for k in dims], bits)), "shard-groups")
    parts = cells.groupBy("cell", "part").agg(F.sum("n").alias("m"))
    whole = parts.groupBy("cell").agg(F.sum("m").alias("m"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**(3 * bits) rows
    whole = whole.select("cell", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    in_cell = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("inner", F.coalesce(F.sum("m").over(in_cell), F.lit(0))).drop("m").join(whole, "cell")
    in_part = Window.partitionBy("cell", "part").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    based = cells.withColumn("mine", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(parts, ["cell", "part"])
    based = based.select(*group, "cell", "salts", (F.col("base") + F.col("inner") + F.col("mine")).alias("first"), "total")
    placed = rows.join(based, group).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    division = [*group, "salt"]
    counts = placed.groupBy(*division).agg(F.count("*").alias("k"))
    in_group = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("k").over(in_group), F.lit(0))).drop("k")
    numbered = placed.withColumn("i", F.row_number().over(Window.partitionBy(*division).orderBy("doc_id", "row")) - 1)
    ranked = numbered.join(offsets, division).withColumn("rank", F.col("first") + F.col("offset") + F.col("i"))
    shard = F.expr(f"cast((rank * {n_shards}) div total as int)")
    out = ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "cell", "shard", F.expr(f"rank - ((shard * total + {n_shards - 1}) div {n_shards})").cast("long").alias("slot"))
    out = cut(out, "shards")
    discard(rows, cells)
    return out


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(read_documents(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
