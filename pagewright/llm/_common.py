"""Session helpers shared by the corpus operators.

Input handling that every operator of this subpackage shares:

* ``select_documents`` takes only the id and text columns, so extra columns
  with clashing names never reach an operator's own columns;
* a null text counts as an empty one; a row with a null id is kept and ordered first;
* an empty table gives an empty result with the documented schema.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The C library where it can give memory back (glibc).
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share.

    It lies under ``spark.checkpoint.dir`` as the cluster names it. Where that
    setting is absent a folder of this process is used, on a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"corpus-shared-{os.getpid()}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    lost executors need only reread files."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once what is read from them has itself been written."""
    for t in tables:
        path = getattr(t, "written", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def select_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty strings."""
    return df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _trim() -> None:
    """Give the memory that a batch needed back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts take about ``max_bytes`` together
    (a longer single text forms a run of its own)."""
    arr = batch.column(batch.schema.get_field_index(column))
    n = len(arr)
    if n == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(arr), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + int(sizes[i]) > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start, n - start)
    _trim()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def filter_rows(documents: DataFrame, keep) -> DataFrame:
    """The rows of ``documents``, all columns unchanged, for whose texts ``keep`` (a function
    from a string column without nulls to a boolean array) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pa.compute.fill_null(column(part, "text"), "")
                yield part.filter(pa.array(keep(texts), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def row_key(doc_id: Column, text: Column) -> Column:
    """A 128-bit digest of the id (null apart from all ids) and the whole text. Rows of one
    key are copies of one another and share all results."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), text)))


def keyed(documents: DataFrame) -> DataFrame:
    """key, doc_id, text of every row, with null texts as empty strings."""
    d = select_documents(documents)
    return d.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")


def with_row(documents: DataFrame) -> DataFrame:
    """key and the whole row as one struct, so that no column of the table can clash with an
    operator's own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(row_key(F.col("doc_id"), text).alias("key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))


def numbered(docs: DataFrame) -> DataFrame:
    """Adds ``rid``, 64 bits of ``key`` for narrow rows. That it tells all keys apart is
    checked, and another salt taken where it does not."""
    for salt in range(64):
        rid, other = (F.xxhash64(F.lit(s), "key") for s in (salt, salt + 1000))
        seen = docs.select(rid.alias("rid"), other.alias("o")).groupBy("rid").agg(F.min("o").alias("a"), F.max("o").alias("b"))
        if seen.where("a <> b").isEmpty():
            return docs.withColumn("rid", rid)
    raise RuntimeError("no salt tells all keys apart")


def id_order(doc_id: str = "doc_id") -> Column:
    """A value that orders ids, null first, and gives the id back as its field ``id``."""
    return F.struct(F.col(doc_id).isNotNull().alias("has"), F.col(doc_id).alias("id"))
