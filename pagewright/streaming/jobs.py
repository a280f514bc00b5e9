"""Parsing of uploaded files: a batch call, and jobs as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.engine import Engine, Parsed
from pagewright.sources.geometry import FILE_SCHEMA, FailingExtractor, PageExtractor, as_jobs, extract_pages, read_files
from pagewright.sources.store import SCHEMAS, Store


def job_rows(files: DataFrame, parsed: Parsed) -> DataFrame:
    """The finished job of each file, with the counters of what was parsed."""
    now = F.current_timestamp()
    out = files.select("job_id", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("path").alias("source_path")).join(parsed.jobs, "job_id", "left")
    known = {"status": F.lit("completed"), "created_at": now, "started_at": now, "completed_at": now}
    return out.select(*[(known[n] if n in known else F.col(n) if n in out.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in SCHEMAS["jobs"].split(", "))])


def parse_files(spark: SparkSession, path: str, extractor: type[PageExtractor] = FailingExtractor, engine: Engine | None = None, store: Store | None = None) -> Parsed:
    """Parse the PDF files of a folder in one call; with a store, everything is saved too."""
    files = read_files(spark, path)
    return _parse(files, extractor, engine or Engine(), store)


def _parse(files: DataFrame, extractor: type[PageExtractor], engine: Engine, store: Store | None) -> Parsed:
    parsed = engine.parse(extract_pages(files, extractor), store=store, jobs=files.select("job_id"))
    if store is not None:
        store.upsert_jobs(job_rows(files, parsed))
    return parsed


def jobs_stream(spark: SparkSession, path: str, store: Store, checkpoint: str, extractor: type[PageExtractor] = FailingExtractor, engine: Engine | None = None, once: bool = True) -> StreamingQuery:
    """A stream over a folder of uploads: each new file becomes a job, parsed and stored with
    its micro-batch. A batch that fails marks its jobs failed and the stream goes on."""
    engine = engine or Engine()
    files = as_jobs(spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.pdf").load(path))

    def handle(batch: DataFrame, _: int) -> None:
        try:
            _parse(batch, extractor, engine, store)
        except Exception as e:  # noqa: BLE001  a job's failure is its result
            failed = {"status": F.lit("failed"), "error": F.lit(str(e)[:4000]), "created_at": F.current_timestamp(), "completed_at": F.current_timestamp(), "source_path": F.col("path"), "file_name": F.regexp_extract("path", r"([^/]+)$", 1)}
            rows = batch.select("job_id", "path").select(*[(failed[n] if n in failed else F.col("job_id") if n == "job_id" else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in SCHEMAS["jobs"].split(", "))])
            store.replace("jobs", rows)

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
