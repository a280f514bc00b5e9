"""The store: append-only Parquet tables whose newest committed version of a job counts.

Every save writes rows under a new version and commits it last, by one row for each table
and job in the ``commits`` table. A reader takes a job's rows of the newest version that is
committed, so all tables of a job change in one step, and a table that got no rows is empty
from then on. Files are sorted by job, so that a job's rows are found by file statistics, and
their number does not grow with the jobs."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.queue import interrupt_jobs, upsert_jobs

#: The tables and the columns that each has at least.
SCHEMAS = {
    "jobs": "job_id string, file_name string, source_path string, status string, page_count int, fast_page_count int, vlm_page_count int, block_count long, embedding_count long, enhancement_task_count long, elapsed_seconds double, timings map<string,double>, error string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "pages": "job_id string, page_index int, route string, reason string, text_chars int, block_count int, image_count int, image_area_ratio double",
    "blocks": "job_id string, page_index int, block_index int, source string, kind string, text string, bbox array<double>, block_id string",
    "embeddings": "embedding_id string, job_id string, block_id string, provider string, model string, dim int, vector array<double>",
    "enhancement_tasks": "task_id string, job_id string, block_id string, page_index int, kind string, status string, crop_path string, bbox array<double>",
}
TABLES = tuple(SCHEMAS)


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def init(self) -> None:
        """Empty tables where there are none."""
        for name, schema in SCHEMAS.items():
            self._append(name, self.spark.createDataFrame([], schema), 0)
        self._commit(self.spark.createDataFrame([], "job_id string"), (), 0)

    def _append(self, table: str, rows: DataFrame, version: int) -> None:
        out = rows.withColumn("_version", F.lit(version).cast("long"))
        out.repartition("job_id").sortWithinPartitions("job_id").write.mode("append").parquet(f"{self.path}/{table}")

    def _commit(self, ids: DataFrame, tables: tuple[str, ...], version: int) -> None:
        names = F.explode(F.array(*[F.lit(t) for t in tables]).cast("array<string>"))
        ids.select(F.col("job_id").cast("string").alias("job_id")).distinct().select("job_id", names.alias("table"), F.lit(version).cast("long").alias("_version")).write.mode("append").parquet(f"{self.path}/commits")

    def save(self, jobs: DataFrame, /, **tables: DataFrame) -> None:
        """Replace the given tables of the jobs named in ``jobs`` (job_id): their rows before are
        gone, also where a table has none now. Tables that are not given stay."""
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        version = time.time_ns()
        for name, rows in tables.items():
            self._append(name, rows, version)
        self._commit(jobs.select("job_id"), tuple(tables), version)

    def replace(self, table: str, rows: DataFrame, jobs: DataFrame | None = None) -> None:
        """Replace one table of the jobs in ``jobs``, or of those that ``rows`` names."""
        self.save(rows if jobs is None else jobs, **{table: rows})

    def read(self, table: str, job_id: str | None = None) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{table}")
        commits = self.spark.read.parquet(f"{self.path}/commits").where(F.col("table") == table)
        if job_id is not None:
            rows = rows.where(F.col("job_id") == job_id)
            commits = commits.where(F.col("job_id") == job_id)
        newest = commits.groupBy("job_id").agg(F.max("_version").alias("_version"))
        return rows.join(newest, ["job_id", "_version"], "left_semi").drop("_version")

    def vacuum(self, folder: str) -> Store:
        """A copy of the store in another folder with the newest versions only."""
        out = Store(self.spark, folder)
        out.init()
        for name in TABLES:
            rows = self.read(name)
            jobs = self.spark.read.parquet(f"{self.path}/commits").where(F.col("table") == name)
            out.save(jobs, **{name: rows})
        return out

    def job(self, job_id: str) -> DataFrame:
        """The job's row; a missing job is an error."""
        found = self.read("jobs", job_id)
        if found.isEmpty():
            raise KeyError(f"no job {job_id!r}")
        return found

    def blocks(self, job_id: str) -> DataFrame:
        return self.read("blocks", job_id).orderBy("page_index", "block_index")

    def enhancement_tasks(self, job_id: str) -> DataFrame:
        return self.read("enhancement_tasks", job_id).orderBy("page_index", "task_id")

    def upsert_jobs(self, rows: DataFrame) -> None:
        """Job rows over old ones; the first start and creation times stay, errors are cleared."""
        known = self.read("jobs").join(rows.select("job_id"), "job_id", "left_semi")
        self.replace("jobs", upsert_jobs(known, rows), rows)

    def update_elapsed(self, job_id: str, elapsed_seconds: float, timings: dict[str, float]) -> None:
        """Set a job's elapsed time and phase times; an unknown id changes nothing."""
        row = self.read("jobs", job_id)
        held = F.from_json(F.lit(json.dumps(timings, sort_keys=True)), "map<string,double>")
        self.replace("jobs", row.withColumns({"elapsed_seconds": F.lit(float(elapsed_seconds)), "timings": held}))

    def interrupt(self, now) -> int:
        """At start: jobs left open by the last run fail. Returns how many."""
        open_ = self.read("jobs").where(F.col("status").isin("queued", "processing"))
        n = open_.count()
        if n:
            self.replace("jobs", interrupt_jobs(open_, now))
        return n


def write_markdown(documents: DataFrame, path: str) -> None:
    """One text file's worth of Markdown a job, under a folder for each."""
    documents.select("job_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("job_id").option("lineSep", "").text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
