"""Runtime statistics, job counters and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G

from .tasks import bench_priority


def status_counts(df: DataFrame, statuses: tuple[str, ...] = ("queued", "processing", "completed", "failed")) -> DataFrame:
    """One row of counts by status and their total."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def job_totals(jobs: DataFrame) -> DataFrame:
    zero = F.lit(0)
    sums = ("page_count", "fast_page_count", "vlm_page_count", "block_count", "embedding_count")
    return jobs.agg(
        F.count("*").alias("total"),
        *[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in sums],
        F.coalesce(F.avg("elapsed_seconds"), F.lit(0.0)).alias("avg_elapsed_seconds"),
        F.coalesce(F.max("elapsed_seconds"), F.lit(0.0)).alias("max_elapsed_seconds"),
    )


def runtime_stats(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: jobs, pages, blocks and embeddings, coverage and the task backlog. Counts come
    from the job rows; the oldest times are epoch seconds, 0 for none; each table is read once and only one row of each meets the other."""
    j = jobs.agg(
        F.struct(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "processing", "completed", "failed")]).alias("jobs"),
        F.struct(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("page_count", "total"), ("fast_page_count", "fast"), ("vlm_page_count", "vlm"))]).alias("pages"),
        F.coalesce(F.sum("block_count"), F.lit(0)).cast("long").alias("blocks"),
        F.coalesce(F.sum("embedding_count"), F.lit(0)).cast("long").alias("embeddings"),
        F.struct(G.rounded(F.coalesce(F.avg("elapsed_seconds"), F.lit(0.0)), 3).alias("avg"), G.rounded(F.coalesce(F.max("elapsed_seconds"), F.lit(0.0)), 3).alias("max")).alias("elapsed"),
    ).withColumn("coverage", F.when(F.col("blocks") > 0, G.rounded(F.try_divide(F.col("embeddings").cast("double"), F.col("blocks").cast("double")), 4)).otherwise(0.0))
    seconds = lambda c: F.coalesce(F.unix_micros(F.min(c).cast("timestamp")) / 1e6, F.lit(0.0))
    t = tasks.agg(
        F.struct(
            F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "processing", "completed", "failed")],
            seconds(F.col("created_at")).alias("oldest_created_at"), seconds(F.when(F.col("status") == "queued", F.col("created_at"))).alias("oldest_queued_at"),
        ).alias("tasks")
    )
    return j.withColumn("_k", F.lit(1)).join(F.broadcast(t.withColumn("_k", F.lit(1))), "_k").drop("_k")


def job_counters(pages: DataFrame, blocks: DataFrame, embeddings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counters of each job; each table is aggregated before it is joined."""
    p = pages.groupBy("job_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("route") == "fast_pymupdf").alias("fast_page_count"), F.count_if(F.col("route") == "vlm").alias("vlm_page_count"))
    out = p
    for df, name in ((blocks, "block_count"), (embeddings, "embedding_count"), (tasks, "enhancement_task_count")):
        out = out.join(df.groupBy("job_id").agg(F.count("*").alias(name)), "job_id", "left")
    return out.fillna(0, ["block_count", "embedding_count", "enhancement_task_count"])


def bench_summary(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per job: task counts by status and priority and pages a second (0 for no time)."""
    p = tasks.withColumn("priority", bench_priority(F.col("metadata")))
    t = p.groupBy("job_id").agg(
        F.count("*").alias("task_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_tasks") for s in ("queued", "processing", "completed", "failed")],
        *[F.count_if(F.col("priority") == s).alias(f"{s}_priority_tasks") for s in ("required", "optional", "asset_only")],
    )
    rate = lambda c: F.when(F.col(c) > 0, G.rounded(F.try_divide(F.col("page_count").cast("double"), F.col(c).cast("double")), 3)).otherwise(0.0)
    return jobs.join(t, "job_id", "left").fillna(0).withColumns({"pages_per_second": rate("wall_seconds"), "parse_pages_per_second": rate("parse_wall_seconds")})


#: The phases that a load report names.
PHASES = ("routing_seconds", "vlm_seconds", "embedding_seconds", "storage_seconds", "total_seconds")


def load_summary(runs: DataFrame, total_seconds: float) -> DataFrame:
    """status, page_count, block_count, service_seconds, wall_seconds, timings map -> one row over
    all runs that took ``total_seconds`` together: counts, pages a second, and mean and maximum
    of service, wall and phase seconds of the completed ones, a missing time counting as 0."""
    done = F.col("status") == "completed"
    of = lambda c: F.when(done, F.coalesce(c, F.lit(0.0)))
    times = {"service": F.col("service_seconds"), "wall": F.col("wall_seconds")} | {p: F.try_element_at(F.col("timings"), F.lit(p)) for p in PHASES}
    pages = F.coalesce(F.sum(F.when(done, F.col("page_count"))), F.lit(0)).cast("long")
    return runs.agg(
        F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), pages.alias("pages"), F.coalesce(F.sum(F.when(done, F.col("block_count"))), F.lit(0)).cast("long").alias("blocks"),
        G.rounded(pages.cast("double") / F.lit(float(total_seconds)), 3).alias("pages_per_second"),
        *[G.rounded(f(of(c)), 3).alias(f"{k}_{n}") for k, c in times.items() for n, f in (("avg", F.avg), ("max", F.max))],
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Outcome events of one round -> claimed, completed, failed."""
    return outcomes.agg(F.count("*").alias("claimed"), F.count_if(F.col("event") == "completed").alias("completed"), F.count_if(F.col("event") == "failed").alias("failed"))
