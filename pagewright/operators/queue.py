"""The task queue: an event log folded to the latest state, claims, leases and job states.

Events: task_id, job_id, kind, ts, seq, event (created, claimed, completed, failed),
worker_id, result, error. The last event by (ts, seq) decides; there is no check that
the worker that completes a task is the one that holds it, unless ``strict``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = {"created": "queued", "claimed": "processing", "completed": "completed", "failed": "failed"}


def fold(events: DataFrame) -> DataFrame:
    """One row a task: its state after its last event. One partial-aggregated shuffle."""
    at = F.struct("ts", "seq")
    is_ = lambda e: F.col("event") == e
    last = lambda c, when=None: F.max_by(F.col(c) if when is None else F.when(when, F.col(c)), at if when is None else F.when(when, at))
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return events.groupBy("task_id").agg(
        F.max_by("job_id", at).alias("job_id"),
        F.max_by("kind", at).alias("kind"),
        F.element_at(status, F.max_by("event", at)).alias("status"),
        F.min(F.when(is_("created"), F.col("ts"))).alias("created_at"),
        last("ts", is_("claimed")).alias("leased_at"),
        last("worker_id", is_("claimed") | is_("completed") | is_("failed")).alias("worker_id"),
        last("result", is_("completed")).alias("result"),
        F.when(F.max_by("event", at) == "failed", F.substring(F.max_by("error", at), 1, 4000)).alias("error"),
        F.count("*").alias("events"),
    )


def claim(tasks: DataFrame, now, limit: int = 1, worker_id: str = "", lease_seconds: float | None = None, job_id: str = "", kind: str = "") -> DataFrame:
    """The tasks a worker gets: queued ones, and with a timeout those whose lease is over,
    the oldest first, at most ``limit`` (held between 1 and 100), in page order. The result
    carries the claimed state; ``apply_claim`` merges it back."""
    open_ = F.col("status") == "queued"
    if lease_seconds is not None:
        limit_at = F.lit(now).cast(tasks.schema["leased_at"].dataType) - F.make_dt_interval(secs=F.lit(max(0.0, float(lease_seconds))))
        over = F.col("leased_at") <= limit_at  # a task without a lease time is not taken over
        open_ = open_ | ((F.col("status") == "processing") & over)
    found = tasks.where(open_)
    if job_id:
        found = found.where(F.col("job_id") == job_id)
    if kind:
        found = found.where(F.col("kind") == kind)
    top = found.orderBy("created_at", "task_id").limit(max(1, min(100, limit)))
    order = ["page_index", "task_id"] if "page_index" in tasks.columns else ["task_id"]
    return top.withColumns({"status": F.lit("processing"), "worker_id": F.lit(worker_id), "leased_at": F.lit(now).cast(tasks.schema["leased_at"].dataType), "error": F.lit(None).cast("string")}).orderBy(*order)


def apply_claim(tasks: DataFrame, claimed: DataFrame) -> DataFrame:
    return tasks.join(claimed.select("task_id"), "task_id", "left_anti").unionByName(claimed)


def complete(tasks: DataFrame, task_id: str, worker_id: str, result, strict: bool = False) -> DataFrame:
    """Sets a task completed; unknown ids change nothing."""
    mine = (F.col("task_id") == task_id) & (F.col("worker_id").eqNullSafe(worker_id) if strict else F.lit(True))
    set_ = lambda c, v: F.when(mine, v).otherwise(F.col(c))
    return tasks.withColumns({"status": set_("status", F.lit("completed")), "result": set_("result", F.lit(result)), "worker_id": set_("worker_id", F.lit(worker_id)), "error": set_("error", F.lit(None).cast("string"))})


def fail(tasks: DataFrame, task_id: str, worker_id: str, error: str, strict: bool = False) -> DataFrame:
    """Sets a task failed for good; an earlier result stays."""
    mine = (F.col("task_id") == task_id) & (F.col("worker_id").eqNullSafe(worker_id) if strict else F.lit(True))
    set_ = lambda c, v: F.when(mine, v).otherwise(F.col(c))
    return tasks.withColumns({"status": set_("status", F.lit("failed")), "worker_id": set_("worker_id", F.lit(worker_id)), "error": set_("error", F.lit(error[:4000]))})


def interrupt_jobs(jobs: DataFrame, now) -> DataFrame:
    """Jobs left queued or processing by a restart fail."""
    open_ = F.col("status").isin("queued", "processing")
    return jobs.withColumns(
        {
            "error": F.when(open_, "interrupted by service restart").otherwise(F.col("error")),
            "completed_at": F.when(open_, F.lit(now).cast(jobs.schema["completed_at"].dataType)).otherwise(F.col("completed_at")),
            "status": F.when(open_, "failed").otherwise(F.col("status")),
        }
    )


def fold_jobs(events: DataFrame) -> DataFrame:
    """job_id, ts, seq, event (queued, processing, completed, failed), error -> jobs."""
    at = F.struct("ts", "seq")
    ends = F.col("event").isin("completed", "failed")
    return events.groupBy("job_id").agg(
        F.max_by("event", at).alias("status"),
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("event") == "processing", F.col("ts"))).alias("started_at"),
        F.max(F.when(ends, F.col("ts"))).alias("completed_at"),
        F.when(F.max_by("event", at) == "failed", F.substring(F.max_by("error", at), 1, 4000)).alias("error"),
    )


def upsert_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """New job rows over old ones; the first start and creation times stay, errors are cleared."""
    o = old.select("job_id", F.col("created_at").alias("_c"), F.col("started_at").alias("_s"))
    fresh = new.join(o, "job_id", "left").withColumns({"created_at": F.coalesce("_c", "created_at"), "started_at": F.coalesce("_s", "started_at"), "error": F.lit(None).cast("string")}).drop("_c", "_s")
    return old.join(new.select("job_id"), "job_id", "left_anti").unionByName(fresh.select(*old.columns))
