"""The worker loop: claim, run, record, once or again and again.

The queue is an event log, an append-only Parquet table (``EventLog``); its state is the fold
of all events. One process claims from a log at a time: two claimers could take the same
task, as no lock is held between reading and appending."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.queue import claim, fold
from pagewright.operators.stats import outcome_counts
from pagewright.sources.shared import scratch

EVENT = "task_id string, job_id string, kind string, page_index int, ts timestamp, seq long, event string, worker_id string, result string, error string"


class EventLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, events: DataFrame) -> None:
        """Events with any of the log's columns; the others are null."""
        columns = [c.split(" ") for c in EVENT.split(", ")]
        events.select(*[(F.col(n) if n in events.columns else F.lit(None)).cast(t).alias(n) for n, t in columns]).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(self.path)

    def tasks(self) -> DataFrame:
        """The state of every task, with the page that its creation named."""
        events = self.events()
        pages = events.groupBy("task_id").agg(F.max("page_index").alias("page_index"))
        return fold(events).join(pages, "task_id")

    def create(self, tasks: DataFrame, at=None) -> None:
        """Creation events of task rows (task_id, job_id, kind, page_index)."""
        when = F.current_timestamp() if at is None else F.lit(at)
        self.append(tasks.select("task_id", "job_id", "kind", "page_index", when.alias("ts"), F.lit(0).alias("seq"), F.lit("created").alias("event")))


@dataclass(frozen=True)
class Worker:
    """``process`` turns claimed tasks into outcome events (``run_provider`` or ``run_tasks`` with
    a provider). A claim takes at most ``limit`` tasks, of one job or kind if named."""

    log: EventLog
    process: Callable[[DataFrame, str], DataFrame]
    worker_id: str
    limit: int = 1
    lease_seconds: float | None = None
    job_id: str = ""
    kind: str = ""

    def once(self, now=None) -> dict[str, int]:
        """One round; counts of tasks claimed, completed and failed. Where the log can't be read,
        claim_errors is 1 and nothing is done."""
        spark = self.log.spark
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        path = scratch(spark, "worker")
        try:
            moment = spark.range(1).select(at.alias("t")).first().t
            found = claim(self.log.tasks(), moment, self.limit, self.worker_id, self.lease_seconds, self.job_id, self.kind)
            found.write.parquet(f"{path}/claimed")  # at most 100 rows; the claim is taken once
        except Exception:  # noqa: BLE001  an unreadable log must not end the loop
            return {"claimed": 0, "completed": 0, "failed": 0, "claim_errors": 1}
        claimed = spark.read.parquet(f"{path}/claimed")
        if claimed.isEmpty():
            return {"claimed": 0, "completed": 0, "failed": 0}
        own = claimed.select("task_id", "job_id", "kind", F.lit(moment).alias("ts"))
        self.log.append(own.withColumns({"seq": F.lit(1), "event": F.lit("claimed"), "worker_id": F.lit(self.worker_id)}))
        self.process(claimed, self.worker_id).write.parquet(f"{path}/outcomes")
        outcomes = spark.read.parquet(f"{path}/outcomes")
        done = outcomes.join(own, "task_id").withColumns({"ts": F.greatest("ts", F.current_timestamp() if now is None else F.col("ts")), "seq": F.lit(2)})
        self.log.append(done)
        return outcome_counts(outcomes).first().asDict()

    def loop(self, interval_seconds: float = 5.0, rounds: int | None = None, stop: Callable[[], bool] = lambda: False, report: Callable[[dict], None] = print) -> dict[str, int]:
        """Rounds until ``stop`` or their number is reached, with a pause after one that claimed
        nothing; the sums of all counts."""
        total: dict[str, int] = {}
        done = 0
        while not stop() and (rounds is None or done < rounds):
            counts = self.once()
            report(counts)
            for k, v in counts.items():
                total[k] = total.get(k, 0) + v
            done += 1
            if not counts["claimed"] and (rounds is None or done < rounds):
                time.sleep(interval_seconds)
        return total
