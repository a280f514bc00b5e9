"""Command entry points: ``python -m pagewright parse|jobs|worker|stats|export ...``."""

from __future__ import annotations

import argparse
import importlib

from pagewright.session import start
from pagewright.sources.store import write_jsonl, write_markdown


def _load(name: str):
    """An object by ``module:name``."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pagewright")
    p.add_argument("--store", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "jobs"):
        c = sub.add_parser(name)
        c.add_argument("files", help="folder of PDF files")
        c.add_argument("--extractor", default="pagewright.sources.geometry:FailingExtractor")
        if name == "jobs":
            c.add_argument("--checkpoint", required=True)
            c.add_argument("--once", action="store_true")
    c = sub.add_parser("worker")
    c.add_argument("--log", required=True, help="folder of the event log")
    c.add_argument("--call", required=True, help="module:name of a function from a task to a result")
    c.add_argument("--worker-id", default="worker")
    c.add_argument("--limit", type=int, default=1)
    c.add_argument("--concurrency", type=int, default=1)
    c.add_argument("--lease-seconds", type=float)
    c.add_argument("--timeout-seconds", type=float, default=120.0)
    c.add_argument("--interval-seconds", type=float, default=5.0)
    c.add_argument("--job-id", default="")
    c.add_argument("--kind", default="")
    c.add_argument("--once", action="store_true")
    c = sub.add_parser("stats")
    c.add_argument("--out", required=True)
    c = sub.add_parser("export")
    c.add_argument("out")
    c.add_argument("--policy", default="all", choices=("none", "required", "all"))
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import functions as F

    from pagewright.operators.render import render_documents
    from pagewright.operators.stats import runtime_stats
    from pagewright.streaming.jobs import jobs_stream, parse_files
    from pagewright.streaming.queue import run_tasks
    from pagewright.streaming.worker import EventLog, Worker

    a = arguments(argv)
    store, _ = start(a.store)
    spark = store.spark
    if a.command == "parse":
        parse_files(spark, a.files, _load(a.extractor), store=store)
    elif a.command == "jobs":
        jobs_stream(spark, a.files, store, a.checkpoint, _load(a.extractor), once=a.once).awaitTermination()
    elif a.command == "worker":
        call = _load(a.call)
        worker = Worker(EventLog(spark, a.log), lambda df, w: run_tasks(df, call, w, a.timeout_seconds, a.concurrency), a.worker_id, a.limit, a.lease_seconds, a.job_id, a.kind)
        worker.loop(a.interval_seconds, 1 if a.once else None)
    elif a.command == "stats":
        tasks = store.read("enhancement_tasks")
        write_jsonl(runtime_stats(store.read("jobs"), tasks if "created_at" in tasks.columns else tasks.withColumn("created_at", F.lit(None).cast("timestamp"))), a.out)
    else:
        jobs = store.read("jobs").select("job_id", F.col("file_name").alias("title"), F.col("source_path").alias("source_pdf"), "page_count")
        tasks = store.read("enhancement_tasks")
        tasks = tasks if "result" in tasks.columns else tasks.withColumn("result", F.lit(None).cast("string"))
        write_markdown(render_documents(jobs, store.read("blocks"), tasks, a.policy), a.out)


if __name__ == "__main__":
    main()
