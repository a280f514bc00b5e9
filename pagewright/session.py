"""Start of a service run: the session, the store's tables, and jobs that a restart broke off."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from pagewright.sources.store import Store


def start(path: str, spark: SparkSession | None = None, now: dt.datetime | None = None) -> tuple[Store, int]:
    """The store in a folder, made where there is none, and the number of jobs failed because
    they were open when the last run ended."""
    spark = spark or SparkSession.builder.appName("pagewright").getOrCreate()
    store = Store(spark, path)
    store.init()
    return store, store.interrupt(now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
