"""Registered queries: each operator on the test tables, or on a fixed small fixture where
those tables hold nothing of its kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import Config
from pagewright.functions import geometry as G
from pagewright.functions import tables as TB
from pagewright.functions import text as T
from pagewright.operators import blocks as BL
from pagewright.operators import captions as CP
from pagewright.operators import embedding as EM
from pagewright.operators import pages as PG
from pagewright.operators import queue as QU
from pagewright.operators import stats as ST
from pagewright.operators import tasks as TK
from pagewright.sources.geometry import pages_of_documents

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as one page; image figures follow its id and cross every threshold."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.length("text").alias("text_chars"), F.size(F.split("text", "\n")).cast("long").alias("block_count"), F.pmod("doc_id", F.lit(4)).alias("image_count"),
        (F.pmod("doc_id", F.lit(5)) / 8.0).alias("image_area_ratio"), (F.pmod("doc_id", F.lit(7)) == 0).alias("has_table_hint"),
    )


def route_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PG.route_counters(PG.route_pages(signals(spark, sf_dir)))


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PG.route_pages(signals(spark, sf_dir)).select("doc_id", "route", "reason")


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PG.page_signals(pages_of_documents(table(spark, sf_dir, "documents")))
    return out.select("job_id", "page_index", F.col("text_chars").cast("long").alias("text_chars"), F.col("block_count").cast("long").alias("block_count"), F.col("image_count").cast("long").alias("image_count"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("clean_chars"), F.md5(F.encode(x, "UTF-8")).alias("clean_md5"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy chunks of each document's lines, target 200 characters."""
    d = table(spark, sf_dir, "documents")
    items = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.array(F.lit(50.0), 60.0 + 18 * i, 50.0 + 6 * F.length(x), 72.0 + 18 * i).alias("bbox"), x.alias("text")))
    chunks = d.select("doc_id", F.posexplode(BL.merge_items(items, Config(chunk_chars=200))).alias("chunk", "c"))
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("c.text").cast("long").alias("chars"), F.md5(F.encode("c.text", "UTF-8")).alias("text_md5"), F.col("c.bbox")[3].alias("bottom"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = EM.hash_embedding(T.clean(F.col("text")), 12)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(v).alias("dim", "value")).select("doc_id", F.col("dim").cast("long").alias("dim"), "value")


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a task log: signup creates, view claims, purchase completes,
    error fails; other events are none."""
    names = {"signup": "created", "view": "claimed", "purchase": "completed", "error": "failed"}
    event = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    e = table(spark, sf_dir, "events").withColumn("event", event).where("event is not null")
    return e.select(
        F.col("user_id").cast("string").alias("task_id"), F.concat(F.lit("job-"), F.pmod("user_id", F.lit(7)).cast("string")).alias("job_id"), F.when(F.pmod("user_id", F.lit(3)) == 0, "image_candidate").otherwise("table_candidate").alias("kind"),
        "ts", F.col("event_id").alias("seq"), "event", F.concat(F.lit("w"), F.pmod("event_id", F.lit(5)).cast("string")).alias("worker_id"), F.when(F.col("event") == "completed", F.col("event_id").cast("string")).alias("result"), F.when(F.col("event") == "failed", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"),
    )


def queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QU.fold(queue_events(spark, sf_dir)).select("task_id", "job_id", "kind", "status", "created_at", "leased_at", "worker_id", "result", "error", "events")


def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tasks for a worker, queued or with an expired lease."""
    claimed = QU.claim(QU.fold(queue_events(spark, sf_dir)), NOW, 10, "worker-9", lease_seconds=3600)
    return claimed.select("task_id", "status", "worker_id", "created_at")


def queue_claim_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = QU.claim(QU.fold(queue_events(spark, sf_dir)), NOW, 500, "worker-9", lease_seconds=0, kind="image_candidate")
    return claimed.select("task_id", "kind", "status")


def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = QU.fold(queue_events(spark, sf_dir)).select(F.col("task_id").alias("job_id"), "status", "error", F.lit(None).cast("timestamp").alias("completed_at"))
    return QU.interrupt_jobs(states, NOW).select("job_id", "status", "error")


def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a job."""
    d = table(spark, sf_dir, "documents")
    jobs = d.select(
        F.lit(1).alias("page_count"), (F.pmod("doc_id", F.lit(2))).alias("fast_page_count"), (1 - F.pmod("doc_id", F.lit(2))).alias("vlm_page_count"),
        F.size(F.split("text", "\n")).alias("block_count"), F.pmod("doc_id", F.lit(3)).alias("embedding_count"), (F.pmod("doc_id", F.lit(16)) / 8.0).alias("elapsed_seconds"),
    )
    return ST.job_totals(jobs)


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as load-test runs that took 4096 seconds together."""
    runs = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.pmod("event_id", F.lit(9)).alias("page_count"),
        F.pmod("event_id", F.lit(5)).alias("block_count"), (F.pmod("event_id", F.lit(32)) / 8.0).alias("wall_seconds"), (F.pmod("event_id", F.lit(16)) / 8.0).alias("service_seconds"),
        F.create_map(F.lit("vlm_seconds"), F.pmod("event_id", F.lit(64)) / 4.0).alias("timings"),
    )
    out = ST.load_summary(runs, 4096.0)
    return out.select("completed", "failed", "pages", "blocks", "pages_per_second", "service_max", "wall_max", "vlm_seconds_max", "total_seconds_avg", *[F.bround(F.col(c) * 8).cast("long").alias(f"{c}_eighths") for c in ("service_avg", "wall_avg", "vlm_seconds_avg")])


_FLAGS = ("table_candidate", "image_candidate", "native_table_needs_vlm", "native_table", "native_table_deferred", "scan_ocr", "force_vlm", "vector_graphics_candidate", "figure_caption_candidate", "image_asset_only")


def _flag_rows(spark: SparkSession) -> DataFrame:
    """Every combination of the metadata flags."""
    bit = lambda i: F.col("id").bitwiseAND(F.lit(1 << i)) != 0
    known = {k: bit(i) for i, k in enumerate(_FLAGS) if k != "image_asset_only"}
    meta = BL.metadata(**known).withField("image_asset_only", bit(9)).withField("enhancement_priority", F.lit(None).cast("string")).withField("max_image_width", F.lit(None).cast("string"))
    return spark.range(1 << len(_FLAGS)).select("id", meta.alias("m"), F.when(F.pmod("id", F.lit(3)) == 0, "").otherwise("x").alias("text"))


def task_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    own = F.array(*[F.lit(x) for x in (0.0, 0.0, 10.0, 10.0)])
    return _flag_rows(spark).select(
        "id", TK.is_candidate(m, own).alias("candidate"), TK.task_kind(m).alias("kind"), TK.block_priority(m, F.col("text"), TK.flag(m, "image_asset_only")).alias("block_priority"),
        TK.export_priority(m).alias("export_priority"), TK.bench_priority(m).alias("bench_priority"),
        *[TK.queues_image(m, Config(image_mode=k)).alias(f"queued_{n}") for k, n in (("none", "none"), ("all", "all"), ("complex_uncaptioned", "uncaptioned"), ("vector", "vector"))],
        TK.max_image_width(TK.task_kind(m), TK.block_priority(m, F.col("text"), F.lit(False)), TK.is_complex(m, F.col("text"), own)).cast("long").alias("width"),
    )


def wait_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TK.export_priority(F.col("m"))
    return _flag_rows(spark).select(p.alias("priority"), *[TK.uses_task(p, k).alias(k) for k in ("none", "required", "all")]).groupBy("priority").agg(F.count("*").alias("tasks"), *[F.count_if(F.col(k)).alias(f"used_{k}") for k in ("none", "required", "all")])


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded and clipped boxes of the parts, as boxes on a 595 x 842 page."""
    p = table(spark, sf_dir, "part")
    b = G.box(F.pmod("p_partkey", F.lit(560)), F.pmod(F.col("p_partkey") * 7, F.lit(800)), F.pmod("p_partkey", F.lit(560)) + F.col("p_size"), F.pmod(F.col("p_partkey") * 7, F.lit(800)) + F.col("p_size") * 2)
    c = G.crop(b, F.lit(40.0), F.lit(595.0), F.lit(842.0))
    return p.select("p_partkey", *[c[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], G.horizontally_related(b, F.lit(100.0), F.lit(300.0)).alias("related"), G.overlap_ratio(b, F.array(*map(F.lit, (0.0, 0.0, 256.0, 256.0)))).alias("overlap"))


def covered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no table box on their page covers to three quarters."""
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    boxes = F.array(*[F.array(*map(F.lit, b)) for b in ((0.0, 100.0, 400.0, 200.0), (0.0, 300.0, 595.0, 420.0))])
    free = F.filter("items", lambda i: ~F.exists(boxes, lambda t: G.overlap_ratio(i["bbox"], t) >= 0.75))
    return pages.select("job_id", F.col("page_index").cast("long").alias("page_index"), F.size("items").cast("long").alias("items"), F.size(free).cast("long").alias("free"))


TEXTS = (
    "Name    Qty    Price    Total\nAlpha    1    2.00    2.00\nBeta    2    3.00    6.00", "a  =  b  +  c  -  d", "plain words only", "one\ttwo\tthree", "Table 1. Results", "See Table 2: values", "Figure 3. Curve",
    "Fig. 4: shape\nTable 5. sums", "bad ×  × cell", "3 4× ×5", "a,,b", "Table 10 shows", "", "TABLE 7 : caps",
)


def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates on fixed texts that fit each of them, and on all documents."""
    x = F.col("x")
    fixed = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "id long, x string")
    rows = fixed.unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("x")))
    return rows.select("id", T.looks_like_table(x).alias("table_like"), T.has_table_caption(x).alias("table_caption"), T.is_strict_table_caption(x).alias("strict_caption"), T.has_figure_caption(x).alias("figure_caption"), T.needs_vision(x).alias("needs_vision"), F.size(T.caption_ids(x)).cast("long").alias("n_captions"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a table."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey).withColumn("row", F.array(F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit(" a|"), F.col("n_nationkey").cast("string"))))
    rows = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("mark"))), F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]))
    return j.groupBy("r_name").agg(rows.alias("rows")).select("r_name", TB.to_markdown(TB.normalise(F.col("rows"))).alias("markdown"), TB.is_usable(TB.normalise(F.col("rows"))).alias("usable"))


def _caption_sizes(d: DataFrame, lines: Column) -> DataFrame:
    items = F.transform(lines, lambda x, i: F.struct(F.array(F.lit(50.0), 60.0 + 20 * i, F.lit(300.0), 72.0 + 20 * i).alias("bbox"), x.alias("text"), i.cast("int").alias("pos")))
    caption = F.struct(F.array(F.lit(50.0), F.lit(120.0), F.lit(300.0), F.lit(132.0)).alias("bbox"), F.lit("Table 1. Sums").alias("text"), F.lit(-1).alias("pos"))
    size = lambda above: F.size(CP.cluster(items, caption, F.lit(595.0), above)).cast("long")
    return d.select("doc_id", size(True).alias("above"), size(False).alias("below"))


def caption_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions planted between all of each document's lines and the blocks that join them."""
    return _caption_sizes(table(spark, sf_dir, "documents"), F.split("text", "\n"))


def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log drained as a stream; equal to the batch fold."""
    from pagewright.sources.shared import scratch
    from pagewright.streaming.queue import fold_stream

    events = queue_events(_AsStream(spark, sf_dir), sf_dir)
    out, marks = scratch(spark, "queue-stream"), scratch(spark, "queue-marks")
    q = fold_stream(events).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start()
    q.awaitTermination()
    fields = ("job_id", "kind", "status", "created_at", "leased_at", "worker_id", "result", "error", "events")
    last = spark.read.parquet(out).groupBy("task_id").agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    return last.select("task_id", *[f"s.{f}" for f in fields])


class _AsStream:
    """Reads tables as streams where ``table`` would read them as batches."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).parquet(path.replace("events.parquet", "event[s].parquet"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        route_counters, page_routes, page_signals, clean_text, text_chunks, hash_embedding, queue_fold, queue_claim, queue_claim_kind, interrupted_jobs, job_totals,
        load_summary, task_priorities, wait_policies, crops, covered_items, text_predicates, table_markdown, caption_clusters, queue_stream,
    )
}
