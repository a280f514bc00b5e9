import datetime as dt
import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.config import Config, image_mode
from pagewright.engine import Engine
from pagewright.functions import geometry as G
from pagewright.operators import blocks as BL
from pagewright.operators import embedding as EM
from pagewright.operators import ocr as OC
from pagewright.operators import pages as PG
from pagewright.operators import payload as PL
from pagewright.operators import queue as QU
from pagewright.operators import render as RE
from pagewright.operators import stats as ST
from pagewright.operators import tasks as TK
from pagewright.session import start
from pagewright.sources.geometry import PAGE_SCHEMA, CropRenderer, PageExtractor, accepted, render_crops
from pagewright.sources.store import SCHEMAS, Store
from pagewright.streaming.jobs import jobs_stream, parse_files
from pagewright.streaming.queue import debounce, fold_stream, run_provider, run_tasks
from pagewright.streaming.worker import EventLog, Worker

SIGNALS = [
    (1200, 10, 0, 0.01, False, "fast_pymupdf", "editable_text_dense"), (0, 0, 1, 0.92, False, "vlm", "scan_or_image_heavy"), (120, 8, 0, 0.0, True, "vlm", "table_hint"),
    (1200, 20, 0, 0.0, True, "fast_pymupdf", "editable_text_dense_table_candidate"), (500, 1, 0, 0.2, False, "fast_pymupdf", "editable_text_moderate"), (220, 1, 2, 0.34, False, "fast_pymupdf", "editable_text_moderate"),
    (220, 1, 3, 0.0, False, "vlm", "mixed_or_low_confidence"), (79, 1, 0, 0.0, False, "vlm", "scan_or_image_heavy"), (80, 1, 0, 0.0, False, "vlm", "mixed_or_low_confidence"), (100, 1, 0, 0.35, False, "vlm", "scan_or_image_heavy"),
]


def test_router_boundaries(spark):
    rows = [(i, *s[:5]) for i, s in enumerate(SIGNALS)]
    df = spark.createDataFrame(rows, "i int, text_chars int, block_count int, image_count int, image_area_ratio double, has_table_hint boolean")
    got = [(r.route, r.reason) for r in PG.route_pages(df).orderBy("i").collect()]
    assert got == [s[5:] for s in SIGNALS]


def page(text, items, images=(), drawings=(), tables=(), job="j", index=0):
    return (job, index, 595.0, 842.0, text, [([float(v) for v in b], t) for b, t in items], [(x, w, h, [float(v) for v in b]) for x, w, h, b in images], [([float(v) for v in b],) for b in drawings], [([float(v) for v in b], r) for b, r in tables])


def test_fast_blocks_order_tables_and_regions(spark):
    body = "w" * 600
    rows = [["Name", "Qty"], ["a", "1"], ["b", "2"]]
    p = page(
        "Table 1. Sums\n" + body,
        [((50, 300, 500, 320), "below"), ((50, 100, 500, 120), "above"), ((60, 205, 200, 215), "inside the table")],
        images=[(7, 10, 10, (0, 0, 10, 10))], drawings=[(0, 0, 50, 50), (60, 60, 100, 100), (1, 1, 90, 90)], tables=[((50, 200, 300, 280), rows)],
    )
    routed = PG.route_pages(PG.page_signals(spark.createDataFrame([p], PAGE_SCHEMA)))
    out = BL.fast_blocks(routed, Config(drawing_threshold=3)).orderBy("block_index").collect()
    assert [(b.block_index, b.kind, b.text.split("\n")[0]) for b in out] == [
        (0, "text", "above"), (1, "native_table", "| Name | Qty |"), (2, "text", "below"), (3, "image", "[image page=0 xref=7]"), (4, "image", "[vector graphics page=0]"),
    ]
    assert all(b.block_id.startswith(f"j-p0000-b000{i}-") for i, b in enumerate(out))
    assert out[1].metadata.native_table and not out[1].metadata.native_table_needs_vlm


def test_chunks_are_greedy(spark):
    items = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in (0, i, 10, i + 1)]).alias("bbox"), F.lit("x" * n).alias("text")) for i, n in enumerate((150, 50, 1, 300, 10))])
    out = spark.range(1).select(BL.merge_items(items, Config(chunk_chars=100)).alias("c")).first().c
    assert [len(c.text) for c in out] == [201, 1, 300, 10]
    assert out[0].bbox == [0, 0, 10, 2]


def test_deferred_caption_cluster(spark):
    items = [((50, 60, 300, 70), "Name    Qty    Price    Total"), ((50, 72, 300, 82), "a    1    2    3"), ((50, 90, 300, 100), "Table 1. Grid"), ((50, 400, 300, 410), "far away text")]
    p = page("x" * 600, items)
    routed = PG.route_pages(PG.page_signals(spark.createDataFrame([p], PAGE_SCHEMA)))
    out = BL.fast_blocks(routed, Config(native_table_mode="defer")).orderBy("block_index").collect()
    assert len(out) == 2 and out[0].metadata.native_table_deferred and out[0].metadata.table_caption == "Table 1. Grid"
    assert out[0].bbox == [50, 60, 300, 100] and out[1].text == "far away text"


def blocks_frame(spark, rows):
    return spark.createDataFrame([(r["job_id"], r["page_index"], r["block_index"], "s", r["kind"], r["text"], r.get("bbox", [50.0, 80.0, 300.0, 180.0])) for r in rows], "job_id string, page_index int, block_index int, source string, kind string, text string, bbox array<double>")


def test_tasks(spark):
    cases = [
        (dict(native_table=True, native_table_needs_vlm=True), "required", 768), (dict(scan_ocr=True, table_candidate=True, native_table_needs_vlm=True), "required", 768),
        (dict(table_candidate=True, native_table_deferred=True), "optional", 640), (dict(image_candidate=True, vector_graphics_candidate=True, figure_caption_candidate=True), None, None),
    ]
    pages = spark.createDataFrame([("j", 0, 595.0, 842.0)], "job_id string, page_index int, width double, height double")
    for meta, priority, width in cases:
        b = blocks_frame(spark, [dict(job_id="j", page_index=0, block_index=0, kind="native_table", text="t")])
        b = BL.with_block_ids(b.withColumn("metadata", BL.metadata(**{k: F.lit(v) for k, v in meta.items()})))
        got = TK.tasks_from_blocks(b, pages, Config(image_mode="complex_uncaptioned")).collect()
        if priority is None:
            assert got == []
        else:
            assert (got[0].metadata.enhancement_priority, got[0].metadata.max_image_width, got[0].kind) == (priority, width, "table_candidate")
            assert got[0].bbox == [10, 40, 340, 220]


def test_queue_lifecycle(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    events = [("a", "j", "table_candidate", at(0), 1, "created", None, None, None), ("b", "j", "image_candidate", at(1), 2, "created", None, None, None), ("a", "j", "table_candidate", at(2), 3, "claimed", "dead", None, None)]
    e = spark.createDataFrame(events, "task_id string, job_id string, kind string, ts timestamp, seq long, event string, worker_id string, result string, error string")
    tasks = QU.fold(e)
    assert {r.task_id: r.status for r in tasks.collect()} == {"a": "processing", "b": "queued"}
    assert [r.task_id for r in QU.claim(tasks, at(10), 5, "w").collect()] == ["b"]
    again = QU.claim(tasks, at(10), 5, "w", lease_seconds=0)
    assert [(r.task_id, r.worker_id) for r in again.collect()] == [("a", "w"), ("b", "w")]
    assert [r.task_id for r in QU.claim(tasks, at(10), 5, "w", lease_seconds=0, kind="image_candidate").collect()] == ["b"]
    assert QU.claim(tasks, at(10), 0, "w", lease_seconds=60).count() == 1  # limits are held between 1 and 100
    done = QU.complete(QU.apply_claim(tasks, again), "a", "late", "r")
    assert [(r.status, r.result, r.worker_id) for r in done.where("task_id = 'a'").collect()] == [("completed", "r", "late")]
    failed = QU.fail(done, "a", "w", "x" * 5000).where("task_id = 'a'").first()
    assert failed.status == "failed" and failed.result == "r" and len(failed.error) == 4000
    assert QU.complete(again, "a", "other", "r", strict=True).where("status = 'completed'").count() == 0


def test_provider_failure_fails_its_batch(spark):
    claimed = spark.createDataFrame([("a",), ("b",)], "task_id string").coalesce(1)
    good = run_provider(claimed, lambda tasks: [t["task_id"] * 2 for t in tasks], "w").collect()
    assert sorted((r.event, r.result) for r in good) == [("completed", "aa"), ("completed", "bb")]

    def broken(tasks):
        raise RuntimeError("no engine")

    assert {(r.event, r.error) for r in run_provider(claimed, broken, "w").collect()} == {("failed", "no engine")}


TSV = "\n".join(["\t".join(OC._FIELDS)] + ["\t".join(map(str, (5, 1, b, 1, line, w, left, top, 60, 20, conf, text))) for b, line, w, left, top, conf, text in [
    (1, 1, 1, 100, 90, 95, "Table"), (1, 1, 2, 170, 90, 95, "1"), (1, 1, 3, 240, 90, 95, "Summary"), (1, 2, 1, 100, 125, 90, "Metric"), (1, 2, 2, 400, 125, -1, "Value"),
    (1, 3, 1, 100, 155, 90, "Alpha"), (1, 3, 2, 400, 155, 90, "42"), (1, 3, 3, 500, 155, 10, "noise"), (2, 1, 1, 100, 230, 90, "Scanned"), (2, 1, 2, 170, 230, 90, "body"), (2, 1, 3, 240, 230, 90, "text"),
]])


def test_ocr_lines_and_blocks(spark):
    tsv = spark.createDataFrame([("j", 0, TSV)], "job_id string, page_index int, tsv string")
    lines = OC.lines(OC.words(tsv))
    texts = [r.text for r in lines.orderBy("line_index").collect()]
    assert texts[0] == "Table 1 Summary" and texts[1].startswith("Metric  ") and "noise" not in texts[2] and texts[3] == "Scanned body text"
    pages = spark.createDataFrame([("j", 0, 595.0, 842.0, "scan_or_image_heavy")], "job_id string, page_index int, width double, height double, reason string")
    out = OC.blocks_from_lines(lines, pages).orderBy("block_index").collect()
    assert [b.kind for b in out] == ["image", "native_table", "text"]
    assert out[1].text.startswith("Table 1 Summary\nMetric") and out[2].text == "Scanned body text"


def test_embeddings(spark):
    b = spark.createDataFrame([("j", "b1", "é text"), ("j", "b2", "")], "job_id string, block_id string, text string")
    native = {r.block_id: r.vector for r in EM.embed_blocks(b, 12).collect()}
    other = {r.block_id: r.vector for r in EM.embed_with(b, lambda: EM.HashProvider(12)).collect()}
    assert native == other and len(native["b1"]) == 12
    pooled = spark.range(1).select(EM.mean_pool(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))).alias("v")).first().v
    assert pooled == [0.707107, 0.707107]
    with pytest.raises(ValueError):
        EM.provider("nothing")


def render_case(spark, policy, result, text="Table 1. a", meta=None, priority="optional"):
    b = blocks_frame(spark, [dict(job_id="j", page_index=0, block_index=0, kind="native_table", text=text), dict(job_id="j", page_index=0, block_index=1, kind="text", text="tail")])
    b = BL.with_block_ids(b.withColumn("metadata", BL.metadata(**(meta or {}))))
    t = b.where("block_index = 0").select(F.lit("t1").alias("task_id"), "job_id", "block_id", "page_index", F.lit("table_candidate").alias("kind"), F.lit("completed").alias("status"), F.lit(result).alias("result"))
    flags = [F.lit(False).alias(k) for k in ("image_asset_only", "scan_ocr", "page_vlm", "force_vlm", "native_table_needs_vlm", "native_table")]
    t = t.withColumn("metadata", F.struct(F.lit(priority).alias("enhancement_priority"), *flags))
    jobs = spark.createDataFrame([("j", 'T "q"', "a.pdf", 1)], "job_id string, title string, source_pdf string, page_count int")
    return RE.render_documents(jobs, b, t, policy).first().markdown


def test_render_policies_and_gate(spark):
    assert RE.render_documents.__defaults__[0] == "all"
    assert "Table 1. a" in render_case(spark, "none", "Table 1. new") and "new" not in render_case(spark, "required", "Table 1. new")
    md = render_case(spark, "all", "Table 1. new")
    assert "Table 1. new\n\ntail\n" in md and 'title: "T \\"q\\""' in md and md.startswith("---\n") and "## Page 1" in md
    assert "Figure 34" not in render_case(spark, "all", "Table 1. new Figure 34. x")
    assert "Figure 34" in render_case(spark, "required", "Figure 34. x", priority="required")
    with pytest.raises(ValueError):
        render_case(spark, "some", "x")


def test_archive_payloads(spark):
    def archive(**files):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in files.items():
                z.writestr(name.replace("__", "."), text)
        return data.getvalue()

    items = json.dumps([[{"type": "table", "html": "<b>", "bbox": [1, 2, 3, 4.567]}], {"text": "  "}, {"content": "c", "poly": [1, "x", 3, 4]}])
    rows = [("j", 0, archive(p_content_list__json=items)), ("k", 0, archive(a__md="# hi", bad_content_list__json="{")), ("m", 0, b"no zip")]
    df = spark.createDataFrame(rows, "job_id string, page_index int, content binary")
    got = [(r.job_id, r.kind, r.text, r.bbox) for r in PL.archive_blocks(df).orderBy("job_id", "block_index").collect()]
    assert got == [("j", "table", "<b>", [1.0, 2.0, 3.0, 4.57]), ("j", "text", "c", None), ("k", "markdown", "# hi", None)]
    nested = json.dumps({"pages": [[{"type": "text", "content": "one"}, {"layout": {"markdown": " two "}}]]})
    out = PL.content_markdown(spark.createDataFrame([("t", nested), ("u", "{")], "task_id string, payload string")).orderBy("task_id").collect()
    assert [(r.n_items, r.markdown) for r in out] == [(2, "one\n\ntwo"), (0, "")]
    assert PL.split_batch([1, 2], 2) == [1, 2] and PL.split_batch([1, 2], 1) == [[1, 2]]
    with pytest.raises(ValueError):
        PL.split_batch([1], 2)


def test_store_replaces_all_rows_of_a_job(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.init()
    df = lambda rows: spark.createDataFrame(rows, "job_id string, page_index int, block_index int, text string")
    s.replace("blocks", df([("a", 0, 0, "x"), ("a", 0, 1, "y"), ("b", 0, 0, "z")]))
    s.replace("blocks", df([("a", 0, 0, "new")]))
    assert [(r.job_id, r.text) for r in s.read("blocks").orderBy("job_id").collect()] == [("a", "new"), ("b", "z")]
    assert s.blocks("a").count() == 1
    task = spark.createDataFrame([("t", "a", "k", 0)], "task_id string, job_id string, block_id string, page_index int")
    s.save(task, enhancement_tasks=task, blocks=df([("a", 0, 0, "kept")]))
    s.save(task, enhancement_tasks=task.limit(0))  # parsed again without tasks: none is left
    assert s.enhancement_tasks("a").count() == 0 and [r.text for r in s.blocks("a").collect()] == ["kept"]
    assert s.vacuum(f"file://{tmp_path}/copy").read("blocks").count() == 2
    with pytest.raises(KeyError):
        s.job("nobody")


def test_start_fails_open_jobs_and_updates_elapsed(spark, tmp_path):
    store, n = start(f"file://{tmp_path}/store", spark)
    assert n == 0
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", "processing", t0), ("b", "completed", t0)], "job_id string, status string, created_at timestamp")
    full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in SCHEMAS["jobs"].split(", "))])
    store.replace("jobs", full)
    store.update_elapsed("b", 1.25, {"total_seconds": 1.25})
    again, n = start(f"file://{tmp_path}/store", spark, dt.datetime(2024, 1, 2))
    got = {r.job_id: (r.status, r.error, r.elapsed_seconds) for r in again.read("jobs").collect()}
    assert n == 1 and got == {"a": ("failed", "interrupted by service restart", None), "b": ("completed", None, 1.25)}
    assert again.job("b").first().timings == {"total_seconds": 1.25}


def test_claims_need_a_lease_time_and_clamp_timeouts(spark):
    t0 = dt.datetime(2024, 1, 1)
    tasks = spark.createDataFrame([("a", "processing", t0, None), ("b", "processing", t0, t0), ("c", "queued", t0, None)], "task_id string, status string, created_at timestamp, leased_at timestamp").withColumns({"worker_id": F.lit(None).cast("string"), "error": F.lit("e")})
    got = lambda s: {r.task_id for r in QU.claim(tasks, t0, 9, "w", lease_seconds=s).collect()}
    assert got(None) == {"c"} and got(0) == {"b", "c"} and got(-5) == {"b", "c"} and got(1) == {"c"}


def test_image_modes_and_assets(spark):
    modes = {"asset-only": "none", "asset": "none", "off": "none", "none": "none", None: "none", "Yes": "all", "all": "all", "disabled": "disabled", "asset_only": "asset_only", "No-Caption": "no-caption"}
    assert {m: image_mode(m) for m in modes} == modes
    meta = lambda **k: BL.metadata(image_candidate=F.lit(True), **{n: F.lit(v) for n, v in k.items()})
    captioned, vector, plain_, forced = meta(vector_graphics_candidate=True, figure_caption_candidate=True), meta(vector_graphics_candidate=True), meta(), meta(force_vlm=True)
    for mode, want in (("none", [0, 0, 0, 1]), ("all", [1, 1, 1, 1]), ("no-caption", [0, 1, 0, 1]), ("complex-uncaptioned", [0, 1, 0, 1]), ("disabled", [1, 1, 0, 1])):
        assert list(spark.range(1).select(*[TK.queues_image(m, Config(image_mode=mode)).cast("int") for m in (captioned, vector, plain_, forced)]).first()) == want
    lines = spark.createDataFrame([("j", 0, 0, "some text", [0.0, 0.0, 9.0, 9.0])], "job_id string, page_index int, line_index int, text string, bbox array<double>")
    pages = spark.createDataFrame([("j", 0, 595.276, 841.8898, "scan_or_image_heavy")], "job_id string, page_index int, width double, height double, reason string")
    b = OC.blocks_from_lines(lines, pages)
    assert b.where("block_index = 0").first().bbox == [0.0, 0.0, 595.28, 841.89]
    assert TK.tasks_from_blocks(b, pages).count() == 0
    (task,) = TK.tasks_from_blocks(b, pages, Config(image_mode="all")).collect()
    assert (task.kind, task.metadata.enhancement_priority, task.metadata.image_asset_only, task.metadata.image_vlm_mode) == ("image_candidate", "required", False, "all")
    marked = TK.mark_candidates(b, pages).where("block_index = 0").first().metadata
    assert (marked.enhancement_priority, marked.image_asset_only, marked.crop_path, marked.crop_padding, marked.crop_scale) == ("asset_only", True, "j/page-0000-block-0000.png", 8.0, 2.0)


def test_stream_takes_events_in_any_order(spark, tmp_path):
    """Events split over micro-batches in any order give the batch fold."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    e = [("a", "j", "k", at(0), 1, "created", None, None, None), ("a", "j", "k", at(5), 2, "claimed", "w1", None, None), ("a", "j", "k", at(9), 3, "completed", "w1", "r1", None), ("a", "j", "k", at(20), 5, "failed", "w2", None, "x" * 4100), ("a", "j", "k", at(12), 4, "claimed", "w2", None, None),
         ("b", "j", "k", at(3), 1, "created", None, None, None), ("b", "j", "k", at(1), 0, "created", None, None, None), ("b", "j", "k", at(4), 2, "claimed", "w3", None, None)]
    schema = "task_id string, job_id string, kind string, ts timestamp, seq long, event string, worker_id string, result string, error string"
    for k, i in enumerate((4, 3, 7, 2, 0, 1, 6, 5)):
        spark.createDataFrame([e[i]], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = fold_stream(events).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/marks").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("batch").distinct().count() > 2
    names = ["task_id", "job_id", "kind", "status", "created_at", "leased_at", "worker_id", "result", "error", "events"]
    last = out.groupBy("task_id").agg(F.max_by(F.struct(*names[1:]), "batch").alias("s")).select("task_id", "s.*")
    want = QU.fold(spark.createDataFrame(e, schema)).select(*names)
    assert sorted(map(tuple, last.select(*names).collect())) == sorted(map(tuple, want.collect()))


def test_worker_rounds(spark, tmp_path):
    log = EventLog(spark, f"{tmp_path}/log")
    tasks = spark.createDataFrame([(f"t{i}", "j", "image_candidate" if i == 3 else "table_candidate", i) for i in range(5)], "task_id string, job_id string, kind string, page_index int")

    def call(task):
        if task["task_id"] == "t1":
            time.sleep(3)
        if task["task_id"] == "t2":
            raise RuntimeError("bad")
        return "r"

    worker = Worker(log, lambda df, w: run_tasks(df, call, w, 0.5, 2), "w", limit=3)
    assert worker.once() == {"claimed": 0, "completed": 0, "failed": 0, "claim_errors": 1}  # there is no log yet
    log.create(tasks, dt.datetime(2024, 1, 1))
    seen = []
    assert worker.loop(0.0, rounds=3, report=seen.append) == {"claimed": 5, "completed": 3, "failed": 2}
    assert [c["claimed"] for c in seen] == [3, 2, 0]
    state = {r.task_id: (r.status, r.error, r.result, r.worker_id) for r in log.tasks().collect()}
    assert state["t1"] == ("failed", "VLM crop parse timed out after 0.5s", None, "w") and state["t2"] == ("failed", "bad", None, "w") and state["t3"] == ("completed", None, "r", "w")


class Pages(PageExtractor):
    def pages(self, job_id, data):
        if data == b"broken":
            raise OSError("no pages")
        for i in range(len(data)):
            yield {"job_id": job_id, "page_index": i, "width": 595.0, "height": 842.0, "text": "w " * 400, "items": [{"bbox": [0.0, 0.0, 9.0, 9.0], "text": "w  w"}], "images": [], "drawings": [], "tables": []}


def test_files_become_jobs(spark, tmp_path):
    (tmp_path / "up").mkdir()
    for name, data in (("a.pdf", b"xx"), ("b.txt", b"x"), ("c.pdf", b"x")):
        (tmp_path / "up" / name).write_bytes(data)
    store, _ = start(f"file://{tmp_path}/store", spark)
    parsed = parse_files(spark, f"file://{tmp_path}/up", Pages, store=store)
    assert parsed.blocks.count() == 3 and {(r.file_name, r.status, r.page_count, r.block_count) for r in store.read("jobs").collect()} == {("a.pdf", "completed", 2, 2), ("c.pdf", "completed", 1, 1)}
    job = store.read("jobs").where("file_name = 'a.pdf'").first().job_id
    assert [r.text for r in store.blocks(job).collect()] == ["w w", "w w"] and store.job(job).count() == 1
    (tmp_path / "up" / "d.pdf").write_bytes(b"broken")
    jobs_stream(spark, f"file://{tmp_path}/up", store, f"{tmp_path}/marks", Pages).awaitTermination()
    got = {r.file_name: (r.status, r.error) for r in store.read("jobs").collect()}
    assert set(got) == {"a.pdf", "c.pdf", "d.pdf"} and got["d.pdf"][0] == "failed" and "Failed to open PDF" in got["d.pdf"][1]
    assert accepted("x.PDF") == "x.PDF"
    with pytest.raises(ValueError):
        accepted("x.txt")


def test_scanner_reasons(spark):
    images = spark.createDataFrame([("j", i, bytes([i])) for i in range(3)], "job_id string, page_index int, image binary")

    class Scan(OC.Scanner):
        def scan(self, image):
            return [(TSV, "ok"), ("level\n", "ok"), (None, "tesseract_error:late")][image[0]]

    got = {r.page_index: (r.available, r.reason) for r in OC.scan_pages(images, Scan).collect()}
    assert got == {0: (True, "ok"), 1: (False, "no_ocr_lines"), 2: (False, "tesseract_error:late")}
    assert OC.scan_pages(images, Scan, Config(ocr_mode="magic")).first().reason == "unsupported_scan_ocr_mode:magic"
    assert OC.CommandScanner("no-such-command").scan(b"") == (None, "tesseract_not_found")


def test_providers_and_results():
    def post(url, body, key):
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    remote = EM.provider("remote", post=post, url="http://h/v1/", model="m", key="k")
    assert remote.embed(["a", "bbb"]) == [[1.0], [3.0]] and EM.provider("remote", post=post, url="http://h/v1/", model="m", key="k") is remote
    with pytest.raises(ValueError):
        EM.RemoteProvider(post, "u", "m", "")
    pooled = EM.PooledProvider(lambda texts: ([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]]], [[1, 1, 0]]), "m", 2)
    assert pooled.embed(["x"]) == [[0.707107, 0.707107]]

    class Model:
        def model_dump(self):
            return {"content": " c ", 3: (1, {2})}

    assert PL.jsonable([Model(), object]) == [{"content": " c ", "3": [1, [2]]}, str(object)]
    r = PL.task_result("p.png", [[Model()], {"x": {"text": "t"}}], (3, 4), 1.5, 640)
    assert (r["markdown"], r["image_size"], r["max_image_width"], len(r["content_items"]), r["crop_path"]) == ("c\n\nt", [3, 4], 640, 2, "p.png")


def test_archives_of_workers_and_their_limits(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b.md", " first \n" + "x" * 3000)
        for i in range(90):
            z.writestr(f"n{i}", "")
        z.writestr("q_content_list.json", json.dumps([{"text": "a"}, [{"type": "t"}]]))
        z.writestr("r_content_list_v2.json", json.dumps({"text": "not a list"}))
    df = spark.createDataFrame([("j", 0, data.getvalue()), ("k", 1, b"?")], "job_id string, page_index int, content binary")
    a, b = PL.worker_results(df).orderBy("job_id").collect()
    assert len(a.zip_entries) == 80 and a.markdown.startswith(" first \n") and json.loads(a.content_items) == [{"text": "a"}, {"type": "t"}] and a.n_items == 2
    assert b.error and b.markdown is None
    s = PL.archive_summary(df).orderBy("job_id").first()
    assert len(s.zip_entries) == 40 and s.markdown_preview is None


def test_service_calls_and_crops(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.md", "# m")
        z.writestr("a_content_list.json", json.dumps([{"text": "t"}]))
    got = json.loads(PL.ServiceCall(lambda task: (200, data.getvalue()))({}))
    assert got == {"status_code": 200, "zip_entries": ["a.md", "a_content_list.json"], "markdown": "# m", "content_items": [{"text": "t"}]}
    with pytest.raises(RuntimeError, match="^x{2000}$"):
        PL.ServiceCall(lambda task: (500, b"x" * 5000), 2000)({})
    with pytest.raises(zipfile.BadZipFile):
        PL.ServiceCall(lambda task: (200, b"no zip"))({})
    assert PL.set_options(a=1, b=None, c="", d=0) == {"a": 1, "d": 0}

    class Box(CropRenderer):
        def crop(self, job_id, page_index, bbox, scale):
            return f"{job_id} {page_index} {bbox} {scale}".encode()

    b = BL.with_block_ids(blocks_frame(spark, [dict(job_id="j", page_index=2, block_index=0, kind="text", text="t")]).withColumn("metadata", BL.metadata(table_candidate=F.lit(True))))
    pages = spark.createDataFrame([("j", 2, 595.0, 842.0)], "job_id string, page_index int, width double, height double")
    r = render_crops(TK.mark_candidates(b, pages), Box).first()
    assert (r.crop_path, bytes(r.content)) == ("j/page-0002-block-0000.png", b"j 2 [10.0, 40.0, 340.0, 220.0] 4.0")


def test_rounding_is_of_the_binary_value(spark):
    values = [2.675, 0.125, 1.005, 0.375, -2.675, -0.125, 595.276, 1e9 + 0.015, 0.0, 2.5, 0.005, 1.115, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (2, 3, 4):
        assert [r[0] for r in df.select(G.rounded(F.col("x"), places)).collect()] == [round(v, places) for v in values]


def test_appended_blocks_are_numbered_on(spark):
    b = BL.with_block_ids(blocks_frame(spark, [dict(job_id="j", page_index=0, block_index=i, kind="text", text="t") for i in range(2)]).withColumn("metadata", BL.metadata()))
    more = b.where("block_index = 0").unionByName(BL.with_block_ids(blocks_frame(spark, [dict(job_id="j", page_index=1, block_index=0, kind="text", text="u")]).withColumn("metadata", BL.metadata())))
    out = BL.append_blocks(b, more).orderBy("page_index", "block_index").collect()
    assert [(r.page_index, r.block_index) for r in out] == [(0, 0), (0, 1), (0, 2), (1, 0)] and len({r.block_id for r in out}) == 4


def test_engine_end_to_end(spark):
    rows = [page("w " * 400, [((50, 60, 500, 80), "w " * 400)]), page("", [], images=[(1, 10, 10, (0, 0, 595, 842))], index=1)]
    p = Engine(Config(embedding_dim=16)).parse(spark.createDataFrame(rows, PAGE_SCHEMA))
    jobs = p.jobs.first()
    assert (jobs.page_count, jobs.fast_page_count, jobs.vlm_page_count, jobs.block_count, jobs.embedding_count, jobs.enhancement_task_count) == (2, 1, 1, 2, 2, 1)
    assert [r.page_index for r in p.in_order().blocks.collect()] == [0, 1]
    ocr = spark.createDataFrame([("j", 1, TSV)], "job_id string, page_index int, tsv string")
    with_ocr = Engine(Config(ocr_min_chars=10)).parse(spark.createDataFrame(rows, PAGE_SCHEMA), ocr)
    assert {r.source for r in with_ocr.blocks.select("source").distinct().collect()} == {"fast_pymupdf", "scan_ocr_tesseract"}


def test_bench_summary(spark):
    jobs = spark.createDataFrame([("j", 12, 1.5, 0.75)], "job_id string, page_count int, wall_seconds double, parse_wall_seconds double")
    flags = "image_asset_only:boolean,scan_ocr:boolean,page_vlm:boolean,force_vlm:boolean"
    tasks = spark.createDataFrame([("j", s, (p, False, False, False, False)) for s, p in (("completed", "required"), ("queued", "optional"), ("completed", "asset_only"))], f"job_id string, status string, metadata struct<enhancement_priority:string,{flags}>")
    r = ST.bench_summary(jobs, tasks).first()
    assert (r.pages_per_second, r.required_priority_tasks, r.optional_priority_tasks, r.asset_only_priority_tasks) == (8.0, 1, 1, 1)
    assert [TK.pending(tasks, p).count() for p in ("none", "required", "all")] == [0, 0, 1]


def test_debounce_counts_from_the_last_run(spark):
    at = [("a", 0), ("a", 40), ("a", 80), ("a", 120), ("a", 140), ("b", 40), (None, 0), (None, 70)]
    rows = spark.createDataFrame(at, "group string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.group, r.s): r.runs for r in debounce(rows, 60).collect()}
    assert {k for k, v in got.items() if v} == {("a", 0), ("a", 80), ("a", 140), ("b", 40), (None, 0), (None, 70)} and len(got) == len(at)
