"""Ordered, content-addressed blocks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config
from pagewright.functions import geometry as G
from pagewright.functions import tables as TB
from pagewright.functions import text as T

from .captions import deferred_tables

def merge_items(items: Column, config: Config = DEFAULT) -> Column:
    """Greedy chunks of an ordered array of (bbox, text): an item starts a new chunk when the
    lengths so far (separators not counted) and its own pass the target. The fold carries
    the open chunk's length and the places where chunks start; texts are joined once."""
    target = max(config.chunk_floor, config.chunk_chars)
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        opens = (F.size(acc["starts"]) == 0) | (acc["n"] + x["n"] > target)
        return F.struct(
            F.when(opens, x["n"]).otherwise(acc["n"] + x["n"]).cast("int").alias("n"),
            F.when(opens, F.concat(acc["starts"], F.array(x["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    sizes = F.transform(items, lambda x, i: F.struct(F.length(x["text"]).alias("n"), i.cast("int").alias("i")))
    ranges = F.aggregate(sizes, start, step, lambda acc: F.transform(acc["starts"], lambda s, i: F.struct(s.alias("s"), F.get(acc["starts"], i + 1).alias("e"))))

    def chunk(r: Column) -> Column:
        own = F.slice(items, r["s"] + 1, F.coalesce(r["e"], F.size(items)) - r["s"])
        return F.struct(G.rounded_box(G.union_of(F.transform(own, lambda x: x["bbox"]))).alias("bbox"), F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))

    return F.transform(ranges, chunk)


def block_id(job: Column, page: Column, index: Column, kind: Column, source: Column, text: Column, bbox: Column) -> Column:
    """Content-derived id; metadata is not part of it."""
    payload = F.to_json(
        F.struct(bbox.alias("bbox"), index.alias("block_index"), job.alias("job_id"), kind.alias("kind"), page.alias("page_index"), source.alias("source"), text.alias("text")),
        {"ignoreNullFields": "false"},
    )
    digits = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(4), F.length(c.cast("string"))), "0")
    return F.concat(job, F.lit("-p"), digits(page), F.lit("-b"), digits(index), F.lit("-"), F.substring(F.sha1(payload), 1, 12))


def task_id(job: Column, block: Column, kind: Column, crop_path: Column) -> Column:
    payload = F.to_json(F.struct(block.alias("block_id"), crop_path.alias("crop_path"), job.alias("job_id"), kind.alias("kind")), {"ignoreNullFields": "false"})
    return F.concat(job, F.lit("-enh-"), F.substring(F.sha1(payload), 1, 16))


def native_tables(config: Config = DEFAULT) -> Column:
    """The usable tables of a routed page: bbox, text, rows, table_index, needs_vision."""
    found = F.transform(F.col("tables"), lambda t, i: F.struct(G.rounded_box(t["bbox"]).alias("bbox"), TB.normalise(t["rows"]).alias("rows"), i.cast("int").alias("table_index")))
    made = F.transform(F.filter(found, lambda t: TB.is_usable(t["rows"])), lambda t: F.struct(t["bbox"].alias("bbox"), TB.to_markdown(t["rows"]).alias("text"), t["rows"].alias("rows"), t["table_index"].alias("table_index")))
    out = F.transform(made, lambda t: F.struct(t["bbox"].alias("bbox"), t["text"].alias("text"), t["rows"].alias("rows"), t["table_index"].alias("table_index"), T.needs_vision(t["text"]).alias("needs_vision")))
    return F.when(T.extract_native_tables(F.col("text"), F.col("reason"), config), out).otherwise(F.slice(out, 1, 0))


_META = (
    ("route_reason", "string"), ("native_table", "boolean"), ("native_table_needs_vlm", "boolean"), ("native_table_deferred", "boolean"), ("table_candidate", "boolean"),
    ("table_index", "int"), ("table_rows", "array<array<string>>"), ("table_caption", "string"), ("image_candidate", "boolean"), ("xref", "int"), ("width", "int"), ("height", "int"),
    ("vector_graphics_candidate", "boolean"), ("figure_caption_candidate", "boolean"), ("drawing_threshold", "int"), ("force_vlm", "boolean"), ("page_vlm", "boolean"), ("scan_ocr", "boolean"),
    ("archive", "string"), ("raw", "string"),
    # set where a block becomes a candidate of the vision queue
    ("crop_path", "string"), ("crop_bbox", "array<double>"), ("crop_padding", "double"), ("crop_scale", "double"), ("image_vlm_mode", "string"), ("image_asset_only", "boolean"),
    ("enhancement_priority", "string"), ("max_image_width", "int"),
)


def metadata(**known: Column) -> Column:
    """The typed metadata of a block; absent keys are null."""
    return F.struct(*[(known[k] if k in known else F.lit(None)).cast(t).alias(k) for k, t in _META])


def fast_blocks(routed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Blocks of the pages on the fast route: text, tables and captions in reading order, then
    images, then a region of vector graphics."""
    pages = routed.where(F.col("route") == "fast_pymupdf").withColumn("_native", native_tables(config))
    tidy = F.transform("items", lambda i, p: F.struct(G.rounded_box(i["bbox"]).alias("bbox"), T.clean(i["text"]).alias("text"), i["text"].alias("raw"), p.cast("int").alias("pos")))
    keep = pages.withColumn("_items", F.filter(tidy, lambda i: i["text"] != ""))
    covered = lambda i, ts: F.exists(ts, lambda t: G.overlap_ratio(i["bbox"], t["bbox"]) >= config.overlap_drop)
    keep = keep.withColumn("_items", F.filter("_items", lambda i: ~covered(i, F.col("_native"))))
    keep = deferred_tables(keep, config)  # adds _deferred: bbox, text, caption
    keep = keep.withColumn("_items", F.filter("_items", lambda i: ~covered(i, F.col("_deferred"))))
    keep = keep.withColumn("_items", F.transform("_items", lambda i: F.struct(i["bbox"].alias("bbox"), i["text"].alias("text"), T.looks_like_table(i["raw"]).alias("hint"))))
    plain = (F.size("_native") == 0) & (F.size("_deferred") == 0) & ~F.col("reason").contains("table_candidate") & ~F.exists("_items", lambda i: i["hint"])
    chunks = F.transform(merge_items(F.col("_items"), config), lambda c: F.struct(c["bbox"].alias("bbox"), c["text"].alias("text"), F.lit(False).alias("hint")))
    keep = keep.withColumn("_merged", F.when(plain, chunks).otherwise(F.col("_items")))

    def entry(phase: int, kind: str, b: Column, text: Column, pos: Column, meta: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), b[1].alias("y"), b[0].alias("x"), pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), text.alias("text"), b.alias("bbox"), meta.alias("metadata"))

    r = F.col("reason")
    texts = F.transform("_merged", lambda t, p: entry(0, "text", t["bbox"], t["text"], p, metadata(route_reason=r, table_candidate=t["hint"])))
    deferred = F.transform("_deferred", lambda t, p: entry(0, "text", t["bbox"], t["text"], p + 100_000, metadata(route_reason=r, table_candidate=F.lit(True), native_table_deferred=F.lit(True), table_caption=t["caption"])))
    native = F.transform("_native", lambda t, p: entry(0, "native_table", t["bbox"], t["text"], p + 200_000, metadata(route_reason=r, native_table=F.lit(True), table_candidate=F.lit(False), native_table_needs_vlm=t["needs_vision"], table_index=t["table_index"], table_rows=t["rows"])))
    number = F.col("page_index").cast("string")
    images = F.transform(
        "images",
        lambda i, p: entry(1, "image", G.rounded_box(i["bbox"]), F.concat(F.lit("[image page="), number, F.lit(" xref="), i["xref"].cast("string"), F.lit("]")), p, metadata(route_reason=r, image_candidate=F.lit(True), xref=i["xref"], width=i["width"], height=i["height"])),
    )
    caption = T.has_figure_caption(F.col("text"))
    threshold = F.when(caption & F.lit(config.drawing_threshold > 0), F.lit(min(config.drawing_threshold, config.figure_drawing_threshold))).otherwise(F.lit(config.drawing_threshold))
    keep = keep.withColumn("_region", G.rounded_box(G.vector_region(F.transform("drawings", lambda d: d["bbox"]), F.col("width"), F.col("height"), threshold)))
    vector = F.when(F.col("_region").isNull(), F.slice(images, 1, 0)).otherwise(
        F.array(entry(2, "image", F.col("_region"), F.concat(F.lit("[vector graphics page="), number, F.lit("]")), F.lit(0), metadata(route_reason=r, image_candidate=F.lit(True), vector_graphics_candidate=F.lit(True), figure_caption_candidate=caption, drawing_threshold=threshold)))
    )
    rows = keep.select("job_id", "page_index", F.posexplode(_in_order(F.concat(texts, deferred, native), images, vector)).alias("block_index", "b"))
    out = rows.select("job_id", "page_index", "block_index", F.lit("fast_pymupdf").alias("source"), "b.kind", "b.text", "b.bbox", "b.metadata")
    return with_block_ids(out)


def _in_order(first: Column, images: Column, vector: Column) -> Column:
    """Reading order inside the first phase; the position settles ties."""
    keyed = F.transform(first, lambda e: F.struct(e["y"].alias("y"), e["x"].alias("x"), e["pos"].alias("pos"), e.alias("e")))
    return F.concat(F.transform(F.array_sort(keyed), lambda k: k["e"]), images, vector)


def with_block_ids(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_id", block_id(F.col("job_id"), F.col("page_index"), F.col("block_index"), F.col("kind"), F.col("source"), F.col("text"), F.col("bbox")))


def page_vision_blocks(routed: DataFrame) -> DataFrame:
    """One whole-page block for each page on the vision route."""
    pages = routed.where(F.col("route") == "vlm")
    text = F.concat(F.lit("[page vlm page="), F.col("page_index").cast("string"), F.lit("]"))
    meta = metadata(route_reason=F.col("reason"), image_candidate=F.lit(True), force_vlm=F.lit(True), page_vlm=F.lit(True), image_asset_only=F.lit(False))
    box = G.rounded_box(G.box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")))
    out = pages.select("job_id", "page_index", F.lit(0).alias("block_index"), F.lit("async_page_vlm").alias("source"), F.lit("image").alias("kind"), text.alias("text"), box.alias("bbox"), meta.alias("metadata"))
    return with_block_ids(out)


def append_blocks(blocks: DataFrame, more: DataFrame) -> DataFrame:
    """``blocks`` and the blocks that another extraction of the same pages found: these are
    numbered on from the page's own, and get the ids of their new places."""
    shift = blocks.groupBy("job_id", "page_index").agg(F.count("*").cast("int").alias("_shift"))
    moved = more.join(shift, ["job_id", "page_index"], "left").withColumn("block_index", (F.col("block_index") + F.coalesce("_shift", F.lit(0))).cast("int"))
    return blocks.unionByName(with_block_ids(moved.drop("_shift", "block_id")).select(*blocks.columns))
