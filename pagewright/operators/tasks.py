"""Enhancement tasks from blocks: candidates, priorities, crops and image widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, UNCAPTIONED_MODES, Config, image_mode
from pagewright.functions import geometry as G
from pagewright.functions import text as T

from .blocks import task_id


def flag(meta: Column, key: str) -> Column:
    return F.coalesce(meta[key], F.lit(False))


def is_candidate(meta: Column, bbox: Column) -> Column:
    wanted = flag(meta, "table_candidate") | flag(meta, "image_candidate") | flag(meta, "native_table_needs_vlm")
    return bbox.isNotNull() & (F.size(bbox) > 0) & wanted


def task_kind(meta: Column) -> Column:
    return F.when(flag(meta, "image_candidate"), "image_candidate").otherwise("table_candidate")


def queues_image(meta: Column, config: Config = DEFAULT) -> Column:
    """Whether an image becomes a task rather than a mere asset."""
    mode = image_mode(config.image_mode)
    forced = flag(meta, "force_vlm")
    vector = flag(meta, "vector_graphics_candidate")
    if mode == "all":
        return F.lit(True)
    if mode == "none":
        return forced
    if mode in UNCAPTIONED_MODES:
        return forced | (vector & ~flag(meta, "figure_caption_candidate"))
    return forced | vector


def block_priority(meta: Column, text: Column, asset_only: Column) -> Column:
    """Priority of a block's task when it is made."""
    noisy = flag(meta, "native_table_needs_vlm") & (flag(meta, "native_table") | ~flag(meta, "native_table_deferred"))
    must = flag(meta, "force_vlm") | flag(meta, "page_vlm") | flag(meta, "scan_ocr") | noisy | (flag(meta, "table_candidate") & (T.clean(text) == ""))
    return F.when(asset_only, "asset_only").when(must, "required").otherwise("optional")


def export_priority(meta: Column) -> Column:
    """Priority of a task when a document is rendered: its own valid value, else by flags."""
    own = F.lower(F.trim(F.coalesce(meta["enhancement_priority"], F.lit(""))))
    must = flag(meta, "scan_ocr") | flag(meta, "page_vlm") | flag(meta, "force_vlm") | (flag(meta, "native_table_needs_vlm") & flag(meta, "native_table"))
    return F.when(own.isin("required", "optional", "asset_only"), own).when(flag(meta, "image_asset_only"), "asset_only").when(must, "required").otherwise("optional")


def bench_priority(meta: Column) -> Column:
    """As ``export_priority`` but without the rule for noisy native tables."""
    own = F.lower(F.trim(F.coalesce(meta["enhancement_priority"], F.lit(""))))
    must = flag(meta, "scan_ocr") | flag(meta, "page_vlm") | flag(meta, "force_vlm")
    return F.when(own.isin("required", "optional", "asset_only"), own).when(flag(meta, "image_asset_only"), "asset_only").when(must, "required").otherwise("optional")


def is_complex(meta: Column, text: Column, crop: Column, config: Config = DEFAULT) -> Column:
    rows = F.coalesce(meta["table_rows"], F.array().cast("array<array<string>>"))
    line_count = F.size(F.filter(T.lines(F.coalesce(text, F.lit(""))), lambda x: T.clean(x) != ""))
    area = F.greatest(F.lit(0.0), G.width(crop)) * F.greatest(F.lit(0.0), G.height(crop))
    out = flag(meta, "force_vlm") | flag(meta, "page_vlm") | flag(meta, "scan_ocr") | flag(meta, "native_table_needs_vlm")
    out = out | (F.size(rows) >= config.complex_rows) | F.exists(rows, lambda r: F.size(r) >= config.complex_columns)
    out = out | (F.length(T.clean(text)) >= config.complex_text) | (line_count >= config.complex_lines)
    return out | (area >= config.complex_area) if config.complex_area > 0 else out


def max_image_width(kind: Column, priority: Column, complex_: Column, config: Config = DEFAULT) -> Column:
    table = F.when((priority == "required") & complex_, config.complex_table_width).otherwise(config.table_width)
    return F.when(kind == "table_candidate", table)


def worker_width(meta: Column, kind: Column, config: Config = DEFAULT) -> Column:
    """The width limit a worker applies: the page's, the task's own, the table's, the default."""
    whole = F.lit(config.page_width).cast("int")
    own = T.positive_int(meta["max_image_width"])
    default = F.lit(config.worker_default_width).cast("int")
    table = F.when(kind == "table_candidate", F.lit(config.worker_table_width)).otherwise(default)
    return F.when(flag(meta, "page_vlm") & whole.isNotNull(), whole).otherwise(F.coalesce(own, table))


_MARKS = ("crop_path", "crop_bbox", "crop_padding", "crop_scale", "image_vlm_mode", "image_asset_only", "enhancement_priority", "max_image_width")


def mark_candidates(blocks: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``blocks`` with the marks of the vision queue in the metadata of its candidates: crop path,
    box, padding and scale, whether an image is a mere asset, priority and width limit."""
    size = pages.select("job_id", "page_index", F.col("width").alias("_w"), F.col("height").alias("_h"))
    m = F.col("metadata")
    own = F.coalesce(is_candidate(m, F.col("bbox")), F.lit(False))
    image = task_kind(m) == "image_candidate"
    digits = lambda c: F.lpad(F.col(c).cast("string"), F.greatest(F.lit(4), F.length(F.col(c).cast("string"))), "0")
    padding = F.when(image, config.image_padding).otherwise(config.table_padding)
    asset = F.when(image, ~queues_image(m, config)).otherwise(m["image_asset_only"])
    priority = F.when(image & F.col("_asset"), "asset_only").otherwise(block_priority(m, F.col("text"), F.coalesce(F.col("_asset"), F.lit(False))))
    limit = max_image_width(task_kind(m), F.col("_priority"), is_complex(m, F.col("text"), F.col("_crop"), config), config)
    out = blocks.join(size, ["job_id", "page_index"], "left").withColumns({"_own": own, "_asset": asset})
    out = out.withColumns({"_priority": priority, "_crop": G.rounded_box(G.crop(F.col("bbox"), padding, F.col("_w"), F.col("_h")))})
    marks = {
        "crop_path": F.concat(F.col("job_id"), F.lit("/page-"), digits("page_index"), F.lit("-block-"), digits("block_index"), F.lit(".png")),
        "crop_bbox": F.col("_crop"), "crop_padding": padding, "crop_scale": F.when(image, config.image_scale).otherwise(config.table_scale),
        "image_vlm_mode": F.when(image, F.lit(image_mode(config.image_mode))), "image_asset_only": F.col("_asset"), "enhancement_priority": F.col("_priority"), "max_image_width": limit,
    }
    changed = m.withField("crop_path", marks["crop_path"])
    for k in _MARKS[1:]:
        changed = changed.withField(k, marks[k].cast({"crop_bbox": "array<double>", "crop_padding": "double", "crop_scale": "double", "image_asset_only": "boolean", "max_image_width": "int"}.get(k, "string")))
    return out.withColumn("metadata", F.when(F.col("_own"), changed).otherwise(m)).select(*blocks.columns)


def queued_tasks(marked: DataFrame) -> DataFrame:
    """The queued tasks of blocks that ``mark_candidates`` marked: task_id, job_id, block_id,
    page_index, kind, status, crop_path, bbox, metadata."""
    m = F.col("metadata")
    c = marked.where(m["crop_path"].isNotNull() & ~((task_kind(m) == "image_candidate") & flag(m, "image_asset_only")))
    flags = ("image_asset_only", "vector_graphics_candidate", "native_table", "native_table_needs_vlm", "scan_ocr", "force_vlm", "page_vlm")
    meta = F.struct(F.col("source"), m["route_reason"].alias("route_reason"), m["image_vlm_mode"].alias("image_vlm_mode"), *[flag(m, k).alias(k) for k in flags], *[m[k].alias(k) for k in ("enhancement_priority", "crop_padding", "crop_scale", "max_image_width")])
    return c.select(
        task_id(F.col("job_id"), F.col("block_id"), task_kind(m), m["crop_path"]).alias("task_id"), "job_id", "block_id", "page_index",
        task_kind(m).alias("kind"), F.lit("queued").alias("status"), m["crop_path"].alias("crop_path"), m["crop_bbox"].alias("bbox"), meta.alias("metadata"),
    )


def tasks_from_blocks(blocks: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The queued tasks of blocks."""
    return queued_tasks(mark_candidates(blocks, pages, config))


def uses_task(priority: Column, policy: str) -> Column:
    """Whether a wait policy takes a task's result."""
    if policy not in ("none", "required", "all"):
        raise ValueError(f"wait policy must be none, required or all, not {policy!r}")
    return F.lit(False) if policy == "none" else priority == "required" if policy == "required" else priority != "asset_only"


def pending(tasks: DataFrame, policy: str) -> DataFrame:
    """Tasks still open that a wait policy waits for."""
    return tasks.where(~F.col("status").isin("completed", "failed") & uses_task(bench_priority(F.col("metadata")), policy))
