"""Page signals and routing.

Input is a page-geometry table: job_id, page_index, width, height, text and arrays
``items`` (bbox, text), ``images`` (xref, width, height, bbox), ``drawings`` (bbox) and
``tables`` (bbox, rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config
from pagewright.functions import geometry as G
from pagewright.functions import text as T

FAST, VISION = "fast_pymupdf", "vlm"  # fixed values of the route column


def page_signals(pages: DataFrame) -> DataFrame:
    """text_chars, block_count, image_count, image_area_ratio and has_table_hint of each page."""
    stripped = F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    boxes = F.transform("images", lambda i: i["bbox"])
    return pages.withColumns(
        {
            "text_chars": F.length(F.coalesce(stripped, F.lit(""))),
            "block_count": F.size(F.filter("items", lambda i: i["text"].rlike(r"(?U)[^\s\x1c-\x1f]"))),
            "image_count": F.size(F.array_distinct(F.transform("images", lambda i: i["xref"]))),
            "image_area_ratio": G.image_area_ratio(boxes, F.col("width"), F.col("height")),
            "has_table_hint": T.looks_like_table(F.col("text")),
        }
    )


def route(config: Config = DEFAULT) -> Column:
    """struct(route, reason) of a page with its signal columns; the first rule that fits wins."""
    chars, ratio, hint = F.col("text_chars"), F.col("image_area_ratio"), F.col("has_table_hint")

    def to(where: str, reason: Column | str) -> Column:
        r = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(where).alias("route"), r.alias("reason"))

    with_hint = lambda base: F.when(hint, f"{base}_table_candidate").otherwise(base)
    return (
        F.when((chars >= config.dense_chars) & (ratio < config.dense_ratio), to(FAST, with_hint("editable_text_dense")))
        .when((chars >= config.moderate_chars) & (ratio < config.moderate_ratio) & (F.col("image_count") <= config.moderate_images), to(FAST, with_hint("editable_text_moderate")))
        .when(hint, to(VISION, "table_hint"))
        .when((ratio >= config.scan_ratio) | (chars < config.scan_chars), to(VISION, "scan_or_image_heavy"))
        .otherwise(to(VISION, "mixed_or_low_confidence"))
    )


def route_pages(signals: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return signals.withColumn("_r", route(config)).select(*signals.columns, "_r.route", "_r.reason")


def route_counters(routed: DataFrame) -> DataFrame:
    """Pages and blocks by route and reason."""
    return routed.groupBy("route", "reason").agg(F.count("*").alias("pages"), F.sum("block_count").alias("blocks"))
