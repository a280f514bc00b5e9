"""OCR output: TSV text to words, words to lines, lines to blocks."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, OCR_MODES, Config
from pagewright.functions import geometry as G
from pagewright.functions import text as T

from .blocks import metadata, with_block_ids

_FIELDS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def words(pages: DataFrame, config: Config = DEFAULT, scale: float = 2.0) -> DataFrame:
    """job_id, page_index, tsv -> one row a word with its box. Only word rows with text and
    readable numbers count; a confidence below the limit drops a word, a negative one does
    not. Quoting is not interpreted."""
    rows = pages.select("job_id", "page_index", F.explode(T.lines(F.col("tsv"))).alias("_line"))
    # the cells come out of a generator, so that a row is split once however often they are read
    rows = rows.select("job_id", "page_index", F.explode(F.array(F.split("_line", "\t"))).alias("_c"))
    c = F.col("_c")
    sizes = {k: _number(c, k, "double") / scale for k in _SIZES}
    box = G.box(sizes["left"], sizes["top"], sizes["left"] + sizes["width"], sizes["top"] + sizes["height"])
    return rows.where(_is_word(c, config)).select("job_id", "page_index", T.clean(_cell(c, "text")).alias("text"), *[_number(c, k, "int").alias(k) for k in _INTS], box.alias("bbox"))


class Scanner(ABC):
    """Reads the text of a page image; made once in each Python worker."""

    @abstractmethod
    def scan(self, image: bytes) -> tuple[str | None, str]:
        """(TSV text or None, reason code)."""


class CommandScanner(Scanner):
    """An OCR command that reads an image file and prints TSV. Reason codes are fixed values."""

    def __init__(self, binary: str = "tesseract", language: str = "", segmentation: str = "6", timeout_seconds: float = 30.0) -> None:
        self.command = shutil.which(binary)
        self.options = [*(["-l", language] if language.strip() else []), "--psm", segmentation, "tsv"]
        self.timeout = timeout_seconds

    def scan(self, image: bytes) -> tuple[str | None, str]:
        if self.command is None:
            return None, "tesseract_not_found"
        with tempfile.NamedTemporaryFile(suffix=".png") as f:  # the worker's own, for one call
            f.write(image)
            f.flush()
            try:
                done = subprocess.run([self.command, f.name, "stdout", *self.options], text=True, capture_output=True, timeout=self.timeout, check=False)
            except (OSError, subprocess.TimeoutExpired) as e:
                return None, f"tesseract_error:{e}"
        return (done.stdout, "ok") if done.returncode == 0 else (None, f"tesseract_failed:{done.stderr[:400]}")


def scan_pages(images: DataFrame, factory: Callable[[], Scanner] = CommandScanner, config: Config = DEFAULT) -> DataFrame:
    """job_id, page_index, image (bytes) -> job_id, page_index, tsv, available, reason: an
    unsupported mode or a failed scan has no text, a scan without any word none to use."""
    keys = "job_id string, page_index int"
    mode = config.ocr_mode.strip().lower()
    if mode not in OCR_MODES:
        return images.select("job_id", "page_index", F.lit(None).cast("string").alias("tsv"), F.lit(False).alias("available"), F.lit(f"unsupported_scan_ocr_mode:{mode}").alias("reason"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = factory()
        for b in batches:
            found = [scanner.scan(bytes(x)) for x in b["image"]]
            yield pd.DataFrame({"job_id": b["job_id"], "page_index": b["page_index"], "tsv": [t for t, _ in found], "reason": [r for _, r in found]})

    scans = images.select("job_id", "page_index", "image").mapInPandas(run, f"{keys}, tsv string, reason string")
    some = F.coalesce(F.exists(T.lines(F.col("tsv")), lambda x: _is_word(F.split(x, "\t"), config)), F.lit(False))
    return scans.withColumn("available", some).withColumn("reason", F.when((F.col("reason") == "ok") & ~some, "no_ocr_lines").otherwise(F.col("reason"))).select("job_id", "page_index", "tsv", "available", "reason")


def _cell(cells: Column, k: str) -> Column:
    return F.get(cells, F.lit(_FIELDS.index(k)))


def _number(cells: Column, k: str, t: str) -> Column:
    return F.coalesce(F.nullif(_cell(cells, k), F.lit("")), F.lit("0")).try_cast(t)


_INTS, _SIZES = ("block_num", "par_num", "line_num", "word_num"), ("left", "top", "width", "height")


def _is_word(cells: Column, config: Config) -> Column:
    """Whether the cells of a TSV row are a word to keep."""
    conf = F.coalesce(_cell(cells, "conf").try_cast("double"), F.lit(-1.0))
    out = (_cell(cells, "level") == "5") & _cell(cells, "text").rlike(r"(?U)[^\s\x1c-\x1f]") & ~((conf >= 0) & (conf < config.ocr_min_confidence))
    for k in (*_INTS, *_SIZES):
        out = out & _number(cells, k, "int" if k in _INTS else "double").isNotNull()
    return out


def gap_blanks(left: Column, before: Column, before_text: Column) -> Column:
    """How many blanks go before a word at ``left`` behind another: gaps wider than one and a
    half characters become as many as characters would fit, at most 12."""
    gap = left - before[2]
    char = F.greatest(F.lit(3.5), F.greatest(F.lit(1.0), G.width(before)) / F.greatest(F.lit(1), F.length(before_text)))
    return F.when(gap > char * 1.5, F.greatest(F.lit(1), F.least(F.lit(12), F.bround(gap / char).cast("int")))).otherwise(1)


def lines(word_rows: DataFrame) -> DataFrame:
    """Words grouped by (block, par, line) in reading order, with the union of their boxes.
    Rows move once, to their page: the window, the lines and their numbers use that order."""
    key = ["job_id", "page_index", "block_num", "par_num", "line_num"]
    placed = word_rows.repartition("job_id", "page_index")
    in_line = Window.partitionBy(*key).orderBy(F.col("bbox")[0], "word_num", "bbox", "text")
    before = placed.withColumns({"_b": F.lag("bbox").over(in_line), "_t": F.lag("text").over(in_line), "_n": F.row_number().over(in_line)})
    part = F.when(F.col("_b").isNull(), F.col("text")).otherwise(F.concat(F.repeat(F.lit(" "), gap_blanks(F.col("bbox")[0], F.col("_b"), F.col("_t"))), "text"))
    grouped = before.select(*key, "_n", "bbox", part.alias("_part")).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_part"))), lambda x: x["_part"]), "").alias("text"), G.union_agg(F.col("bbox")).alias("bbox")
    )  # a line of one page
    order = Window.partitionBy("job_id", "page_index").orderBy("block_num", "par_num", "line_num")
    return grouped.select(*key, "text", "bbox", (F.row_number().over(order) - 1).alias("line_index"))


def mark_table_lines(line_rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds ``in_table``: a table caption and up to eight lines after it while the step from
    one top to the next stays within the limit; or a line that looks like a table."""
    w = Window.partitionBy("job_id", "page_index").orderBy("line_index")
    n = config.ocr_lookahead
    caption = T.has_table_caption(F.col("text"))
    # lines since the last wide step, and since the last caption
    step = F.col("bbox")[1] - F.lag(F.col("bbox")[1]).over(w)
    broken = line_rows.withColumn("_caption", caption).withColumn("_run", F.coalesce((step > config.ocr_line_gap).cast("int"), F.lit(0)))
    broken = broken.withColumn("_group", F.sum("_run").over(w))
    recent = F.max(F.when(F.col("_caption"), F.col("line_index"))).over(Window.partitionBy("job_id", "page_index", "_group").orderBy("line_index").rowsBetween(-n, 0))
    marked = broken.withColumn("in_table", F.col("_caption") | recent.isNotNull() | T.looks_like_table(F.col("text")))
    return marked.drop("_caption", "_run", "_group")


def sufficient(ocr_text: Column, available: Column, config: Config = DEFAULT) -> Column:
    """Whether OCR found enough text to do without whole-page vision."""
    return available & (F.length(T.clean(ocr_text)) >= config.ocr_min_chars)


def blocks_from_lines(line_rows: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """For each scanned page (job_id, page_index, width, height, reason): its image as an asset,
    one block of table lines and one of the other lines."""
    marked = mark_table_lines(line_rows, config)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n")
    grouped = marked.groupBy("job_id", "page_index", "in_table").agg(ordered.alias("text"), G.union_agg(F.col("bbox")).alias("bbox"))  # one page
    reason = pages.select("job_id", "page_index", F.col("reason").alias("_reason"))
    g = grouped.join(reason, ["job_id", "page_index"])
    table = F.col("in_table")
    meta = metadata(route_reason=F.col("_reason"), scan_ocr=F.lit(True), table_candidate=F.when(table, True), native_table_needs_vlm=F.when(table, True))
    body = g.select("job_id", "page_index", F.when(table, 1).otherwise(2).alias("phase"), F.when(table, "native_table").otherwise("text").alias("kind"), "text", G.rounded_box(F.col("bbox")).alias("bbox"), meta.alias("metadata"))
    asset = pages.join(line_rows.select("job_id", "page_index").distinct(), ["job_id", "page_index"], "left_semi").select(
        "job_id", "page_index", F.lit(0).alias("phase"), F.lit("image").alias("kind"), F.concat(F.lit("[scan page asset page="), F.col("page_index").cast("string"), F.lit("]")).alias("text"),
        G.rounded_box(G.box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))).alias("bbox"), metadata(route_reason=F.col("reason"), scan_ocr=F.lit(True), image_candidate=F.lit(True), image_asset_only=F.lit(True)).alias("metadata"),
    )
    w = Window.partitionBy("job_id", "page_index").orderBy("phase")
    out = asset.unionByName(body).withColumn("block_index", F.row_number().over(w) - 1).withColumn("source", F.lit("scan_ocr_tesseract")).drop("phase")
    return with_block_ids(out)
