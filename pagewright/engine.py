"""The engine: page geometry in, blocks, tasks, embeddings and Markdown out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config, scan_ocr_enabled
from pagewright.functions import geometry as G
from pagewright.operators.blocks import fast_blocks, page_vision_blocks
from pagewright.operators.embedding import embed_blocks
from pagewright.operators.ocr import blocks_from_lines, lines, sufficient, words
from pagewright.operators.pages import page_signals, route_pages
from pagewright.operators.render import render_documents
from pagewright.operators.stats import job_counters
from pagewright.operators.tasks import mark_candidates, queued_tasks
from pagewright.sources.store import Store


@dataclass(frozen=True)
class Parsed:
    pages: DataFrame
    blocks: DataFrame
    tasks: DataFrame
    embeddings: DataFrame
    jobs: DataFrame

    def in_order(self) -> Parsed:
        """Pages by number, blocks by page and place, tasks by page and id."""
        by = {"pages": ("page_index",), "blocks": ("page_index", "block_index"), "tasks": ("page_index", "task_id")}
        return replace(self, **{k: getattr(self, k).orderBy("job_id", *c) for k, c in by.items()})


class Engine:
    def __init__(self, config: Config = DEFAULT) -> None:
        self.config = config

    def parse(self, pages: DataFrame, ocr: DataFrame | None = None, embed: bool = True, store: Store | None = None, jobs: DataFrame | None = None) -> Parsed:
        """Parse a page-geometry table. ``ocr`` (job_id, page_index, tsv, and available where a
        scan may have failed) serves pages on the vision route that it covers well enough; the
        others become whole-page tasks. With a store, pages and blocks are written first and
        all else is derived from what was written, so that blocks are made once; ``jobs``
        (job_id) then names the jobs to replace, also those without any page."""
        c = self.config
        routed = route_pages(page_signals(pages), c)
        fast = fast_blocks(routed, c)
        vision = routed.where(F.col("route") == "vlm")
        if ocr is None or not scan_ocr_enabled(c.ocr_mode):
            blocks = fast.unionByName(page_vision_blocks(vision))
        else:
            key = ["job_id", "page_index"]
            line_rows = lines(words(ocr, c))
            available = F.col("available") if "available" in ocr.columns else F.lit(True)
            text = line_rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n").alias("_t"))  # one page
            good = text.join(ocr.select(*key, available.alias("_a")), key).where(sufficient(F.col("_t"), F.col("_a"), c)).select(*key)
            scanned = vision.join(good, key, "left_semi")
            blocks = fast.unionByName(blocks_from_lines(line_rows.join(scanned.select(*key), key, "left_semi"), scanned, c)).unionByName(page_vision_blocks(vision.join(good, key, "left_anti")))
        blocks = mark_candidates(blocks, pages, c)
        listed = routed.select("job_id", "page_index", "route", "reason", "text_chars", "block_count", "image_count", G.rounded(F.col("image_area_ratio"), 4).alias("image_area_ratio"))
        if store is not None:
            ids = listed.select("job_id").distinct() if jobs is None else jobs
            store.save(ids, pages=listed, blocks=blocks)
            listed, blocks = (store.read(t).join(ids.distinct(), "job_id", "left_semi") for t in ("pages", "blocks"))
        tasks = queued_tasks(blocks)
        embeddings = embed_blocks(blocks if embed else blocks.limit(0), c.embedding_dim)
        if store is not None:
            store.save(ids, embeddings=embeddings, enhancement_tasks=tasks)
        return Parsed(listed, blocks, tasks, embeddings, job_counters(listed, blocks, embeddings, tasks))

    def render(self, jobs: DataFrame, blocks: DataFrame, tasks: DataFrame, policy: str = "all", assets: DataFrame | None = None) -> DataFrame:
        return render_documents(jobs, blocks, tasks, policy, assets)
