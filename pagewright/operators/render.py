"""Finished documents as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

from .reflow import convert_tables_udf, reflow_udf
from .tasks import export_priority, flag, uses_task

_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def quality_gate(priority: Column, task_kind: Column, block_meta: Column, block_text: Column, result: Column) -> Column:
    """Optional table results may name no caption that their block does not name."""
    table = (task_kind == "table_candidate") | flag(block_meta, "table_candidate") | flag(block_meta, "native_table_needs_vlm")
    extra = F.array_except(T.caption_ids(F.coalesce(result, F.lit(""))), T.caption_ids(F.coalesce(block_text, F.lit(""))))
    return (priority != "optional") | ~table | block_text.isNull() | (F.size(extra) == 0)


def chosen_results(blocks: DataFrame, tasks: DataFrame, policy: str) -> DataFrame:
    """block_id, result: the last completed task of each block (by page and task id) that the
    policy takes and that passes the quality gate."""
    t = tasks.where((F.col("status") == "completed") & F.col("result").isNotNull()).withColumn("_p", export_priority(F.col("metadata")))
    t = t.where(uses_task(F.col("_p"), policy)).select("block_id", "task_id", "page_index", F.col("kind").alias("_kind"), "_p", "result")
    b = blocks.select("block_id", F.col("metadata").alias("_meta"), F.col("text").alias("_text"))
    ok = t.join(b, "block_id", "left").where(quality_gate(F.col("_p"), F.col("_kind"), F.col("_meta"), F.col("_text"), F.col("result")))
    return ok.groupBy("block_id").agg(F.max_by("result", F.struct("page_index", "task_id")).alias("result"))


def render_blocks(blocks: DataFrame, results: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Adds ``markdown`` to blocks: an image's link and result, a table's result or text, other
    text with its inline tables laid out again."""
    w = Window.partitionBy("job_id", "page_index", F.col("kind") == "image").orderBy("block_index")
    b = blocks.join(results, "block_id", "left").withColumn("_n", F.row_number().over(w))
    b = b.join(assets.select("block_id", "asset_name"), "block_id", "left") if assets is not None else b.withColumn("asset_name", F.lit(None).cast("string"))
    result = F.regexp_replace(F.coalesce(F.when(F.col("result").contains("<"), convert_tables_udf("result")).otherwise(F.col("result")), F.lit("")), _STRIP, "")
    b = b.withColumn("_result", result).withColumn("_text", F.regexp_replace(F.coalesce("text", F.lit("")), _STRIP, ""))
    link = F.concat(F.lit("![page "), (F.col("page_index") + 1).cast("string"), F.lit(" image "), F.col("_n").cast("string"), F.lit("]("), F.col("asset_name"), F.lit(")"))
    image = F.array_join(F.filter(F.array(link, F.nullif("_result", F.lit(""))), lambda x: x.isNotNull()), "\n\n")
    # only text that names a caption goes through Python
    plain = F.when(F.col("_text").rlike(r"(?im)^\s*Table\s+\d+\s*[.:]"), reflow_udf("_text")).otherwise(F.col("_text"))
    m = F.col("metadata")
    candidate = (F.col("kind") == "native_table") | flag(m, "table_candidate") | flag(m, "native_table_needs_vlm")
    body = F.when(candidate & (F.col("_result") != ""), F.col("_result")).when(F.col("kind") == "native_table", F.col("_text")).otherwise(plain)
    return b.withColumn("markdown", F.when(F.col("kind") == "image", image).otherwise(body)).drop("_n", "_result", "_text", "result", "asset_name")


def render_documents(jobs: DataFrame, blocks: DataFrame, tasks: DataFrame, policy: str = "all", assets: DataFrame | None = None) -> DataFrame:
    """job_id, markdown: front matter, then the pages and their blocks in order. Blocks beyond
    the page count are left out; a document is gathered from its own blocks only."""
    rendered = render_blocks(blocks, chosen_results(blocks, tasks, policy), assets)
    pages = rendered.where(F.col("markdown") != "").groupBy("job_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("block_index", "markdown"))).alias("x"))
    pages = pages.select("job_id", "page_index", F.array_join(F.transform("x", lambda e: F.concat(e["markdown"], F.lit("\n\n"))), "").alias("body"))
    docs = pages.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("page_index", "body"))).alias("bodies"))
    n_blocks = blocks.groupBy("job_id").agg(F.count("*").alias("_b"))
    n_tasks = tasks.groupBy("job_id").agg(F.count("*").alias("_t"))
    j = jobs.join(docs, "job_id", "left").join(n_blocks, "job_id", "left").join(n_tasks, "job_id", "left").fillna(0, ["_b", "_t"])
    quote = lambda c: F.concat(F.lit(f'{c}: "'), T.escape_yaml(F.col(c)), F.lit('"\n'))
    count = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\n"))
    head = F.concat(F.lit("---\n"), quote("title"), quote("source_pdf"), quote("job_id"), count("page_count", "page_count"), count("block_count", "_b"), count("enhancement_task_count", "_t"), F.lit("---\n\n# "), F.col("title"), F.lit("\n\n"))
    numbers = F.when(F.col("page_count") > 0, F.sequence(F.lit(0), F.greatest(F.col("page_count") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    body = F.array_join(F.transform(numbers, lambda p: F.concat(F.lit("## Page "), (p + 1).cast("string"), F.lit("\n\n"), F.coalesce(F.element_at(F.col("bodies"), p), F.lit("")))), "")
    text = F.concat(F.regexp_replace(F.concat(head, body), r"(?U)[\s\x1c-\x1f]+\z", ""), F.lit("\n"))
    return j.select("job_id", text.alias("markdown"))


def asset_names(blocks: DataFrame, crops: DataFrame) -> DataFrame:
    """block_id, crop_path, asset_name of the images whose crop exists: numbered through the document."""
    found = blocks.where(F.col("kind") == "image").join(crops.select("block_id", "crop_path"), "block_id")
    w = Window.partitionBy("job_id").orderBy("page_index", "block_index")
    suffix = F.regexp_extract("crop_path", r"(\.[^./]+)$", 1)
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), "0")
    return found.withColumn("_n", F.row_number().over(w)).select(
        "job_id", "block_id", "crop_path", F.concat(F.lit("page-"), two(F.col("page_index") + 1), F.lit("-figure-"), two(F.col("_n")), F.when(suffix == "", ".png").otherwise(suffix)).alias("asset_name")
    )
