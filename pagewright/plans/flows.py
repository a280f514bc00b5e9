"""Registered queries over whole flows: parsing, tasks, rendering, archives, the store, the
worker, each on whole test tables, and their DuckDB SQL."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagewright.config import Config
from pagewright.engine import Engine
from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import blocks as BL
from pagewright.operators import embedding as EM
from pagewright.operators import ocr as OC
from pagewright.operators import payload as PL
from pagewright.operators import queue as QU
from pagewright.operators import reflow as RF
from pagewright.operators import render as RE
from pagewright.operators import stats as ST
from pagewright.operators import tasks as TK
from pagewright.sources.geometry import pages_of_documents
from pagewright.sources.shared import scratch
from pagewright.sources.store import Store
from pagewright.streaming.queue import run_tasks
from pagewright.streaming.worker import EventLog, Worker

from .oracles import FOLD, PAGES
from .queries import NOW, queue_events, table

SQL: dict[str, str] = {}


def _md5(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


# --- parsing -----------------------------------------------------------------------------


def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole parse of the derived geometry table, counted by source and kind."""
    p = Engine().parse(pages_of_documents(table(spark, sf_dir, "documents")), embed=False)
    return p.blocks.groupBy("source", "kind").agg(F.count("*").alias("blocks"), F.count("block_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


def parse_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of that parse, by kind, priority and page."""
    p = Engine().parse(pages_of_documents(table(spark, sf_dir, "documents")), embed=False)
    m = F.col("metadata")
    return p.tasks.groupBy("kind", m["enhancement_priority"].alias("priority"), m["route_reason"].alias("reason")).agg(F.count("*").alias("tasks"), F.countDistinct("job_id").alias("jobs"), F.sum(F.col("bbox")[3]).alias("bottoms"))


def parse_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each job of that parse."""
    p = Engine().parse(pages_of_documents(table(spark, sf_dir, "documents")))
    return p.jobs.select("job_id", *[F.col(c).cast("long").alias(c) for c in ("page_count", "fast_page_count", "vlm_page_count", "block_count", "embedding_count", "enhancement_task_count")])


_PARSE = rf"""WITH RECURSIVE p AS (SELECT doc_id, page_index, ls, array_to_string(ls, chr(10)) AS t FROM ({PAGES})),
  r AS (SELECT *, length(trim(t, ' ' || chr(10))) AS n, doc_id % 4 AS pics FROM p),
  q AS (SELECT *, n >= 500 OR (n >= 220 AND pics <= 2) AS fast FROM r),
  i AS (SELECT doc_id, page_index, x, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY k) AS k FROM (
    SELECT doc_id, page_index, trim(regexp_replace(unnest(ls), '\s+', ' ', 'g')) AS x, unnest(range(0, len(ls))) AS k FROM q WHERE fast) WHERE x <> ''),
  s AS (SELECT doc_id, page_index, k, 1 AS chunk, length(x)::BIGINT AS n FROM i WHERE k = 1
    UNION ALL SELECT i.doc_id, i.page_index, i.k, CASE WHEN s.n + length(i.x) > 1800 THEN chunk + 1 ELSE chunk END, CASE WHEN s.n + length(i.x) > 1800 THEN length(i.x) ELSE s.n + length(i.x) END
    FROM s JOIN i ON i.doc_id = s.doc_id AND i.page_index = s.page_index AND i.k = s.k + 1),
  c AS (SELECT doc_id, page_index, max(chunk) AS chunks, max(k) AS items FROM s GROUP BY doc_id, page_index),
  l AS (SELECT doc_id, page_index, sum(length(x)) AS chars FROM i GROUP BY doc_id, page_index),
  b AS (SELECT 'fast_pymupdf' AS source, 'text' AS kind, doc_id, page_index, chunks AS n, chars + items - chunks AS chars FROM c JOIN l USING (doc_id, page_index)
    UNION ALL SELECT 'fast_pymupdf', 'image', doc_id, page_index, pics, pics * length('[image page=' || page_index::VARCHAR || ' xref=1]') FROM q WHERE fast AND pics > 0
    UNION ALL SELECT 'async_page_vlm', 'image', doc_id, page_index, 1, length('[page vlm page=' || page_index::VARCHAR || ']') FROM q WHERE NOT fast)"""
SQL["parse_documents"] = f"{_PARSE} SELECT source, kind, sum(n)::BIGINT AS blocks, sum(n)::BIGINT AS ids, sum(chars)::BIGINT AS chars FROM b GROUP BY source, kind"
SQL["parse_tasks"] = f"""{_PARSE} SELECT 'image_candidate' AS kind, 'required' AS priority, CASE WHEN n < 80 THEN 'scan_or_image_heavy' ELSE 'mixed_or_low_confidence' END AS reason, count(*) AS tasks, count(DISTINCT doc_id) AS jobs, sum(842.0)::DOUBLE AS bottoms
  FROM q WHERE NOT fast GROUP BY ALL"""
SQL["parse_counters"] = f"""{_PARSE}, n AS (SELECT doc_id, sum(n) AS n FROM b GROUP BY doc_id)
  SELECT doc_id::VARCHAR AS job_id, count(*)::BIGINT AS page_count, count(*) FILTER (WHERE fast) AS fast_page_count, count(*) FILTER (WHERE NOT fast) AS vlm_page_count,
  coalesce(any_value(n.n), 0)::BIGINT AS block_count, coalesce(any_value(n.n), 0)::BIGINT AS embedding_count, count(*) FILTER (WHERE NOT fast) AS enhancement_task_count FROM q LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-derived ids of documents as blocks."""
    d = table(spark, sf_dir, "documents")
    b = d.select(
        F.col("doc_id").cast("string").alias("job_id"), F.pmod("doc_id", F.lit(3)).cast("int").alias("page_index"), F.pmod("doc_id", F.lit(11000)).cast("int").alias("block_index"), F.lit("s").alias("source"), F.lit("text").alias("kind"),
        T.clean(F.col("text")).alias("text"), F.array(*[F.lit(x) for x in (0.0, 1.5, 10.0, 20.25)]).alias("bbox"),
    )
    return BL.with_block_ids(b).select("job_id", "block_id")


SQL["block_ids"] = r"""SELECT doc_id::VARCHAR AS job_id, doc_id::VARCHAR || '-p' || lpad((doc_id % 3)::VARCHAR, 4, '0') || '-b' || lpad((doc_id % 11000)::VARCHAR, greatest(4, length((doc_id % 11000)::VARCHAR))::INTEGER, '0') || '-' || substr(sha1(
  '{"bbox":[0.0,1.5,10.0,20.25],"block_index":' || (doc_id % 11000)::VARCHAR || ',"job_id":"' || doc_id::VARCHAR || '","kind":"text","page_index":' || (doc_id % 3)::VARCHAR || ',"source":"s","text":' || to_json(x)::VARCHAR || '}'), 1, 12) AS block_id
  FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)"""


# --- geometry ----------------------------------------------------------------------------


def vector_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as drawings on a page: the region of those of 4 x 4 points and
    more, where there are at least three."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.pmod("l_partkey", F.lit(600)).cast("double"), F.pmod("l_suppkey", F.lit(900)).cast("double")
    b = li.select("l_orderkey", G.box(x, y, x + F.col("l_quantity"), y + F.col("l_linenumber") * 2).alias("b"))
    pages = b.groupBy("l_orderkey").agg(F.collect_list("b").alias("drawings"))
    r = G.vector_region(F.col("drawings"), F.lit(595.0), F.lit(842.0), F.lit(3))
    return pages.select("l_orderkey", *[r[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).where("x0 is not null")


SQL["vector_regions"] = """SELECT * FROM (SELECT l_orderkey, greatest(0.0, min(x))::DOUBLE AS x0, greatest(0.0, min(y))::DOUBLE AS y0, least(595.0, max(x + w))::DOUBLE AS x1, least(842.0, max(y + h))::DOUBLE AS y1 FROM (
  SELECT l_orderkey, (l_partkey % 600)::DOUBLE AS x, (l_suppkey % 900)::DOUBLE AS y, l_quantity AS w, l_linenumber * 2 AS h FROM lineitem) WHERE w >= 4 AND h >= 4 GROUP BY l_orderkey HAVING count(*) >= 3) WHERE x1 > x0 AND y1 > y0"""


def image_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as images: their share of the page, and the size of each image no wider
    than its limit."""
    li = table(spark, sf_dir, "lineitem")
    b = li.groupBy("l_orderkey").agg(F.collect_list(G.box(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.col("l_linenumber") * 32)).alias("b"))
    return b.select("l_orderkey", G.image_area_ratio(F.col("b"), F.lit(64.0), F.lit(128.0)).alias("ratio"))


SQL["image_ratios"] = "SELECT l_orderkey, least(1.0, sum(l_quantity * l_linenumber * 32) / 8192.0)::DOUBLE AS ratio FROM lineitem GROUP BY l_orderkey"


def crop_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    d = G.downscaled((F.col("p_partkey") + 1).cast("int"), (F.col("p_size") * 13 + 1).cast("int"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.lit(None)).otherwise(F.pmod("p_partkey", F.lit(7)) * 100).cast("int"))
    return p.select("p_partkey", d["width"].cast("long").alias("width"), d["height"].cast("long").alias("height"))


SQL["crop_images"] = """SELECT p_partkey, CASE WHEN m > 0 AND w > m THEN m ELSE w END::BIGINT AS width, CASE WHEN m > 0 AND w > m THEN greatest(1, round_even(h * m / w, 0)) ELSE h END::BIGINT AS height
  FROM (SELECT p_partkey, p_partkey + 1 AS w, p_size * 13 + 1 AS h, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 7) * 100 END AS m FROM part)"""


def worker_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    own = F.when(F.pmod("p_partkey", F.lit(5)) > 1, (F.pmod("p_partkey", F.lit(900)) - 100).cast("string"))
    meta = F.struct((F.pmod("p_partkey", F.lit(2)) == 0).alias("page_vlm"), own.alias("max_image_width"))
    kind = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "image_candidate").otherwise("table_candidate")
    c = [TK.worker_width(meta, kind, Config(page_width=w, worker_default_width=d)).cast("long").alias(n) for n, w, d in (("plain", None, None), ("paged", 1600, None), ("limited", None, 512))]
    return p.select("p_partkey", *c)


_OWN = "CASE WHEN p_partkey % 5 > 1 AND p_partkey % 900 - 100 > 0 THEN p_partkey % 900 - 100 END"
SQL["worker_widths"] = f"""SELECT p_partkey, coalesce({_OWN}, CASE WHEN p_partkey % 3 <> 0 THEN 1024 END)::BIGINT AS plain, CASE WHEN p_partkey % 2 = 0 THEN 1600 ELSE coalesce({_OWN}, CASE WHEN p_partkey % 3 <> 0 THEN 1024 END) END::BIGINT AS paged,
  coalesce({_OWN}, CASE WHEN p_partkey % 3 <> 0 THEN 1024 ELSE 512 END)::BIGINT AS limited FROM part"""


# --- tasks -------------------------------------------------------------------------------


def block_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidate blocks of all sorts: the tasks that are queued, with crop and width."""
    p = table(spark, sf_dir, "part")
    bit = lambda n: F.pmod("p_partkey", F.lit(n)) == 0
    meta = BL.metadata(image_candidate=bit(4), table_candidate=bit(3), native_table_needs_vlm=bit(5), native_table=bit(10), force_vlm=bit(28), vector_graphics_candidate=bit(8), figure_caption_candidate=bit(16), scan_ocr=bit(9))
    x, y = F.pmod("p_partkey", F.lit(560)), F.pmod(F.col("p_partkey") * 7, F.lit(800))
    box = F.when(F.pmod("p_partkey", F.lit(11)) == 0, F.lit(None)).otherwise(G.box(x, y, x + F.col("p_size"), y + F.col("p_size") * 2))
    b = p.select(F.col("p_partkey").cast("string").alias("job_id"), F.lit(0).alias("page_index"), F.lit(0).alias("block_index"), F.lit("s").alias("source"), F.lit("text").alias("kind"), F.when(bit(6), "").otherwise("x").alias("text"), box.alias("bbox"), meta.alias("metadata"))
    pages = p.select(F.col("p_partkey").cast("string").alias("job_id"), F.lit(0).alias("page_index"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    t = TK.tasks_from_blocks(BL.with_block_ids(b), pages, Config(image_mode="no-caption"))
    m = F.col("metadata")
    return t.select("job_id", "kind", m["enhancement_priority"].alias("priority"), m["max_image_width"].cast("long").alias("width"), m["image_vlm_mode"].alias("mode"), m["crop_scale"].alias("scale"), *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


SQL["block_tasks"] = """WITH b AS (SELECT p_partkey AS k, k % 4 = 0 AS img, k % 3 = 0 AS tab, k % 5 = 0 AS needs, k % 10 = 0 AS native, k % 28 = 0 AS force, k % 8 = 0 AS vec, k % 16 = 0 AS cap, k % 9 = 0 AS ocr, k % 6 = 0 AS blank,
    CASE WHEN k % 4 = 0 THEN 8.0 ELSE 40.0 END AS pad, (k % 560)::DOUBLE AS x, ((k * 7) % 800)::DOUBLE AS y, p_size AS s FROM part WHERE k % 11 <> 0),
  t AS (SELECT *, force OR ocr OR needs OR (tab AND blank) AS must FROM b WHERE (img AND (force OR (vec AND NOT cap))) OR (NOT img AND (tab OR needs)))
  SELECT k::VARCHAR AS job_id, CASE WHEN img THEN 'image_candidate' ELSE 'table_candidate' END AS kind, CASE WHEN must THEN 'required' ELSE 'optional' END AS priority,
    CASE WHEN img THEN NULL WHEN must AND (force OR ocr OR needs) THEN 768 ELSE 640 END::BIGINT AS width, CASE WHEN img THEN 'no-caption' END AS mode, CASE WHEN img THEN 2.0 ELSE 4.0 END::DOUBLE AS scale,
    greatest(0.0, x - pad)::DOUBLE AS x0, greatest(0.0, y - pad)::DOUBLE AS y0, least(595.0, x + s + pad)::DOUBLE AS x1, least(842.0, y + s * 2 + pad)::DOUBLE AS y1 FROM t"""


# --- joins, rendering, the store ---------------------------------------------------------


def blocks_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks, left-joined to vectors that exist for some."""
    d = table(spark, sf_dir, "documents").select(F.lit("j").alias("job_id"), F.col("doc_id").cast("int").alias("page_index"), F.lit(0).alias("block_index"), F.col("doc_id").cast("string").alias("block_id"), "lang")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("block_id"), F.lit("j").alias("job_id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"))
    j = EM.blocks_with_embeddings(d, e, "j")
    return j.groupBy("lang").agg(F.count("*").alias("blocks"), F.count("dim").alias("embeddings"), F.coalesce(F.sum("dim"), F.lit(0)).alias("numbers"))


SQL["blocks_with_embeddings"] = """SELECT lang, count(*) AS blocks, count(dim) AS embeddings, coalesce(sum(dim), 0)::BIGINT AS numbers FROM documents LEFT JOIN (SELECT vec_id, len(embedding)::BIGINT AS dim FROM embeddings) e ON doc_id = vec_id GROUP BY lang"""


def _conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks, three a page; an assistant's turns are table candidates."""
    c = table(spark, sf_dir, "conversations")
    b = c.select(
        F.col("conv_id").cast("string").alias("job_id"), F.floor(F.col("turn") / 3).cast("int").alias("page_index"), F.pmod("turn", F.lit(3)).cast("int").alias("block_index"), F.lit("s").alias("source"),
        F.when(F.pmod("turn", F.lit(7)) == 6, "native_table").otherwise("text").alias("kind"), "text", F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("bbox"), "turn", "role",
        BL.metadata(table_candidate=F.col("role") == "assistant").alias("metadata"),
    )
    return BL.with_block_ids(b)


def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered as documents: assistants' turns have results, of which every
    fourth names a caption that its block does not, and every fifth task failed."""
    b = _conversation_blocks(spark, sf_dir)
    own = F.col("turn")
    result = F.concat(F.lit("<table><tr><td>n</td><td>"), own.cast("string"), F.lit("</td></tr></table>"), F.when(F.pmod(own, F.lit(4)) == 1, " Table 9. more").otherwise(""))
    flags = [F.lit(False).alias(k) for k in ("image_asset_only", "scan_ocr", "page_vlm", "force_vlm", "native_table_needs_vlm", "native_table")]
    meta = F.struct(F.when(F.pmod(own, F.lit(8)) == 1, "required").otherwise("optional").alias("enhancement_priority"), *flags)
    t = b.where("role = 'assistant'").select(F.concat(F.lit("t"), own.cast("string")).alias("task_id"), "job_id", "block_id", "page_index", F.lit("table_candidate").alias("kind"), F.when(F.pmod(own, F.lit(5)) == 0, "failed").otherwise("completed").alias("status"), result.alias("result"), meta.alias("metadata"))
    jobs = b.groupBy("job_id").agg(F.concat(F.lit('Talk "'), F.first("job_id"), F.lit('"')).alias("title"), F.lit("a\\b.pdf").alias("source_pdf"), (F.max("page_index") + F.when(F.max("turn") > 5, 0).otherwise(1)).alias("page_count"))
    out = RE.render_documents(jobs, b, t)
    return out.select("job_id", F.length("markdown").cast("long").alias("chars"), _md5(F.col("markdown")).alias("markdown_md5"))


SQL["rendered_documents"] = r"""WITH b AS (SELECT conv_id AS c, turn, turn // 3 AS p, turn % 3 AS i, role, trim(text, ' ' || chr(10)) AS t FROM conversations),
  d AS (SELECT *, role = 'assistant' AND turn % 5 <> 0 AND (turn % 4 <> 1 OR turn % 8 = 1) AS used FROM b),
  x AS (SELECT *, CASE WHEN used THEN '| n | ' || turn::VARCHAR || ' |' || chr(10) || '| --- | --- |' || CASE WHEN turn % 4 = 1 THEN chr(10) || ' Table 9. more' ELSE '' END ELSE t END AS m FROM d),
  n AS (SELECT c, max(p) + CASE WHEN max(turn) > 5 THEN 0 ELSE 1 END AS pages, count(*) AS blocks, count(*) FILTER (WHERE role = 'assistant') AS tasks FROM b GROUP BY c),
  g AS (SELECT c, p, string_agg(m || chr(10) || chr(10), '' ORDER BY i) AS body FROM x WHERE m <> '' GROUP BY c, p),
  y AS (SELECT n.c, pages, blocks, tasks, unnest(range(0, greatest(pages, 1))) AS p FROM n),
  z AS (SELECT y.c, any_value(pages) AS pages, any_value(blocks) AS blocks, any_value(tasks) AS tasks, string_agg(CASE WHEN y.p < pages THEN '## Page ' || (y.p + 1)::VARCHAR || chr(10) || chr(10) || coalesce(body, '') ELSE '' END, '' ORDER BY y.p) AS body FROM y LEFT JOIN g ON g.c = y.c AND g.p = y.p GROUP BY y.c),
  o AS (SELECT c, rtrim('---' || chr(10) || 'title: "Talk \"' || c::VARCHAR || '\""' || chr(10) || 'source_pdf: "a\\b.pdf"' || chr(10) || 'job_id: "' || c::VARCHAR || '"' || chr(10) || 'page_count: ' || pages::VARCHAR || chr(10) || 'block_count: ' || blocks::VARCHAR || chr(10) ||
    'enhancement_task_count: ' || tasks::VARCHAR || chr(10) || '---' || chr(10) || chr(10) || '# Talk "' || c::VARCHAR || '"' || chr(10) || chr(10) || body, ' ' || chr(10)) || chr(10) AS m FROM z)
  SELECT c::VARCHAR AS job_id, length(m)::BIGINT AS chars, md5(m) AS markdown_md5 FROM o"""


def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as images, of which two of three have a crop file."""
    b = _conversation_blocks(spark, sf_dir).withColumn("kind", F.when(F.col("role") == "user", "image").otherwise("text"))
    crops = b.where("turn % 3 <> 2").select("block_id", F.concat(F.lit("c/p"), F.col("turn").cast("string"), F.when(F.pmod("turn", F.lit(4)) == 0, "").otherwise(".jpg")).alias("crop_path"))
    names = RE.asset_names(b, crops)
    return names.join(b.select("block_id", "turn"), "block_id").select("job_id", "turn", "asset_name")


SQL["asset_names"] = """SELECT conv_id::VARCHAR AS job_id, turn, 'page-' || lpad((turn // 3 + 1)::VARCHAR, greatest(2, length((turn // 3 + 1)::VARCHAR))::INTEGER, '0') || '-figure-' || lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INTEGER, '0') || CASE WHEN turn % 4 = 0 THEN '.png' ELSE '.jpg' END AS asset_name
  FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND turn % 3 <> 2)"""


def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stored as jobs, the even ones again with their first turns only, and every
    fifth once more without any block: what the store then holds."""
    store = Store(spark, scratch(spark, "store"))
    store.init()
    b = _conversation_blocks(spark, sf_dir).drop("role")
    store.save(b, blocks=b)
    again = b.where("cast(job_id as long) % 2 = 0")
    store.replace("blocks", again.where("turn < 2"), again)
    gone = b.where("cast(job_id as long) % 5 = 0")
    store.replace("blocks", gone.limit(0), gone)
    return store.read("blocks").groupBy("job_id").agg(F.count("*").alias("blocks"), F.sum("turn").alias("turns"), F.min("block_id").alias("first_id"))


SQL["stored_blocks"] = r"""WITH b AS (SELECT conv_id AS c, turn, conv_id::VARCHAR || '-p' || lpad((turn // 3)::VARCHAR, 4, '0') || '-b' || lpad((turn % 3)::VARCHAR, 4, '0') || '-' || substr(sha1('{"bbox":[0.0,0.0,1.0,1.0],"block_index":' || (turn % 3)::VARCHAR || ',"job_id":"' || conv_id::VARCHAR ||
    '","kind":"' || CASE WHEN turn % 7 = 6 THEN 'native_table' ELSE 'text' END || '","page_index":' || (turn // 3)::VARCHAR || ',"source":"s","text":' || to_json(text)::VARCHAR || '}'), 1, 12) AS id FROM conversations)
  SELECT c::VARCHAR AS job_id, count(*) AS blocks, sum(turn)::BIGINT AS turns, min(id) AS first_id FROM b WHERE c % 5 <> 0 AND (c % 2 <> 0 OR turn < 2) GROUP BY c"""


def upserted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as runs of one job: every second run is saved over the first."""
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.date_add("o_orderdate", 1).cast("timestamp").alias("started_at"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "old").alias("error"))
    first = runs.groupBy("job_id").agg(*[F.min_by(c, "k").alias(c) for c in ("created_at", "started_at", "error")], F.min("k").alias("k"))
    last = runs.groupBy("job_id").agg(*[F.max_by(c, "k").alias(c) for c in ("created_at", "started_at", "error")], F.max("k").alias("k"))
    return QU.upsert_jobs(first, last.where("cast(job_id as long) % 2 = 0")).select("job_id", "created_at", "started_at", "error", "k")


SQL["upserted_jobs"] = """SELECT o_custkey::VARCHAR AS job_id, arg_min(o_orderdate, o_orderkey) AS created_at, arg_min(o_orderdate, o_orderkey) + INTERVAL 1 DAY AS started_at,
  CASE WHEN o_custkey % 2 <> 0 THEN arg_min(CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE '' END, o_orderkey) END AS e0, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderkey) ELSE min(o_orderkey) END AS k FROM orders GROUP BY o_custkey"""
SQL["upserted_jobs"] = f"SELECT job_id, created_at, started_at, nullif(e0, '') AS error, k FROM ({SQL['upserted_jobs']})"


# --- statistics and the worker -----------------------------------------------------------


def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runtime statistics of documents as jobs and of the event table as tasks."""
    d = table(spark, sf_dir, "documents")
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    jobs = d.select(status.alias("status"), F.lit(2).alias("page_count"), F.lit(1).alias("fast_page_count"), F.pmod("doc_id", F.lit(2)).alias("vlm_page_count"), F.lit(4).alias("block_count"), F.pmod("doc_id", F.lit(5)).alias("embedding_count"), (F.pmod("doc_id", F.lit(16)) / 8.0).alias("elapsed_seconds"))
    s = ST.runtime_stats(jobs, QU.fold(queue_events(spark, sf_dir)))
    t = [F.col(f"tasks.{c}").alias(f"tasks_{c}") for c in ("total", "queued", "processing", "completed", "failed", "oldest_created_at", "oldest_queued_at")]
    return s.select(*[F.col(f"jobs.{c}").alias(f"jobs_{c}") for c in ("total", "queued", "processing", "completed", "failed")], *[F.col(f"pages.{c}").alias(f"pages_{c}") for c in ("total", "fast", "vlm")], "blocks", "embeddings", F.col("elapsed.max").alias("longest"), "coverage", *t)


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {{0}}_{s}" for s in ("queued", "processing", "completed", "failed"))
SQL["queue_stats"] = f"""{FOLD}, j AS (SELECT *, ['queued', 'processing', 'completed', 'failed'][doc_id % 4 + 1] AS status FROM documents),
  a AS (SELECT count(*) AS jobs_total, {_COUNTS.format("jobs")}, (count(*) * 2)::BIGINT AS pages_total, count(*)::BIGINT AS pages_fast, sum(doc_id % 2)::BIGINT AS pages_vlm, (count(*) * 4)::BIGINT AS blocks, sum(doc_id % 5)::BIGINT AS embeddings,
    max((doc_id % 16) / 8.0)::DOUBLE AS longest, round(sum(doc_id % 5) / (count(*) * 4), 4)::DOUBLE AS coverage FROM j),
  b AS (SELECT count(*) AS tasks_total, {_COUNTS.format("tasks")}, coalesce(epoch_us(min(created_at)) / 1000000.0, 0.0)::DOUBLE AS tasks_oldest_created_at, coalesce(epoch_us(min(created_at) FILTER (WHERE status = 'queued')) / 1000000.0, 0.0)::DOUBLE AS tasks_oldest_queued_at FROM f)
  SELECT * FROM a, b"""


def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customers' jobs, lines as blocks, those of odd parts embedded,
    returned ones as tasks."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pages = o.select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "vlm").otherwise("fast_pymupdf").alias("route"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("job_id"), "l_partkey", "l_returnflag")
    out = ST.job_counters(pages, rows, rows.where("l_partkey % 2 = 1"), rows.where("l_returnflag = 'R'"))
    return out.select("job_id", "page_count", "fast_page_count", "vlm_page_count", "block_count", "embedding_count", "enhancement_task_count")


SQL["job_counters"] = """WITH p AS (SELECT o_custkey AS job_id, count(*) AS page_count, count(*) FILTER (WHERE o_orderstatus <> 'F') AS fast_page_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS vlm_page_count FROM orders GROUP BY o_custkey),
  l AS (SELECT o_custkey AS job_id, count(*) AS b, count(*) FILTER (WHERE l_partkey % 2 = 1) AS e, count(*) FILTER (WHERE l_returnflag = 'R') AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
  SELECT p.*, coalesce(b, 0)::BIGINT AS block_count, coalesce(e, 0)::BIGINT AS embedding_count, coalesce(t, 0)::BIGINT AS enhancement_task_count FROM p LEFT JOIN l USING (job_id)"""


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as benchmark jobs, their orders as tasks."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    jobs = c.select(F.col("c_custkey").alias("job_id"), (F.pmod("c_custkey", F.lit(50)) + 1).alias("page_count"), (F.pmod("c_custkey", F.lit(3)) * 2.0).alias("wall_seconds"), F.lit(0.5).alias("parse_wall_seconds"))
    flags = F.struct(F.when(F.col("o_orderstatus") == "P", "optional").alias("enhancement_priority"), (F.col("o_orderkey") % 7 == 0).alias("image_asset_only"), (F.col("o_orderkey") % 2 == 0).alias("scan_ocr"), F.lit(False).alias("page_vlm"), F.lit(False).alias("force_vlm"))
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed"))), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    out = ST.bench_summary(jobs, o.select(F.col("o_custkey").alias("job_id"), status.alias("status"), flags.alias("metadata")))
    return out.select("job_id", "task_count", "queued_tasks", "completed_tasks", "required_priority_tasks", "optional_priority_tasks", "asset_only_priority_tasks", "pages_per_second", "parse_pages_per_second")


SQL["bench_summary"] = """WITH t AS (SELECT o_custkey AS j, o_orderkey % 4 AS s, CASE WHEN o_orderstatus = 'P' THEN 'optional' WHEN o_orderkey % 7 = 0 THEN 'asset_only' WHEN o_orderkey % 2 = 0 THEN 'required' ELSE 'optional' END AS p FROM orders),
  n AS (SELECT j, count(*) AS n, count(*) FILTER (WHERE s = 0) AS q, count(*) FILTER (WHERE s = 2) AS c, count(*) FILTER (WHERE p = 'required') AS r, count(*) FILTER (WHERE p = 'optional') AS o, count(*) FILTER (WHERE p = 'asset_only') AS a FROM t GROUP BY j)
  SELECT c_custkey AS job_id, coalesce(n.n, 0)::BIGINT AS task_count, coalesce(q, 0)::BIGINT AS queued_tasks, coalesce(n.c, 0)::BIGINT AS completed_tasks, coalesce(r, 0)::BIGINT AS required_priority_tasks, coalesce(o, 0)::BIGINT AS optional_priority_tasks, coalesce(a, 0)::BIGINT AS asset_only_priority_tasks,
  CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE (c_custkey % 50 + 1) / ((c_custkey % 3) * 2.0) END::DOUBLE AS pages_per_second, ((c_custkey % 50 + 1) * 2.0)::DOUBLE AS parse_pages_per_second FROM customer LEFT JOIN n ON n.j = c_custkey"""


def _call(task: dict) -> str:
    """A provider that fails on images."""
    if task["kind"] == "image_candidate":
        raise RuntimeError("no images")
    return f"done {task['task_id']}"


def worker_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of a worker on the event table as its log: the state of all tasks after it."""
    log = EventLog(spark, scratch(spark, "event-log"))
    log.append(queue_events(spark, sf_dir))
    Worker(log, lambda df, w: run_tasks(df, _call, w, 30.0, 4), "worker-9", 40, 3600.0).once(NOW)
    return log.tasks().select("task_id", "kind", "status", "worker_id", "result", "error", "events")


SQL["worker_round"] = f"""{FOLD}, taken AS (SELECT task_id FROM f WHERE status = 'queued' OR (status = 'processing' AND leased_at <= TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND) ORDER BY created_at NULLS FIRST, task_id LIMIT 40)
  SELECT f.task_id, kind, CASE WHEN taken.task_id IS NULL THEN status WHEN kind = 'image_candidate' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN taken.task_id IS NULL THEN worker_id ELSE 'worker-9' END AS worker_id,
    CASE WHEN taken.task_id IS NULL OR kind = 'image_candidate' THEN result ELSE 'done ' || f.task_id END AS result, CASE WHEN taken.task_id IS NULL THEN error WHEN kind = 'image_candidate' THEN 'no images' END AS error,
    events + CASE WHEN taken.task_id IS NULL THEN 0 ELSE 2 END AS events FROM f LEFT JOIN taken ON taken.task_id = f.task_id"""


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as the life of jobs."""
    names = {"signup": "queued", "view": "processing", "purchase": "completed", "error": "failed"}
    event = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    e = table(spark, sf_dir, "events").withColumn("event", event).where("event is not null")
    return QU.fold_jobs(e.select(F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_id").alias("seq"), "event", F.when(F.col("event") == "failed", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error")))


SQL["job_states"] = """WITH e AS (SELECT user_id::VARCHAR AS job_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS event FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error')),
  l AS (SELECT job_id, event, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS n FROM e) WHERE n = 1)
  SELECT job_id, any_value(l.event) AS status, min(ts) AS created_at, min(ts) FILTER (WHERE e.event = 'processing') AS started_at, max(ts) FILTER (WHERE e.event IN ('completed', 'failed')) AS completed_at, any_value(CASE WHEN l.event = 'failed' THEN 'e' || l.seq::VARCHAR END) AS error FROM e JOIN l USING (job_id) GROUP BY job_id"""


# --- text that is rewritten, archives, OCR -----------------------------------------------


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as HTML tables with spans and entities, inside of other text."""
    c = table(spark, sf_dir, "customer")
    html = F.concat(
        F.lit("<b>kept</b> <TABLE class='x'><tr><th rowspan=\"2\">"), "c_name", F.lit("</th><th colspan=2>a &amp; <i>b</i>|c</th></tr><tr><td>"), F.col("c_custkey").cast("string"), F.lit("<br/>\n"), "c_mktsegment",
        F.lit("</td></tr><tr></tr><tr><td></td></tr></table> &amp; rest"),
    )
    return c.select("c_custkey", RF.convert_tables_udf(html).alias("markdown"))


SQL["html_tables"] = r"""SELECT c_custkey, '<b>kept</b> ' || chr(10) || '| ' || c_name || ' | a & b \|c |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '|  | ' || c_custkey::VARCHAR || ' ' || c_mktsegment || ' |  |' || chr(10) || ' &amp; rest' AS markdown FROM customer"""


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML tables of all web pages as pipe tables."""
    return table(spark, sf_dir, "pages").select("page_id", RF.convert_tables_udf("html").alias("markdown"))


def inline_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of inline text tables, two records a line, under captions."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("intro\n Table "), k, F.lit(": Sizes\n\nrank Group Name top-1 err. size\n"), F.col("p_partkey").cast("string"), F.lit(". "), "p_name", F.lit(" "), size, F.lit(".5 - "), size, F.lit("%  ... 7. other|part .25 1.0 2.0\nend"))
    return p.select("p_partkey", RF.reflow_udf(text).alias("markdown"))


SQL["inline_tables"] = r"""SELECT p_partkey, 'intro' || chr(10) || 'Table ' || p_partkey::VARCHAR || ': Sizes' || chr(10) || '| rank | Group Name | top-1 err. | size |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  '| ' || p_partkey::VARCHAR || '. ' || p_name || ' | ' || p_size::VARCHAR || '.5 | - | ' || p_size::VARCHAR || '% |' || chr(10) || '| ... 7. other\|part | .25 | 1.0 | 2.0 |' || chr(10) || 'end' AS markdown FROM part"""


@F.pandas_udf(BinaryType())
def _zip(text: pd.Series) -> pd.Series:
    def one(t: str) -> bytes:
        data = io.BytesIO()
        lines = t.split("\n")
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("a/readme.md", t)
            if len(lines) % 3:
                z.writestr("a/x_content_list.json", json.dumps([[{"type": "text" if i % 2 else "title", "text": x, "bbox": [0, i, 10.129, i + 1]}] for i, x in enumerate(lines)]))
            z.writestr("a/broken_content_list_v2.json", "{")
        return data.getvalue()

    return text.map(one)


def archive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archives of content items, every third with Markdown only, as blocks."""
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").cast("string").alias("job_id"), F.lit(0).alias("page_index"), _zip(F.coalesce("text", F.lit(""))).alias("content"))
    b = PL.archive_blocks(a)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]), "\n")
    return b.groupBy("job_id", "kind").agg(F.count("*").alias("blocks"), _md5(ordered).alias("text_md5"), F.max(F.col("bbox")[2]).alias("right"))


SQL["archive_blocks"] = r"""WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
  b AS (SELECT doc_id, CASE WHEN i % 2 = 1 THEN 'text' ELSE 'title' END AS kind, i, trim(regexp_replace(x, '\s+', ' ', 'g')) AS t, 10.13 AS r FROM l WHERE n % 3 <> 0
    UNION ALL SELECT doc_id, 'markdown', 0, trim(regexp_replace(text, '\s+', ' ', 'g')), NULL FROM documents d WHERE len(string_split(text, chr(10))) % 3 = 0 OR NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = d.doc_id AND trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''))
  SELECT doc_id::VARCHAR AS job_id, kind, count(*) AS blocks, md5(string_agg(t, chr(10) ORDER BY i)) AS text_md5, max(r)::DOUBLE AS "right" FROM b WHERE t <> '' GROUP BY doc_id, kind"""


def worker_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same archives as a worker reports them."""
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").cast("string").alias("job_id"), F.lit(0).alias("page_index"), _zip(F.coalesce("text", F.lit(""))).alias("content"))
    return PL.worker_results(a).select("job_id", F.size("zip_entries").cast("long").alias("entries"), _md5(F.col("markdown")).alias("markdown_md5"), F.col("n_items").cast("long").alias("n_items"), "error")


SQL["worker_archives"] = """SELECT doc_id::VARCHAR AS job_id, CASE WHEN n % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS entries, md5(coalesce(text, '')) AS markdown_md5, CASE WHEN n % 3 = 0 THEN 0 ELSE n END::BIGINT AS n_items, NULL::VARCHAR AS error
  FROM (SELECT doc_id, text, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)"""


def _tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the TSV of an OCR run: a word every 128 pixels, a line every 32; every
    seventh word is doubtful, every fifth of unknown confidence."""
    d = table(spark, sf_dir, "documents")
    fields = lambda k, i, w: F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), k.cast("string"), i.cast("string"), (i * 128).cast("string"), (k * 32).cast("string"), F.lit("64"), F.lit("16"), F.when(F.pmod(i, F.lit(7)) == 6, "10.5").when(F.pmod(i, F.lit(5)) == 4, "-1").otherwise("90"), w)
    rows = F.transform(F.split("text", "\n"), lambda x, k: F.array_join(F.transform(F.split(x, " "), lambda w, i: fields(k, i, w)), "\n"))
    return d.select(F.col("doc_id").cast("string").alias("job_id"), F.lit(0).alias("page_index"), F.concat(F.lit("\t".join(OC._FIELDS) + "\n"), F.array_join(rows, "\n")).alias("tsv"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document read back from TSV, by line."""
    w = OC.words(_tsv(spark, sf_dir))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ")
    return w.groupBy("job_id", "line_num").agg(F.count("*").alias("words"), _md5(joined).alias("text_md5"), F.sum(F.col("bbox")[0] + F.col("bbox")[3]).alias("places"))


def _placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words as rows: the doubtful ones are left out."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("line_num", "t"))
    w = d.select("job_id", "line_num", F.posexplode(F.split("t", " ")).alias("word_num", "text")).where("text <> '' and word_num % 7 <> 6")
    x, y = F.col("word_num") * 64.0, F.col("line_num") * 16.0
    return w.select("job_id", F.lit(0).alias("page_index"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), "line_num", "word_num", F.array(x, y, x + 32.0, y + 8.0).alias("bbox"), "text")


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document put together to lines."""
    out = OC.lines(_placed_words(spark, sf_dir))
    return out.select("job_id", F.col("line_index").cast("long").alias("line_index"), _md5(F.col("text")).alias("text_md5"), F.col("bbox")[2].alias("right"), F.col("bbox")[3].alias("bottom"))


_WORDS = """w AS (SELECT doc_id, line, unnest(string_split(t, ' ')) AS w, unnest(range(0, len(string_split(t, ' ')))) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents)),
  g AS (SELECT doc_id, line, i, w, lag(i) OVER v AS bi, lag(w) OVER v AS bw FROM w WHERE w <> '' AND i % 7 <> 6 WINDOW v AS (PARTITION BY doc_id, line ORDER BY i)),
  c AS (SELECT *, 64.0 * (i - bi) - 32 AS gap, greatest(3.5, 32.0 / length(bw)) AS ch FROM g),
  l AS (SELECT doc_id, line, string_agg(CASE WHEN bi IS NULL THEN w ELSE repeat(' ', CASE WHEN gap > ch * 1.5 THEN greatest(1, least(12, round_even(gap / ch, 0)))::INTEGER ELSE 1 END) || w END, '' ORDER BY i) AS t, max(i * 64.0 + 32) AS r, max(line * 16.0 + 8) AS b FROM c GROUP BY doc_id, line)"""
SQL["ocr_words"] = f"""WITH {_WORDS} SELECT doc_id::VARCHAR AS job_id, line::INTEGER AS line_num, count(*) AS words, md5(string_agg(w, ' ' ORDER BY i)) AS text_md5, sum(i * 64.0 + line * 16.0 + 8)::DOUBLE AS places FROM g GROUP BY doc_id, line"""
SQL["ocr_lines"] = f"""WITH {_WORDS} SELECT doc_id::VARCHAR AS job_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1)::BIGINT AS line_index, md5(t) AS text_md5, r::DOUBLE AS "right", b::DOUBLE AS bottom FROM l"""


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those lines as blocks of scanned pages, every 20th line a table caption and every 17th
    far below the last."""
    k = F.col("line_index")
    shift = F.floor(k / 17) * 100.0
    rows = OC.lines(_placed_words(spark, sf_dir)).withColumn("text", F.when(F.pmod(k, F.lit(20)) == 12, F.concat(F.lit("Table "), k.cast("string"), F.lit(". x"))).otherwise(F.col("text")))
    b = F.col("bbox")
    rows = rows.withColumn("bbox", F.array(b[0], k * 16.0 + shift, b[2], k * 16.0 + shift + 8))
    pages = rows.select("job_id", "page_index").distinct().select("*", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit("scan_or_image_heavy").alias("reason"))
    out = OC.blocks_from_lines(rows, pages)
    return out.select("job_id", F.col("block_index").cast("long").alias("block_index"), "kind", _md5(F.col("text")).alias("text_md5"), F.col("bbox")[1].alias("top"), F.col("bbox")[3].alias("bottom"), F.coalesce(F.col("metadata.image_asset_only"), F.lit(False)).alias("asset"))


SQL["ocr_blocks"] = f"""WITH {_WORDS}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS k, t FROM l),
  m AS (SELECT doc_id, k, CASE WHEN k % 20 = 12 THEN 'Table ' || k::VARCHAR || '. x' ELSE t END AS t, k * 16.0 + (k // 17) * 100.0 AS y, k % 20 = 12 OR EXISTS (SELECT 1 FROM n c WHERE c.doc_id = n.doc_id AND c.k % 20 = 12 AND n.k > c.k AND n.k <= c.k + 8 AND n.k // 17 = c.k // 17) AS tab FROM n),
  b AS (SELECT doc_id, CASE WHEN tab THEN 1 ELSE 2 END AS phase, CASE WHEN tab THEN 'native_table' ELSE 'text' END AS kind, string_agg(t, chr(10) ORDER BY k) AS t, min(y) AS top, max(y + 8) AS bottom, false AS asset FROM m GROUP BY doc_id, tab
    UNION ALL SELECT DISTINCT doc_id, 0, 'image', '[scan page asset page=0]', 0.0, 842.0, true FROM m)
  SELECT doc_id::VARCHAR AS job_id, (row_number() OVER (PARTITION BY doc_id ORDER BY phase) - 1)::BIGINT AS block_index, kind, md5(t) AS text_md5, top::DOUBLE AS top, bottom::DOUBLE AS bottom, asset FROM b"""

FLOWS = (
    parse_documents, parse_tasks, parse_counters, block_ids, vector_regions, image_ratios, crop_images, worker_widths, block_tasks, blocks_with_embeddings, rendered_documents, asset_names, stored_blocks, upserted_jobs,
    queue_stats, job_counters, bench_summary, worker_round, job_states, html_tables, page_tables, inline_tables, archive_blocks, worker_archives, ocr_words, ocr_lines, ocr_blocks,
)
