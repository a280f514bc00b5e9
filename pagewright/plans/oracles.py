"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from pagewright.plans.queries import _FLAGS, NOW, TEXTS

_SIGNALS = """SELECT doc_id, length(text) AS text_chars, len(string_split(text, chr(10)))::BIGINT AS block_count, doc_id % 4 AS image_count,
  (doc_id % 5) / 8.0 AS image_area_ratio, doc_id % 7 = 0 AS has_table_hint FROM documents"""

_ROUTED = f"""SELECT *, CASE WHEN text_chars >= 500 AND image_area_ratio < 0.2 THEN 'fast_pymupdf' WHEN text_chars >= 220 AND image_area_ratio < 0.35 AND image_count <= 2 THEN 'fast_pymupdf' ELSE 'vlm' END AS route,
  CASE WHEN text_chars >= 500 AND image_area_ratio < 0.2 THEN 'editable_text_dense' || CASE WHEN has_table_hint THEN '_table_candidate' ELSE '' END
  WHEN text_chars >= 220 AND image_area_ratio < 0.35 AND image_count <= 2 THEN 'editable_text_moderate' || CASE WHEN has_table_hint THEN '_table_candidate' ELSE '' END
  WHEN has_table_hint THEN 'table_hint' WHEN image_area_ratio >= 0.35 OR text_chars < 80 THEN 'scan_or_image_heavy' ELSE 'mixed_or_low_confidence' END AS reason FROM ({_SIGNALS})"""

PAGES = """SELECT doc_id, p AS page_index, list_slice(ls, p * 40 + 1, p * 40 + 40) AS ls FROM (
  SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // 40 + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""

_EVENTS = """SELECT user_id::VARCHAR AS task_id, 'job-' || (user_id % 7)::VARCHAR AS job_id, CASE WHEN user_id % 3 = 0 THEN 'image_candidate' ELSE 'table_candidate' END AS kind, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'claimed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS event, 'w' || (event_id % 5)::VARCHAR AS worker_id,
  CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END AS result, CASE WHEN event_type = 'error' THEN 'e' || event_id::VARCHAR END AS error
  FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error')"""

_NTH = "row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC)"
FOLD = f"""WITH e AS ({_EVENTS}), l AS (SELECT * FROM (SELECT *, {_NTH} AS n FROM e) WHERE n = 1),
  c AS (SELECT task_id, min(ts) AS created_at FROM e WHERE event = 'created' GROUP BY task_id),
  k AS (SELECT task_id, max(ts) AS leased_at FROM e WHERE event = 'claimed' GROUP BY task_id),
  w AS (SELECT task_id, worker_id FROM (SELECT *, {_NTH} AS n FROM e WHERE event <> 'created') WHERE n = 1),
  r AS (SELECT task_id, result FROM (SELECT *, {_NTH} AS n FROM e WHERE event = 'completed') WHERE n = 1),
  t AS (SELECT task_id, count(*) AS events FROM e GROUP BY task_id),
  f AS (SELECT l.task_id, l.job_id, l.kind, CASE l.event WHEN 'created' THEN 'queued' WHEN 'claimed' THEN 'processing' ELSE l.event END AS status, c.created_at, k.leased_at, w.worker_id, r.result,
    CASE WHEN l.event = 'failed' THEN l.error END AS error, t.events FROM l LEFT JOIN c USING (task_id) LEFT JOIN k USING (task_id) LEFT JOIN w USING (task_id) LEFT JOIN r USING (task_id) LEFT JOIN t USING (task_id))"""

_BITS = ", ".join(f"(id // {1 << i}) % 2 = 1 AS {k}" for i, k in enumerate(_FLAGS))
_FLAG_ROWS = f"SELECT id, {_BITS}, CASE WHEN id % 3 = 0 THEN '' ELSE 'x' END AS text FROM (SELECT unnest(range(0, {1 << len(_FLAGS)})) AS id)"
_BLOCK = """CASE WHEN {asset} THEN 'asset_only' WHEN force_vlm OR scan_ocr OR (native_table_needs_vlm AND (native_table OR NOT native_table_deferred)) OR (table_candidate AND text = '') THEN 'required' ELSE 'optional' END"""
_EXPORT = "CASE WHEN image_asset_only THEN 'asset_only' WHEN scan_ocr OR force_vlm OR (native_table_needs_vlm AND native_table) THEN 'required' ELSE 'optional' END"
_KIND = "CASE WHEN image_candidate THEN 'image_candidate' ELSE 'table_candidate' END"

_TEXTS = ", ".join("({}, {})".format(-1 - i, "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'") for i, t in enumerate(TEXTS))
_BOX = "(p_partkey % 560)::DOUBLE AS bx0, ((p_partkey * 7) % 800)::DOUBLE AS by0, (p_partkey % 560 + p_size)::DOUBLE AS bx1, ((p_partkey * 7) % 800 + p_size * 2)::DOUBLE AS by1"

_OVERLAPS = " AND ".join(
    f"NOT (greatest(0.0, least(50.0 + 6 * length(x), {x1}) - greatest(50.0, {x0})) * greatest(0.0, least(72.0 + 18 * i, {y1}) - greatest(60.0 + 18 * i, {y0})) / greatest(1.0, 6.0 * length(x) * 12.0) >= 0.75)"
    for x0, y0, x1, y1 in ((0.0, 100.0, 400.0, 200.0), (0.0, 300.0, 595.0, 420.0))
)

ORACLES: dict[str, str] = {
    "route_counters": f"SELECT route, reason, count(*) AS pages, sum(block_count)::BIGINT AS blocks FROM ({_ROUTED}) GROUP BY route, reason",
    "page_routes": f"SELECT doc_id, route, reason FROM ({_ROUTED})",
    "page_signals": f"""SELECT doc_id::VARCHAR AS job_id, page_index::INTEGER AS page_index, length(trim(array_to_string(ls, chr(10)), ' ' || chr(10) || chr(9) || chr(13)))::BIGINT AS text_chars,
      len(list_filter(ls, lambda x: trim(x) <> ''))::BIGINT AS block_count, (doc_id % 4)::BIGINT AS image_count FROM ({PAGES})""",
    "clean_text": r"SELECT doc_id, length(x)::BIGINT AS clean_chars, md5(x) AS clean_md5 FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)",
    "text_chunks": """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
      s AS (SELECT doc_id, ls, 1 AS i, 0::BIGINT AS chunk, length(ls[1])::BIGINT AS n FROM l
        UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN n + length(ls[i + 1]) > 200 THEN chunk + 1 ELSE chunk END, CASE WHEN n + length(ls[i + 1]) > 200 THEN length(ls[i + 1]) ELSE n + length(ls[i + 1]) END FROM s WHERE i < len(ls)),
      g AS (SELECT doc_id, chunk, string_agg(ls[i], chr(10) ORDER BY i) AS t, max(72.0 + 18 * (i - 1))::DOUBLE AS bottom FROM s GROUP BY doc_id, chunk)
      SELECT doc_id, chunk, length(t)::BIGINT AS chars, md5(t) AS text_md5, bottom FROM g""",
    "queue_fold": f"{FOLD} SELECT * FROM f",
    "queue_claim": f"""{FOLD} SELECT task_id, 'processing' AS status, 'worker-9' AS worker_id, created_at FROM f WHERE status = 'queued' OR (status = 'processing' AND (leased_at <= TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND))
      ORDER BY created_at NULLS FIRST, task_id LIMIT 10""",
    "queue_claim_kind": f"""{FOLD} SELECT task_id, kind, 'processing' AS status FROM f WHERE kind = 'image_candidate' AND (status = 'queued' OR (status = 'processing' AND (leased_at <= TIMESTAMP '{NOW}')))
      ORDER BY created_at NULLS FIRST, task_id LIMIT 100""",
    "interrupted_jobs": f"""{FOLD} SELECT task_id AS job_id, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'processing') THEN 'interrupted by service restart' ELSE error END AS error FROM f""",
    "queue_stream": f"{FOLD} SELECT * FROM f",
    "job_totals": """SELECT count(*) AS total, count(*)::BIGINT AS page_count, sum(doc_id % 2)::BIGINT AS fast_page_count, sum(1 - doc_id % 2)::BIGINT AS vlm_page_count, sum(len(string_split(text, chr(10))))::BIGINT AS block_count,
      sum(doc_id % 3)::BIGINT AS embedding_count, avg((doc_id % 16) / 8.0) AS avg_elapsed_seconds, max((doc_id % 16) / 8.0)::DOUBLE AS max_elapsed_seconds FROM documents""",
    "load_summary": """SELECT count(*) FILTER (WHERE ok) AS completed, count(*) FILTER (WHERE NOT ok) AS failed, coalesce(sum(event_id % 9) FILTER (WHERE ok), 0)::BIGINT AS pages, coalesce(sum(event_id % 5) FILTER (WHERE ok), 0)::BIGINT AS blocks,
      round(sum(event_id % 9) FILTER (WHERE ok) / 4096.0, 3)::DOUBLE AS pages_per_second, (max(event_id % 16) FILTER (WHERE ok) / 8.0)::DOUBLE AS service_max, (max(event_id % 32) FILTER (WHERE ok) / 8.0)::DOUBLE AS wall_max, (max(event_id % 64) FILTER (WHERE ok) / 4.0)::DOUBLE AS vlm_seconds_max, 0.0::DOUBLE AS total_seconds_avg,
      round_even(avg(event_id % 16) FILTER (WHERE ok), 0)::BIGINT AS service_avg_eighths, round_even(avg(event_id % 32) FILTER (WHERE ok), 0)::BIGINT AS wall_avg_eighths, round_even(avg(event_id % 64) FILTER (WHERE ok) * 2, 0)::BIGINT AS vlm_seconds_avg_eighths FROM (SELECT *, event_type <> 'error' AS ok FROM events)""",
    "task_priorities": f"""SELECT id, table_candidate OR image_candidate OR native_table_needs_vlm AS candidate, {_KIND} AS kind, {_BLOCK.format(asset="image_asset_only")} AS block_priority, {_EXPORT} AS export_priority,
      CASE WHEN image_asset_only THEN 'asset_only' WHEN scan_ocr OR force_vlm THEN 'required' ELSE 'optional' END AS bench_priority, force_vlm AS queued_none, true AS queued_all,
      force_vlm OR (vector_graphics_candidate AND NOT figure_caption_candidate) AS queued_uncaptioned, force_vlm OR vector_graphics_candidate AS queued_vector,
      CASE WHEN image_candidate THEN NULL WHEN {_BLOCK.format(asset="false")} = 'required' AND (force_vlm OR scan_ocr OR native_table_needs_vlm) THEN 768 ELSE 640 END::BIGINT AS width FROM ({_FLAG_ROWS})""",
    "wait_policies": f"""SELECT priority, count(*) AS tasks, 0::BIGINT AS used_none, count(*) FILTER (WHERE priority = 'required') AS used_required, count(*) FILTER (WHERE priority <> 'asset_only') AS used_all FROM (SELECT {_EXPORT} AS priority FROM ({_FLAG_ROWS})) GROUP BY priority""",
    "crops": f"""SELECT p_partkey, greatest(0.0, bx0 - 40)::DOUBLE AS x0, greatest(0.0, by0 - 40)::DOUBLE AS y0, least(595.0, bx1 + 40)::DOUBLE AS x1, least(842.0, by1 + 40)::DOUBLE AS y1,
      greatest(0.0, least(bx1, 300.0) - greatest(bx0, 100.0)) / greatest(1.0, bx1 - bx0) >= 0.25 AS related,
      (greatest(0.0, least(bx1, 256.0) - greatest(bx0, 0.0)) * greatest(0.0, least(by1, 256.0) - greatest(by0, 0.0)) / greatest(1.0, (bx1 - bx0) * (by1 - by0)))::DOUBLE AS overlap FROM (SELECT p_partkey, {_BOX} FROM part)""",
    "covered_items": f"""SELECT doc_id::VARCHAR AS job_id, page_index::BIGINT AS page_index, count(*) AS items, count(*) FILTER (WHERE {_OVERLAPS}) AS free FROM (SELECT doc_id, page_index, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM ({PAGES})) GROUP BY doc_id, page_index""",
    "text_predicates": rf"""SELECT id, len(list_filter(string_split(x, chr(10)), lambda r: trim(r) <> '' AND length(r) - length(replace(r, chr(9), '')) >= 2)) > 0
        OR len(list_filter(string_split(x, chr(10)), lambda r: regexp_matches(r, '\S+([ \t]{{2,}}\S+){{3,}}'))) >= 2 AS table_like,
      regexp_matches(x, '(?i)(^|\n)\s*Table\s+\d+[.:]?') AS table_caption, regexp_matches(x, '(?i)^\s*Table\s+\d+\s*[.:]') AS strict_caption, regexp_matches(x, '(?i)(^|\n)\s*(Figure|Fig\.)\s+\d+[.:]?') AS figure_caption,
      regexp_matches(x, '×\s*×|,,|\d+\s+\d+×\s*×\d+') AS needs_vision, len(list_distinct(regexp_extract_all(x, '(?i)\b(?:Table|Fig(?:ure)?\.?)\s*\d+\s*[.:]')))::BIGINT AS n_captions FROM (SELECT * FROM (VALUES {_TEXTS}) AS t(id, x) UNION ALL SELECT doc_id, coalesce(text, '') FROM documents)""",
    "table_markdown": r"""SELECT r_name, '| key | name | mark |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey::VARCHAR || ' | ' || n_name || ' | a\|' || n_nationkey::VARCHAR || ' |', chr(10) ORDER BY n_nationkey) AS markdown, true AS usable
      FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "caption_clusters": """WITH l AS (SELECT doc_id, 60.0 + 20 * i AS y0, 72.0 + 20 * i AS y1 FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
      a AS (SELECT doc_id, y0, coalesce(lag(y0) OVER w, 120) - y1 <= CASE WHEN lag(y0) OVER w IS NULL THEN 64 ELSE 18 END AS near FROM l WHERE 120 - y1 BETWEEN 0 AND 220 WINDOW w AS (PARTITION BY doc_id ORDER BY y0 DESC)),
      b AS (SELECT doc_id, y0, y0 - coalesce(lag(y1) OVER w, 132) <= CASE WHEN lag(y1) OVER w IS NULL THEN 64 ELSE 24 END AS near FROM l WHERE y0 - 132 BETWEEN 0 AND 220 WINDOW w AS (PARTITION BY doc_id ORDER BY y0)),
      x AS (SELECT doc_id, count(*) FILTER (WHERE run) AS n FROM (SELECT doc_id, bool_and(near) OVER (PARTITION BY doc_id ORDER BY y0 DESC) AS run FROM a) GROUP BY doc_id),
      y AS (SELECT doc_id, count(*) FILTER (WHERE run) AS n FROM (SELECT doc_id, bool_and(near) OVER (PARTITION BY doc_id ORDER BY y0) AS run FROM b) GROUP BY doc_id)
      SELECT doc_id, coalesce(x.n, 0) AS above, coalesce(y.n, 0) AS below FROM documents LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)""",
}

#: Eight sha256 words of each counter, as numbers from -1 to 1.
ORACLES["hash_embedding"] = r"""SELECT doc_id, (c * 8 + o)::BIGINT AS dim, (('0x' || substr(h, o * 8 + 1, 8))::BIGINT)::DOUBLE / 2147483648.0 - 1.0 AS value FROM (
  SELECT doc_id, c, sha256(encode(trim(regexp_replace(text, '\s+', ' ', 'g'))) || unhex(printf('%08x', c))) AS h, unnest(range(0, 8)) AS o FROM documents, (SELECT unnest(range(0, 2)) AS c)) WHERE c * 8 + o < 12"""
