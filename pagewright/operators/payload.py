"""Results of vision workers: archives and nested JSON to blocks and Markdown."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

from .blocks import metadata, with_block_ids

ITEM_KEYS = ("type", "content", "text", "html", "markdown", "latex")
TEXT_KEYS = ("text", "content", "html", "latex", "caption", "markdown")
_ITEMS = "archive string, position int, kind string, bbox array<double>, " + ", ".join(f"`{k}` string" for k in TEXT_KEYS)


def flatten(value) -> Iterator[dict]:
    """The objects of nested lists, in order; objects are not entered."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
        elif isinstance(v, list):
            stack.extend(reversed(v))


def flatten_content(value) -> Iterator[dict]:
    """Content items of nested lists and objects; objects that are no items are entered."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if any(k in v for k in ITEM_KEYS):
                yield v
            else:
                stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def item_box(item: dict) -> list[float] | None:
    """First four numbers of bbox, poly or position, to two places; null unless all are numbers."""
    raw = next((item[k] for k in ("bbox", "poly", "position") if item.get(k)), None)
    if not isinstance(raw, list) or len(raw) < 4:
        return None
    try:
        return [round(float(x), 2) for x in raw[:4]]
    except (TypeError, ValueError):
        return None


def _string(v) -> str | None:
    return None if v is None or v == "" else str(v)


#: Endings of content lists, and how much of an archive's names and text is kept.
CONTENT_ENDINGS = ("content_list.json", "content_list_v2.json")
PAGE_NAMES, WORKER_NAMES, PREVIEW_CHARS = 40, 80, 2000


class _Archive:
    """A ZIP of results: its names, its readable content lists, its Markdown files."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = self.zip.namelist()

    def text(self, name: str) -> str:
        return self.zip.read(name).decode("utf-8", errors="replace")

    def content(self) -> Iterator[tuple[str, object]]:
        for name in filter(lambda n: n.endswith(CONTENT_ENDINGS), self.names):
            try:
                yield name, json.loads(self.text(name))
            except json.JSONDecodeError:
                pass

    def markdown(self) -> Iterator[tuple[str, str]]:
        return ((n, self.text(n)) for n in self.names if n.endswith(".md"))


def _each_archive(archives: DataFrame, read: Callable[[_Archive], list[dict]], schema: str) -> DataFrame:
    """job_id, page_index, content (a ZIP) -> the rows that ``read`` gives for each, or one row
    whose ``error`` says that the archive is broken."""
    columns = ["job_id", "page_index", *(re.sub("`", "", c.split(" ")[0]) for c in schema.split(", ")), "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[dict] = []
            for job, page, data in zip(b["job_id"], b["page_index"], b["content"]):
                own = {"job_id": job, "page_index": page}
                try:
                    out += [own | r for r in read(_Archive(bytes(data)))]
                except (zipfile.BadZipFile, ValueError) as e:
                    out.append(own | {"error": str(e)})
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in columns})

    return archives.select("job_id", "page_index", "content").mapInPandas(run, f"job_id string, page_index int, {schema}, error string")


def archive_items(archives: DataFrame) -> DataFrame:
    """The content items of each page archive in order, or else its first Markdown file with
    text: archive, position, kind, bbox, the text fields and the item as JSON (raw)."""

    def read(a: _Archive) -> list[dict]:
        rows = []
        for name, payload in a.content():
            for item in flatten(payload):
                fields = {k: _string(item.get(k)) for k in TEXT_KEYS}
                if any(v and v.split() for v in fields.values()):
                    rows.append(fields | {"archive": name, "kind": str(item.get("type") or item.get("kind") or "text"), "bbox": item_box(item), "raw": json.dumps(item, ensure_ascii=False)})
        if not rows:
            rows = [{"archive": n, "kind": "markdown", "markdown": t} for n, t in a.markdown() if t.split()][:1]
        return [r | {"position": i} for i, r in enumerate(rows)]

    return _each_archive(archives, read, f"{_ITEMS}, raw string")


def archive_summary(archives: DataFrame) -> DataFrame:
    """The first names of each page archive, and the beginning of the Markdown that stands in
    where no content list has an item with text."""

    def read(a: _Archive) -> list[dict]:
        items = any(_string(x.get(k)) and str(x[k]).split() for _, p in a.content() for x in flatten(p) for k in TEXT_KEYS)
        preview = None if items else next((t[:PREVIEW_CHARS] for _, t in a.markdown() if t.split()), None)
        return [{"zip_entries": a.names[:PAGE_NAMES], "markdown_preview": preview}]

    return _each_archive(archives, read, "zip_entries array<string>, markdown_preview string")


def worker_results(archives: DataFrame) -> DataFrame:
    """Archives as a worker reports them: the first names, the first Markdown file as it is
    (empty for none), and the items of all content lists that are lists, as JSON."""

    def read(a: _Archive) -> list[dict]:
        items = [x for _, p in a.content() if isinstance(p, list) for x in flatten(p)]
        return [{"zip_entries": a.names[:WORKER_NAMES], "markdown": next((t for _, t in a.markdown()), ""), "content_items": json.dumps(items, ensure_ascii=False), "n_items": len(items)}]

    return _each_archive(archives, read, "zip_entries array<string>, markdown string, content_items string, n_items int")


class ServiceCall:
    """A vision service behind ``post(task)``, which gives (status, body): a status of 400 and more
    fails with the beginning of the body, an archive that can't be read with its error. The result
    is JSON text for the event log."""

    def __init__(self, post: Callable[[dict], tuple[int, bytes]], error_chars: int = 4000) -> None:
        self.post, self.error_chars = post, error_chars

    def __call__(self, task: dict) -> str:
        status, body = self.post(task)
        if status >= 400:
            raise RuntimeError(body.decode("utf-8", errors="replace")[: self.error_chars])
        a = _Archive(body)
        items = [x for _, p in a.content() if isinstance(p, list) for x in flatten(p)]
        found = {"status_code": status, "zip_entries": a.names[:WORKER_NAMES], "markdown": next((t for _, t in a.markdown()), ""), "content_items": items}
        return json.dumps(found, ensure_ascii=False)


def set_options(**options) -> dict:
    """The options of a model that are set; the model's own defaults hold for the others."""
    return {k: v for k, v in options.items() if v is not None and v != ""}


def archive_blocks(archives: DataFrame, source: str = "archive_vlm") -> DataFrame:
    """Blocks of page archives, in archive order."""
    items = archive_items(archives).where("error is null")
    text = T.item_text({k: F.col(k) for k in TEXT_KEYS})
    out = items.select("job_id", "page_index", F.col("position").alias("block_index"), F.lit(source).alias("source"), "kind", text.alias("text"), "bbox", metadata(archive=F.col("archive"), raw=F.col("raw")).alias("metadata"))
    return with_block_ids(out)


def content_markdown(results: DataFrame) -> DataFrame:
    """task_id, payload (nested JSON) -> task_id, n_items, markdown of its content items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts, texts = [], []
            for p in b["payload"]:
                try:
                    items = list(flatten_content(json.loads(p))) if p else []
                except json.JSONDecodeError:
                    items = []
                counts.append(len(items))
                texts.append(markdown_of(items))
            yield pd.DataFrame({"task_id": b["task_id"], "n_items": counts, "markdown": texts})

    return results.select("task_id", "payload").mapInPandas(run, "task_id string, n_items int, markdown string")


def jsonable(value):
    """Any provider value as JSON types: models by their fields, other iterables as lists, the
    rest as text."""
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    for method in ("model_dump", "dict"):
        if not isinstance(value, dict) and callable(getattr(value, method, None)):
            value = getattr(value, method)()
            break
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    try:
        return [jsonable(v) for v in value]
    except TypeError:
        return str(value)


def split_batch(raw, n_tasks: int) -> list:
    """One result for each task of a batch; a wrong number is an error."""
    found = jsonable(raw)
    if n_tasks == 1:
        return [found]
    if not isinstance(found, list) or len(found) != n_tasks:
        raise ValueError(f"VLM returned {type(found).__name__} for {n_tasks} tasks")  # fixed text
    return found


def markdown_of(items: list[dict]) -> str:
    """The first filled text field of each item, in paragraphs."""
    keys = ("markdown", "content", "text", "html", "latex")
    texts = (next((i[k].strip() for k in keys if isinstance(i.get(k), str) and i[k].strip()), "") for i in items)
    return "\n\n".join(filter(None, texts))


def task_result(crop_path: str, raw, image_size: tuple[int, int], batch_seconds: float, max_image_width: int | None, backend: str = "direct") -> dict:
    """What a worker reports for a task."""
    held = jsonable(raw)
    items = list(flatten_content(held))
    return {
        "backend": backend, "elapsed_seconds": batch_seconds, "crop_path": crop_path, "image_size": list(image_size), "max_image_width": max_image_width,
        "raw_result": held, "content_items": items, "markdown": markdown_of(items),
    }
