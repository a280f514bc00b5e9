"""Page-geometry tables: the engine's input contract and ways to get one."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = (
    "job_id string, page_index int, width double, height double, text string, "
    "items array<struct<bbox:array<double>,text:string>>, images array<struct<xref:int,width:int,height:int,bbox:array<double>>>, "
    "drawings array<struct<bbox:array<double>>>, tables array<struct<bbox:array<double>,rows:array<array<string>>>>"
)
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
LINES_PER_PAGE = 40


class PageExtractor(ABC):
    """Reads a document's bytes into page rows; made once in each Python worker."""

    @abstractmethod
    def pages(self, job_id: str, data: bytes) -> Iterator[dict]: ...


class FailingExtractor(PageExtractor):
    """Stands in where no document library is installed."""

    def pages(self, job_id: str, data: bytes) -> Iterator[dict]:
        raise RuntimeError("no document library is configured")


def accepted(file_name: str) -> str:
    """The name under which an upload is saved; only PDF names are accepted."""
    if not file_name.lower().endswith(".pdf"):
        raise ValueError(f"only PDF files are accepted, not {file_name!r}")
    return file_name


def as_jobs(files: DataFrame) -> DataFrame:
    return files.select(F.sha1("path").alias("job_id"), "path", "content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files (only ``*.pdf``) as job_id, path, content."""
    return as_jobs(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path))


def extract_pages(files: DataFrame, extractor: type[PageExtractor] = FailingExtractor) -> DataFrame:
    """Page rows of files; the extractor runs in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = extractor()
        names = [c.split(" ")[0] for c in ("job_id s", "page_index s", "width s", "height s", "text s", "items s", "images s", "drawings s", "tables s")]
        for b in batches:
            rows = []
            for job, data in zip(b["job_id"], b["content"]):
                try:
                    rows += e.pages(job, bytes(data))
                except Exception as x:
                    raise ValueError(f"Failed to open PDF: {x}") from x  # fixed text
            yield pd.DataFrame(rows, columns=names)

    return files.select("job_id", "content").mapInPandas(run, PAGE_SCHEMA)


class CropRenderer(ABC):
    """Draws a box of a page as PNG bytes; made once in each Python worker."""

    @abstractmethod
    def crop(self, job_id: str, page_index: int, bbox: list[float], scale: float) -> bytes: ...


def render_crops(marked: DataFrame, factory: Callable[[], CropRenderer]) -> DataFrame:
    """Blocks with the marks of the vision queue -> crop_path, content of each candidate."""
    m = F.col("metadata")
    todo = marked.where(m["crop_path"].isNotNull()).select("job_id", "page_index", m["crop_path"].alias("crop_path"), m["crop_bbox"].alias("bbox"), m["crop_scale"].alias("scale"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = factory()
        for b in batches:
            yield pd.DataFrame({"crop_path": b["crop_path"], "content": [renderer.crop(j, int(p), [float(v) for v in x], float(s)) for j, p, x, s in zip(b["job_id"], b["page_index"], b["bbox"], b["scale"])]})

    return todo.mapInPandas(run, "crop_path string, content binary")


def pages_of_documents(documents: DataFrame) -> DataFrame:
    """A geometry table derived from plain texts: a page is every 40 lines, an item a line,
    and image figures follow the id, so that all routes occur."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    n = LINES_PER_PAGE
    pages = documents.select(
        F.col("doc_id").cast("string").alias("job_id"), F.col("doc_id").alias("_id"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / n).cast("int")), lambda p: F.slice(lines, p * n + 1, F.lit(n)))).alias("page_index", "_lines"),
    )
    items = F.transform("_lines", lambda x, i: F.struct(F.array(F.lit(50.0), 60.0 + 18 * i, 50.0 + 6 * F.length(x), 72.0 + 18 * i).alias("bbox"), x.alias("text")))
    xrefs = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, F.pmod("_id", F.lit(4)).cast("int"))
    images = F.transform(xrefs, lambda x: F.struct(x.alias("xref"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("bbox")))
    out = pages.withColumns({"width": F.lit(595.0), "height": F.lit(842.0), "text": F.array_join("_lines", "\n"), "items": items, "images": images})
    out = out.withColumns({"drawings": F.array().cast("array<struct<bbox:array<double>>>"), "tables": F.array().cast("array<struct<bbox:array<double>,rows:array<array<string>>>>")})
    return out.select("job_id", "page_index", "width", "height", "text", "items", "images", "drawings", "tables")
