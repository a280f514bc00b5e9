"""Every threshold of the engine, passed explicitly; nothing reads the environment."""

from __future__ import annotations

from dataclasses import dataclass

#: The accepted spellings of the mode settings.
OFF_MODES = ("0", "false", "no", "off", "none", "disabled")
ON_MODES = ("1", "true", "yes", "on", "all", "full")
IMAGE_ALL_MODES = ("1", "true", "yes", "on")
IMAGE_NONE_MODES = ("0", "false", "no", "off", "asset", "asset-only")
UNCAPTIONED_MODES = ("complex_uncaptioned", "complex-uncaptioned", "uncaptioned", "no-caption")
OCR_MODES = ("auto", "tesseract", "ocr", "hybrid", "hybrid_ocr")
DEFER_MODES = ("defer", "deferred", "async", "candidate", "candidates", "vlm")


@dataclass(frozen=True)
class Config:
    # fixed values: the defaults of all thresholds
    # routing
    dense_chars: int = 500
    dense_ratio: float = 0.20
    moderate_chars: int = 220
    moderate_ratio: float = 0.35
    moderate_images: int = 2
    scan_ratio: float = 0.35
    scan_chars: int = 80
    # blocks
    chunk_chars: int = 1800
    chunk_floor: int = 200
    native_table_mode: str = "auto"
    overlap_drop: float = 0.75
    drawing_threshold: int = 40
    figure_drawing_threshold: int = 3
    # caption clusters
    queue_mode: str = "all"
    above_gap: float = 18.0
    below_gap: float = 24.0
    first_gap: float = 64.0
    lookback: float = 220.0
    full_width_ratio: float = 0.55
    x_padding: float = 24.0
    min_x_overlap: float = 0.25
    complex_blocks: int = 5
    complex_chars: int = 700
    # tasks
    image_mode: str = "none"
    table_padding: float = 40.0
    table_scale: float = 4.0
    image_padding: float = 8.0
    image_scale: float = 2.0
    table_width: int = 640
    complex_table_width: int = 768
    complex_rows: int = 8
    complex_columns: int = 6
    complex_text: int = 900
    complex_lines: int = 10
    complex_area: float = 0.0
    page_width: int | None = None
    worker_table_width: int = 1024
    worker_default_width: int | None = None
    # OCR
    ocr_mode: str = "auto"
    ocr_min_confidence: float = 20.0
    ocr_min_chars: int = 80
    ocr_line_gap: float = 30.0
    ocr_lookahead: int = 8
    # embeddings
    embedding_dim: int = 32


DEFAULT = Config()


def native_tables(mode: str) -> str:
    """off, defer, on or auto."""
    m = mode.strip().lower()
    return "off" if m in OFF_MODES else "defer" if m in DEFER_MODES else "on" if m in ON_MODES else "auto"


def image_mode(mode: str | None) -> str:
    """all, none or the literal lower-cased mode; unset means none."""
    m = "none" if mode is None else mode.strip().lower()
    return "all" if m in IMAGE_ALL_MODES else "none" if m in IMAGE_NONE_MODES else m


def scan_ocr_enabled(mode: str) -> bool:
    return mode.strip().lower() not in (*OFF_MODES, "page_vlm")
