"""Geometry on boxes ``array<double>`` [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config


def rounded(x: Column, places: int = 2) -> Column:
    """``x`` rounded by its exact binary value, ties to even. The error of the scaled product
    is found by splitting the factors, so that no value near a tie goes the wrong way."""
    scale = float(10**places)
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    near = F.rint(product)
    off = product - near
    step = F.when((off > 0.5) | ((off == 0.5) & (error > 0)), 1.0).when((off < -0.5) | ((off == -0.5) & (error < 0)), -1.0).otherwise(0.0)
    return (near + step) / scale


def rounded_box(b: Column) -> Column:
    """A box to two places; null stays null."""
    return F.transform(b, lambda x: rounded(x))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[c.cast("double") for c in (x0, y0, x1, y1)])


def width(b: Column) -> Column:
    return b[2] - b[0]


def height(b: Column) -> Column:
    return b[3] - b[1]


def union_of(boxes: Column) -> Column:
    """Union of an array of boxes; null for none."""
    pick = lambda i: F.transform(boxes, lambda b: b[i])
    return F.when(F.size(boxes) > 0, F.array(F.array_min(pick(0)), F.array_min(pick(1)), F.array_max(pick(2)), F.array_max(pick(3))))


def union_agg(b: Column) -> Column:
    """Union of the boxes of a group."""
    return F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3]))


def overlap_ratio(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` (area at least 1) that ``outer`` covers."""
    w = F.least(inner[2], outer[2]) - F.greatest(inner[0], outer[0])
    h = F.least(inner[3], outer[3]) - F.greatest(inner[1], outer[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h) / F.greatest(F.lit(1.0), width(inner) * height(inner))


def image_area_ratio(boxes: Column, page_width: Column, page_height: Column) -> Column:
    """Summed image area over page area, at most 1; overlaps count twice."""
    area = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + F.greatest(F.lit(0.0), width(b) * height(b)))
    return F.least(F.lit(1.0), area / F.greatest(F.lit(1.0), page_width * page_height))


def crop(b: Column, padding: Column, page_width: Column, page_height: Column) -> Column:
    """A box padded on all sides and clipped to the page."""
    zero = F.lit(0.0)
    return F.array(F.greatest(zero, b[0] - padding), F.greatest(zero, b[1] - padding), F.least(page_width, b[2] + padding), F.least(page_height, b[3] + padding))


def vector_region(drawings: Column, page_width: Column, page_height: Column, threshold: Column) -> Column:
    """Union of the drawings of at least 4 x 4 points, if there are ``threshold`` of them,
    clipped to the page; null when too few or empty."""
    large = F.filter(drawings, lambda b: (width(b) >= 4) & (height(b) >= 4))
    u = union_of(large)
    zero = F.lit(0.0)
    clipped = F.array(F.greatest(zero, u[0]), F.greatest(zero, u[1]), F.least(page_width, u[2]), F.least(page_height, u[3]))
    enough = (threshold > 0) & (F.size(large) >= threshold) & (F.size(large) > 0)
    return F.when(enough & (width(clipped) > 0) & (height(clipped) > 0), clipped)


def caption_bounds(caption: Column, page_width: Column, config: Config = DEFAULT) -> Column:
    """Horizontal reach of a caption: the page for a wide one, else the caption padded."""
    w = F.greatest(F.lit(1.0), page_width)
    wide = F.greatest(F.lit(1.0), width(caption)) / w >= config.full_width_ratio
    narrow = F.struct(F.greatest(F.lit(0.0), caption[0] - config.x_padding).alias("x0"), F.least(page_width, caption[2] + config.x_padding).alias("x1"))
    return F.when(wide, F.struct(F.lit(0.0).alias("x0"), page_width.alias("x1"))).otherwise(narrow)


def horizontally_related(b: Column, x0: Column, x1: Column, config: Config = DEFAULT) -> Column:
    shared = F.greatest(F.lit(0.0), F.least(b[2], x1) - F.greatest(b[0], x0))
    return shared / F.greatest(F.lit(1.0), width(b)) >= config.min_x_overlap


def downscaled(w: Column, h: Column, limit: Column) -> Column:
    """Target size of an image no wider than ``limit`` (null or 0: unlimited)."""
    shrink = F.coalesce((limit > 0) & (w > limit), F.lit(False))
    new_h = F.greatest(F.lit(1), F.bround(h * limit / w).cast("int"))
    return F.struct(F.when(shrink, limit).otherwise(w).alias("width"), F.when(shrink, new_h).otherwise(h).alias("height"))
