"""Nested tables ``array<array<string>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cell_lines, clean_cell, escape_cell


def _count(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def widest(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def pad(rows: Column) -> Column:
    n = widest(rows)
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), (n - F.size(r)).cast("int"))))


def normalise(raw: Column) -> Column:
    """Cells cleaned, empty rows dropped, rows padded, empty columns dropped."""
    cells = F.transform(raw, lambda r: F.transform(r, clean_cell))
    rows = pad(F.filter(cells, lambda r: F.exists(r, lambda c: c != "")))
    used = F.filter(_count(widest(rows)), lambda i: F.exists(rows, lambda r: F.get(r, i) != ""))
    return F.transform(rows, lambda r: F.transform(used, lambda i: F.get(r, i)))


def is_usable(rows: Column) -> Column:
    """Two rows and columns, four filled cells, 45 % filled, a header, and no iteration log."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.trim(c) != ""))
    text = F.lower(F.array_join(cells, " "))
    log = text.contains("iter.") & text.contains("error") & text.contains("%")
    head = F.exists(F.coalesce(F.get(rows, 0), F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    size = F.size(rows) * widest(rows)
    return (F.size(rows) >= 2) & (widest(rows) >= 2) & (filled >= 4) & (filled / F.greatest(size, F.lit(1)) >= 0.45) & head & ~log


def expand_row(row: Column) -> Column:
    """One row per cell line where every cell has one line or as many as the longest."""
    parts = F.transform(row, cell_lines)
    target = F.coalesce(F.array_max(F.transform(parts, lambda p: F.size(p))), F.lit(1))
    fits = F.forall(parts, lambda p: (F.size(p) == 1) | (F.size(p) == target))
    each = F.transform(_count(target), lambda i: F.transform(parts, lambda p: F.when(F.size(p) > 1, F.get(p, i)).otherwise(F.get(p, F.lit(0)))))
    return F.when((target > 1) & fits, each).otherwise(F.array(row))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def to_markdown(rows: Column) -> Column:
    """A pipe table: the first row as header, body rows with several lines expanded."""
    full = pad(rows)
    escape = lambda r: F.transform(r, escape_cell)
    body = F.flatten(F.transform(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), expand_row))
    rule = F.transform(F.get(full, 0), lambda c: F.lit("---"))
    all_lines = F.concat(F.array(_line(escape(F.get(full, 0))), _line(rule)), F.transform(body, lambda r: _line(escape(r))))
    return F.when((F.size(rows) > 0) & (widest(rows) > 0), F.array_join(all_lines, "\n")).otherwise("")
