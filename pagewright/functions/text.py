"""Text functions and predicates as Column -> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config, native_tables

#: White space as Unicode sees it, with the four separator controls: an explicit class, which the
#: matcher tests faster than a property.
SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Line ends: LF CR CRLF VT FF FS GS RS NEL LS PS.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Fixed patterns of captions and table-like rows. Three gaps are enough to find a row; asking
#: for more would make the matcher recurse over a long line.
TABLE_ROW = r"(?U)\S+(?:[^\S\r\n]{2,}\S+){3}"
TABLE_CAPTION = r"(?iU)(^|\n)\s*Table\s+\d+[.:]?"
TABLE_CAPTION_START = r"(?iU)^\s*Table\s+\d+\s*[.:]"
FIGURE_CAPTION = r"(?iU)(^|\n)\s*(Figure|Fig\.)\s+\d+[.:]?"
CAPTION_ID = r"(?iU)\b(Table|Fig(?:ure)?\.?)\s*(\d+)\s*[.:]"
NOISE = "[\\x00-\\x08\\x0b-\\x1f]|[\\uf000-\\uf8ff]|\\d+\\s+\\d+×\\s*×\\d+|×\\s*×|,,"
#: Glyphs that table cells drop.
CELL_JUNK = "\x14\uf8ee\uf8ef"


def clean(x: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), SPACE, " "))


def lines(x: Column) -> Column:
    """The lines of a text; a closing line end gives no empty line, an empty text none. The
    closing end goes first, so that the text is split once."""
    rare = x.rlike("[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    open_ = F.when(rare, F.regexp_replace(x, f"(?:{LINE_END})\\z", "")).when(x.endswith("\n"), F.left(x, F.length(x) - 1)).otherwise(x)
    parts = F.when(rare, F.split(open_, LINE_END)).otherwise(F.split(open_, "\n"))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(parts)


def _tidy_lines(x: Column) -> Column:
    """Each line cleaned, blank lines dropped; without lambdas, so that it nests cheaply."""
    one = F.regexp_replace(F.coalesce(x, F.lit("")), LINE_END, "\n")
    one = F.regexp_replace(one, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    one = F.regexp_replace(one, r" *\n[ \n]*", "\n")
    return F.regexp_replace(one, r"^[ \n]+|[ \n]+$", "")


def clean_lines(x: Column) -> Column:
    """Each line cleaned, blank lines dropped."""
    return _tidy_lines(x)


def clean_cell(x: Column) -> Column:
    """Junk glyphs gone, CR as LF, each line cleaned, blank lines dropped."""
    return _tidy_lines(F.translate(F.coalesce(x, F.lit("")), CELL_JUNK, ""))


def cell_lines(x: Column) -> Column:
    """Cleaned non-blank lines of a cell, at least one (empty) line."""
    return F.split(_tidy_lines(x), "\n")


def escape_cell(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def escape_inline_cell(x: Column) -> Column:
    return F.replace(clean(x), F.lit("|"), F.lit("\\|"))


def escape_yaml(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def item_text(item: dict[str, Column]) -> Column:
    """First non-empty cleaned field in the order of page content items."""
    keys = ("text", "content", "html", "latex", "caption", "markdown")
    return F.coalesce(*[F.nullif(clean(item[k]), F.lit("")) for k in keys if k in item], F.lit(""))


def item_markdown(item: dict[str, Column]) -> Column:
    """First non-blank field, stripped, in the order of worker results."""
    keys = ("markdown", "content", "text", "html", "latex")
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.coalesce(*[F.nullif(strip(item[k]), F.lit("")) for k in keys if k in item], F.lit(""))


def looks_like_table(x: Column) -> Column:
    """A line with two tabs, or two lines of four or more widely spaced tokens. Plain
    scans for a tab and for a double space come first and spare most texts the rest."""
    t = F.coalesce(x, F.lit(""))
    tabs = t.contains("\t") & F.exists(lines(t), lambda r: (F.length(r) - F.length(F.replace(r, F.lit("\t"), F.lit(""))) >= 2) & r.rlike(r"(?U)[^\s\x1c-\x1f]"))
    wide = t.rlike(r"(?U)[^\S\r\n]{2}") & (F.size(F.filter(lines(t), lambda r: r.rlike(TABLE_ROW))) >= 2)
    return tabs | wide


def has_table_caption(x: Column) -> Column:
    return x.rlike(TABLE_CAPTION)


def is_strict_table_caption(x: Column) -> Column:
    return x.rlike(TABLE_CAPTION_START)


def has_figure_caption(x: Column) -> Column:
    return x.rlike(FIGURE_CAPTION)


def needs_vision(markdown: Column) -> Column:
    """Signs of a badly read table: controls, private-use glyphs, doubled times signs or commas."""
    return F.coalesce(markdown, F.lit("")).rlike(NOISE)


def caption_ids(x: Column) -> Column:
    """Distinct (label, number) of the captions named in a text."""
    labels = F.regexp_extract_all(x, F.lit(CAPTION_ID), F.lit(1))
    numbers = F.regexp_extract_all(x, F.lit(CAPTION_ID), F.lit(2))
    ids = F.zip_with(labels, numbers, lambda a, b: F.struct(F.when(F.lower(a).startswith("fig"), "figure").otherwise("table").alias("label"), b.cast("long").alias("number")))
    return F.array_distinct(ids)


def html_span(attributes: Column, name: str) -> Column:
    found = F.regexp_extract(attributes, rf"(?i){name}\s*=\s*[\"']?(\d+)", 1)
    return F.greatest(F.lit(1), F.coalesce(F.nullif(found, F.lit("")).try_cast("int"), F.lit(1)))


def positive_int(x: Column) -> Column:
    """A positive whole number, else null."""
    n = x.try_cast("int")
    return F.when(n > 0, n)


def truncate(x: Column, n: int = 4000) -> Column:
    return F.substring(x, 1, n)


def extract_native_tables(text: Column, reason: Column, config: Config = DEFAULT) -> Column:
    """Whether a page's tables are worth finding."""
    mode = native_tables(config.native_table_mode)
    if mode != "auto":
        return F.lit(mode == "on")
    return reason.contains("table_candidate") | has_table_caption(text) | looks_like_table(text)


def header_tokens(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Tokens of a header line with the given neighbouring pairs merged, left to right."""
    known = F.array(*[F.lit(f"{a} {b}") for a, b in pairs])
    tokens = F.filter(F.split(clean(x), " "), lambda t: t != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("merged"))

    def step(acc: Column, token: Column) -> Column:
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        pair = F.concat(last, F.lit(" "), token)
        join = F.coalesce(~acc["merged"] & F.array_contains(known, F.lower(pair)), F.lit(False))
        out = F.when(join, F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(pair))).otherwise(F.concat(acc["out"], F.array(token)))
        return F.struct(out.alias("out"), join.alias("merged"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def descriptor_cells(x: Column, width: int) -> Column:
    """Descriptor columns of an inline row: rank and label where the text starts with a rank."""
    if width <= 1:
        return F.array(x)
    rank = r"^(?:\.\.\.\s*)?(\d+)\.\s+(.+)$"
    fill = [F.lit("")] * (width - 2)
    return F.when(x.rlike(rank), F.array(F.regexp_extract(x, rank, 1), F.regexp_extract(x, rank, 2), *fill)).otherwise(F.array(F.lit(""), x, *fill))
