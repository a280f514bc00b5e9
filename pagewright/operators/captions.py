"""Tables deferred to the vision queue: blocks of text that belong to a table caption.

A strict caption collects text above it, else below it: items that overlap its reach
are taken outwards while the gap to the last one taken stays small. All of it is array
work inside a page, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, OFF_MODES, ON_MODES, Config, native_tables
from pagewright.functions import geometry as G
from pagewright.functions import text as T


def cluster(items: Column, caption: Column, page_width: Column, above: bool, config: Config = DEFAULT) -> Column:
    """Items (bbox, text, pos; text as extracted) of the run next to a caption, in reading order."""
    reach = G.caption_bounds(caption["bbox"], page_width, config)
    far = lambda b: caption["bbox"][1] - b[3] if above else b[1] - caption["bbox"][3]
    pool = F.filter(
        items,
        lambda i: (i["pos"] != caption["pos"]) & G.horizontally_related(i["bbox"], reach["x0"], reach["x1"], config) & (far(i["bbox"]) >= 0) & (far(i["bbox"]) <= config.lookback),
    )
    sign = -1.0 if above else 1.0
    edge = 3 if above else 1
    order = F.array_sort(F.transform(pool, lambda i: F.struct((i["bbox"][edge] * sign).alias("d"), (i["bbox"][0] * sign).alias("x"), i["pos"].alias("pos"), i["bbox"].alias("bbox"), i["text"].alias("text"))))
    limit = config.above_gap if above else config.below_gap
    taken = F.slice(F.transform(order, lambda o: F.struct(o["bbox"].alias("bbox"), o["text"].alias("text"), o["pos"].alias("pos"))), 1, 0)
    start = F.struct(taken.alias("taken"), (caption["bbox"][1] if above else caption["bbox"][3]).alias("edge"), F.lit(True).alias("open"))

    def step(acc: Column, o: Column) -> Column:
        gap = acc["edge"] - o["bbox"][3] if above else o["bbox"][1] - acc["edge"]
        most = F.when(F.size(acc["taken"]) == 0, F.lit(config.first_gap)).otherwise(F.lit(limit))
        more = acc["open"] & (gap <= most)
        item = F.struct(o["bbox"].alias("bbox"), o["text"].alias("text"), o["pos"].alias("pos"))
        return F.struct(
            F.when(more, F.concat(acc["taken"], F.array(item))).otherwise(acc["taken"]).alias("taken"),
            F.when(more, o["bbox"][1] if above else o["bbox"][3]).otherwise(acc["edge"]).alias("edge"),
            more.alias("open"),
        )

    run = F.aggregate(order, start, step, lambda acc: acc["taken"])
    by = F.array_sort(F.transform(run, lambda i: F.struct(i["bbox"][1].alias("y"), i["bbox"][0].alias("x"), i["pos"].alias("pos"), i["bbox"].alias("bbox"), i["text"].alias("text"))))
    return F.transform(by, lambda i: F.struct(i["bbox"].alias("bbox"), i["text"].alias("text"), i["pos"].alias("pos")))


def queue_gate(run: Column, caption: Column, config: Config = DEFAULT) -> Column:
    """Whether a cluster is worth a vision task."""
    mode = config.queue_mode.strip().lower()
    if mode in (*OFF_MODES, "text"):
        return F.lit(False)
    if mode in ("all", *ON_MODES[:4]):
        return F.lit(True)
    raw = F.array_join(F.concat(F.transform(run, lambda i: i["text"]), F.array(caption["text"])), "\n")
    long_table = (F.length(T.clean(raw)) >= config.complex_chars) & T.looks_like_table(raw)
    return T.needs_vision(raw) | (F.size(run) >= config.complex_blocks) | long_table


def keep_first(tables: Column, ratio: float = 0.75) -> Column:
    """Tables in reading order, each dropped that an earlier kept one covers."""
    order = F.array_sort(F.transform(tables, lambda t, p: F.struct(t["bbox"][1].alias("y"), t["bbox"][0].alias("x"), p.alias("p"), t.alias("t"))))
    none = F.slice(tables, 1, 0)
    return F.aggregate(order, none, lambda kept, o: F.when(F.exists(kept, lambda k: G.overlap_ratio(o["t"]["bbox"], k["bbox"]) >= ratio), kept).otherwise(F.concat(kept, F.array(o["t"]))))


def deferred_tables(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds ``_deferred`` (bbox, text, caption) to pages with ``_items`` (bbox, raw, pos)."""
    empty = F.array().cast("array<struct<bbox:array<double>,text:string,caption:string>>")
    if native_tables(config.native_table_mode) != "defer":
        return pages.withColumn("_deferred", empty)
    items = F.transform("_items", lambda i: F.struct(i["bbox"].alias("bbox"), i["raw"].alias("text"), i["pos"].alias("pos")))
    captions = F.filter(items, lambda i: T.is_strict_table_caption(i["text"]))

    def table(caption: Column, run: Column) -> Column:
        parts = F.concat(run, F.array(F.struct(caption["bbox"].alias("bbox"), caption["text"].alias("text"), caption["pos"].alias("pos"))))
        # ties of place keep the order of the run, the caption last
        order = F.array_sort(F.transform(parts, lambda i, p: F.struct(i["bbox"][1].alias("y"), i["bbox"][0].alias("x"), p.alias("p"), i["text"].alias("text"))))
        text = T.clean_lines(F.array_join(F.transform(order, lambda o: o["text"]), "\n"))
        made = F.struct(G.rounded_box(G.union_of(F.transform(parts, lambda i: i["bbox"]))).alias("bbox"), text.alias("text"), T.clean(caption["text"]).alias("caption"))
        return F.when((F.size(run) > 0) & queue_gate(run, caption, config) & (text != ""), made)

    def near(caption: Column) -> Column:
        """The run above a caption, or else the one below it."""
        both = F.struct(*[cluster(items, caption, F.col("width"), x, config).alias(n) for x, n in ((True, "above"), (False, "below"))])
        return F.element_at(F.transform(F.array(both), lambda b: F.when(F.size(b["above"]) > 0, b["above"]).otherwise(b["below"])), 1)

    found = F.transform(F.transform(captions, lambda c: F.struct(c.alias("c"), near(c).alias("run"))), lambda x: table(x["c"], x["run"]))
    none = F.size("_native") == 0  # tables are deferred only where none was found
    return pages.withColumn("_deferred", F.when(none, keep_first(F.filter(found, lambda t: t.isNotNull()), config.overlap_drop)).otherwise(empty))
