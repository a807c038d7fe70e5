import pytest
from pyspark.sql import functions as F

from pagequarry.functions import numeric as num
from pagequarry.functions import text as tx
from pagequarry.operators import blocks, evidence, grids
from pagequarry.sources.selection import page_numbers, selected


def test_selection(spark):
    assert page_numbers("3-1,2", 5) == [2, 1, 0]
    with pytest.raises(IndexError):
        page_numbers("0", 5)
    with pytest.raises(ValueError):
        page_numbers("", 5)
    rows = selected(spark.range(5).withColumnRenamed("id", "page_index"), "3-1,2", 5).orderBy("place").collect()
    assert [r.page_index for r in rows] == [2, 1, 0]


def test_components_cross(spark):
    rows = [(1, "h", 0.0, 10.0, 50.0, 10.0), (1, "h", 0.0, 30.0, 50.0, 30.0), (1, "v", 5.0, 10.0, 5.0, 30.0), (1, "h", 80.0, 10.0, 90.0, 10.0), (2, "v", 0.0, 0.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "page int, orientation string, x0 double, top double, x1 double, bottom double")
    got = {(r.page, r.x0, r.top): r.component for r in grids.grid_components(df, ["page"]).collect()}
    assert got[1, 0.0, 10.0] == got[1, 0.0, 30.0] == got[1, 5.0, 10.0] != got[1, 80.0, 10.0]
    assert got[2, 0.0, 0.0] == 0


def test_word_columns(spark):
    rows = [(1, 0.0, 20.0 + i) for i in range(3)] + [(1, 60.0, 90.0 - i) for i in range(3)] + [(2, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "page int, x0 double, x1 double")
    got = [(r.page, r.x) for r in grids.word_columns(df, ["page"]).orderBy("page", "x").collect()]
    assert got == [(1, 0.0), (1, 60.0), (1, 90.0)]


def test_merged_cells_must_be_rectangles(spark):
    cells = spark.createDataFrame([(1, r, c) for r in range(2) for c in range(2)], "t int, row long, col long")
    closed = spark.createDataFrame([(1, 0, 1, "below"), (1, 1, 0, "right")], "t int, row long, col long, side string")
    assert {(r.rowspan, r.colspan) for r in grids.merge_cells(cells, closed, ["t"]).collect()} == {(1, 1)}
    none = closed.where("t = 2")
    assert [(r.row, r.col, r.rowspan, r.colspan) for r in grids.merge_cells(cells, none, ["t"]).collect()] == [(0, 0, 2, 2)]


def test_repeated_tables(spark):
    rows = [(1, 1, "a b c", 0.0, 0.0, 10.0, 10.0), (1, 2, "a b", 0.0, 0.0, 10.0, 9.0), (1, 3, "a x", 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "page int, table_id int, text string, x0 double, top double, x1 double, bottom double")
    assert sorted(r.table_id for r in grids.without_repeats(df, ["page"]).collect()) == [1, 3]


def test_tripled_glyphs_compare_with_the_last_kept(spark):
    rows = [(1, i, "a", x, x + 6, 0.0) for i, x in enumerate((0.0, 1.5, 3.0))]
    df = spark.createDataFrame(rows, "line int, seqno int, text string, x0 double, x1 double, top double")
    assert evidence.without_doubled(df, ["line"]).first().text == "aa"


def test_layers_by_state(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, layer string")
    layers = spark.createDataFrame([("a", "on"), ("b", "off")], "layer string, listed string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(evidence.visible_layers(items, "layer", layers)) == [1, 3]
    assert ids(evidence.visible_layers(items, "layer", layers.where("listed = 'off'"), base_off=True)) == [3]


def test_parents_and_fixed_width(spark):
    rows = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, None), (1, 3, 2), (1, 4, 1), (1, 5, None)], "d int, o int, k int")
    got = blocks.parents(rows, ["d"], "o", F.col("k"), 2, "o").orderBy("o").collect()
    assert [r.parent_id for r in got] == [None, 0, 1, 0, None, 4]
    words = spark.createDataFrame([(1, 0, 12.0, 1, "ab"), (1, 0, 18.0, 2, "c"), (1, 2, 0.0, 3, "d")], "p int, ln int, x0 double, seqno int, text string")
    assert blocks.fixed_width(words, ["p"], 6.0).first().text == "  ab c\n\nd"


def test_text_functions(spark):
    df = spark.createDataFrame([("a1b22 3", "שלום abc", "Page 3 of 9", "the cat and the dog of it")], "a string, b string, c string, d string")
    one = df.select(tx.find_all(F.col("a"), "[0-9]+").alias("m"), tx.right_to_left(F.col("b")).alias("rtl"), tx.page_footer(F.col("c")).alias("f"), tx.language(F.col("d")).alias("l"), tx.markdown_block(F.lit("heading"), F.col("c"), F.lit(9)).alias("h"), tx.innocuous(F.lit("The, a"), ["the", "a"]).alias("ok")).first()
    assert [(m.start, m.end, m.text) for m in one.m] == [(1, 2, "1"), (3, 5, "22"), (6, 7, "3")]
    assert one.rtl and one.f and one.l == "eng" and one.h == "###### Page 3 of 9" and one.ok


def test_colour_blends_keep_luminosity(spark):
    b, s = [F.lit(v) for v in (0.9, 0.2, 0.1)], [F.lit(v) for v in (0.1, 0.6, 0.3)]
    for mode in ("Hue", "Saturation", "Color"):
        r = spark.range(1).select(num.luminosity(*num.blend_colour(mode, b, s)).alias("l"), num.luminosity(*b).alias("m")).first()
        assert r.l == pytest.approx(r.m)
