"""Page ranges, text strings, glyph names, CSV columns and page-wide cells on small cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import glyphs
from pagequarry.operators import tables
from pagequarry.sources import reports
from pagequarry.sources.objects import words
from pagequarry.sources.selection import page_range


def test_page_range_as_a_slice(spark):
    parts = ["", "-4", "-1", "0", "2", "9"]
    specs = [":".join(p) for p in itertools.product(parts, parts, ["", "-2", "1"])] + [f"{a}:{b}" for a in parts for b in parts]
    rows = [(s, n) for s in specs for n in (0, 1, 3, 5)]
    got = spark.createDataFrame(rows, "s string, n int").select("s", "n", page_range(F.col("s"), F.col("n")).alias("p")).collect()
    for r in got:
        cut = slice(*[int(x) if x else None for x in r.s.split(":")])
        assert r.p == list(range(*cut.indices(r.n))), r
    odd = spark.createDataFrame([("", 3), ("a", 3), ("::0", 3), ("-", 3), ("1:-", 3), (None, 3), ("-1", 3), ("2", 3), ("7", 3)], "s string, n int")
    assert [r.p for r in odd.select(page_range(F.col("s"), F.col("n")).alias("p")).collect()] == [None] * 6 + [[2], [2], []]


def test_strings_and_glyph_names(spark):
    data = [(b"\xfe\xff\x00A\x20\x26",), (b"\xef\xbb\xbf\xc3\xa9",), (b"a\x80\xa0\x1f",), (b"a\x9f",), (b"",), (None,)]
    assert [r.t for r in spark.createDataFrame(data, "d binary").select(glyphs.text_string(F.col("d")).alias("t")).collect()] == ["A…", "é", "a•€˜", None, "", None]
    names = [("uni00410042",), ("u1F600.alt",), ("A_uni0042",), ("uni004",), ("u110000",), (None,)]
    assert [r.t for r in spark.createDataFrame(names, "n string").select(glyphs.glyph_text(F.col("n"), {"A": "A"}).alias("t")).collect()] == ["AB", "😀", "AB", None, None, None]


def test_csv_columns():
    assert reports.kept_columns(["zone", "x0", "top", "object_type", "abc"]) == ["object_type", "x0", "top", "abc", "zone"]
    assert reports.kept_columns(["zone", "x0"], include=["zone"]) == ["object_type", "zone"]
    with pytest.raises(ValueError):
        reports.kept_columns(["a"], include=[], exclude=[])
    with pytest.raises(ValueError):
        reports.kept_columns(["a"], exclude=["object_type"])


def test_words_of_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, " \n\n  a  bc \n"), (4, "\n" * 12 + "x " * 3000)]
    got = words(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "page_index", "seqno").collect()
    assert [(r.doc_id, r.ln, r.wi, r.text, r.x0, r.x1) for r in got[:2]] == [(3, 2, 0, "a", 0.0, 6.0), (3, 2, 1, "bc", 12.0, 24.0)]
    last = [r for r in got if r.doc_id == 4]
    assert [r.seqno for r in last] == list(range(1, 3001)) and {r.page_index for r in last} == {1}
    assert [r.x0 for r in last] == [12.0 * i for i in range(3000)] and {r.doctop for r in last} == {144.0}


def test_a_cell_past_a_missing_corner(spark):
    """The lower rule has a further crossing, of an upright that ends there, between the corners."""
    h = spark.createDataFrame([(1, 0.0, 20.0, 0.0), (1, 0.0, 20.0, 10.0)], "k int, x0 double, x1 double, top double")
    v = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (1, 20.0, 0.0, 10.0), (1, 10.0, 10.0, 30.0)], "k int, x double, v0 double, v1 double")
    got = tables.lattice_cells(tables.crossings(h, v, ["k"]), ["k"]).collect()
    assert [(r.x0, r.top, r.x1, r.bottom) for r in got] == [(0.0, 0.0, 20.0, 10.0)]
