"""Trees, fields, annotations, rows, titles, candidates and outcomes on small odd cases."""

import math

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as tx
from pagequarry.operators import graph, records
from pagequarry.sources import reports

NODES = "id long, parent long, ord long, role string, entries array<string>"


def test_tree_items_leave_out_broken_entries(spark):
    rows = [(1, None, 0, "Root", None), (2, 1, 1, "Sect", ["7", "b", "x", "c", "9"]), (3, 1, 0, "Sect", [None, "d", "8", None]), (4, 2, 0, "P", []), (5, 6, 0, "P", ["1", "e"]), (6, 5, 0, "P", None)]
    nodes = spark.createDataFrame(rows, NODES)
    got = records.tree_items(nodes).orderBy("path", "place").collect()
    assert [(r.path, r.place, r.key, r.value) for r in got] == [([0, 0], 1, "8", None), ([0, 1], 0, "7", "b"), ([0, 1], 1, "x", "c")]
    assert [(r.key, r.value) for r in records.tree_items(nodes, numbers=True).orderBy("key").collect()] == [(7, "b"), (8, None)]
    assert [r.id for r in records.find_all(nodes, role="Sect").orderBy("path").collect()] == [3, 2]
    assert [r.id for r in records.find_all(nodes).orderBy("path").collect()] == [1, 3, 2, 4]
    with pytest.raises(ValueError):
        records.find_all(nodes, "P", "P")
    assert records.tree_items(nodes.where("id < 0")).count() == 0


def test_fields_inherit(spark):
    nodes = spark.createDataFrame([(1, None, "a", "Tx", None), (2, 1, None, None, 3), (3, 2, "c", "Btn", None)], "id long, parent long, name string, kind string, quadding int")
    got = {r.id: (r.name, r.kind, r.quadding) for r in records.inherit_down(nodes, ["kind", "quadding"], "name").collect()}
    assert got == {1: ("a", "Tx", None), 2: ("a", "Tx", 3), 3: ("a.c", "Btn", 3)}
    with pytest.raises(RecursionError):
        records.inherit_down(nodes, ["kind"], "name", limit=1)


def test_annotations_link_to_the_first_of_an_object(spark):
    rows = [(1, 0, "a", "Text", None, None, "p"), (1, 1, "p", "Popup", None, None, "a"), (1, 2, "a", "Text", "a", "R", None), (1, 3, "b", "Text", "a", "Group", "z"), (2, 0, "c", None, "a", "R", "c")]
    annots = spark.createDataFrame(rows, "page int, i int, object string, subtype string, reply_to string, reply_type string, target string")
    got = {(r.page, r.i): (r.in_reply_to, r.reply_type, r.popup, r.popup_parent) for r in records.link_annotations(annots, ["page"], "i").collect()}
    assert got == {(1, 0): (None, None, 1, None), (1, 1): (None, None, None, 0), (1, 2): (None,) * 4, (1, 3): (0, "Group", None, None), (2, 0): (None,) * 4}


def test_rows_that_a_line_repeats(spark):
    box = lambda r, c: (c * 30.0, c * 30 + 20.0, r * 12.0, r * 12 + 10.0)
    kind = "k int, table int, row long, col int, row_span int, text string, x0 double, x1 double, top double, bottom double"
    rows = [(1, 0, r, c, 3 if r == 1 else 1, f" a{r}  {c}", *box(r, c)) for r in (1, 2, 3, 5) for c in (0, 1)]
    rows += [(1, 1, 0, 0, 1, "a2 0 a2 1", None, None, None, None), (1, 1, 1, 0, 1, "", 0.0, 50.0, 24.0, 34.0), (1, 1, 2, 0, 1, None, 0.0, 50.0, 24.0, 34.0)]
    lines = spark.createDataFrame([(1, 0.0, 50.0, 24.0, 34.0, "a2 0  a2 1"), (1, 0.0, 50.0, 30.0, 40.0, "a3 0 a3 1"), (2, 0.0, 50.0, 60.0, 70.0, "a5 0 a5 1"), (1, None, None, None, None, None)], "k int, x0 double, x1 double, top double, bottom double, text string")
    got = records.without_repeated_rows(spark.createDataFrame(rows, kind), lines, ["k"]).where("col = 0").orderBy("table", "row").collect()
    assert [(r.table, r.row, r.row_span, r.text) for r in got] == [(0, 0, 2, " a1  0"), (0, 1, 1, " a3  0"), (0, 2, 1, " a5  0"), (1, 0, 1, "a2 0 a2 1"), (1, 1, 1, ""), (1, 2, 1, None)]


def test_utility_and_candidates(spark):
    def plain(t, c):
        s = "".join((t or "").split())
        if not s:
            return 0.0
        a = sum(map(str.isalnum, s))
        most = max(s.lower().count(x) for x in s.lower())
        worn = max(0.2, 1 - (most / len(s) - 0.6) * 2) if len(s) >= 6 and most / len(s) > 0.6 else 1.0
        return (a + min(len(s) - a, max(2.0, a / 2)) * 0.3) * (0.25 + 0.75 * min(100.0, max(0.0, c)) / 100) * worn

    rows = [("aaaaAAb!", 50.0), ("", 10.0), (" \n", 10.0), (None, 10.0), ("-----", 200.0), ("éa 1 ..", -5.0), ("x" * 3000 + "y" * 100, 99.0)]
    t = spark.createDataFrame(rows, "text string, confidence double")
    got = [r.u for r in t.select(tx.utility(F.col("text"), F.col("confidence")).utility.alias("u")).collect()]
    assert all(math.isclose(a, plain(*b)) for a, b in zip(got, rows))
    seen = spark.createDataFrame([(1, "ab c", 80.0), (1, "!", float("nan")), (1, "d", None)], "k int, text string, confidence double")
    r = records.candidate(seen, ["k"]).first()
    assert (r.characters, r.alphanumeric_characters, r.tokens, r.line_count, r.mean_confidence, r.symbol_ratio) == (8, 4, 4, 3, 80.0, 0.2)


def test_catalogue_outcomes_and_records(spark):
    kind = "k int, number int, generation int, offset int, is_catalog boolean, has_pages boolean, tree_score int, n_extras int"
    rows = [(1, 1, 0, 90, True, False, None, 0), (1, 2, 0, 10, True, True, -5, 9), (1, 3, 0, 50, False, True, 90, 0), (2, 4, 0, 5, False, False, None, 3), (3, 5, 0, 7, True, False, None, 0), (3, 6, 1, 6, True, False, None, 0)]
    assert sorted((r.k, r.number, r.generation) for r in records.catalog_root(spark.createDataFrame(rows, kind), ["k"]).collect()) == [(1, 3, 0), (3, 6, 1)]
    files = spark.createDataFrame([("a", None), ("b", "bad"), ("c", None)], "file string, error string")
    assert tuple(records.outcomes(files).first()) == (3, 2, 1, 200 / 3, 1)
    assert tuple(records.outcomes(files.where("false")).first()) == (0, 0, 0, None, 1)
    pages = spark.createDataFrame([("f", 2, None), ("f", 1, "x")], "file string, page int, text string")
    r = records.file_records(pages, ["file"], "page", {"file": "own", "by": "me"}).first()
    assert r.text == "x\n" and r.metadata == {"file": "own", "by": "me"}


def test_serialized_values(spark):
    rows = spark.createDataFrame([("word", 1.23456, True, b"\xff", 5), ("word", None, None, "é".encode(), None)], "object_type string, x0 double, flag boolean, raw binary, zone int")
    got = [r.json for r in reports.json_line(rows, precision=2, exclude=["zone"]).collect()]
    assert got == ['{"object_type":"word","x0":1.23,"flag":1,"raw":null}', '{"object_type":"word","x0":null,"flag":null,"raw":"é"}']


def test_long_chains_of_roles_and_reach(spark, tmp_path):
    """Chains of any length are followed to their end, and a chain into a cycle ends."""
    chain = [(f"r{i}", f"r{i + 1}") for i in range(12)] + [("x", "y"), ("y", "x")]
    got = {r.role: (r.standard, r.cyclic) for r in graph.resolve_roles(spark.createDataFrame(chain, "role string, target string")).collect()}
    assert got["r0"] == ("r12", False) and got["r11"] == ("r12", False) and got["x"][1] and got["y"][1]
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 0), (8, 9)], "src long, dst long")
    seen = graph.reachable(spark.createDataFrame([(0,), (0,)], "id long"), edges, str(tmp_path))
    assert sorted((r.id, r.depth) for r in seen.collect()) == [(i, i) for i in range(7)]
