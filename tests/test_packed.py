"""Operators on whole pages at a time: the same rows as in SQL or in plain Python, and nothing moved word by word."""

import random
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import blocks, evidence, grids, groups, names, tables
from pagequarry.operators import words as wd
from pagequarry.plans.queries import QUERIES
from pagequarry.sources import objects

TEXTS = ["two words\n\n  spaced   out \n", "", None, "é日本 𝒳y\nb", "x\n" * 25 + "last one", " \n ", "a b c d e f g h\n" * 12]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lines_beside_the_tables_of_their_page(spark, data):
    """lines and tables were repeated with their texts in each grid cell that they touch."""
    assert "cx" not in plan(QUERIES["lines_outside_tables"](spark, data)) and "Window [sum" not in plan(QUERIES["lines_outside_tables"](spark, data))
    box = "p int, ln int, x0 double, top double, x1 double, bottom double, text string"
    made = [(0, 1, 0, 0, 10, 5, "in it"), (0, 2, 0, 0, 10, 5, "not in"), (0, 3, 0, 0, 90, 5, "in it"), (0, 4, 50, 50, 50, 50, "it"), (1, 1, 0, 0, 10, 5, "in it"), (0, 5, 0, 0, float("inf"), 5, "in"), (0, 6, 0, 0, 10, 5, "far"), (0, 6, 80, 80, 90, 90, "far"), (0, 7, 0, 0, 10, 5, None)]
    lines = spark.createDataFrame([(p, n, *map(float, b), t) for p, n, *b, t in made], box)
    held = spark.createDataFrame([(0, 0.0, 0.0, 20.0, 20.0, "it far"), (0, 0.0, 0.0, 10.0, 6.0, "in IT"), (2, 0.0, 0.0, 20.0, 20.0, "in it")], "p int, x0 double, top double, x1 double, bottom double, text string")
    assert rows(blocks.outside_tables(lines, held, ["p"], "ln"), "p", "ln") == [(0, 2), (0, 3), (0, 4), (0, 5), (0, 7), (1, 1)]


def test_lines_are_the_unions_of_their_words(spark):
    w = objects.words(odd_docs(spark)).groupBy("doc_id", "page_index", "ln")
    w = w.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), blocks.ordered_text(["wi"], "text", " ").alias("text"))
    assert rows(w, *w.columns) == rows(objects.line_boxes(odd_docs(spark)), *w.columns)


# F2
def test_batches_are_cut_by_size(spark):
    """a batch of 10,000 pages was made into Python dictionaries at once."""
    few = pa.array([[{"x": 1}] * 100] * 10_000)
    cuts = list(groups._parts(few))
    assert cuts[0][0] == 0 and cuts[-1][1] == 10_000 and all(a == b for (_, a), (b, _) in zip(cuts, cuts[1:]))
    assert max((b - a) * 100 * 16 for a, b in cuts) <= groups.AT_ONCE + 1600
    lines = pa.array([["a" * 1000] * 10, None, [], ["b" * groups.AT_ONCE * 2], ["c"]])
    assert [b - a for a, b in groups._parts(lines)] == [3, 2] or sum(b - a for a, b in groups._parts(lines)) == 5


def test_packed_words_are_the_words(spark):
    """words were made by two sorts of all of them."""
    c = ["doc_id", "page_index", "wi", "text", "x0", "x1", "top", "bottom", "seqno"]
    got = groups.per_batch(objects.packed_words(odd_docs(spark)), c[:2], c[2:], lambda g, w, n: (g, [w[k] for k in c[2:]]), "wi long, text string, x0 double, x1 double, top double, bottom double, seqno long")
    assert rows(got, *c) == rows(objects.words(odd_docs(spark)), *c)


def test_columns_of_packed_words(spark, data):
    p = plan(QUERIES["word_columns"](spark, data))
    assert p.count("Exchange") == 1 and "Window" not in p and "Aggregate" not in p
    keys = ["doc_id", "page_index"]
    assert rows(grids.word_columns(objects.packed_words(odd_docs(spark)), keys), *keys, "x") == rows(grids.word_columns(objects.words(odd_docs(spark)), keys), *keys, "x")


# F5
def test_components_of_packed_rules(spark, data):
    from pagequarry.plans.grid_queries import PAGE, _rules

    p = plan(QUERIES["grid_components"](spark, data))
    assert "collect_list" not in p and "Window" not in p
    plain = grids.grid_components(grids.axis_segments(_rules(spark, data), 600.0, 120.0), PAGE).groupBy(*PAGE, "component").agg(F.count("*").alias("n"))
    assert rows(plain, *plain.columns) == rows(QUERIES["grid_components"](spark, data), *plain.columns)


# F3
def lattice(points):
    """Smallest cells of crossings (x, top, hs, vs), by trying all corners."""
    made = []
    for p in points:
        r = min((q for q in points if q[1] == p[1] and q[0] > p[0]), default=None)
        b = min((q for q in points if q[0] == p[0] and q[1] > p[1]), key=lambda q: q[1], default=None)
        if r and b and set(p[2]) & set(r[2]) and set(p[3]) & set(b[3]):
            found = [
                (down[1], over[0]) for down in points for over in points for q in points
                if down[0] == p[0] and down[1] > p[1] and set(down[3]) & set(p[3]) and over[1] == p[1] and over[0] > p[0] and set(over[2]) & set(p[2])
                and q[:2] == (over[0], down[1]) and set(q[2]) & set(down[2]) and set(q[3]) & set(over[3])
            ]
            if found:
                made.append((p[0], p[1], min(found)[1], min(found)[0]))
    return sorted(made)


def test_cells_of_random_edges(spark):
    rnd = random.Random(7)
    h = [(p, float(a), float(a + rnd.randint(1, 4)), float(rnd.randint(0, 4))) for p in range(90) for a in rnd.choices(range(5), k=6)]
    v = [(p, float(rnd.randint(0, 6)), float(a), float(a + rnd.randint(1, 4))) for p in range(90) for a in rnd.choices(range(4), k=6)]
    points = tables.crossings(spark.createDataFrame(h, "p int, x0 double, x1 double, top double"), spark.createDataFrame(v, "p int, x double, v0 double, v1 double"), ["p"], 0.0)
    by_page = {}
    for r in points.collect():
        by_page.setdefault(r.p, []).append((r.x, r.top, r.hs, r.vs))
    want = sorted((p, *c) for p, q in by_page.items() for c in lattice(q))
    assert rows(tables.lattice_cells(points, ["p"]), "p", "x0", "top", "x1", "bottom") == want and len(want) > 30


def test_texts_of_cells(spark, data):
    """every word and every cell was moved by the grid cells that it touches."""
    p = plan(QUERIES["cell_text"](spark, data))
    assert p.count("Exchange") == 1 and "Window" not in p and "Join" not in p
    rnd = random.Random(3)
    word = [(p, x, x + 2.0, y, y + 2.0, i, f"{p}w{i}") for p in range(9) for i, (x, y) in enumerate((rnd.randint(0, 20), rnd.randint(0, 9)) for _ in range(40))]
    cell = [(p, float(x), float(y), x + rnd.randint(0, 9) * 1.0, y + 3.0) for p in range(9) for x, y in {(rnd.randint(0, 15), rnd.randint(0, 9)) for _ in range(12)}] + [(0, 0.0, 0.0, float("inf"), 9.0), (9, 0.0, 0.0, 9.0, 9.0)]
    want = {}
    for p, a, b, c, e in cell:
        hit = sorted((w[3], w[1], w[5], w[6]) for w in word if w[0] == p and a <= (w[1] + w[2]) / 2 < c < float("inf") and b <= (w[3] + w[4]) / 2 < e)
        if hit:
            want[p, a, b] = " ".join(h[3] for h in hit)
    w = spark.createDataFrame([(p, float(a), b, float(c), float(e), i, t) for p, a, b, c, e, i, t in word], "p int, x0 double, x1 double, top double, bottom double, seqno int, text string")
    got = tables.cell_texts(w, spark.createDataFrame(cell, "p int, x0 double, top double, x1 double, bottom double"), ["p"])
    assert {(r.p, r.c0, r.ct): r.text for r in got.collect()} == want and len(want) > 50


# F7
def test_tables_of_packed_pages(spark, data):
    p = plan(QUERIES["largest_table"](spark, data))
    assert "collect_list" not in p and "lead" not in p
    w, keys = objects.words(odd_docs(spark)), ["doc_id", "page_index"]
    h = tables.word_rows(w, keys)
    page = {}
    for r in w.collect():
        page.setdefault((r.doc_id, r.page_index), []).append(r)
    import numpy as np

    got = {(*k, float(t), float(a), float(b)) for k, ws in page.items() for a, b, t in zip(*tables.edge_rows({c: np.array([getattr(x, c) for x in ws]) for c in ("x0", "x1", "top", "bottom")}).values())}
    assert got == {(r.doc_id, r.page_index, r.top, r.x0, r.x1) for r in h.collect()}


# F4
def char_rows(spark):
    """Characters of shuffled words on slightly uneven rows, packed and as rows."""
    c = ["text", "x0", "x1", "top", "bottom", "seqno"]
    packed = objects.packed_chars(odd_docs(spark))
    return packed, groups.per_batch(packed, ["doc_id", "page_index"], c, lambda g, w, n: (g, [w[k] for k in c]), "text string, x0 double, x1 double, top double, bottom double, seqno long").orderBy(F.rand(1))


def test_words_of_packed_chars(spark, data):
    """every character was a row that was sorted four times."""
    p = plan(QUERIES["chars_words"](spark, data))
    assert "Window" not in p and "collect_list" not in p
    packed, plain = char_rows(spark)
    c, keys = ["word", "text", "x0", "x1", "top", "bottom"], ["doc_id", "page_index"]
    got = rows(wd.chars_to_words(packed, keys), *keys, *c)
    assert got == rows(wd.chars_to_words(plain, keys), *keys, *c)
    assert [g[:2] + g[3:] for g in got] == [tuple(r) for r in objects.words(odd_docs(spark)).orderBy(*keys, "seqno").select(*keys, "text", "x0", "x1", "top", "bottom").collect()]


# F6
def test_text_of_packed_chars(spark, data):
    """a task of characters ran out of memory while it sorted them."""
    p = plan(QUERIES["chars_text"](spark, data))
    assert p.count("Exchange") == 1 and "Window" not in p and "Aggregate" not in p
    packed, plain = char_rows(spark)
    got = rows(wd.simple_text(packed, ["doc_id", "page_index"]), "doc_id", "page_index", "text")
    assert got == rows(wd.simple_text(plain, ["doc_id", "page_index"]), "doc_id", "page_index", "text")
    assert got[:2] == [(0, 0, "two words\nspaced out"), (3, 0, "é日本 𝒳y\nb")]


# F8
def test_doubled_glyphs_of_many_lines(spark, data):
    """F8: a task of doubled characters ran out of memory."""
    p = plan(QUERIES["without_doubled"](spark, data))
    assert p.count("Exchange") == 1 and "Window" not in p and "Aggregate" not in p
    rnd = random.Random(5)
    chars = [(line, i, rnd.choice("aab"), x, x + rnd.choice([1.0, 6.0]), rnd.choice([0.0, 0.0, 3.0])) for line in range(40) for i, x in enumerate(rnd.choices([k / 2 for k in range(30)], k=25))]
    want = {}
    for line, i, t, x0, x1, top in sorted(chars, key=lambda c: (c[0], c[3], c[1])):
        kept = want.setdefault(line, [])
        q = kept[-1] if kept else None
        if not (q and q[0] == t and abs(q[1] - x0) < 2 and abs(q[3] - top) < 2 and min(q[2], x1) - max(q[1], x0) > (q[2] - q[1] + x1 - x0) / 4):
            kept.append((t, x0, x1, top))
    df = spark.createDataFrame(chars, "line int, seqno int, text string, x0 double, x1 double, top double").orderBy(F.rand(2))
    assert {r.line: r.text for r in evidence.without_doubled(df, ["line"]).collect()} == {k: "".join(c[0] for c in v) for k, v in want.items()}


# F9
@pytest.mark.parametrize("limit", [1, 2, 3])
def test_close_rows_are_all_close_pairs(spark, limit):
    """all rows of a key were compared with each other."""

    @lru_cache(None)
    def far(a, b):
        return len(a) + len(b) if not a or not b else min(far(a[1:], b) + 1, far(a, b[1:]) + 1, far(a[1:], b[1:]) + (a[0] != b[0]))

    rnd = random.Random(limit)
    made = [(i, i % 2, None if i == 3 else "".join(rnd.choices("abé", k=rnd.randint(0, 7)))) for i in range(150)]
    df = spark.createDataFrame(made, "i long, k int, t string")
    want = sorted((i, j, far(s, t)) for i, k, s in made for j, m, t in made if i < j and k == m and s is not None and t is not None and far(s, t) <= limit)
    assert rows(names.close_rows(df, ["k"], "i", "t", limit), "a", "b", "d") == want and len(want) > 100


def test_distances_are_taken_between_texts(spark, data):
    assert "p_partkey" not in plan(QUERIES["edit_distance"](spark, data)).split("levenshtein")[1].split("\n")[0]
