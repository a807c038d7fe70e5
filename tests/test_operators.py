import pytest
from pyspark.sql import functions as F

from pagequarry.functions import numeric as num
from pagequarry.functions import text as tx
from pagequarry.functions.geometry import Affine, Box
from pagequarry.operators import cluster, graph, layout, spatial, tables
from pagequarry.plans.pipeline import Pipeline, Stage
from pagequarry.sources import pdf
from pagequarry.sources.folders import shared_folder


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_islands_are_inclusive(spark):
    df = spark.createDataFrame([(0, v) for v in (1.0, 4.0, 7.0, 10.1)], "k int, v double")
    assert [r.cluster_id for r in cluster.islands(df, ["k"], "v", 3).orderBy("v").collect()] == [1, 1, 1, 2]
    twice = spark.createDataFrame([(0, 5.0), (0, 5.0)], "k int, v double")
    assert cluster.islands(twice, ["k"], "v", 0).select("cluster_id").distinct().count() == 2


def test_interval_merge_uses_running_end(spark):
    df = spark.createDataFrame([(0, 0.0, 10.0), (0, 2.0, 3.0), (0, 12.0, 14.0)], "k int, s double, e double")
    assert [(r.st, r.en, r.n) for r in cluster.merge_intervals(df, ["k"], "s", "e", 3).collect()] == [(0.0, 14.0, 3)]
    assert cluster.merge_intervals(df, ["k"], "s", "e", 1).count() == 2


def test_fold_linkages(spark):
    df = spark.createDataFrame([(0, v) for v in (0.0, 2.0, 4.0, 6.0)], "k int, v double")
    sizes = lambda how: [c["n"] for c in cluster.fold_clusters(df, ["k"], "v", 2.5, how).first()["clusters"]]
    assert sizes("anchor") == [2, 2]
    assert sizes("mean") == [2, 2]


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(0, "a", 10.0, 5.0, 1), (0, "a", 10.5, 5.5, 2), (0, "b", 10.0, 5.0, 3)], "p int, text string, doctop double, x0 double, seqno int")
    assert sorted(r.seqno for r in cluster.dedupe(df, ["p"], ["text"]).collect()) == [1, 3]


def test_corner_touch_is_no_overlap(spark):
    a = Box.at(0, 0, 10, 10)
    assert one(spark, a.overlaps(Box.at(10, 0, 20, 10)))
    assert not one(spark, a.overlaps(Box.at(10, 10, 20, 20)))
    assert one(spark, Box.at(2, 2, 3, 3).inside(a))


def test_affine():
    m = Affine(2, 1, 0, 3, 5, 7)
    i = m.then(m.inverse())
    assert [round(v, 9) for v in (i.a, i.b, i.c, i.d, i.e, i.f)] == [1, 0, 0, 1, 0, 0]
    assert Affine(1, 2, 2, 4).inverse() is None


BOX = "p int, seqno int, text string, x0 double, top double, x1 double, bottom double"


def test_occlusion_and_claims(spark):
    chars = spark.createDataFrame([(0, 5, "a", 0.0, 0.0, 100.0, 100.0)], BOX)
    later = spark.createDataFrame([(0, 9, 1, 0.0, 0.0, 90.0, 100.0), (0, 8, 2, 0.0, 0.0, 100.0, 100.0), (0, 1, 3, 0.0, 0.0, 100.0, 100.0)], "p int, seqno int, rect_id int, x0 double, top double, x1 double, bottom double")
    assert spatial.occluded(chars, later, ["p"]).count() == 1
    assert spatial.occluded(chars, later.where("seqno < 5"), ["p"]).count() == 0
    assert [(r.rect_id, r.text) for r in spatial.claims(chars, later, ["p"]).collect()] == [(1, "a")]
    assert spatial.box_join(chars, later, ["p"], cell=7.0).count() == 3


def test_lattice(spark):
    pts = [(0, x, y) for x in (0.0, 10.0, 20.0) for y in (0.0, 10.0, 20.0)]
    df = spark.createDataFrame(pts, "p int, x double, top double")
    cells = tables.lattice_cells(df, ["p"])
    assert cells.count() == 4
    assert tables.tables_of(cells, ["p"]).select("table_id").distinct().count() == 1
    h = spark.createDataFrame([(0, 0.0, 20.0, y) for y in (0.0, 10.0, 20.0)], "p int, x0 double, x1 double, top double")
    v = spark.createDataFrame([(0, x, 0.0, 20.0) for x in (0.0, 20.0)], "p int, x double, v0 double, v1 double")
    points = tables.crossings(h, v, ["p"])
    assert points.count() == 6 and tables.lattice_cells(points, ["p"]).count() == 2


def test_cells_share_edges(spark):
    """No cell between two tables, and a wider one where the nearest corner is missing."""
    h = spark.createDataFrame([(0, a, b, y) for a, b in ((0.0, 20.0), (30.0, 50.0)) for y in (0.0, 10.0, 20.0)], "p int, x0 double, x1 double, top double")
    v = spark.createDataFrame([(0, x, 0.0, 20.0) for x in (0.0, 10.0, 20.0, 30.0, 50.0)] + [(0, 40.0, 0.0, 10.0)], "p int, x double, v0 double, v1 double")
    got = sorted((r.x0, r.top, r.x1, r.bottom) for r in tables.lattice_cells(tables.crossings(h, v, ["p"]), ["p"]).collect())
    left = [(x, y, x + 10, y + 10) for x in (0.0, 10.0) for y in (0.0, 10.0)]
    assert got == sorted([*left, (30.0, 0.0, 40.0, 10.0), (40.0, 0.0, 50.0, 10.0), (30.0, 10.0, 50.0, 20.0)])


def test_grid_of_odd_boxes(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0.0, 0.0, 100.0, 10.0), (2, 0.0, 0.0, inf, 1.0), (3, nan, 0.0, 1.0, 1.0), (4, 9.0, 0.0, 1.0, 1.0), (5, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, x0 double, top double, x1 double, bottom double")
    assert [(r.i, r.cx) for r in spatial.grid(df).orderBy("cx").collect()] == [(1, 0), (1, 1)]


def test_rect_edges_and_merge(spark):
    r = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0), (0, 10.5, 0.5, 20.0, 10.0)], "p int, x0 double, top double, x1 double, bottom double")
    e = tables.rect_edges(r)
    assert e.count() == 8 and tables.filter_edges(e, "h").count() == 4
    assert tables.merge_edges(e, ["p"]).where("orientation = 'h'").count() == 2


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "src int, dst int")
    got = graph.reachable(spark.createDataFrame([(1,)], "id int"), e, shared_folder(spark))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.root) for r in cluster.components(chain, shared_folder(spark)).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    roles = spark.createDataFrame([("A", "B"), ("B", "P"), ("X", "Y"), ("Y", "X")], "role string, target string")
    out = {r.role: (r.standard, r.cyclic) for r in graph.resolve_roles(roles).collect()}
    assert out["A"] == ("P", False) and out["X"][1]
    up = graph.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert sorted((r.k, r.v) for r in up.collect()) == [(1, "a"), (2, "c")]


def test_orders():
    heading, left, right = (0, 0, 200, 10), (0, 20, 90, 100), (110, 20, 200, 100)
    assert layout.xy_cut([right, heading, left]) == [1, 2, 0]
    assert layout.topological([right, heading, left]) == [1, 2, 0]


def test_labels_and_text(spark):
    assert one(spark, tx.roman(F.lit(4))) == "iv" and one(spark, tx.roman(F.lit(1994))) == "mcmxciv"
    assert [one(spark, tx.alpha(F.lit(n))) for n in (1, 27, 28)] == ["a", "aa", "bb"]
    assert one(spark, tx.page_label(F.lit("A"), F.lit("x-"), F.lit(27))) == "x-AA"
    kinds = [one(spark, tx.list_kind(F.lit(s))) for s in ("1. x", "- y", "1.5 million")]
    assert kinds == ["numbered", "bullet", None]
    assert one(spark, tx.numeric_cell(F.lit("12a"))) and not one(spark, tx.numeric_cell(F.lit("abc1")))
    assert one(spark, tx.repeated_character(F.lit("xxx"))) and not one(spark, tx.repeated_character(F.lit("x")))
    assert one(spark, tx.date_only(F.lit("2020-01-02, 3/4/2020"))) and not one(spark, tx.date_only(F.lit("on 2020-01-02")))
    assert one(spark, tx.contains_run(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "bc"))))
    assert one(spark, tx.one_substitution(F.lit("cat"), F.lit("cut"))) and not one(spark, tx.one_substitution(F.lit("cat"), F.lit("cat")))
    assert one(spark, tx.strip_private(F.lit("ab......"))) == "ab..."
    assert one(spark, tx.character_spaced(F.lit("T I T L E")))


def test_functions(spark):
    assert one(spark, num.calculator("round", F.lit(-2.5))[0]) == -2.0
    assert one(spark, num.calculator("atan", F.lit(-1.0), F.lit(0.0))[0]) == 270.0
    assert one(spark, num.calculator("roll:3:1 pop pop", F.lit(1.0), F.lit(2.0), F.lit(3.0))[0]) == 3.0
    assert one(spark, num.calculator("idiv", F.lit(-7.0), F.lit(2.0))[0]) == -3.0
    lab = num.xyz_to_lab(*num.lab_to_xyz(F.lit(50.0), F.lit(20.0), F.lit(-30.0)))
    assert [round(one(spark, c), 6) for c in lab] == [50, 20, -30]
    with pytest.raises(ValueError):
        num.calculator("copy", F.lit(1.0))


def test_pdf(spark, tmp_path):
    data = pdf.write_pdf([[(72, 700, 10, "Hello (world)")], [(10, 10, 8, "two")]], [[(0, 0, 100, 50)], []])
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    rows = pdf.read_pdf(spark, str(tmp_path)).collect()
    text = "".join(r.text for r in sorted(rows, key=lambda r: (r.page_index or 0, r.seqno or 0)) if r.kind == "char" and r.page_index == 0)
    assert text == "Hello (world)"
    assert [(r.x0, r.top, r.x1, r.bottom) for r in rows if r.kind == "rect"] == [(0.0, 742.0, 100.0, 792.0)]
    only = pdf.read_pdf(spark, str(tmp_path / "a.pdf"), pages="2").collect()
    assert "".join(r.text for r in only) == "two"
    assert pdf.read_pdf(spark, str(tmp_path / "a.pdf"), pages="7").first().kind == "error"


def test_pdf_parts():
    assert pdf.page_selection("3-1,2", 5) == [2, 1, 0]
    with pytest.raises(IndexError):
        pdf.page_selection("0", 5)
    with pytest.raises(ValueError):
        pdf.page_selection("", 5)
    assert pdf.run_length(bytes([2, 1, 2, 3, 254, 9, 128])) == b"\1\2\3\x09\x09\x09"
    assert pdf.ascii_hex(b"48 65>") == b"He" and pdf.ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert pdf.unpredict(bytes([1, 1, 1, 1, 2, 1, 1, 1]), {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf.Lexer(b"<< /A [1 2 R (x\\051) <4142>] /B true >>").value() == {"A": [pdf.Ref(1, 2), b"x)", b"AB"], "B": True}
    assert pdf.to_unicode(b"2 beginbfrange <01> <03> <0041> <05> <06> [<0058> <0059>] endbfrange") == {1: "A", 2: "B", 3: "C", 5: "X", 6: "Y"}


def test_pipeline(spark):
    p = Pipeline.of([("a", lambda d: d.withColumn("x", F.lit(1))), ("b", lambda d: d.withColumn("x", F.col("x") + 1))])
    p = p.after("a", Stage("c", lambda d: d.withColumn("x", F.col("x") * 10))).replaced("b", Stage("b", lambda d: d.withColumn("x", F.col("x") + 5)))
    assert p(spark.range(1)).first()["x"] == 15


def test_stream(spark, tmp_path, data):
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in"))
    from pagequarry.streaming.windows import event_windows

    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = event_windows(spark.read.parquet(f"{data}/events.parquet"))
    assert spark.table("hours").count() == want.count()


def test_chars_to_words(spark):
    from pagequarry.operators import words as wd

    chars = [(0, i, c, i * 6.0, 0.0, i * 6.0 + 6, 10.0) for i, c in enumerate("ab-c d")] + [(0, 9, "z", 0.0, 20.0, 6.0, 30.0)]
    df = spark.createDataFrame(chars, BOX)
    text = lambda **o: [r.text for r in wd.chars_to_words(df, ["p"], **o).orderBy("word").collect()]
    assert text() == ["ab-c", "d", "z"]
    assert text(split_at="-") == ["ab", "-", "c", "d", "z"]
    assert text(keep_blanks=True) == ["ab-c d", "z"]
    assert wd.simple_text(df, ["p"]).first().text == "ab-c d\nz"


def test_majority_and_walk(spark):
    from pagequarry.operators import trees

    votes = spark.createDataFrame([(1, "a")] * 9 + [(1, "b")] + [(2, "a"), (2, "b")] + [(3, "a")], "k int, v string")
    assert [(r.k, r.v, r.votes) for r in trees.majority(votes, ["k"], "v").collect()] == [(1, "a", 9)]
    nodes = spark.createDataFrame([("1", None, "x"), ("2", "1", "y"), ("3", "4", "q"), ("4", "3", "r")], "id string, parent string, name string")
    assert sorted((r.id, ".".join(r.path)) for r in trees.walk(nodes, "name").collect()) == [("1", "x"), ("2", "x.y")]
