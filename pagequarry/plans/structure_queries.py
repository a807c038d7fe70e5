"""Registered queries on page ranges, strings and glyphs, edges, lines, destinations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import glyphs
from ..functions import numeric as num
from ..operators import evidence, graph, layout, tables
from ..sources import reports
from ..sources.folders import table
from ..sources.selection import page_range
from .queries import query

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_SPECS = [":", "5", ":-1", "-1", "-3:-1", "::2", "3:0:-1", "2::-1"]


@query("""SELECT p_partkey, array_to_string(CASE p_partkey % 8
  WHEN 0 THEN range(n) WHEN 1 THEN range(5, greatest(least(6, n), 5)) WHEN 2 THEN range(greatest(n - 1, 0)) WHEN 3 THEN range(greatest(n - 1, 0), n)
  WHEN 4 THEN range(greatest(n - 3, 0), greatest(n - 1, 0)) WHEN 5 THEN range(0, n, 2)
  WHEN 6 THEN list_reverse(range(1, least(4, n))) ELSE list_reverse(range(0, least(3, n))) END, ',') AS pages
FROM (SELECT p_partkey, p_size::BIGINT % 9 AS n FROM part)""")
def page_ranges(spark, d):
    spec = F.element_at(F.array(*map(F.lit, _SPECS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    pages = page_range(spec, F.col("p_size") % 9)
    return table(spark, d, "part").select("p_partkey", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '…' WHEN 1 THEN p_name || 'é' WHEN 2 THEN p_name || '•ﬁ€˘' END AS text FROM part")
def text_strings(spark, d):
    """Names in each of the three encodings, and some with a byte that has no character."""
    name, marked = F.col("p_name"), lambda bom, c: F.concat(F.unhex(F.lit(bom)), c)
    data = (
        F.when(F.col("p_partkey") % 4 == 0, marked("FEFF", F.encode(F.concat(name, F.lit("…")), "UTF-16BE")))
        .when(F.col("p_partkey") % 4 == 1, marked("EFBBBF", F.encode(F.concat(name, F.lit("é")), "UTF-8")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.encode(name, "ISO-8859-1"), F.unhex(F.lit("8093A018"))))
        .otherwise(F.concat(F.encode(name, "ISO-8859-1"), F.unhex(F.lit("9F"))))
    )
    return table(spark, d, "part").select("p_partkey", glyphs.text_string(data).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN chr(65 + c) WHEN 1 THEN chr(128512 + c) WHEN 2 THEN 'A' || chr(65 + c) || 'B' WHEN 3 THEN chr(65 + c) || chr(97 + c) END AS text
FROM (SELECT p_partkey, p_size::INTEGER AS c FROM part)""")
def glyph_names(spark, d):
    digits = lambda first: F.upper(F.conv((F.col("p_size") + first).cast("string"), 10, 16))
    four = lambda first: F.lpad(digits(first), 4, "0")
    uni, k = F.concat(F.lit("uni"), four(65)), F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(uni, F.lit(".alt"))).when(k == 1, F.concat(F.lit("u"), digits(128512))).when(k == 2, F.concat(F.lit("A_"), uni, F.lit("_bee")))
    name = name.when(k == 3, F.concat(uni, four(97))).otherwise("unknown_A")
    return table(spark, d, "part").select("p_partkey", glyphs.glyph_text(name, {"A": "A", "bee": "B"}).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'ff' WHEN 1 THEN 'a' ELSE 'ﬀa' END AS text,
  CASE l_linenumber % 4 WHEN 0 THEN 0.92 WHEN 1 THEN CASE WHEN l_suppkey % 2 = 0 THEN 0.68 ELSE 0.58 END WHEN 2 THEN 0.2 ELSE 0.0 END::DOUBLE AS confidence FROM lineitem""")
def glyph_confidence(spark, d):
    i = F.col("l_linenumber")
    mark = F.when(i % 3 == 0, "ﬀ").when(i % 3 == 1, "a").otherwise("ﬀa")
    text = F.when(i % 4 == 2, F.lit("")).when(i % 4 == 3, "").otherwise("x")
    source = F.when(i % 4 == 0, "glyph_name").when(i % 4 == 1, "identity").otherwise("to_unicode")
    alternates = F.array(F.when((i % 4 == 1) & (F.col("l_suppkey") % 2 == 0), "y").otherwise(""))
    sure = glyphs.confidence(text, source, alternates).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", glyphs.ligature(mark).alias("text"), sure.alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, 'no,' || l_linenumber || ' Ab m ' || l_linenumber || ' x: ' || l_suppkey || 'b' AS text, l_linenumber % 2 = 0 AS formula FROM lineitem")
def label_boundaries(spark, d):
    n = F.col("l_linenumber").cast("string")
    glued = F.concat(F.lit("no,"), n, F.lit("Ab m"), n, F.lit(" x:"), F.col("l_suppkey").cast("string"), F.lit("b"))
    parts = F.array(F.lit("a b"), F.when(F.col("l_linenumber") % 2 == 0, "x = √2").otherwise("x = é"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", glyphs.split_labels(glued).alias("text"), glyphs.formula_like(parts).alias("formula"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 0.6 THEN x / 0.6 WHEN x < 0.3 THEN 0.5 ELSE 1 - 0.5 * (1 - (x - 0.3) / 0.7) END, 6) AS y
FROM (SELECT l_orderkey, l_linenumber, least(1.0, l_discount * 10) AS x FROM lineitem)""")
def fn_unordered(spark, d):
    made = num.stitched_unordered(F.col("l_discount") * 10, [lambda x: x, lambda x: F.lit(0.5), lambda x: 1 - x * 0.5], [0.6, 0.3], [(0, 1), (0, 1), (1, 0)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(made, 6).alias("y"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, (l_linenumber // 2)::DOUBLE AS y, lead(l_quantity) OVER w AS nx, lead((l_linenumber // 2)::DOUBLE) OVER w AS ny FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
e AS (SELECT l_orderkey, least(x, nx) AS x0, least(y, ny) AS top, greatest(x, nx) AS x1, greatest(y, ny) AS bottom, CASE WHEN x = nx THEN 'v' WHEN y = ny THEN 'h' END AS o FROM p WHERE nx IS NOT NULL),
b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_quantity + 8.0 AS x1, l_linenumber * 10.0 AS top, l_linenumber * 10.0 + 5 AS bottom FROM lineitem),
a AS (FROM e UNION ALL SELECT l_orderkey, x0, bottom, x1, bottom, 'h' FROM b WHERE l_linenumber = 1
 UNION ALL SELECT l_orderkey, x0, unnest([top, bottom]), x1, unnest([top, bottom]), 'h' FROM b
 UNION ALL SELECT l_orderkey, unnest([x0, x1]), top, unnest([x0, x1]), bottom, 'v' FROM b)
SELECT l_orderkey, coalesce(o, '-') AS orientation, count(*) AS n, round(sum(x0 + 2 * top + 3 * x1 + 5 * bottom), 4) AS s FROM a GROUP BY 1, 2""")
def all_edges(spark, d):
    """Lines, sides of rectangles and segments of curves of a page."""
    rows = table(spark, d, "lineitem")
    at = F.col("l_linenumber") * 10.0
    rects = rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), at.alias("top"), (F.col("l_quantity") + 8.0).alias("x1"), (at + 5).alias("bottom"))
    ruled = rects.where("l_linenumber = 1").withColumn("top", F.col("bottom"))
    point = F.struct(*_ORDER, F.col("l_quantity").alias("x"), F.floor(F.col("l_linenumber") / 2).cast("double").alias("y"))
    curves = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("pts"))
    made = tables.page_edges(ruled, rects, curves, ["l_orderkey"]).withColumn("orientation", F.coalesce("orientation", F.lit("-")))
    return made.groupBy("l_orderkey", "orientation").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("x0 + 2 * top + 3 * x1 + 5 * bottom")), 4).alias("s"))


@query("""SELECT l_orderkey, round(CASE WHEN max(l_linenumber) >= 7 THEN 0 ELSE avg(greatest(least(l1, r1) - greatest(l0, r0), 0) / greatest(1, greatest(l1, r1) - least(l0, r0))) END, 6) AS alignment
FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 10.0 AS l0, l_linenumber * 10.0 + 1 + max(l_quantity % 10) AS l1, l_linenumber * 10.0 + min(l_discount * 60) AS r0, l_linenumber * 10.0 + max(l_discount * 60) + 8 AS r1 FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def column_alignment(spark, d):
    at = F.col("l_linenumber") * 10.0
    rows = table(spark, d, "lineitem").withColumn("col", F.col("l_linenumber"))
    left = rows.select("l_orderkey", "col", at.alias("x0"), (at + 1 + F.col("l_quantity") % 10).alias("x1"))
    right = rows.where("l_linenumber <> 7").select("l_orderkey", "col", (at + F.col("l_discount") * 60).alias("x0"), (at + F.col("l_discount") * 60 + 8).alias("x1"))
    made = tables.column_alignment(left, right, ["l_orderkey"])
    return made.select("l_orderkey", F.round("alignment", 6).alias("alignment"))


_LB = "(SELECT l_orderkey AS k, l_linenumber AS i, (l_partkey % 4) * 3.0 AS x0, (l_partkey % 4) * 3.0 + l_quantity AS x1, l_linenumber * 12.0 AS y0, l_linenumber * 12.0 + 8 + l_suppkey % 6 AS y1 FROM lineitem)"


@query(f"""SELECT k AS l_orderkey, a.i AS l_linenumber, b.i AS r_l_linenumber FROM (SELECT *, (y1 - y0) / 2 AS t FROM {_LB}) a JOIN {_LB} b USING (k)
WHERE a.i <> b.i AND NOT (b.x1 <= a.x0 OR a.x1 <= b.x0) AND NOT (b.y1 <= a.y0 - t OR a.y1 + t <= b.y0) AND abs((b.y1 - b.y0) - (a.y1 - a.y0)) <= t
 AND (abs(b.x0 - a.x0) <= t OR abs(b.x1 - a.x1) <= t OR abs((b.x0 + b.x1 - a.x0 - a.x1) / 2) <= t)""")
def neighbour_lines(spark, d):
    x0, top = (F.col("l_partkey") % 4) * 3.0, F.col("l_linenumber") * 12.0
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), top.alias("top"), (top + 8 + F.col("l_suppkey") % 6).alias("bottom"))
    return layout.neighbour_lines(rows, ["l_orderkey"], "l_linenumber")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag AS t, l_linenumber * 10.0 AS x0, l_linenumber * 10.0 + 2 + l_quantity % 9 AS x1 FROM lineitem),
g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS gap FROM c)
SELECT l_orderkey, string_agg(CASE WHEN gap > 0.25 * greatest(x1 - x0, 8) THEN ' ' ELSE '' END || t, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM g GROUP BY 1""")
def spaced_lines(spark, d):
    x0 = F.col("l_linenumber") * 10.0
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(*_ORDER).alias("o"), F.col("l_returnflag").alias("text"), x0.alias("x0"), (x0 + 2 + F.col("l_quantity") % 9).alias("x1"), F.lit(0.0).alias("top"), F.lit(8.0).alias("bottom"))
    return layout.spaced_lines(rows, ["l_orderkey"], "o", 0.25)


@query("""SELECT o.o_orderkey, c.c_custkey % 100 AS page FROM orders o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_nationkey = o.o_orderkey % 25""")
def destinations(spark, d):
    """Destinations name a page object of their document; the others stay without a page."""
    names = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("doc"), F.col("o_custkey").alias("object"))
    pages = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("doc"), F.col("c_custkey").alias("object"), (F.col("c_custkey") % 100).alias("page"))
    return graph.resolve_destinations(names, pages, ["doc"], "object", "page").select("o_orderkey", "page")


@query("""SELECT l_orderkey, p.place::BIGINT AS place, l_partkey FROM lineitem JOIN (VALUES (0, 3), (1, 1), (2, 3), (3, 2)) p(place, i) ON l_linenumber = i""")
def taken_rows(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    wanted = rows.select("l_orderkey").distinct().withColumn("at", F.array(*[F.lit(i).cast(dict(rows.dtypes)["l_linenumber"]) for i in (3, 1, 3, 2)]))
    return graph.take(rows, wanted, ["l_orderkey"], "l_linenumber", "at").select("l_orderkey", "place", "l_partkey")


@query("""SELECT l_orderkey, CASE WHEN max(l_quantity) > 48 THEN 'exceeds_limits' WHEN bool_or(l_quantity * 400 > 10000 AND l_quantity * 400 / greatest(l_suppkey % 50 * 20, 1) >= 20) THEN 'vector_heavy' END AS verdict
FROM lineitem GROUP BY 1""")
def page_gate(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") * 400).alias("graphics"), (F.col("l_suppkey") % 50 * 20).alias("shown"), (F.col("l_quantity") * 1000).alias("bytes"))
    return evidence.page_gate(rows, ["l_orderkey"], most_bytes=48_000)


@query("""SELECT n_regionkey, 'iso' AS specification, '6.' || n_nationkey AS clause, (n_nationkey % 3)::VARCHAR AS test, CASE WHEN n_nationkey % 2 = 0 THEN 'failed' ELSE 'passed' END AS status, n_name || ' & <co>' AS description FROM nation""")
def report_rules(spark, d):
    k = F.col("n_nationkey").cast("string")
    rule = F.concat(F.lit('<rule specification="iso" clause="6.'), k, F.lit('" testNumber="'), (F.col("n_nationkey") % 3).cast("string"), F.lit('" status="'), F.when(F.col("n_nationkey") % 2 == 0, "failed").otherwise("passed"), F.lit('"><description>'), F.col("n_name"), F.lit(" &amp; &lt;co&gt;</description></rule>"))
    xml = F.concat(F.lit("<report><details>"), F.array_join(F.collect_list(rule), ""), F.lit("</details></report>"))
    return reports.rules(table(spark, d, "nation").groupBy("n_regionkey").agg(xml.alias("xml")), "xml")


@query("""SELECT l_orderkey, sha256(string_agg('word,' || (l_linenumber % 3) || ',' || l_linenumber || ',' || l_partkey || ',"a ""' || l_returnflag || '"", b",' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS sha FROM lineitem GROUP BY 1""")
def object_csv(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(*_ORDER).alias("o"), F.concat(F.lit('a "'), "l_returnflag", F.lit('", b')).alias("text"), F.lit("word").alias("object_type"), (F.col("l_linenumber") % 3).alias("page_number"), F.col("l_partkey").alias("top"), F.col("l_linenumber").alias("x0"), F.col("l_suppkey").alias("zone"))
    line = reports.csv_line(rows.drop("l_orderkey", "o"), exclude=["colour"])
    made = rows.select("l_orderkey", "o", line.alias("line"))
    return made.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda r: r["line"]), "\n"), 256).alias("sha"))
