"""Registered queries on cells that share edges, spans, coverage, cell texts and page evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import spatial, tables
from ..sources.folders import table
from ..sources.objects import lines
from .queries import LINES, docs, query

# Two tables of two by two cells side by side; in the second the rule between its
# lower cells is missing, and no edge links the tables.
_H = [(0, 20, 0), (0, 20, 10), (0, 20, 20), (30, 50, 0), (30, 50, 10), (30, 50, 20)]
_V = [(0, 0, 20), (10, 0, 20), (20, 0, 20), (30, 0, 20), (40, 0, 10), (50, 0, 20)]
_PAIR = ", ".join(str(c) for c in [(0, 0, 10, 10), (10, 0, 20, 10), (0, 10, 10, 20), (10, 10, 20, 20), (30, 0, 40, 10), (40, 0, 50, 10), (30, 10, 50, 20)])


@query(f"""SELECT n_nationkey, x0 + n_nationkey * 100.0 AS x0, top * 1.0 AS top, x1 + n_nationkey * 100.0 AS x1, bottom * 1.0 AS bottom
FROM nation, (VALUES {_PAIR}) c(x0, top, x1, bottom)""")
def lattice_pair(spark, d):
    shift = F.col("n_nationkey") * 100.0
    keys = table(spark, d, "nation").select("n_nationkey")
    edge = lambda rows, a, b, c: F.explode(F.array(*[F.struct(F.lit(float(x)).alias(a), F.lit(float(y)).alias(b), F.lit(float(z)).alias(c)) for x, y, z in rows]))
    h = keys.select("n_nationkey", edge(_H, "x0", "x1", "top").alias("e")).select("n_nationkey", (F.col("e.x0") + shift).alias("x0"), (F.col("e.x1") + shift).alias("x1"), "e.top")
    v = keys.select("n_nationkey", edge(_V, "x", "v0", "v1").alias("e")).select("n_nationkey", (F.col("e.x") + shift).alias("x"), "e.v0", "e.v1")
    return tables.lattice_cells(tables.crossings(h, v, ["n_nationkey"]), ["n_nationkey"])


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x00-/:-@\\x{2000}-\\x{206F}\\x{20A0}-\\x{21FF}]')) AS neutral, sha256(regexp_replace(text, '  +', ' ', 'g')) AS sha FROM documents")
def neutral_characters(spark, d):
    text = F.col("text")
    return docs(spark, d).select("doc_id", tx.neutral_count(text).cast("long").alias("neutral"), F.sha2(tx.single_spaces(text), 256).alias("sha"))


_DIGITS = "len(regexp_extract_all(line, '[0-9]'))"


@query(f"""WITH {LINES}
SELECT doc_id, count(*) FILTER ({_DIGITS} >= 1) AS digit_bearing, count(*) FILTER ({_DIGITS} >= 1 AND length(line) <= 25) AS short_digits
FROM l GROUP BY 1""")
def digit_cells(spark, d):
    line = F.col("line")
    return lines(docs(spark, d)).groupBy("doc_id").agg(F.count_if(tx.digit_bearing(line)).alias("digit_bearing"), F.count_if(tx.short_digits(line)).alias("short_digits"))


@query("""SELECT p_partkey, try_cast(a[1] AS DOUBLE) AS x0, try_cast(a[2] AS DOUBLE) AS top, try_cast(a[3] AS DOUBLE) AS x1, try_cast(a[4] AS DOUBLE) AS bottom
FROM (SELECT p_partkey, [p_partkey::VARCHAR, CASE WHEN p_size % 5 = 0 THEN 'x' ELSE p_size::VARCHAR END, p_size::VARCHAR || '.5'] || CASE WHEN p_size % 3 = 0 THEN [] ELSE ['7'] END AS a, p_size FROM part)
WHERE p_size % 5 <> 0 AND p_size % 3 <> 0""")
def parsed_boxes(spark, d):
    size = F.col("p_size").cast("string")
    head = F.array(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, "x").otherwise(size), F.concat(size, F.lit(".5")))
    values = F.concat(head, F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("7"))))
    return table(spark, d, "part").select("p_partkey", tx.box_of(values).alias("b")).where("b is not null").select("p_partkey", "b.*")


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 4 >= greatest(1, floor(l_quantity * 5 * 0.8)) OR l_linenumber % 7 = 0
  OR (1 - l_discount >= 0.95 AND l_tax <= 0.05 AND l_discount / 4 <= 0.02 AND l_tax / 4 <= 0.02) AS usable FROM lineitem""")
def usable_mappings(spark, d):
    c = F.col
    ok = tx.mapping_usable(c("l_quantity") * 5, c("l_quantity") * 4, c("l_linenumber") % 7, 1 - c("l_discount"), c("l_tax"), c("l_discount") / 4, c("l_tax") / 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("usable"))


@query("""SELECT l_orderkey, l_linenumber, n >= 100 AND p < n * 0.2 AND o / greatest(1, n) <= 0.01
  AND (a >= greatest(32, floor(n * 0.8)) OR (g > 0 AND l_discount / 5 <= 0.01 AND l_tax / 8 <= 0.01 AND (1 - l_tax * 2 >= 0.9
    OR (1 - l_discount / 10 >= 0.99 AND l_tax / 8 <= 0.01 AND 0.7 >= 0.65 AND l_discount <= 0.05)))) AS trusted
FROM (SELECT *, l_quantity * 6 AS n, l_linenumber * 10.0 AS p, l_suppkey % 3 AS o, l_partkey % 300 AS a, l_linenumber % 5 AS g FROM lineitem)""")
def trusted_hidden_text(spark, d):
    c, zero = F.col, F.col("l_tax") / 8
    ok = tx.hidden_trusted(c("l_quantity") * 6, c("l_linenumber") * 10.0, c("l_suppkey") % 3, c("l_partkey") % 300, c("l_linenumber") % 5, c("l_discount") / 5, zero, 1 - c("l_tax") * 2, 1 - c("l_discount") / 10, zero, F.lit(0.7), c("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("trusted"))


_BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_quantity + 8 AS x1, l_discount * 100 AS top, l_discount * 100 + 5 AS bottom FROM lineitem)"


def _boxes(spark, d):
    left, top = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", left.alias("x0"), (left + 8).alias("x1"), top.alias("top"), (top + 5).alias("bottom"))


@query(f"""WITH {_BOXES}
SELECT a.l_orderkey, a.l_linenumber, round(max(CASE WHEN o.x0 IS NULL THEN 0 ELSE (least(a.x1, o.x1) - greatest(a.x0, o.x0)) * (least(a.bottom, o.bottom) - greatest(a.top, o.top)) / greatest(1.0, (a.x1 - a.x0) * (a.bottom - a.top)) END), 6) AS coverage
FROM (FROM b WHERE l_linenumber % 2 = 1) a
LEFT JOIN (FROM b WHERE l_linenumber % 2 = 0) o ON o.l_orderkey = a.l_orderkey AND a.x0 < o.x1 AND o.x0 < a.x1 AND a.top < o.bottom AND o.top < a.bottom
GROUP BY 1, 2""")
def candidate_coverage(spark, d):
    b = _boxes(spark, d)
    made = spatial.best_coverage(b.where("l_linenumber % 2 = 1"), b.where("l_linenumber % 2 = 0"), ["l_orderkey"], "l_linenumber")
    return made.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max("coverage"), 6).alias("coverage"))


@query(f"WITH {_BOXES} SELECT l_orderkey, count(*) AS n FROM b WHERE x0 < 30 AND x1 > 0 AND top < 6 AND bottom > 0 GROUP BY 1")
def boxes_on_page(spark, d):
    return spatial.inside_page(_boxes(spark, d), 30.0, 6.0).groupBy("l_orderkey").agg(F.count("*").alias("n"))


_SPANS = "(SELECT l_orderkey, l_linenumber * 10.0 AS lo, l_linenumber * 10.0 + {} AS hi FROM lineitem)"


@query(f"""SELECT a.l_orderkey, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi
FROM {_SPANS.format('l_quantity % 10')} a JOIN {_SPANS.format('8')} b ON a.l_orderkey = b.l_orderkey AND greatest(a.lo, b.lo) < least(a.hi, b.hi)""")
def shared_spans(spark, d):
    rows, lo = table(spark, d, "lineitem"), F.col("l_linenumber") * 10.0
    left = rows.select("l_orderkey", lo.alias("lo"), (lo + F.col("l_quantity") % 10).alias("hi"))
    return spatial.common_spans(left, rows.select("l_orderkey", lo.alias("lo"), (lo + 8).alias("hi")), ["l_orderkey"])


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1
HAVING NOT bool_and(o_orderkey % 4 <> 0)""")
def undated_findings(spark, d):
    """Findings of a document, unless all of them are dates."""
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    found = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 4 == 0, "a name").otherwise(day).alias("text"))
    return found.groupBy("o_custkey").agg(F.count("*").alias("n"), F.every(tx.date_only(F.col("text"))).alias("dated")).where("not dated").drop("dated")
