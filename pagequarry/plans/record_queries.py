"""Registered queries on trees, fields, annotations, table rows and titles, runs, candidates and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import glyphs
from ..operators import records
from ..sources import reports
from ..sources.folders import table
from .queries import docs, query

_ENTRIES = "[s_name, s_suppkey::VARCHAR] || CASE WHEN s_suppkey % 3 = 0 THEN [s_suppkey::VARCHAR, 'n'] ELSE ['odd'] END"
_TREE = f"""t AS (SELECT r_regionkey::BIGINT AS id, r_name AS role, [r_regionkey::BIGINT] AS path, NULL::VARCHAR[] AS entries FROM region
UNION ALL SELECT 100 + n_nationkey, n_name, [n_regionkey::BIGINT, n_nationkey::BIGINT], NULL FROM nation
UNION ALL SELECT 1000 + s_suppkey, s_name, [n_regionkey::BIGINT, n_nationkey::BIGINT, s_suppkey], {_ENTRIES} FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def _tree(spark, d):
    """Regions, their nations and these nations' suppliers, which carry entries."""
    c = F.col
    made = lambda t, key, up, add, name: table(spark, d, t).select((c(key) + add).cast("long").alias("id"), up.cast("long").alias("parent"), c(key).cast("long").alias("ord"), c(name).alias("role"))
    s = c("s_suppkey").cast("string")
    entries = F.concat(F.array(c("s_name"), s), F.when(c("s_suppkey") % 3 == 0, F.array(s, F.lit("n"))).otherwise(F.array(F.lit("odd"))))
    leaves = table(spark, d, "supplier").select((c("s_suppkey") + 1000).alias("id"), (c("s_nationkey") + 100).cast("long").alias("parent"), c("s_suppkey").alias("ord"), c("s_name").alias("role"), entries.alias("entries"))
    inner = made("region", "r_regionkey", F.lit(None), 0, "r_name").unionByName(made("nation", "n_nationkey", c("n_regionkey"), 100, "n_name"))
    return inner.withColumn("entries", F.lit(None).cast("array<string>")).unionByName(leaves)


_ITEMS = f"""WITH {_TREE}, p AS (SELECT id, path, unnest(range(len(entries) // 2)) AS place, entries FROM t WHERE entries IS NOT NULL)
SELECT id, array_to_string(path, '/') AS path, place, entries[2 * place + 1] AS key, entries[2 * place + 2] AS value FROM p"""


@query(_ITEMS)
def name_tree(spark, d):
    return records.tree_items(_tree(spark, d)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query(f"SELECT id, path, place, try_cast(key AS BIGINT) AS key, value FROM ({_ITEMS}) WHERE try_cast(key AS BIGINT) IS NOT NULL")
def number_tree(spark, d):
    return records.tree_items(_tree(spark, d), numbers=True).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query(f"SELECT i.key, i.value, c_custkey % 100 AS page FROM ({_ITEMS}) i LEFT JOIN customer ON c_custkey % 2 = 0 AND c_custkey::VARCHAR = i.value")
def named_places(spark, d):
    pages = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("value"), (F.col("c_custkey") % 100).alias("page"))
    return records.named_destinations(_tree(spark, d), pages)


@query(f"WITH {_TREE} SELECT id, role, array_to_string(path, '/') AS path FROM t WHERE regexp_matches(role, 'A$|7$')")
def structure_search(spark, d):
    found = records.find_all(_tree(spark, d), pattern="A$|7$")
    return found.select("id", "role", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query("""SELECT r_regionkey::BIGINT AS id, r_name AS name, 'Tx' AS kind, r_regionkey::BIGINT AS quadding FROM region
UNION ALL SELECT 100 + n_nationkey, r_name || '.' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Btn' ELSE 'Tx' END, r_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 1000 + s_suppkey, r_name || '.' || n_name || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '.' || s_name END, CASE WHEN n_nationkey % 2 = 0 THEN 'Btn' ELSE 'Tx' END, CASE WHEN s_suppkey % 4 = 0 THEN 9 ELSE r_regionkey END
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def field_records(spark, d):
    c, i = F.col, F.col("id")
    kind = F.when(i < 100, "Tx").when((i < 1000) & ((i - 100) % 2 == 0), "Btn")
    quadding = F.when(i < 100, i).when((i >= 1000) & ((i - 1000) % 4 == 0), F.lit(9).cast("long"))
    name = F.when((i < 1000) | ((i - 1000) % 5 != 0), c("role"))
    nodes = _tree(spark, d).select("id", "parent", name.alias("name"), kind.alias("kind"), quadding.alias("quadding"))
    return records.inherit_down(nodes, ["kind", "quadding"], "name")


@query("""SELECT DISTINCT o_custkey % 10 AS doc, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 ELSE o_orderkey % 5 END AS page, o_custkey AS field
FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 7 < 5""")
def widget_pages(spark, d):
    """Every third widget names its page, of which pages 0 to 4 exist; the others are listed by theirs."""
    c = F.col
    rows = table(spark, d, "orders").withColumn("doc", c("o_custkey") % 10)
    widgets = rows.select("doc", c("o_custkey").alias("field"), c("o_orderkey").alias("widget"), F.when(c("o_orderkey") % 3 == 0, c("o_custkey") % 7).alias("page_ref"))
    listed = rows.select("doc", c("o_orderkey").alias("widget"), (c("o_orderkey") % 5).alias("page"))
    pages = rows.select("doc").distinct().select("doc", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("page")).select("doc", c("page").cast("long").alias("page"), c("page").cast("long").alias("page_ref"))
    return records.fields_by_page(widgets, pages, listed, ["doc"])


@query("""SELECT 'catalog' AS owner, r_name AS name, NULL::BIGINT AS page FROM region UNION ALL SELECT 'page', n_name, n_nationkey::BIGINT FROM nation
UNION ALL SELECT 'annotation', s_name, s_suppkey % 9 FROM supplier""")
def owned_files(spark, d):
    t = lambda n, name, page=None: table(spark, d, n).select(F.col(name).alias("name"), *([page.cast("long").alias("page")] if page is not None else []))
    return records.associated_files(catalog=t("region", "r_name"), page=t("nation", "n_name", F.col("n_nationkey")), annotation=t("supplier", "s_name", F.col("s_suppkey") % 9))


@query("SELECT o_custkey, o_orderstatus AS name, count(*) AS n, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS contents FROM orders GROUP BY 1, 2")
def attached_files(spark, d):
    files = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("name"), F.encode("o_orderpriority", "UTF-8").alias("content"))
    made = records.attachments(files, ["o_custkey"], "o_orderkey")
    return made.select("o_custkey", "name", F.size("contents").cast("long").alias("n"), F.array_join(F.transform("contents", lambda b: F.decode(b, "UTF-8")), "|").alias("contents"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey AS i, o_orderkey % 5 AS object, CASE WHEN o_orderkey % 4 = 0 THEN 'Popup' ELSE 'Text' END AS subtype, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END AS reply_to, o_orderkey % 6 AS target FROM orders),
f AS (SELECT o_custkey, object, min(i) AS f FROM a GROUP BY 1, 2),
j AS (SELECT a.*, CASE WHEN r.object <> a.object THEN r.f END AS r, CASE WHEN t.object <> a.object THEN t.f END AS t FROM a
 LEFT JOIN f r ON r.o_custkey = a.o_custkey AND r.object = a.reply_to LEFT JOIN f t ON t.o_custkey = a.o_custkey AND t.object = a.target)
SELECT o_custkey, i, object, subtype, r AS in_reply_to, CASE WHEN r IS NOT NULL THEN 'R' END AS reply_type, CASE WHEN subtype <> 'Popup' THEN t END AS popup, CASE WHEN subtype = 'Popup' THEN t END AS popup_parent FROM j""")
def linked_annotations(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", k.alias("i"), (k % 5).alias("object"), F.when(k % 4 == 0, "Popup").otherwise("Text").alias("subtype"), F.when(k % 2 == 0, k % 7).alias("reply_to"), F.lit("R").alias("reply_type"), (k % 6).alias("target"))
    return records.link_annotations(rows, ["o_custkey"], "i")


@query("SELECT l_orderkey, count(*) AS n, sum(100 - l_quantity - 5) AS tops, sum(100 - l_quantity) AS bottoms FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1")
def page_links(spark, d):
    kind = F.when(F.col("l_partkey") % 3 != 0, "URI")
    links = table(spark, d, "lineitem").select("l_orderkey", kind.alias("link_type"), F.col("l_quantity").alias("top"), (F.col("l_quantity") + 5).alias("bottom"))
    return records.action_links(links, 100).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("top").alias("tops"), F.sum("bottom").alias("bottoms"))


_ROWS = "g AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS r, min(l_suppkey) AS s, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_ROWS}, x AS (SELECT *, NOT (p % 2 = s % 2 AND q % 10 <= 1) AS kept FROM g), n AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY k ORDER BY r) - 1 AS i FROM x)
SELECT n.k, i AS "row", c.col, 'a  ' || CASE c.col WHEN 0 THEN s ELSE p % 2 END AS text, (SELECT count(*) FROM n m WHERE m.k = n.k AND m.kept AND m.r >= n.r AND m.r < n.r + 2) AS row_span
FROM n, (VALUES (0), (1)) c(col) WHERE kept""")
def rows_without_lines(spark, d):
    """Two cells a row; a line has the row's text if p and s are both odd or both even and lies up to 9 below it."""
    c = F.col
    g = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").cast("long").alias("r")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    name = lambda x: F.concat(F.lit("a  "), x.cast("string"))
    cell = lambda i, x, t: F.struct(F.lit(i).alias("col"), name(t).alias("text"), F.lit(x).alias("x0"), F.lit(x + 20.0).alias("x1"))
    cells = g.select("k", F.lit(0).alias("table"), c("r").alias("row"), F.lit(2).alias("row_span"), (c("r") * 12.0).alias("top"), (c("r") * 12.0 + 10).alias("bottom"), F.explode(F.array(cell(0, 0.0, c("s")), cell(1, 30.0, c("p") % 2))).alias("_c"))
    cells = cells.select("k", "table", "row", "row_span", "top", "bottom", "_c.*")
    down = c("r") * 12.0 + c("q") % 10
    lines = g.select("k", F.lit(0.0).alias("x0"), F.lit(50.0).alias("x1"), down.alias("top"), (down + 10).alias("bottom"), F.concat(name(c("s")), F.lit(" "), name(c("s") % 2)).alias("text"))
    return records.without_repeated_rows(cells, lines, ["k"]).select("k", "row", "col", "text", "row_span")


@query(f"""WITH {_ROWS}, b AS (SELECT k, r, r * 50.0 AS top, q AS x0, q + 30 AS x1, (r - 1) * 50.0 + p % 50 AS rb, s % 60 AS r0, s % 60 + 20.0 AS r1, 'title ' || p AS t FROM g)
SELECT a.k, a.r, arg_min(o.t, (a.top - o.rb, o.r0, o.t)) AS title FROM b a JOIN b o USING (k)
WHERE a.top - o.rb BETWEEN 0 AND 36 AND greatest(0, least(a.x1, o.r1) - greatest(a.x0, o.r0)) / 20 >= 0.6 GROUP BY 1, 2""")
def table_titles(spark, d):
    c = F.col
    g = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").cast("long").alias("r")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    tables = g.select("k", "r", c("q").alias("x0"), (c("q") + 30).alias("x1"), (c("r") * 50.0).alias("top"))
    rows = g.select("k", (c("s") % 60).alias("x0"), (c("s") % 60 + 20.0).alias("x1"), ((c("r") - 1) * 50.0 + c("p") % 50).alias("bottom"), F.concat(F.lit("title "), c("p").cast("string")).alias("text"))
    return records.table_titles(tables, rows, ["k"], "r")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1 AS table_index FROM orders")
def table_references(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("page"))
    return records.table_references(rows, ["o_custkey"], "page", "o_orderkey").drop("page")


@query(f"""WITH {_ROWS}, b AS (SELECT k, r, q AS x0, q + 8 AS x1, p % 60 AS y0, p % 60 + 5 AS y1, s % 7 = 0 AS w FROM g)
SELECT x.k, x.r AS a, y.r AS b FROM b x JOIN b y ON x.k = y.k AND x.r < y.r WHERE (x.x0 < y.x1 AND y.x0 < x.x1) OR (x.y0 < y.y1 AND y.y0 < x.y1) OR x.w OR y.w""")
def order_pairs(spark, d):
    c = F.col
    g = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").cast("long").alias("r")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    blocks = g.select("k", "r", c("q").alias("x0"), (c("q") + 8).alias("x1"), (c("p") % 60).alias("top"), (c("p") % 60 + 5).alias("bottom"), (c("s") % 7 == 0).alias("wide"))
    return records.candidate_pairs(blocks, ["k"], "r", "wide")


@query(f"""WITH {_ROWS}, u AS (SELECT k, r, CASE WHEN p % 3 <> 0 THEN p % 3 END AS o, 't' || r AS t, q AS x0, q + 4 AS x1, s % 2 = 0 AS v FROM g)
SELECT k, r, t AS text, x0, x1, v AS visible FROM u WHERE o IS NULL UNION ALL SELECT k, min(r), 'actual ' || o, min(x0), max(x1), bool_or(v) FROM u WHERE o IS NOT NULL GROUP BY k, o""")
def actual_texts(spark, d):
    c = F.col
    g = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").cast("long").alias("r")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    runs = g.select("k", "r", F.when(c("p") % 3 != 0, c("p") % 3).alias("owner"), F.concat(F.lit("actual "), (c("p") % 3).cast("string")).alias("actual"), F.concat(F.lit("t"), c("r").cast("string")).alias("text"), c("q").alias("x0"), (c("q") + 4).alias("x1"), F.lit(0.0).alias("top"), F.lit(8.0).alias("bottom"), (c("s") % 2 == 0).alias("visible"))
    return records.actual_text(runs, ["k"], "r").drop("top", "bottom")


@query("""WITH c AS (SELECT *, sum(length(l_returnflag) + length(l_partkey::VARCHAR)) OVER w AS n, sum(CASE WHEN l_suppkey % 4 = 0 THEN length(l_returnflag) + length(l_partkey::VARCHAR) ELSE 0 END) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, max(n)::BIGINT AS native_characters, max(p)::BIGINT AS painted_characters, count(*) FILTER (l_suppkey % 4 = 0 OR (n >= 12 AND p < n * 0.2)) AS shown FROM c GROUP BY 1""")
def selected_runs(spark, d):
    text = F.concat("l_returnflag", F.lit(" "), F.col("l_partkey").cast("string"))
    runs = table(spark, d, "lineitem").select("l_orderkey", text.alias("text"), (F.col("l_suppkey") % 4 == 0).alias("visible"))
    made = records.select_runs(runs, ["l_orderkey"], (F.col("native_characters") >= 12) & (F.col("painted_characters") < F.col("native_characters") * 0.2))
    return made.groupBy("l_orderkey").agg(F.max("native_characters").alias("native_characters"), F.max("painted_characters").alias("painted_characters"), F.count_if("shown").alias("shown"))


@query("""WITH o AS (SELECT p_brand, CASE p_size % 4 WHEN 0 THEN 'aaaAaa!!' WHEN 1 THEN '--- #' ELSE p_name END AS t, p_size * 3.0 AS c FROM part),
s AS (SELECT *, regexp_replace(t, '\\s+', '', 'g') AS b FROM o), u AS (SELECT *, length(b) AS n, length(regexp_replace(b, '[^A-Za-z0-9]', '', 'g')) AS a, list_max(list_transform(list_distinct(string_split(lower(b), '')), lambda x: length(b) - length(replace(lower(b), x, '')))) AS m FROM s)
SELECT p_brand, (sum(length(t)) + count(*) - 1)::BIGINT AS characters, sum(a)::BIGINT AS alphanumeric_characters, sum(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')))::BIGINT AS tokens, count(*) AS line_count, round(avg(c), 6) AS mean_confidence,
 round((sum(n) - sum(a)) / greatest(1, sum(n)), 6) AS symbol_ratio, round(sum((a + least(n - a, greatest(2.0, a * 0.5)) * 0.3) * (0.25 + least(100, c) * 0.75 / 100) * CASE WHEN n >= 6 AND m / n > 0.6 THEN greatest(0.2, 1 - (m / n - 0.6) * 2) ELSE 1 END)::DOUBLE, 4) AS utility FROM u GROUP BY 1""")
def candidate_metrics(spark, d):
    k = F.col("p_size") % 4
    rows = table(spark, d, "part").select("p_brand", F.when(k == 0, "aaaAaa!!").when(k == 1, "--- #").otherwise(F.col("p_name")).alias("text"), (F.col("p_size") * 3.0).alias("confidence"))
    made = records.candidate(rows, ["p_brand"])
    return made.withColumns({"mean_confidence": F.round("mean_confidence", 6), "symbol_ratio": F.round("symbol_ratio", 6), "utility": F.round("utility", 4)})


@query("SELECT o_custkey, o_orderkey, (o_orderkey % 9 - min(o_orderkey % 9) OVER (PARTITION BY o_custkey))::DOUBLE AS tx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_orderkey % 9, o_orderkey) - 1 AS place FROM orders")
def shown_groups(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", k.alias("seqno"), (k % 9).cast("double").alias("tx"), (-(k % 5).cast("double")).alias("ty"), F.lit(-1).alias("flip"))
    return records.show_groups(rows, ["o_custkey"]).select("o_custkey", F.col("seqno").alias("o_orderkey"), "tx", "place")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 100 WHEN o_orderkey % 2 = 0 THEN 25 END + CASE WHEN o_orderkey % 2 <> 0 THEN 0 WHEN o_orderkey % 7 - 2 <= 0 THEN -150 ELSE o_orderkey % 7 - 2 END + 2 * (o_orderkey % 4) AS s FROM orders)
SELECT o_custkey, arg_max(o_orderkey, (s, -(o_orderkey % 11), o_orderkey)) AS number, 0::BIGINT AS generation FROM s WHERE s > -100 GROUP BY 1""")
def catalog_roots(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", k.alias("number"), F.lit(0).cast("long").alias("generation"), (k % 11).alias("offset"), (k % 3 == 0).alias("is_catalog"), (k % 2 == 0).alias("has_pages"), (k % 7 - 2).alias("tree_score"), (k % 4).alias("n_extras"))
    return records.catalog_root(rows, ["o_custkey"])


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 7 <> 0) AS succeeded, count(*) FILTER (doc_id % 7 = 0) AS failed, count(*) FILTER (doc_id % 7 <> 0) * 100.0 / count(*) AS success_rate, 1 AS exit_code FROM documents")
def batch_outcome(spark, d):
    return records.outcomes(docs(spark, d).select(F.when(F.col("doc_id") % 7 == 0, "unreadable").alias("error")))


@query("SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS text, o_custkey::VARCHAR AS name, 'x' AS lang FROM orders GROUP BY 1")
def file_records(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("text"))
    made = records.file_records(rows, ["o_custkey"], "o_orderkey", {"lang": "x"})
    return made.select("o_custkey", "text", F.col("metadata")["o_custkey"].alias("name"), F.col("metadata")["lang"].alias("lang"))


_SOURCES = "['to_unicode', 'encoding', 'identity', 'glyph_name']"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 = 0 OR l_suppkey % 5 = 1 THEN 'unsupported' ELSE ['authoritative', 'heuristic', 'unknown-identifier', 'authoritative'][l_linenumber % 4 + 1] END AS semantics,
  {_SOURCES}[l_linenumber % 4 + 1] AS source FROM lineitem""")
def glyph_semantics(spark, d):
    source = F.element_at(F.array(*map(F.lit, ["to_unicode", "encoding", "identity", "glyph_name"])), F.col("l_linenumber") % 4 + 1)
    text = F.when(F.col("l_suppkey") % 5 == 0, "").when(F.col("l_suppkey") % 5 == 1, "\x01").otherwise("x")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", glyphs.semantics(text, source).alias("semantics"), source.alias("source"))


@query("""SELECT to_json({'object_type': 'word', 'page_number': l_linenumber, 'x0': l_partkey, 'flag': (l_suppkey % 2 = 0)::INTEGER, 'note': CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_returnflag END})::VARCHAR AS json FROM lineitem""")
def object_json(spark, d):
    """Every third note holds bytes that are no text."""
    note = F.when(F.col("l_suppkey") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.encode("l_returnflag", "UTF-8"))
    rows = table(spark, d, "lineitem").select(F.lit("word").alias("object_type"), F.col("l_linenumber").alias("page_number"), F.col("l_partkey").alias("x0"), (F.col("l_suppkey") % 2 == 0).alias("flag"), note.alias("note"), F.lit(1).alias("zone"))
    return reports.json_line(rows, exclude=["zone"])
