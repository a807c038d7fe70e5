"""Registered queries on tokens, scripts, languages, search, markup and colour."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..sources.folders import table
from ..sources.objects import lines
from .queries import _TOK, LINES, docs, joined, query


@query(f"SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS sha FROM (SELECT doc_id, list_filter(list_transform({_TOK}, lambda x: regexp_replace(lower(x), '[^\\pL\\pN]', '', 'g')), lambda x: length(x) >= 2) AS t FROM documents)")
def compact_tokens(spark, d):
    rows = docs(spark, d).select("doc_id", tx.compact_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("sha"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]')) * 2 > length(text) - len(regexp_extract_all(text, '[\\s0-9!-/:-@\\[-`{-~\\x{2000}-\\x{206F}]')) AS rtl FROM documents")
def text_direction(spark, d):
    return docs(spark, d).select("doc_id", tx.right_to_left(F.col("text")).alias("rtl"))


@query("SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[\\x{00A0}\\n\\r\\t]', ' ', 'g'), ' +', ' ', 'g'))) AS clean_sha, regexp_matches(text, '\\S') AND 2 * len(regexp_extract_all(text, '\\pL')) >= len(regexp_extract_all(text, '\\S')) AS classifiable FROM documents")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(tx.clean(F.col("text")), 256).alias("clean_sha"), tx.classifiable(F.col("text")).alias("classifiable"))


_HITS = ", ".join(f"len(list_filter(t, lambda x: x IN ({', '.join(repr(v) for v in w)}))) AS {c}" for c, w in sorted(tx.STOP_WORDS.items()))
_BEST = "CASE WHEN n < 5 THEN 'eng' WHEN greatest(deu, eng, fra, spa) = 0 THEN NULL WHEN deu = greatest(deu, eng, fra, spa) THEN 'deu' WHEN eng = greatest(deu, eng, fra, spa) THEN 'eng' WHEN fra = greatest(deu, eng, fra, spa) THEN 'fra' ELSE 'spa' END"


@query(f"SELECT doc_id, {_BEST} AS language FROM (SELECT doc_id, len(t) AS n, {_HITS} FROM (SELECT doc_id, list_transform({_TOK}, lambda x: lower(x)) AS t FROM documents))")
def languages(spark, d):
    return docs(spark, d).select("doc_id", tx.language(F.col("text")).alias("language"))


@query(f"WITH k AS (SELECT source, doc_id, {_BEST} AS language FROM (SELECT source, doc_id, len(t) AS n, {_HITS} FROM (SELECT source, doc_id, list_transform({_TOK}, lambda x: lower(x)) AS t FROM documents))) SELECT source, CASE WHEN count(DISTINCT language) = 1 THEN any_value(language) END AS language, count(*) AS n FROM k GROUP BY 1")
def source_language(spark, d):
    """The language of a whole source, where its documents agree on one."""
    rows = docs(spark, d).select("source", tx.language(F.col("text")).alias("language")).groupBy("source", "language").agg(F.count("*").alias("n"))
    return rows.groupBy("source").agg(F.when(F.count("language") == 1, F.max("language")).alias("language"), F.sum("n").alias("n"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, ln, regexp_extract_all(line, '[0-9]+') AS m, regexp_split_to_array(line, '[0-9]+') AS g FROM l),
e AS (SELECT doc_id, ln, unnest(range(1, len(m) + 1)) AS i, m, g FROM m WHERE len(m) > 0)
SELECT doc_id, ln, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, m[i] AS text FROM e""")
def line_search(spark, d):
    """Every number of every line with its place, hence its box on the fixed pitch."""
    rows = lines(docs(spark, d)).select("doc_id", F.col("ln").cast("long").alias("ln"), F.explode(tx.find_all(F.col("line"), "[0-9]+")).alias("m"))
    return rows.select("doc_id", "ln", F.col("m.start").cast("long").alias("start"), "m.text")


_MD = f"""CASE WHEN regexp_matches(line, '^\\s*[0-9]{{1,9}}[.)](\\s|$)') OR regexp_matches(line, '^\\s*[-*{tx.BULLETS}](\\s|$)') THEN 'list' WHEN regexp_matches(line, '^[A-Z][^.]*$') THEN 'heading' ELSE 'paragraph' END"""
_ESC = lambda x: f"regexp_replace({x}, '([\\\\`*_\\[\\]#<>|])', '\\\\\\1', 'g')"


@query(f"""WITH {LINES}, k AS (SELECT doc_id, ln, line, {_MD} AS kind, regexp_extract(line, '^\\s*([0-9]{{1,9}})[.)](\\s|$)', 1) AS num FROM l WHERE regexp_matches(line, '[^ ]')),
b AS (SELECT doc_id, ln, CASE kind WHEN 'heading' THEN '## ' || {_ESC('trim(line)')} WHEN 'list' THEN CASE WHEN num <> '' THEN num || '. ' ELSE '- ' END || {_ESC(f"regexp_replace(trim(line), '^([0-9]{{1,9}}[.)]|[-*{tx.BULLETS}])\\s*', '')")} ELSE {_ESC('trim(line)')} END AS x FROM k)
SELECT doc_id, sha256(string_agg(x, chr(10) || chr(10) ORDER BY ln)) AS md_sha FROM b GROUP BY 1""")
def block_markdown(spark, d):
    rows = lines(docs(spark, d)).where(F.col("line").rlike("[^ ]"))
    kind = F.when(tx.list_kind(F.col("line")).isNotNull(), "list").when(F.col("line").rlike("^[A-Z][^.]*$"), "heading").otherwise("paragraph")
    out = rows.select("doc_id", "ln", tx.markdown_block(kind, F.col("line")).alias("x"))
    return out.groupBy("doc_id").agg(F.sha2(joined(["ln"], "x", "\n\n"), 256).alias("md_sha"))


@query("""WITH r AS (SELECT r_regionkey, r_name, '<tr><td' || CASE WHEN count(*) > 1 THEN ' rowspan="' || count(*) || '"' ELSE '' END || '>' || r_name || '</td>' || string_agg('<td>' || n_nationkey || '</td>', '' ORDER BY n_nationkey) || '</tr>' AS x FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2) SELECT r_regionkey, '<table>' || x || '</table>' AS html FROM r""")
def table_html(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    cell = lambda t, rows: F.struct(t.alias("text"), F.lit(1).cast("long").alias("colspan"), rows.cast("long").alias("rowspan"))
    keys = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))
    row = F.concat(F.array(cell(F.col("r_name"), F.size("k"))), F.transform("k", lambda x: cell(x.cast("string"), F.lit(1))))
    return keys.select("r_regionkey", tx.html_table(F.array(row)).alias("html"))


@query("SELECT conv_id, turn, sha256('role: ' || role || chr(10) || chr(10) || text) AS sha FROM conversations")
def node_content(spark, d):
    meta = F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(tx.content(F.col("text"), meta, ["turn"]), 256).alias("sha"))


@query("SELECT o_orderkey, o_orderpriority || CASE WHEN r > 1 THEN '.' || (r - 1) ELSE '' END AS name FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders)")
def form_field_names(spark, d):
    """Short names within a form; later ones of a name get a number."""
    r = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey").withColumn("r", r)
    return rows.select("o_orderkey", F.concat("o_orderpriority", F.when(F.col("r") > 1, F.concat(F.lit("."), (F.col("r") - 1).cast("string"))).otherwise("")).alias("name"))


_RGB = "WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS b0, l_tax * 12.5 AS b1, 0.25 AS b2, l_tax * 12.5 AS s0, 0.5 AS s1, l_discount * 10 AS s2 FROM lineitem), t AS (SELECT *, 0.3 * b0 + 0.59 * b1 + 0.11 * b2 - (0.3 * s0 + 0.59 * s1 + 0.11 * s2) AS d FROM v), u AS (SELECT l_orderkey, l_linenumber, s0 + d AS x, s1 + d AS y, s2 + d AS z FROM t), w AS (SELECT *, 0.3 * x + 0.59 * y + 0.11 * z AS l, least(x, y, z) AS lo, greatest(x, y, z) AS hi FROM u)"
_CLIP = lambda c: f"CASE WHEN hi > 1 THEN l + (g - l) * (1 - l) / (hi - l) ELSE g END".replace("g", f"(CASE WHEN lo < 0 THEN l + ({c} - l) * l / (l - lo) ELSE {c} END)")  # noqa: E731, F541


@query(f"{_RGB} SELECT l_orderkey, l_linenumber, round({_CLIP('x')} + 1e-9, 5)::DOUBLE AS r, round({_CLIP('y')} + 1e-9, 5)::DOUBLE AS g, round({_CLIP('z')} + 1e-9, 5)::DOUBLE AS b FROM w")
def colour_blend(spark, d):
    b = [F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.lit(0.25)]
    s = [F.col("l_tax") * 12.5, F.lit(0.5), F.col("l_discount") * 10]
    made = num.blend_colour("Color", b, s)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(x + 1e-9, 5).alias(n) for n, x in zip("rgb", made)])
