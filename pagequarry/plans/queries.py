"""Registered queries of the engine's own operators, each with the SQL it is held against.

``query(sql)`` registers a function under its name. W is the word table of
``sources.objects.words`` in SQL. Sums and means are rounded to four places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..functions.geometry import Affine, Box, crop, move, outside, union_box, within
from ..operators import cluster, graph, layout, names, spatial, tables, trees
from ..operators import words as wd
from ..operators.groups import per_batch, per_page
from ..sources.folders import shared_folder, table
from ..sources.objects import elements, lines, packed_chars, packed_words, words
from ..streaming.windows import event_windows, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PAGE = ["doc_id", "page_index"]


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


LINES = """l AS (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""
W = f"""{LINES},
k AS (SELECT doc_id, ln, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l),
e AS (SELECT doc_id, ln, unnest(range(len(ws))) AS wi, unnest(ws) AS text FROM k),
w AS (SELECT doc_id, ln // 10 AS page_index, ln, wi, text,
  6.0 * (sum(length(text) + 1) OVER (PARTITION BY doc_id, ln ORDER BY wi) - length(text) - 1)::DOUBLE AS x0,
  6.0 * (sum(length(text) + 1) OVER (PARTITION BY doc_id, ln ORDER BY wi) - 1)::DOUBLE AS x1,
  12.0::DOUBLE * (ln % 10) AS top, 12.0::DOUBLE * (ln % 10) + 10 AS bottom, 12.0::DOUBLE * ln AS doctop,
  row_number() OVER (PARTITION BY doc_id, ln // 10 ORDER BY ln, wi) AS seqno FROM e)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    return words(docs(spark, d).select("doc_id", "text"))


def joined(order: list[str], text: str, sep: str):
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), sep)


# ------------------------------------------------------------------ page objects


@query(f"WITH {W} SELECT doc_id, page_index, count(*) AS n_words, sum(x1) AS sum_x1 FROM w GROUP BY 1, 2")
def page_words(spark, d):
    return page_boxes(spark, d).groupBy(*PAGE).agg(F.count("*").alias("n_words"), F.sum("x1").alias("sum_x1"))


@query(f"WITH {W}, r AS (SELECT doc_id, page_index, ln, string_agg(text, ' ' ORDER BY wi) AS t FROM w GROUP BY ALL) SELECT doc_id, page_index, sha256(string_agg(t, chr(10) ORDER BY ln)) AS text_sha FROM r GROUP BY 1, 2")
def page_text(spark, d):
    rows = page_boxes(spark, d).groupBy(*PAGE, "ln").agg(joined(["wi"], "text", " ").alias("t"))
    return rows.groupBy(*PAGE).agg(F.sha2(joined(["ln"], "t", "\n"), 256).alias("text_sha"))


@query(f"WITH {W} SELECT doc_id, page_index, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM w GROUP BY 1, 2")
def page_union(spark, d):
    return union_box(page_boxes(spark, d), *PAGE)


_OVER = "greatest(x0, 60) <= least(x1, 300) AND greatest(top, 24) <= least(bottom, 84) AND (least(x1, 300) - greatest(x0, 60)) + (least(bottom, 84) - greatest(top, 24)) > 0"
_BOX = (60, 24, 300, 84)


@query(f"WITH {W} SELECT doc_id, page_index, seqno, greatest(x0, 60)::DOUBLE AS x0, least(x1, 300)::DOUBLE AS x1, greatest(top, 24)::DOUBLE AS top, least(bottom, 84)::DOUBLE AS bottom, doctop + greatest(top, 24) - top AS doctop FROM w WHERE {_OVER}")
def crop_words(spark, d):
    return crop(page_boxes(spark, d), Box.at(*_BOX)).select(*PAGE, "seqno", "x0", "x1", "top", "bottom", "doctop")


@query(f"WITH {W} SELECT doc_id, page_index, seqno FROM w WHERE x0 >= 60 AND top >= 24 AND x1 <= 300 AND bottom <= 84")
def within_words(spark, d):
    return within(page_boxes(spark, d), Box.at(*_BOX)).select(*PAGE, "seqno")


@query(f"WITH {W} SELECT doc_id, page_index, seqno FROM w WHERE NOT ({_OVER})")
def outside_words(spark, d):
    return outside(page_boxes(spark, d), Box.at(*_BOX)).select(*PAGE, "seqno")


@query(f"WITH {W} SELECT doc_id, page_index, sum(-2 * bottom + 7) AS sx, sum(2 * x1 - 3) AS sy, count(*) AS n FROM w GROUP BY 1, 2")
def affine_words(spark, d):
    m = Affine(0, 1, -1, 0).then(Affine(2, 0, 0, 2, 7, -3))
    b = m.box(Box.of())
    return page_boxes(spark, d).select(*PAGE, b.x0.alias("sx"), b.bottom.alias("sy")).groupBy(*PAGE).agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.count("*").alias("n"))


@query(f"WITH {W} SELECT doc_id, page_index, sum(CASE doc_id % 4 WHEN 0 THEN x0 WHEN 1 THEN 120 - bottom WHEN 2 THEN 3000 - x1 ELSE top END) AS sx, sum(CASE doc_id % 4 WHEN 0 THEN bottom WHEN 1 THEN x1 WHEN 2 THEN 120 - top ELSE 3000 - x0 END) AS sb FROM w GROUP BY 1, 2")
def rotate_boxes(spark, d):
    b = Box.of().turned((F.col("doc_id") % 4) * 90, F.lit(3000.0), F.lit(120.0))
    return page_boxes(spark, d).select(*PAGE, b.x0.alias("a"), b.bottom.alias("b")).groupBy(*PAGE).agg(F.sum("a").alias("sx"), F.sum("b").alias("sb"))


@query(f"WITH {W} SELECT doc_id, page_index, sum(x0 + 5) AS a, sum(120 - bottom) AS b FROM w GROUP BY 1, 2")
def move_flip(spark, d):
    flipped = Box.of().flipped(F.lit(120.0))
    return move(page_boxes(spark, d), "h", 5).groupBy(*PAGE).agg(F.sum("x0").alias("a"), F.sum(flipped.top).alias("b"))


# ------------------------------------------------------------------------ islands


@query(f"WITH {W}, a AS (SELECT *, CASE WHEN top > lag(top) OVER (PARTITION BY doc_id, page_index ORDER BY top) + 3 THEN 1 ELSE 0 END AS b FROM w), c AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, page_index ORDER BY top) + 1 AS cluster_id FROM a) SELECT doc_id, page_index, cluster_id::BIGINT AS cluster_id, count(*) AS n FROM c GROUP BY 1, 2, 3")
def line_clusters(spark, d):
    return cluster.islands(page_boxes(spark, d), PAGE, "top", 3).groupBy(*PAGE, "cluster_id").agg(F.count("*").alias("n"))


_CHAIN = "a AS (SELECT event_type, value, CASE WHEN value > lag(value) OVER (PARTITION BY event_type ORDER BY value) + 0.05 THEN 1 ELSE 0 END AS b FROM events), c AS (SELECT event_type, value, sum(b) OVER (PARTITION BY event_type ORDER BY value) + 1 AS cluster_id FROM a)"


@query(f"WITH {_CHAIN} SELECT event_type, count(*) AS n_clusters, max(n) AS max_size FROM (SELECT event_type, cluster_id, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1")
def cluster_chain(spark, d):
    rows = cluster.islands(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", 0.05)
    return rows.groupBy("event_type", "cluster_id").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.count("*").alias("n_clusters"), F.max("n").alias("max_size"))


@query(f"WITH {_CHAIN} SELECT event_type, cluster_id::BIGINT AS cluster_id, round(avg(value) + 1e-9, 4) AS target FROM c GROUP BY 1, 2")
def snap_mean(spark, d):
    rows = cluster.islands(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", 0.05)
    return rows.groupBy("event_type", "cluster_id").agg(F.round(F.avg("value") + 1e-9, 4).alias("target"))


@query(None)
def cluster_anchor(spark, d):
    rows = cluster.fold_clusters(table(spark, d, "events").select("user_id", "value"), ["user_id"], "value", 5.0, "anchor")
    return rows.select("user_id", F.size("clusters").alias("n"))


@query("WITH i AS (SELECT l_suppkey, l_extendedprice AS s, l_extendedprice + l_quantity AS t FROM lineitem), m AS (SELECT *, max(t) OVER (PARTITION BY l_suppkey ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i), g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS seg FROM m) SELECT l_suppkey, seg::BIGINT AS seg, round(min(s), 4) AS st, round(max(t), 4) AS en, count(*) AS n FROM g GROUP BY 1, 2")
def interval_merge(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("s"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("t"))
    return cluster.merge_intervals(rows, ["l_suppkey"], "s", "t").withColumns({"st": F.round("st", 4), "en": F.round("en", 4)})


@query(f"WITH {W} SELECT doc_id, page_index, 2 * count(*) AS n_before, count(*) AS n_after FROM w GROUP BY 1, 2")
def dedupe_words(spark, d):
    base = page_boxes(spark, d)
    twin = base.withColumns({"x0": F.col("x0") + 0.5, "doctop": F.col("doctop") + 0.5, "seqno": F.col("seqno") + 1_000_000})
    both = base.unionByName(twin)
    kept = cluster.dedupe(both, PAGE, ["text"]).groupBy(*PAGE).agg(F.count("*").alias("n_after"))
    return both.groupBy(*PAGE).agg(F.count("*").alias("n_before")).join(kept, PAGE)


# ----------------------------------------------------------------------- spatial


@query(f"WITH {W}, s AS (SELECT doc_id, page_index, ln, min(x0) AS a, max(x1) AS b FROM w GROUP BY 1, 2, 3) SELECT x.doc_id, x.page_index, count(*) AS n_pairs FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.page_index = y.page_index AND x.ln < y.ln AND x.a < y.b AND y.a < x.b GROUP BY 1, 2")
def overlap_pairs(spark, d):
    spans = page_boxes(spark, d).groupBy(*PAGE, "ln").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    return spatial.overlapping_spans(spans, PAGE, "a", "b", "ln").groupBy(*PAGE).agg(F.count("*").alias("n_pairs"))


def _rects(w: DataFrame) -> DataFrame:
    cover = w.where("seqno % 7 = 0").withColumn("seqno", F.col("seqno") + 100_000)
    under = w.where("seqno % 11 = 0").withColumn("seqno", F.col("seqno") - 1)
    return cover.unionByName(under).select(*PAGE, "seqno", "x0", "top", "x1", "bottom").withColumn("rect_id", F.col("seqno"))


@query(f"WITH {W} SELECT doc_id, page_index, seqno FROM w WHERE seqno % 7 = 0")
def occluded_words(spark, d):
    w = page_boxes(spark, d)
    return spatial.occluded(w, _rects(w), PAGE).select(*PAGE, "seqno")


@query(f"WITH {W} SELECT doc_id, page_index, seqno + 100000 AS rect_id, text FROM w WHERE seqno % 7 = 0 AND NOT (length(text) > 1 AND replace(text, text[1], '') = '')")
def redaction_claims(spark, d):
    w = page_boxes(spark, d)
    return spatial.claims(w, _rects(w), PAGE).where(~tx.repeated_character(F.col("text")))


@query("WITH t AS (SELECT conv_id, turn, turn // 25 * 25 AS st FROM conversations) SELECT conv_id, turn, turn - st + 1 AS label_n FROM t")
def label_asof(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn").withColumn("start", F.when(F.col("turn") % 25 == 0, F.col("turn")))
    out = spatial.as_of(t, ["conv_id"], "turn", "start", "st")
    return out.select("conv_id", "turn", (F.col("turn") - F.col("st") + 1).alias("label_n"))


@query(f"WITH {W}, s AS (SELECT doc_id, page_index, ln, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM w GROUP BY 1, 2, 3), p AS (SELECT a.doc_id, a.page_index, a.ln, b.ln AS r_ln, b.top - a.bottom AS gap FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND b.top > a.bottom AND b.top - a.bottom <= 24) SELECT doc_id, page_index, ln, min_by(r_ln, gap) AS below, min(gap) AS gap FROM p GROUP BY 1, 2, 3")
def caption_nearest(spark, d):
    s = page_boxes(spark, d).groupBy(*PAGE, "ln").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    gap = F.col("r_top") - F.col("bottom")
    out = spatial.nearest(s, s.withColumn("below", F.col("ln")).drop("ln"), PAGE, gap, (gap > 0) & (gap <= 24), "below", "ln")
    return out.select(*PAGE, "ln", F.col("below"), "gap")


# ------------------------------------------------------------------------ tables

_EDGES = f"WITH {W}, r AS (SELECT doc_id, page_index, top, min(x0) AS x0, max(x1) AS x1, max(bottom) AS bottom, count(*) AS n FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2), g AS (SELECT doc_id, page_index, top, bottom, min(x0) OVER (PARTITION BY doc_id, page_index) AS x0, max(x1) OVER (PARTITION BY doc_id, page_index) AS x1 FROM r), h AS (SELECT DISTINCT doc_id, page_index, unnest([top, bottom]) AS top, x0, x1 FROM g)"
_V = "v AS (SELECT doc_id, page_index, 120.0 * unnest(range(0, (x1 // 120)::BIGINT + 1)) AS x FROM (SELECT doc_id, page_index, max(x1) AS x1 FROM h GROUP BY 1, 2))"
_P = "p AS (SELECT DISTINCT h.doc_id, h.page_index, x, top FROM h JOIN v ON h.doc_id = v.doc_id AND h.page_index = v.page_index AND x >= x0 - 1 AND x <= x1 + 1)"
_C = "c AS (SELECT doc_id, page_index, x AS x0, top, lead(x) OVER (PARTITION BY doc_id, page_index, top ORDER BY x) AS x1, lead(top) OVER (PARTITION BY doc_id, page_index, x ORDER BY top) AS bottom FROM p)"


@query(f"{_EDGES} SELECT doc_id, page_index, top, x0, x1 FROM h")
def edges_h(spark, d):
    return tables.word_rows(page_boxes(spark, d), PAGE)


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = page_boxes(spark, d)
    h = tables.word_rows(w, PAGE)
    reach = h.groupBy(*PAGE).agg(F.max("x1").alias("x1"))
    v = reach.select(*PAGE, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("x1") / 120)), lambda k: k * 120.0)).alias("x"), F.lit(0.0).alias("v0"), F.lit(1000.0).alias("v1"))
    return w, tables.crossings(h, v, PAGE)


_WORD = ["x0", "x1", "top", "bottom", "seqno", "text"]


def _page_cells(words: dict) -> dict:
    """The cells of one page between the edges of its rows and uprights 120 apart."""
    h = tables.edge_rows(words)
    x = np.arange(h["x1"].max() // 120 + 1 if len(h["x1"]) else 0) * 120.0
    return tables.page_cells(tables.page_crossings(h, {"x": x, "v0": np.zeros(len(x)), "v1": np.full(len(x), 1000.0)}))


@query(f"{_EDGES}, {_V}, {_P} SELECT doc_id, page_index, count(*) AS n FROM p GROUP BY 1, 2")
def intersections(spark, d):
    return _points(spark, d)[1].groupBy(*PAGE).agg(F.count("*").alias("n"))


@query(f"{_EDGES}, {_V}, {_P}, {_C} SELECT doc_id, page_index, count(*) AS n_cells, round(sum((x1 - x0) * (bottom - top)), 4) AS area FROM c WHERE x1 IS NOT NULL AND bottom IS NOT NULL GROUP BY 1, 2")
def cells(spark, d):
    made = tables.lattice_cells(_points(spark, d)[1], PAGE)
    return made.groupBy(*PAGE).agg(F.count("*").alias("n_cells"), F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))), 4).alias("area"))


@query(f"{_EDGES}, {_V}, {_P}, {_C} SELECT c.doc_id, c.page_index, c.x0 AS c0, c.top AS ct, sha256(string_agg(text, ' ' ORDER BY w.top, w.x0, seqno)) AS text_sha FROM c JOIN w ON w.doc_id = c.doc_id AND w.page_index = c.page_index AND (w.x0 + w.x1) / 2 >= c.x0 AND (w.x0 + w.x1) / 2 < c.x1 AND (w.top + w.bottom) / 2 >= c.top AND (w.top + w.bottom) / 2 < c.bottom GROUP BY 1, 2, 3, 4")
def cell_text(spark, d):
    made = per_batch(packed_words(docs(spark, d)), PAGE, _WORD, tables.texts_by(_page_cells, _WORD[:4]), "c0 double, ct double, text string")
    return made.select(*PAGE, "c0", "ct", F.sha2("text", 256).alias("text_sha"))


@query(None)
def largest_table(spark, d):
    made = per_page(packed_words(docs(spark, d)), PAGE, _WORD[:4], lambda w: tables.page_tables(_page_cells(w)), "x0 double, top double, x1 double, bottom double, table_id long")
    size = made.groupBy(*PAGE, "table_id").agg(F.count("*").alias("n_cells"), F.min("top").alias("top"), F.min("x0").alias("x0"))
    first = Window.partitionBy(*PAGE).orderBy(F.desc("n_cells"), "top", "x0")
    return size.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


# -------------------------------------------------------------------------- text

_TOK = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_Q = f"""q AS (SELECT doc_id, text, {_TOK} AS t FROM documents), s AS (SELECT doc_id, len(t) AS n_tokens,
  len(list_filter(t, lambda x: regexp_matches(x, '^[A-Za-z]{{3,}}$') AND regexp_matches(x, '[AEIOUaeiou]'))) AS wordlike,
  len(list_filter(t, lambda x: length(x) <= 2)) AS short, len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) AS digit,
  len(regexp_extract_all(text, '[!-/:-@\\[-`{{-~]')) AS symbols, len(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS non_ascii, len(regexp_extract_all(text, '[^\\x00-\\x20]')) AS visible FROM q)"""


@query(f"WITH {_Q} SELECT * FROM s")
def text_quality(spark, d):
    return docs(spark, d).select("doc_id", *[c.alias(n) for n, c in tx.quality(F.col("text")).items()])


@query(f"WITH {_Q} SELECT doc_id, round(greatest(0, least(1, 0.35 * short / n_tokens + 0.30 * symbols / visible + 0.20 * non_ascii / visible + 0.15 * digit / n_tokens - 0.25 * wordlike / n_tokens)) + 1e-9, 4)::DOUBLE AS noise FROM s WHERE n_tokens > 0")
def noise_score(spark, d):
    rows = QUERIES["text_quality"](spark, d).where("n_tokens > 0")
    share = lambda c, by: F.col(c) / F.col(by)
    return rows.select("doc_id", F.round(tx.noise(share("short", "n_tokens"), share("symbols", "visible"), share("non_ascii", "visible"), share("digit", "n_tokens"), share("wordlike", "n_tokens")) + 1e-9, 4).alias("noise"))


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS key_sha FROM documents")
def search_keys(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(tx.search_key(F.col("text")), 256).alias("key_sha"))


@query("SELECT doc_id, sha256(regexp_replace(lower(text), '[^\\pL\\pN]', '', 'g')) AS compact_sha FROM documents")
def compact_text(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(tx.compact(F.col("text")), 256).alias("compact_sha"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS n_tokens FROM documents")
def content_token_count(spark, d):
    return docs(spark, d).select("doc_id", F.size(tx.content_tokens(F.col("text"))).cast("long").alias("n_tokens"))


_TOKS = "len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''))"
_CLS = f"""CASE WHEN NOT regexp_matches(line, '\\S') THEN 'Empty' WHEN regexp_matches(line, '^\\s*[0-9]{{1,9}}[.)](\\s|$)') OR regexp_matches(line, '^\\s*[-*{tx.BULLETS}](\\s|$)') THEN 'ListItem'
  WHEN regexp_matches(line, '^\\s*[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\s*$') THEN 'EmailAddress'
  WHEN 2 * len(regexp_extract_all(line, '[A-Za-z]')) < len(regexp_extract_all(line, '\\S')) THEN 'Text'
  WHEN {_TOKS} <= 12 AND regexp_matches(line, '^\\s*[A-Z]') AND NOT regexp_matches(line, '[.!?,;:]\\s*$') THEN 'Title'
  WHEN {_TOKS} >= 5 AND regexp_matches(line, '[.!?]\\s*$') THEN 'NarrativeText' ELSE 'Text' END"""


@query(f"WITH {LINES} SELECT doc_id, ln, {_CLS} AS cls FROM l")
def element_class(spark, d):
    return lines(docs(spark, d)).select("doc_id", F.col("ln").cast("long").alias("ln"), tx.element_class(F.col("line")).alias("cls"))


@query(f"WITH {LINES}, k AS (SELECT doc_id, ln, CASE WHEN regexp_matches(line, '^\\s*[0-9]{{1,9}}[.)](\\s|$)') THEN 'numbered' WHEN regexp_matches(line, '^\\s*[-*{tx.BULLETS}](\\s|$)') THEN 'bullet' END AS kind FROM l), g AS (SELECT *, ln - row_number() OVER (PARTITION BY doc_id, kind ORDER BY ln) AS run FROM k WHERE kind IS NOT NULL) SELECT doc_id, kind, min(ln) AS first_ln, count(*) AS n FROM g GROUP BY doc_id, kind, run")
def list_runs(spark, d):
    rows = lines(docs(spark, d)).select("doc_id", F.col("ln").cast("long").alias("ln"), tx.list_kind(F.col("line")).alias("kind")).where("kind is not null")
    run = F.col("ln") - F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ln"))
    return rows.withColumn("run", run).groupBy("doc_id", "kind", "run").agg(F.min("ln").alias("first_ln"), F.count("*").alias("n")).drop("run")


@query(f"WITH {LINES} SELECT doc_id, ln, substr(sha256('doc' || doc_id || line || (ln // 10) || (ln % 10)), 1, 32) AS element_id FROM l")
def element_ids(spark, d):
    rows = lines(docs(spark, d))
    return rows.select("doc_id", F.col("ln").cast("long").alias("ln"), F.substring(F.sha2(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), "line", F.col("page_index").cast("string"), (F.col("ln") % 10).cast("string")), 256), 1, 32).alias("element_id"))


@query("SELECT p_partkey, CASE WHEN p_size >= 1.2 * m THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN p_size >= 1.2 * m THEN least(3, r) END::INT AS level FROM (SELECT p_partkey, p_brand, p_size, (SELECT median(p_size) FROM part b WHERE b.p_brand = a.p_brand) AS m, (SELECT count(DISTINCT p_size) FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size) AS r FROM part a)")
def heading_rank(spark, d):
    return layout.headings(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").select("p_partkey", "kind", "level")


_RUN = "' ' || array_to_string(list_filter(regexp_split_to_array(text, '[ \\x09-\\x0D]+'), lambda x: x <> ''), ' ') || ' '"


@query(f"""WITH b AS (SELECT item_id, {_RUN} AS run FROM benchmark), d AS (SELECT doc_id, {_RUN} AS run FROM documents)
SELECT b.item_id, d.doc_id FROM b JOIN d ON contains(d.run, b.run) AND trim(b.run) <> ''""")
def containment(spark, d):
    """Benchmark texts whose words, taken at all white space, are a contiguous run of a
    document's: candidates by the item's first three words, or all of a shorter one's,
    among the document's, then the exact test."""
    split = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    run = lambda w, i, n: F.concat_ws(" ", F.slice(w, i, n))
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    items = table(spark, d, "benchmark").select("item_id", split(F.col("text")).alias("part")).where(F.size("part") > 0)
    items = items.select("item_id", "part", F.least(F.size("part"), F.lit(3)).alias("n")).withColumn("k", run(F.col("part"), F.lit(1), F.col("n")))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # of 1, 2 and 3
    runs = docs(spark, d).select("doc_id", split(F.col("text")).alias("w"))
    every = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: run(F.col("w"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = runs.select("doc_id", F.explode(F.array_distinct(F.concat(*[every(n) for n in lengths or [3]]))).alias("k"))
    pairs = grams.join(items, "k").select("doc_id", "item_id", "part")
    out = pairs.join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return out.where(F.contains(spaced(split(F.col("text"))), spaced(F.col("part")))).select("item_id", "doc_id")


@query("WITH n AS (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_name IS NOT NULL GROUP BY 1) SELECT k AS a, p_partkey AS b, p_name AS a_text, p_name AS b_text, 0::BIGINT AS d FROM part JOIN n USING (p_name) UNION ALL SELECT x.k, y.k, x.p_name, y.p_name, levenshtein(x.p_name, y.p_name) FROM n x JOIN n y ON x.p_name < y.p_name WHERE levenshtein(x.p_name, y.p_name) <= 2")
def edit_distance(spark, d):
    return names.close_classes(table(spark, d, "part"), [], "p_partkey", "p_name", 2)


@query(f"WITH {LINES} SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def duplicate_lines(spark, d):
    out = lines(docs(spark, d)).where(F.trim("line") != "").groupBy("line").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return out.where("n_docs > 1")


@query("SELECT doc_id, 'native' AS src FROM documents WHERE n_chars >= 500 UNION ALL SELECT doc_id, 'second' FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 500)")
def fuse_union(spark, d):
    native = docs(spark, d).where("n_chars >= 500").select("doc_id")
    other = table(spark, d, "labels").where("quality = 1").select("doc_id").join(native, "doc_id", "left_anti")
    return native.withColumn("src", F.lit("native")).unionByName(other.withColumn("src", F.lit("second")))


@query("SELECT doc_id, CASE WHEN n = 0 THEN 'ocr' WHEN u * 10 > v THEN 'hybrid' ELSE 'native' END AS route, CASE WHEN n = 0 THEN 'no_text' WHEN u * 10 > v THEN 'symbols' ELSE 'trusted' END AS reason FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n, len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]')) AS u, len(regexp_extract_all(text, '[^\\x00-\\x20]')) AS v FROM documents)")
def plan_route(spark, d):
    q = tx.quality(F.col("text"))
    rows = docs(spark, d).select("doc_id", q["n_tokens"].alias("n"), q["symbols"].alias("u"), q["visible"].alias("v"))
    pick = lambda a, b, c: F.when(F.col("n") == 0, a).when(F.col("u") * 10 > F.col("v"), b).otherwise(c)
    return rows.select("doc_id", pick("ocr", "hybrid", "native").alias("route"), pick("no_text", "symbols", "trusted").alias("reason"))


@query("SELECT l_orderkey, l_linenumber, repeat('m', (q // 1000)::INT) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][q // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][q // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][q % 10 + 1] AS roman, repeat(chr((97 + (q - 1) % 26)::INT), ((q - 1) // 26 + 1)::INT) AS alpha FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 3000 + 1)::BIGINT AS q FROM lineitem)")
def page_labels(spark, d):
    n = F.col("l_orderkey") % 3000 + 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.roman(n).alias("roman"), tx.alpha(n).alias("alpha"))


# ------------------------------------------------------------------ object graphs


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1")
def latest_revision(spark, d):
    return graph.latest_revision(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT 'region' AS kind, 1::BIGINT AS n UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 UNION ALL SELECT 'order', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0")
def reachable(spark, d):
    ref = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    e = table(spark, d, "nation").select(ref("region", "n_regionkey").alias("src"), ref("nation", "n_nationkey").alias("dst"))
    e = e.union(table(spark, d, "customer").select(ref("nation", "c_nationkey"), ref("customer", "c_custkey")))
    e = e.union(table(spark, d, "orders").select(ref("customer", "o_custkey"), ref("order", "o_orderkey")))
    roots = spark.range(1).select(F.lit("region:0").alias("id"))
    return graph.reachable(roots, e, shared_folder(spark)).groupBy(F.substring_index("id", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT min(p_partkey) AS keep_key, count(*) AS n FROM part GROUP BY p_brand, p_type, p_size")
def identical_objects(spark, d):
    return graph.identical(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"]).select("keep_key", "n")


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inherit_attrs(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("c_custkey", graph.inherited(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("r_name")).alias("value"))


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.p <> b.p THEN 'changed' END AS change FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'F') a FULL JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderpriority END AS p FROM orders WHERE o_orderstatus <> 'O') b USING (o_orderkey)) WHERE change IS NOT NULL GROUP BY 1")
def incremental_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("p"))
    old, new = o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'O'").withColumn("p", F.when(F.col("o_totalprice") > 100000, F.lit("X")).otherwise(F.col("p")))
    return graph.diff(old, new, "o_orderkey", ["p"]).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS k, s_nationkey::BIGINT AS ref FROM supplier UNION ALL SELECT c_custkey + (SELECT max(s_suppkey) FROM supplier), c_nationkey + (SELECT max(s_suppkey) FROM supplier) FROM customer")
def merge_renumber(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("ref"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("ref"))
    return graph.append_renumbered(a, b, "k", ["ref"])


@query("WITH RECURSIVE e AS (SELECT c_custkey + 1000000 AS a, c_nationkey + 1000 AS b FROM customer UNION ALL SELECT n_nationkey + 1000, n_regionkey FROM nation), z AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS s FROM z UNION SELECT r.id, z.b FROM r JOIN z ON z.a = r.s) SELECT id, min(s) AS root FROM r GROUP BY 1")
def graph_components(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("a"), (F.col("c_nationkey") + 1000).cast("long").alias("b"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    return cluster.components(c.union(n), shared_folder(spark))


# ------------------------------------------------------------------------ outputs


@query(f"WITH {LINES} SELECT doc_id, sha256(string_agg((ln // 10 + 1) || ',' || (ln % 10) || ',' || CASE WHEN regexp_matches(line, '[\",\\r\\n]') THEN '\"' || replace(line, '\"', '\"\"') || '\"' ELSE line END, chr(10) ORDER BY ln)) AS csv_sha, count(*) AS n FROM l GROUP BY 1")
def doc_csv(spark, d):
    rows = lines(docs(spark, d)).select("doc_id", "ln", F.concat_ws(",", (F.col("page_index") + 1).cast("string"), (F.col("ln") % 10).cast("string"), tx.csv_field(F.col("line"))).alias("row"))
    return rows.groupBy("doc_id").agg(F.sha2(joined(["ln"], "row", "\n"), 256).alias("csv_sha"), F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, sha256('<TEI>' || string_agg(CASE WHEN ln % 10 = 0 THEN '<pb n=\"' || (ln // 10 + 1) || '\"/>' ELSE '' END || '<p>' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY ln) || '</TEI>') AS tei_sha FROM l GROUP BY 1")
def doc_tei(spark, d):
    page = F.when(F.col("ln") % 10 == 0, F.concat(F.lit('<pb n="'), (F.col("page_index") + 1).cast("string"), F.lit('"/>'))).otherwise("")
    rows = lines(docs(spark, d)).select("doc_id", "ln", F.concat(page, F.lit("<p>"), tx.escape_xml(F.col("line")), F.lit("</p>")).alias("x"))
    return rows.groupBy("doc_id").agg(F.sha2(F.concat(F.lit("<TEI>"), joined(["ln"], "x", ""), F.lit("</TEI>")), 256).alias("tei_sha"))


@query(f"WITH {LINES} SELECT doc_id, sha256(string_agg(regexp_replace(line, '([\\\\`*_\\[\\]#<>|])', '\\\\\\1', 'g'), chr(10) || chr(10) ORDER BY ln)) AS md_sha FROM l GROUP BY 1")
def doc_markdown(spark, d):
    rows = lines(docs(spark, d)).select("doc_id", "ln", tx.escape_markdown(F.col("line")).alias("x"))
    return rows.groupBy("doc_id").agg(F.sha2(joined(["ln"], "x", "\n\n"), 256).alias("md_sha"))


@query(f"WITH {LINES}, p AS (SELECT doc_id, ln // 10 AS page, string_agg(line, chr(10) ORDER BY ln) AS t FROM l GROUP BY 1, 2) SELECT doc_id, sha256(string_agg(t, chr(12) ORDER BY page) || chr(12)) AS text_sha, count(*) AS n_pages FROM p GROUP BY 1")
def doc_text(spark, d):
    pages = lines(docs(spark, d)).groupBy(*PAGE).agg(joined(["ln"], "line", "\n").alias("t"))
    return pages.groupBy("doc_id").agg(F.sha2(F.concat(joined(["page_index"], "t", "\f"), F.lit("\f")), 256).alias("text_sha"), F.count("*").alias("n_pages"))


@query(None)
def doc_json(spark, d):
    """The normalised record graph of each document as JSON: pages refer to nodes, nodes to lines."""
    rows = lines(docs(spark, d))
    ident = lambda kind, i: F.concat(F.lit("p"), (F.col("page_index") + 1).cast("string"), F.lit(f":{kind}:"), i.cast("string"))
    rows = rows.select("doc_id", "page_index", "ln", F.struct(ident("line", F.col("ln") % 10).alias("id"), F.col("line").alias("text")).alias("line"))
    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("all"))
    page = F.struct((F.col("page_index") + 1).alias("number"), F.transform("all", lambda x: x["line"]).alias("lines"))
    return pages.groupBy("doc_id").agg(F.to_json(F.struct(F.lit("5.0").alias("version"), F.transform(F.array_sort(F.collect_list(F.struct("page_index", page.alias("page")))), lambda p: p["page"]).alias("pages"))).alias("json"))


@query("SELECT conv_id, 'node-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS node_id, length('role: ' || role || chr(10) || 'turn: ' || turn || chr(10) || chr(10) || text) AS len_all, length(text) AS len_none FROM conversations")
def nodes(spark, d):
    c = table(spark, d, "conversations")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    whole = F.concat(F.lit("role: "), "role", F.lit("\nturn: "), F.col("turn").cast("string"), F.lit("\n\n"), "text")
    return c.select("conv_id", F.concat(F.lit("node-"), number.cast("string")).alias("node_id"), F.char_length(whole).cast("long").alias("len_all"), F.char_length("text").cast("long").alias("len_none"))


@query(None)
def page_elements(spark, d):
    return elements(table(spark, d, "pages"))


# ---------------------------------------------------------------------- functions


@query("SELECT l_orderkey, l_linenumber, round(0.2 + power(least(1, greatest(0, l_discount)), 2.0) * 0.6, 6) AS y FROM lineitem")
def fn_exponential(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(num.exponential(F.col("l_discount"), 0.2, 0.8, 2), 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount < 0.05 THEN l_discount / 0.05 ELSE power(1 - (l_discount - 0.05) / 0.95, 2.0) END, 6) AS y FROM lineitem")
def fn_stitched(spark, d):
    y = num.stitched(F.col("l_discount"), [lambda x: num.exponential(x, 0, 1, 1), lambda x: num.exponential(x, 0, 1, 2)], [0.05], [(0, 1), (1, 0)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(y, 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > l_tax THEN l_discount - l_tax ELSE sqrt(l_tax) * 2 END, 6) AS y FROM lineitem")
def fn_calculator(spark, d):
    y = num.calculator("copy:2 gt { sub } { exch pop sqrt 2 mul } ifelse", F.col("l_discount"), F.col("l_tax"))[-1]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(y, 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount * 10 < 0.5 THEN l_discount * 20 ELSE 1 - (l_discount * 10 - 0.5) END, 6) AS y FROM lineitem")
def fn_sampled(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(num.sampled(F.col("l_discount") * 10, [0.0, 1.0, 0.5]), 6).alias("y"))


_BLEND = {
    "Normal": "s", "Multiply": "b * s", "Screen": "b + s - b * s", "Overlay": "CASE WHEN b <= 0.5 THEN 2 * s * b ELSE s + (2 * b - 1) - s * (2 * b - 1) END", "Darken": "least(b, s)", "Lighten": "greatest(b, s)",
    "ColorDodge": "CASE WHEN b = 0 THEN 0 WHEN s >= 1 THEN 1 ELSE least(1, b / (1 - s)) END", "ColorBurn": "CASE WHEN b >= 1 THEN 1 WHEN s <= 0 THEN 0 ELSE 1 - least(1, (1 - b) / s) END",
    "HardLight": "CASE WHEN s <= 0.5 THEN 2 * s * b ELSE b + (2 * s - 1) - b * (2 * s - 1) END", "SoftLight": "CASE WHEN s <= 0.5 THEN b - (1 - 2 * s) * b * (1 - b) ELSE b + (2 * s - 1) * ((CASE WHEN b <= 0.25 THEN ((16 * b - 12) * b + 4) * b ELSE sqrt(b) END) - b) END",
    "Difference": "abs(b - s)", "Exclusion": "b + s - 2 * b * s",
}


@query("WITH v AS (SELECT l_discount * 10 AS b, l_tax * 12.5 AS s FROM lineitem) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, round(avg(({e})::DOUBLE), 6) AS mean, round(min(({e})::DOUBLE), 6) AS low, round(max(({e})::DOUBLE), 6) AS high FROM v" for m, e in _BLEND.items()))
def blend_modes(spark, d):
    b, s = F.col("l_discount") * 10, F.col("l_tax") * 12.5
    rows = table(spark, d, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), num.blend(m, b, s).cast("double").alias("y")) for m in num.MODES])).alias("v")).select("v.*")
    return rows.groupBy("mode").agg(F.round(F.avg("y"), 6).alias("mean"), F.round(F.min("y"), 6).alias("low"), F.round(F.max("y"), 6).alias("high"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax * 12.5 <= 0.0031308 THEN 12.92 * l_tax * 12.5 ELSE 1.055 * power(l_tax * 12.5, 1 / 2.4) - 0.055 END, 6) AS srgb, round(0.3 * l_tax + 0.59 * l_discount + 0.11 * 0.5, 6) AS lum FROM lineitem")
def colour(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(num.linear_to_srgb(F.col("l_tax") * 12.5), 6).alias("srgb"), F.round(num.luminosity(F.col("l_tax"), F.col("l_discount"), F.lit(0.5)), 6).alias("lum"))


@query("SELECT event_type, round(median(value), 6) AS m FROM events WHERE isfinite(value) GROUP BY 1")
def finite_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(num.finite_median(F.col("value")), 6).alias("m"))


# ------------------------------------------------------- characters, trees, votes


@query(f"WITH {W} SELECT doc_id, page_index, count(*) AS n_words, sum(x1) AS sum_x1, sum(length(text)) AS n_chars FROM w GROUP BY 1, 2")
def chars_words(spark, d):
    made = wd.chars_to_words(packed_chars(docs(spark, d)), PAGE)
    return made.groupBy(*PAGE).agg(F.count("*").alias("n_words"), F.sum("x1").alias("sum_x1"), F.sum(F.char_length("text")).alias("n_chars"))


@query(f"WITH {W}, r AS (SELECT doc_id, page_index, ln, string_agg(text, ' ' ORDER BY wi) AS t FROM w GROUP BY ALL) SELECT doc_id, page_index, sha256(string_agg(t, chr(10) ORDER BY ln)) AS text_sha FROM r GROUP BY 1, 2")
def chars_text(spark, d):
    return wd.simple_text(packed_chars(docs(spark, d)), PAGE).select(*PAGE, F.sha2("text", 256).alias("text_sha"))


@query(f"WITH {W}, m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page_index ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w) SELECT doc_id, page_index, greatest(0, coalesce(max(x0 - p), 0)) AS gap FROM m GROUP BY 1, 2")
def projection_gap(spark, d):
    return wd.largest_gap(page_boxes(spark, d), PAGE)


@query(f"WITH {LINES}, p AS (SELECT doc_id, ln // 10 AS page_index, 12.0 * (ln % 10) AS top, line FROM l) SELECT doc_id, page_index, coalesce(string_agg(line, chr(10) ORDER BY top) FILTER (length(line) <= 240 AND top + 10 <= 14.4), '') AS header, coalesce(string_agg(line, chr(10) ORDER BY top) FILTER (length(line) <= 240 AND NOT top + 10 <= 14.4 AND top >= 105.6), '') AS footer FROM p GROUP BY 1, 2")
def header_footer(spark, d):
    top = (F.col("ln") % 10) * 12.0
    rows = lines(docs(spark, d)).select(*PAGE, top.alias("top"), (top + 10).alias("bottom"), F.col("line").alias("text"))
    return wd.margins(rows, PAGE, 120.0)


@query("SELECT 'c' || c_custkey AS id, r_name || '.' || n_name || '.' || c_name AS name, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || n_nationkey, r_name || '.' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name, 0 FROM region")
def qualified_names(spark, d):
    ref = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    t = table(spark, d, "region").select(ref("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    t = t.union(table(spark, d, "nation").select(ref("n", "n_nationkey"), ref("r", "n_regionkey"), "n_name"))
    t = t.union(table(spark, d, "customer").select(ref("c", "c_custkey"), ref("n", "c_nationkey"), "c_name"))
    return trees.walk(t, "name").select("id", trees.qualified(F.col("path")).alias("name"), "depth")


@query("WITH v AS (SELECT l_suppkey, l_linestatus, count(*) AS votes FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(votes) OVER (PARTITION BY l_suppkey) AS s, rank() OVER (PARTITION BY l_suppkey ORDER BY votes DESC) AS k FROM v), t AS (SELECT *, count(*) FILTER (k = 1) OVER (PARTITION BY l_suppkey) AS ties FROM r) SELECT l_suppkey, l_linestatus, votes FROM t WHERE k = 1 AND ties = 1 AND votes >= 2 AND votes >= 0.5 * s")
def font_votes(spark, d):
    return trees.majority(table(spark, d, "lineitem").select("l_suppkey", "l_linestatus"), ["l_suppkey"], "l_linestatus", share=0.5)


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), k AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE trim(ch, ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY 1, 2), s AS (SELECT doc_id, sum(n) AS v, max(n) AS m, coalesce(sum(n) FILTER (regexp_matches(ch, '[A-Za-z0-9]')), 0) AS a FROM k GROUP BY 1) SELECT doc_id, round((a + least(v - a, a / 4.0)) * 0.8 * (1 - greatest(0, m * 1.0 / v - 0.3)) + 1e-9, 3)::DOUBLE AS utility FROM s")
def text_utility(spark, d):
    """Letters and digits, with symbols up to a quarter of them, weighed by confidence and repetition."""
    c = docs(spark, d).select("doc_id", F.explode(F.split("text", "")).alias("ch")).where(F.col("ch").rlike(r"[^ \n\t\r]"))
    k = c.groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    s = k.groupBy("doc_id").agg(F.sum("n").alias("v"), F.max("n").alias("m"), F.sum(F.when(F.col("ch").rlike("[A-Za-z0-9]"), F.col("n")).otherwise(0)).alias("a"))
    u = (F.col("a") + F.least(F.col("v") - F.col("a"), F.col("a") / 4.0)) * 0.8 * (1 - F.greatest(F.lit(0.0), F.col("m") / F.col("v") - 0.3))
    return s.select("doc_id", F.round(u + 1e-9, 3).alias("utility"))


# ------------------------------------------------------------- layout and streams


@query(None)
def xy_cut_order(spark, d):
    b = page_boxes(spark, d).groupBy(*PAGE, "ln").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return layout.reading_order(b, PAGE, "ln")


@query(None)
def topological_order(spark, d):
    b = page_boxes(spark, d).groupBy(*PAGE, "ln").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return layout.reading_order(b, PAGE, "ln", "topological")


@query(f"WITH {W}, m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page_index ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w) SELECT doc_id, page_index, 1 + count(*) FILTER (p IS NOT NULL AND x0 > p + 24) AS n_columns FROM m GROUP BY 1, 2")
def column_bands(spark, d):
    return layout.columns_of(page_boxes(spark, d), PAGE).groupBy(*PAGE).agg(F.count("*").alias("n_columns"))


@query("SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_hours(spark, d):
    return event_windows(table(spark, d, "events")).select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 minute THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    return sessions(table(spark, d, "events")).select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


from . import grid_queries, native_queries, page_queries, record_queries, structure_queries, text_queries  # noqa: E402, F401  (register their queries)
