"""Page objects from text and HTML tables.

A line of text is a row of words on a fixed pitch of 6 by 12 units; ten lines
make a page. Whole pages are hash-partitioned once, so page-level windows and
groups need no further exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import Packed, starts, strings, utf8

PITCH, LEADING, LINES = 6, 12, 10


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("ln", "line")).withColumn("page_index", F.floor(F.col("ln") / LINES).cast("long"))


def pages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, page_index, ls: the lines of whole pages, dealt out by page."""
    cut = lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / LINES).cast("int")), lambda p: F.slice(ls, p * LINES + 1, LINES))
    of_text = F.transform(F.array(F.split("text", "\n", -1)), cut)[0]  # the lines are split once, however often they are named
    made = docs.select(key, F.posexplode(of_text).alias("page_index", "ls")).withColumn("page_index", F.col("page_index").cast("long"))
    return made.repartition(key, "page_index")


def line_boxes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, page_index, ln, x0, x1, top, bottom, text of each line with a word: the union of
    its words' boxes and their texts in order, without a row for each word."""
    text = F.array_join(F.filter(F.split("line", " "), lambda w: w != ""), " ")
    rows = pages(docs, key).select(key, "page_index", F.posexplode("ls").alias("i", "line")).select(key, "page_index", "i", text.alias("text")).where("text <> ''")
    top = F.col("i") * float(LEADING)
    return rows.select(key, "page_index", (F.col("page_index") * LINES + F.col("i")).alias("ln"), F.lit(0.0).alias("x0"), (F.char_length("text") * float(PITCH)).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"), "text")


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
    """The words of pages of lines, in order, as ``words`` has them."""
    groups = batch.column("_rows")
    n = pc.list_value_length(groups).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    page, i = np.repeat(np.arange(len(groups)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    parts = pc.split_pattern(groups.flatten(), " ")
    line = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    text = parts.flatten()
    full = pc.binary_length(text).to_numpy(zero_copy_only=False) > 0
    text, line = text.filter(pa.array(full)), line[full]
    long = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(long + 1) - (long + 1)
    since = lambda new, v: v - np.maximum.accumulate(np.where(new, v, 0))
    at, g = np.arange(len(line)), page[line]
    x0, top = since(starts(line), before) * float(PITCH), i[line] * float(LEADING)
    return g, {"i": i[line], "wi": since(starts(line), at), "text": text, "x0": x0, "x1": x0 + long * float(PITCH), "top": top, "bottom": top + 10.0, "seqno": since(starts(g), at) + 1}


def _chars_of(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
    """The characters of the words of pages of lines."""
    g, w = _words_of(batch)
    offsets, data = utf8(w["text"])
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    word = np.searchsorted(offsets, begin, side="right") - 1
    i = np.arange(len(begin)) - np.searchsorted(begin, offsets[:-1])[word]
    x0 = w["x0"][word] + i * float(PITCH)
    return g[word], {"i": w["i"][word], "seqno": w["seqno"][word] * 100_000 + i, "text": strings(np.append(begin, len(data)), data), "x0": x0, "x1": x0 + PITCH, "top": w["top"][word], "bottom": w["bottom"][word]}


def packed_words(docs: DataFrame, key: str = "doc_id") -> Packed:
    """The rows of ``words`` (without ln and doctop, i is the line on the page), packed by page."""
    kinds = [("i", "bigint"), ("wi", "bigint"), ("text", "string"), ("x0", "double"), ("x1", "double"), ("top", "double"), ("bottom", "double"), ("seqno", "bigint")]
    return Packed(pages(docs, key).withColumnRenamed("ls", "_rows"), _words_of, kinds)


def packed_chars(docs: DataFrame, key: str = "doc_id") -> Packed:
    """The characters of all words, each a PITCH wide, packed by page."""
    kinds = [("i", "bigint"), ("seqno", "bigint"), ("text", "string"), ("x0", "double"), ("x1", "double"), ("top", "double"), ("bottom", "double")]
    return Packed(pages(docs, key).withColumnRenamed("ls", "_rows"), _chars_of, kinds)


def words(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, page_index, ln, wi, text, x0, x1, top, bottom, doctop, seqno.

    Whole pages are dealt out before words are made of them, so that the exchange moves
    ten lines of text instead of a row for each word."""
    rows = pages(docs, key).select(key, "page_index", F.posexplode("ls").alias("i", "line"))
    rows = rows.withColumn("ln", F.col("page_index") * LINES + F.col("i"))
    rows = rows.select(key, "page_index", "ln", "i", F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("wi", "text")).withColumn("n", F.char_length("text"))
    before = Window.partitionBy(key, "page_index", "ln").orderBy("wi").rowsBetween(Window.unboundedPreceding, -1)
    page = Window.partitionBy(key, "page_index").orderBy("ln", "wi")
    x0 = F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)) * float(PITCH)
    top = F.col("i") * float(LEADING)
    return rows.select(
        key, "page_index", "ln", F.col("wi").cast("long").alias("wi"), "text", x0.alias("x0"), (x0 + F.col("n") * float(PITCH)).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"),
        (F.col("ln") * float(LEADING)).alias("doctop"), F.row_number().over(page).cast("long").alias("seqno"),
    )


def elements(pages: DataFrame) -> DataFrame:
    """page_id, n, kind and text of the block elements of HTML pages, in order."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:p|h[1-6]|li|td|title)(?:\s[^>]*)?>.*?(?=</?(?:p|h[1-6]|li|td|title|ul|ol|table|body|html|div)\b)"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("n", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    kind = F.when(tag == "title", "Title").when(tag.rlike("^h[1-6]$"), "Title").when(tag == "li", "ListItem").when(tag == "td", "Cell").otherwise("Paragraph")
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), kind.alias("kind"), text.alias("text")).where("text <> ''")
