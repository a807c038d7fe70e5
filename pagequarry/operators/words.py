"""Characters to words, lines and text, many pages at a time; gaps and margins by windows of a page."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import Packed, chained, in_order, joined, numbers, per_batch, starts


def _rows(group: np.ndarray, c: dict, y_tolerance: float) -> tuple[np.ndarray, ...]:
    """The characters' order by group, row (chain clusters of top) and x0, and their groups and rows in it."""
    row = chained(group, numbers(c["top"]).astype(float), y_tolerance)
    order = in_order(row, numbers(c["x0"]), numbers(c["seqno"]))
    return order, group[order], row[order]


def _of_kind(text: pa.Array, test: Callable[[str | None], bool]) -> np.ndarray:
    """A test of each text, done once for equal ones."""
    coded = text.dictionary_encode(null_encoding="encode")
    return np.array([test(t) for t in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy(zero_copy_only=False)]


def chars_to_words(chars: DataFrame | Packed, keys: list[str], x_tolerance: float = 3.0, y_tolerance: float = 3.0, keep_blanks: bool = False, split_at: str = "") -> DataFrame:
    """keys, word, text, x0, x1, top, bottom.

    Characters on one row (chain clusters of top) go by x0. A word ends where the
    next character lies left of the last one's start, more than the tolerance
    right of its end, or off its row by more than the tolerance; blanks end a
    word and vanish unless kept; every sign in ``split_at`` is a word by itself.
    """

    def run(group: np.ndarray, c: dict, n: int) -> tuple[np.ndarray, list]:
        if not len(group):
            return group, [[]] * 6
        order, g, row = _rows(group, c, y_tolerance)
        x0, x1, top, bottom = (numbers(c[k])[order] for k in ("x0", "x1", "top", "bottom"))
        text = c["text"].take(pa.array(order))
        blank = _of_kind(text, lambda t: t is None or not t.strip(" ")) & (not keep_blanks)
        alone = _of_kind(text, lambda t: bool(t) and t in split_at)
        new = starts(row)
        near = (x0[1:] >= x0[:-1]) & (x0[1:] <= x1[:-1] + x_tolerance) & (np.abs(top[1:] - top[:-1]) <= y_tolerance)
        new[1:] |= ~near | blank[:-1] | alone[1:] | alone[:-1]
        word, seen = np.cumsum(new)[~blank], ~blank
        first = np.flatnonzero(starts(word))
        if not len(first):
            return g[:0], [[]] * 6
        at = g[seen][first]
        number = np.arange(len(at)) - np.maximum.accumulate(np.where(starts(at), np.arange(len(at)), 0)) + 1
        least, most = (lambda v: np.fmin.reduceat(v[seen], first)), (lambda v: np.fmax.reduceat(v[seen], first))
        return at, [number, joined(text.filter(pa.array(seen)), first), least(x0), most(x1), least(top), most(bottom)]

    kind = dict(chars.dtypes)
    more = "word long, text string, " + ", ".join(f"{k} {kind[k]}" for k in ("x0", "x1", "top", "bottom"))
    return per_batch(chars, keys, ["text", "x0", "x1", "top", "bottom", "seqno"], run, more)


def simple_text(chars: DataFrame | Packed, keys: list[str], x_tolerance: float = 3.0, y_tolerance: float = 3.0) -> DataFrame:
    """keys and text: rows from top to bottom, a space where characters are farther apart than the tolerance."""

    def run(group: np.ndarray, c: dict, n: int) -> tuple[np.ndarray, list]:
        if not len(group):
            return group, [[]]
        order, g, row = _rows(group, c, y_tolerance)
        x0, x1 = numbers(c["x0"])[order], numbers(c["x1"])[order]
        page = starts(g)
        before = np.full(len(g), 0)
        before[1:][x0[1:] > x1[:-1] + x_tolerance] = 1
        before[starts(row)] = 2
        before[page] = 0
        text = pc.binary_join_element_wise(pa.array(["", " ", "\n"]).take(pa.array(before)), c["text"].take(pa.array(order)).fill_null(""), "")
        first = np.flatnonzero(page)
        return g[first], [joined(text, first)]

    return per_batch(chars, keys, ["text", "x0", "x1", "top", "seqno"], run, "text string")


def largest_gap(objects: DataFrame, keys: list[str], start: str = "x0", end: str = "x1") -> DataFrame:
    """keys, gap: the widest empty span between the objects' intervals (0 for none)."""
    order = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = objects.withColumn("_g", F.col(start) - F.max(end).over(order))
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.coalesce(F.max("_g"), F.lit(0.0))).alias("gap"))


def margins(lines: DataFrame, keys: list[str], height: float, share: float = 0.12, longest: int = 240) -> DataFrame:
    """keys, header, footer: texts of short lines in the top and bottom share of the page, joined in order."""
    short = F.char_length("text") <= longest
    part = F.when(short & (F.col("bottom") <= height * share), "header").when(short & (F.col("top") >= height * (1 - share)), "footer")
    rows = lines.withColumn("_part", part)
    text = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_part") == p, F.struct("top", "text")))), lambda r: r["text"]), "\n")
    return rows.groupBy(*keys).agg(text("header").alias("header"), text("footer").alias("footer"))
