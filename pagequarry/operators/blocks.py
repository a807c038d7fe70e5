"""Lines and blocks of a page: grouping, sizes, context, decoration, lists, parents, fixed-width text.

All of it runs on one page (or one document's elements) per key, by windows and
equal-key joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .spatial import box_join


def ordered_text(order: list[str], text: str, sep: str) -> Column:
    """Aggregate: texts joined in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), sep)


def line_groups(words: DataFrame, keys: list[str], order: str, rotation: str | None = None, explicit: str | None = None) -> DataFrame:
    """A line number for each word: a new line starts at an explicit break, a change of
    rotation, or where the middle moves by more than max(2, 0.65 of the smaller height)."""
    page = Window.partitionBy(*keys).orderBy(order)
    middle, height = (F.col("top") + F.col("bottom")) / 2, F.col("bottom") - F.col("top")
    far = F.abs(middle - F.lag(middle).over(page)) > F.greatest(F.lit(2.0), F.least(height, F.lag(height).over(page)) * 0.65)
    new = F.coalesce(far, F.lit(True))
    if rotation:
        new = new | (F.col(rotation) != F.lag(rotation).over(page))
    if explicit:
        new = new | F.col(explicit)
    rows = words.withColumn("_new", F.coalesce(new, F.lit(False)).cast("long"))
    return rows.withColumn("line", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def size_medians(words: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """keys and the median of the positive finite sizes, the middle pair averaged."""
    good = (F.col(size) > 0) & (F.col(size) < float("inf"))
    return words.groupBy(*keys).agg(F.percentile(F.when(good, F.col(size)), F.lit(0.5)).alias("median"))


def char_width(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the mean width of a character, weighed by length of text."""
    n = F.char_length("text")
    return words.groupBy(*keys).agg(F.try_divide(F.sum(F.col("x1") - F.col("x0")), F.sum(n)).alias("char_width"))


def full_width(blocks: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Blocks at least as wide as the share of the page's extent."""
    page = Window.partitionBy(*keys)
    extent = F.max("x1").over(page) - F.min("x0").over(page)
    return blocks.withColumn("full_width", F.col("x1") - F.col("x0") >= extent * share)


def crossing_counts(boxes: DataFrame, keys: list[str], step: float) -> DataFrame:
    """keys, sample and the number of boxes that hold it strictly inside, samples being
    multiples of the step. Each box names its samples, so no range join is needed."""
    first, last = F.floor(F.col("x0") / step) + 1, F.ceil(F.col("x1") / step) - 1
    inside = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return boxes.select(*keys, F.explode(inside).alias("sample")).groupBy(*keys, "sample").agg(F.count("*").alias("n"))


def captions(figures: DataFrame, texts: DataFrame, keys: list[str], ident: str, least_overlap: float = 0.3) -> DataFrame:
    """For each figure the nearest text above or below it on the page: horizontal overlap
    of at least the share, gap of at most max(24, 2.5 heights of the text); of equals the first above."""
    r = texts.withColumnsRenamed({c: f"r_{c}" for c in texts.columns if c not in keys})
    a, b = Box.of(), Box.of("r_")
    above, below = a.top - b.bottom, b.top - a.bottom
    gap = F.when(above >= 0, above).when(below >= 0, below)
    reach = F.greatest(F.lit(24.0), b.height * 2.5)
    pairs = figures.join(r, keys).where((gap <= reach) & (b.horizontal_share(a) >= least_overlap)).withColumns({"_gap": gap, "_under": (above < 0).cast("int")})
    best = F.min_by(F.struct("r_text", "_gap"), F.struct("_gap", "_under", "r_top", "r_x0"))
    return pairs.groupBy(*keys, ident).agg(best.alias("b")).select(*keys, ident, F.col("b.r_text").alias("caption"), F.col("b._gap").alias("gap"))


def under_heading(elements: DataFrame, keys: list[str], order: str, heading: Column, out: str = "heading") -> DataFrame:
    """Each element with the text of the last heading before it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn(out, F.last(F.when(heading, F.col("text")), ignorenulls=True).over(before))


def decorations(words: DataFrame, rules: DataFrame, keys: list[str], ident: str, cover: float = 0.75, window: float = 2.5) -> DataFrame:
    """keys, ident, underline, strikeout: thin rules (at least 2 wide, at most 2.5 high) that
    cover the share of a word's width, near its lower edge or its middle."""
    thin = rules.where((F.col("x1") - F.col("x0") >= 2) & (F.col("bottom") - F.col("top") <= 2.5))
    pairs = box_join(words.withColumns({"_b": F.col("bottom"), "bottom": F.col("bottom") + window}), thin, keys)
    at, width = (F.col("r_top") + F.col("r_bottom")) / 2, F.col("x1") - F.col("x0")
    over = F.least("x1", F.col("r_x1")) - F.greatest("x0", F.col("r_x0"))
    middle = (F.col("top") + F.col("_b")) / 2
    hits = pairs.where((width > 0) & (over >= width * cover)).groupBy(*keys, ident)
    return hits.agg(F.bool_or(F.abs(at - F.col("_b")) <= window).alias("underline"), F.bool_or(F.abs(at - middle) <= (F.col("_b") - F.col("top")) * 0.15).alias("strikeout")).where("underline or strikeout")


def linked(boxes: DataFrame, links: DataFrame, keys: list[str], threshold: float = 0.9) -> DataFrame:
    """Pairs of a text box and a link of which more than the threshold lies in the box; links without area never."""
    return box_join(boxes, links, keys).where(Box.of("r_").share_of_self(Box.of()) > threshold)


def outside_tables(lines: DataFrame, tables: DataFrame, keys: list[str], ident: str, share: float = 0.9) -> DataFrame:
    """Lines without those that lie in a table by the share and whose tokens it holds. The
    tables of a page stand beside each of its lines, so no line is moved more than once."""
    t = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    own, box = Box.of(), ["x0", "top", "x1", "bottom"]
    whole = (own.x0 <= own.x1) & (own.top <= own.bottom)
    for c in (own.x0, own.x1, own.top, own.bottom):
        whole &= ~F.isnan(c.cast("double")) & (F.abs(c) != float("inf"))
    beside = tables.select(*keys, F.struct(*box, t(F.col("text")).alias("tokens")).alias("_r")).groupBy(*keys).agg(F.collect_list("_r").alias("_tables"))

    def holds(r: Column) -> Column:
        other = Box(*[r[c] for c in box])
        within = own.overlaps(other) & (own.share_of_self(other) >= share)
        return F.when(within, F.size(F.array_except(t(F.col("text")), r["tokens"])) == 0)

    rows = lines.join(beside, keys, "left").withColumn("_in", whole & F.exists("_tables", holds)).drop("_tables")
    inside = F.bool_or("_in").over(Window.partitionBy(*keys, ident))
    return rows.withColumn("_in", F.coalesce(inside, F.lit(False))).where("not _in").select(*lines.columns)


def marked_content(chars: DataFrame, elements: DataFrame, keys: list[str], order: str = "seqno") -> DataFrame:
    """Structure elements (keys, mcid, element) with text and box of their characters; an
    element's own box, where it has one (a0, a1, a2, a3), takes the place of the union."""
    made = chars.where("mcid is not null").join(elements, [*keys, "mcid"]).groupBy(*keys, "element")
    own = [F.first(c, ignorenulls=True).alias(c) for c in ("a0", "a1", "a2", "a3") if c in elements.columns]
    out = made.agg(ordered_text([order], "text", "").alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), *own)
    if not own:
        return out
    return out.withColumns({c: F.coalesce(a, c) for a, c in zip(("a0", "a1", "a2", "a3"), ("x0", "top", "x1", "bottom"))}).drop("a0", "a1", "a2", "a3")


def parents(elements: DataFrame, keys: list[str], order: str, rank: Column, most: int, ident: str, out: str = "parent_id") -> DataFrame:
    """The id of the nearest earlier element of a smaller rank (1 .. ``most``); rows of a
    null rank take the nearest ranked one. One running last per rank instead of a stack."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = elements.withColumn("_k", rank)
    seen = {k: F.last(F.when(F.col("_k") == k, F.struct(F.col(order).alias("o"), F.col(ident).alias("i"))), ignorenulls=True).over(before) for k in range(1, most + 1)}
    rows = rows.withColumns({f"_p{k}": v for k, v in seen.items()})
    own = F.coalesce(F.col("_k"), F.lit(most + 1))
    options = F.array(*[F.when(own > k, F.col(f"_p{k}")) for k in seen])
    last = F.array_max(F.filter(options, lambda p: p.isNotNull()))
    return rows.withColumn(out, last["i"]).drop("_k", *[f"_p{k}" for k in seen])


def combined_lists(lines: DataFrame, keys: list[str], order: str, item: Column, continues: Column) -> DataFrame:
    """Lines with those that continue a list item joined to it: keys, first, kind, text, n."""
    doc = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumns({"_item": item, "_more": continues & ~item})
    start = ~F.col("_more")
    rows = rows.withColumn("_g", F.sum(start.cast("long")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.first("_item").over(Window.partitionBy(*keys, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_in", head).withColumn("_g", F.when(F.col("_in"), F.concat(F.lit("i"), F.col("_g").cast("string"))).otherwise(F.concat(F.lit("l"), F.col(order).cast("string"))))
    return rows.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.bool_or("_item").alias("is_item"), ordered_text([order], "text", " ").alias("text"), F.count("*").alias("n")).drop("_g")


def fixed_width(words: DataFrame, keys: list[str], width: float) -> DataFrame:
    """keys and text: each word at the column of its left edge, at least one space after
    the word before; rows from top to bottom, an empty row for each missing line of the page.

    A word starts at max(column, end of the last + 1), which is a running maximum of
    column less the room that the words before take, so windows do without a fold.
    """
    row = Window.partitionBy(*keys, "ln").orderBy("x0", "seqno")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    rows = words.select(*keys, "ln", "x0", "seqno", "text", F.floor(F.col("x0") / width).alias("_c"), F.char_length("text").alias("_n"))
    rows = rows.withColumn("_s", F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0)))
    rows = rows.withColumn("_at", F.col("_s") + F.max(F.col("_c") - F.col("_s")).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.lag(F.col("_at") + F.col("_n")).over(row)
    rows = rows.withColumn("_t", F.concat(F.repeat(F.lit(" "), (F.col("_at") - F.coalesce(end, F.lit(0))).cast("int")), "text"))
    lines = rows.groupBy(*keys, "ln").agg(ordered_text(["x0", "seqno"], "_t", "").alias("_l"))
    page = Window.partitionBy(*keys).orderBy("ln")
    skipped = F.coalesce(F.col("ln") - F.lag("ln").over(page) - 1, F.lit(0)).cast("int")
    lines = lines.withColumn("_l", F.concat(F.repeat(F.lit("\n"), skipped), "_l"))
    return lines.groupBy(*keys).agg(ordered_text(["ln"], "_l", "\n").alias("text"))
