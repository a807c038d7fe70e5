"""Records of a document beside its page text: items of name and number trees, fields, links,
attached files, table rows and titles, runs, candidates, outcomes of a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import Box
from .blocks import outside_tables
from .graph import resolve_destinations
from .spatial import box_join, overlapping_spans
from .trees import descend, walk


def tree_items(nodes: DataFrame, numbers: bool = False) -> DataFrame:
    """id, path, place, key, value of the entries of a tree of (id, parent, ord, entries): nodes
    in pre-order (``path`` of the ords from the root), entries as key, value, key, value.

    An entry without a value, or with a key that is null or, in a number tree, no whole
    number, is left out. One join a level; a node on a cycle hangs below no root."""
    paths = walk(nodes.select("id", "parent", "ord"), "ord").select("id", "path")
    entries = F.col("entries")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size(entries)), lambda i: (i % 2 == 0) & (i + 1 < F.size(entries))), lambda i: F.struct(F.get(entries, i).alias("key"), F.get(entries, i + 1).alias("value")))
    rows = nodes.where("entries is not null").select("id", F.posexplode(pairs).alias("place", "_p"))
    key = F.expr("try_cast(_p.key as bigint)") if numbers else F.col("_p.key")
    return rows.join(paths, "id").select("id", "path", F.col("place").cast("long").alias("place"), key.alias("key"), F.col("_p.value").alias("value")).where("key is not null")


def named_destinations(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """key, value, page: the entries of a name tree with the page that each value names
    (pages: value, page), null where there is none."""
    return resolve_destinations(tree_items(nodes), pages, [], "value", "page").select("key", "value", "page")


def find_all(nodes: DataFrame, role: str | None = None, pattern: str | None = None, name: str = "role") -> DataFrame:
    """Nodes (id, parent, ord) with the role, or a role that the pattern finds, with their pre-order ``path``."""
    if role is not None and pattern is not None:
        raise ValueError("either a role or a pattern")
    found = nodes if role is None and pattern is None else nodes.where(F.col(name) == role if role is not None else F.col(name).rlike(pattern))
    return found.join(walk(nodes.select("id", "parent", "ord"), "ord").select("id", "path"), "id")


def inherit_down(nodes: DataFrame, columns: list[str], name: str, limit: int = 50) -> DataFrame:
    """Field records of nodes (id, parent): dotted ``name`` (a node without one has its parent's)
    and, for each column, the own value or that of the nearest ancestor. Beyond ``limit`` levels it raises."""
    roots = nodes.where("parent is null").select("id", name, *columns)
    children = nodes.where("parent is not null").select(F.col("id").alias("_c"), F.col("parent").alias("_p"), *[F.col(c).alias(f"_{c}") for c in (name, *columns)])

    def below(level: DataFrame) -> DataFrame:
        pairs = level.join(children, F.col("id") == F.col("_p"))
        return pairs.select(F.col("_c").alias("id"), F.concat_ws(".", name, f"_{name}").alias(name), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])

    return descend(roots, below, limit)


def fields_by_page(widgets: DataFrame, pages: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, field: once for each page that a widget (field, widget, page_ref) of the field is
    on. The page that a widget names counts, even if the document has none such; a widget
    that names none is on the page that lists it (annotations: widget, page)."""
    named = widgets.where("page_ref is not null").join(pages.select(*keys, "page_ref", "page"), [*keys, "page_ref"])
    listed = widgets.where("page_ref is null").join(annotations.groupBy(*keys, "widget").agg(F.max("page").alias("page")), [*keys, "widget"])
    return named.select(*keys, "page", "field").unionByName(listed.select(*keys, "page", "field")).distinct()


def associated_files(**owners: DataFrame) -> DataFrame:
    """The files that each kind of owner names, with the kind as ``owner``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("owner", F.lit(o)) for o, t in owners.items()])


def attachments(files: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, name, contents: all contents under one name of a document, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "content")))
    return files.groupBy(*keys, "name").agg(F.transform(rows, lambda r: r["content"]).alias("contents"))


def link_annotations(annotations: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Annotations (object, subtype, reply_to, reply_type, target) of a page with the first index of what they
    reply to (in_reply_to, reply_type) and of the pop-up they have (popup) or belong to
    (popup_parent). A link to itself or to what the page does not list is null."""
    first = annotations.groupBy(*keys, "object").agg(F.min(index).alias("_i"))
    at = lambda c, n: first.select(*keys, F.col("object").alias(c), F.col("_i").alias(n))
    both = annotations.join(at("reply_to", "_r"), [*keys, "reply_to"], "left").join(at("target", "_t"), [*keys, "target"], "left")
    reply, target = (F.when(F.col(c) != F.col("object"), F.col(i)) for c, i in (("reply_to", "_r"), ("target", "_t")))
    popup = F.col("subtype") == "Popup"
    kept = [c for c in annotations.columns if c not in ("reply_to", "reply_type", "target")]
    return both.select(*kept, reply.alias("in_reply_to"), F.when(reply.isNotNull(), F.col("reply_type")).alias("reply_type"), F.when(~F.coalesce(popup, F.lit(False)), target).alias("popup"), F.when(popup, target).alias("popup_parent"))


def action_links(links: DataFrame, height: Column | float) -> DataFrame:
    """Links that have an action, their boxes measured from the upper edge of the page."""
    h = height if isinstance(height, Column) else F.lit(float(height))
    return links.where("link_type is not null").withColumns({"top": h - F.col("bottom"), "bottom": h - F.col("top")})


def without_repeated_rows(cells: DataFrame, lines: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """Cells (keys, table, row, col, row_span, text, box) without the rows that a line of the page repeats: equal
    text, at least the share of the line within the row, every cell met by it. The rows
    left are numbered anew and spans counted in rows left. A row without text, or with a cell without box, stays."""
    order = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("col", tx.collapse(F.col("text")).alias("t")))))
    box = [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]
    full = F.every((F.coalesce(F.col("text"), F.lit("")) == "") | F.col("x0").isNotNull())
    boxes = F.collect_list(F.when((F.col("text") != "") & F.col("x0").isNotNull(), F.struct("x0", "top", "x1", "bottom")))
    seen = cells.where("text <> '' or text is null or x0 is null")
    rows = seen.groupBy(*keys, "table", "row").agg(F.array_join(F.transform(order, lambda c: c["t"]), " ").alias("_text"), full.alias("_full"), boxes.alias("_cells"), *box)
    known = rows.where(F.col("_full") & (F.col("_text") != ""))
    told = lines.select(*keys, *[F.col(c).alias(f"l_{c}") for c in ("x0", "top", "x1", "bottom")], tx.collapse(F.col("text")).alias("_text"))
    line = Box.of("l_")
    met = F.forall("_cells", lambda c: line.common_area(Box(c["x0"], c["top"], c["x1"], c["bottom"])) > 0)
    gone = known.join(told, [*keys, "_text"]).where((line.share_of_self(Box.of()) >= share) & met).select(*keys, "table", "row").distinct()
    number = Window.partitionBy(*keys, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    left = cells.select(*keys, "table", "row").distinct().join(gone.withColumn("_gone", F.lit(1)), [*keys, "table", "row"], "left")
    left = left.withColumn("_new", F.coalesce(F.count_if(F.col("_gone").isNull()).over(number), F.lit(0)))
    per_table = left.groupBy(*keys, "table").agg(F.collect_list(F.when(F.col("_gone").isNull(), F.col("row"))).alias("_rows"))
    kept = cells.join(left.where("_gone is null").select(*keys, "table", "row", "_new"), [*keys, "table", "row"]).join(per_table, [*keys, "table"])
    span = F.size(F.filter("_rows", lambda r: (r >= F.col("row")) & (r < F.col("row") + F.col("row_span"))))
    # the span first: beside a new "row", the name in the lambda would stand for that one
    return kept.withColumn("row_span", span.cast("long")).withColumn("row", F.col("_new").cast("long")).select(*cells.columns)


def text_and_tables(lines: DataFrame, tables: DataFrame, cells: DataFrame, keys: list[str], ident: str) -> tuple[DataFrame, DataFrame]:
    """Lines without those that a table holds, then cells without the rows that a line left repeats."""
    text = outside_tables(lines, tables, keys, ident)
    return text, without_repeated_rows(cells, text, keys)


def table_titles(tables: DataFrame, rows: DataFrame, keys: list[str], ident: str, overlap: float = 0.6, gap: float = 36.0) -> DataFrame:
    """keys, ident, title: the nearest row of text at most ``gap`` above a table of which the
    narrower has the share of its width in common with the other; ties to the row further left."""
    reach = tables.select(*keys, ident, "x0", "x1", "top", (F.col("top") - gap).alias("_from"))
    near = rows.select(*keys, F.col("x0").alias("r0"), F.col("x1").alias("r1"), F.col("bottom").alias("rb"), F.col("text").alias("title"))
    common = F.greatest(F.lit(0.0), F.least("x1", "r1") - F.greatest("x0", "r0"))
    narrow = F.greatest(F.lit(1.0), F.least(F.col("x1") - F.col("x0"), F.col("r1") - F.col("r0")))
    hits = reach.join(near, keys).where((F.col("rb") >= F.col("_from")) & (F.col("rb") <= F.col("top")) & (common / narrow >= overlap))
    return hits.groupBy(*keys, ident).agg(F.min_by("title", F.struct(F.col("top") - F.col("rb"), "r0", "title")).alias("title"))


def table_references(tables: DataFrame, keys: list[str], page: str, order: str) -> DataFrame:
    """Tables with ``table_index``, their number on the page from 0."""
    number = F.row_number().over(Window.partitionBy(*keys, page).orderBy(order)) - 1
    return tables.withColumn("table_index", number.cast("long"))


def candidate_pairs(blocks: DataFrame, keys: list[str], ident: str, full_width: str) -> DataFrame:
    """Pairs (a before b) of blocks of a page that share a stretch of x or of y, and all pairs with a
    block of full width."""
    sides = [overlapping_spans(blocks, keys, *s, ident).select(*keys, F.col(ident).alias("a"), F.col("o2").alias("b")) for s in (("x0", "x1"), ("top", "bottom"))]
    wide = blocks.where(full_width).select(*keys, F.col(ident).alias("_w")).join(blocks.select(*keys, F.col(ident).alias("_o")), keys).where("_w <> _o")
    return sides[0].unionByName(sides[1]).unionByName(wide.select(*keys, F.least("_w", "_o").alias("a"), F.greatest("_w", "_o").alias("b"))).distinct()


def actual_text(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs (owner, actual, text, box, visible) with one row for each owner of replaced text: its first run, with
    that text, the box of all of them, visible if one of them is. Runs without owner stay."""
    free = runs.where("owner is null").select(*keys, order, "text", "x0", "top", "x1", "bottom", "visible")
    first = F.min_by(F.struct(order, F.col("actual").alias("text")), order).alias("_f")
    box = [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.bool_or("visible").alias("visible")]
    owned = runs.where("owner is not null").groupBy(*keys, "owner").agg(first, *box)
    return free.unionByName(owned.select(*keys, f"_f.{order}", "_f.text", "x0", "top", "x1", "bottom", "visible"))


def select_runs(runs: DataFrame, keys: list[str], trusted: Column) -> DataFrame:
    """Runs (text, visible) with the characters of all runs of a page and of its visible ones
    (native_characters, painted_characters), and ``shown``: visible, or hidden text that is trusted.
    ``trusted`` is a condition on those two numbers and columns of the page."""
    page = Window.partitionBy(*keys)
    size = F.char_length(F.regexp_replace("text", r"\s+", ""))
    counted = runs.withColumns({"native_characters": F.sum(size).over(page), "painted_characters": F.sum(F.when(F.col("visible"), size).otherwise(0)).over(page)})
    return counted.withColumn("shown", F.col("visible") | F.coalesce(trusted, F.lit(False)))


def candidate(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of a reading from its observations (text, confidence): characters with the breaks
    between observations, alphanumeric characters, tokens, lines, mean finite confidence, share of symbols, utility."""
    u = tx.utility(F.col("text"), F.col("confidence"))
    rows = observations.withColumn("_u", u).withColumn("_w", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    sure = F.when(~F.isnan("confidence") & (F.abs("confidence") != float("inf")), F.col("confidence"))
    n, letters = F.sum("_u.nonspace"), F.sum("_u.alphanumeric")
    return rows.groupBy(*keys).agg(
        (F.sum(F.char_length("text")) + F.count("*") - 1).alias("characters"), letters.alias("alphanumeric_characters"), F.sum("_w").alias("tokens"), F.count("*").alias("line_count"),
        F.coalesce(F.avg(sure), F.lit(0.0)).alias("mean_confidence"), ((n - letters) / F.greatest(n, F.lit(1))).alias("symbol_ratio"), F.sum("_u.utility").alias("utility"),
    )


def show_groups(shows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of shown text (tx, ty, flip) from the top of the page down and left to right, with their
    ``place`` from 0; tx counts from the leftmost group."""
    page = Window.partitionBy(*keys)
    down = page.orderBy(F.desc(F.col("ty") * F.col("flip")), "tx", "seqno")
    return shows.withColumns({"place": (F.row_number().over(down) - 1).cast("long"), "_left": F.min("tx").over(page)}).withColumn("tx", F.col("tx") - F.col("_left")).drop("_left")


def catalog_root(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number, generation of the likeliest catalogue among the objects of a document (number,
    generation, offset, is_catalog, has_pages, tree_score, n_extras). A catalogue counts 100, another object
    with pages 25, others not at all; a page tree adds its score, one without a score takes 150; each further
    catalogue entry adds 2. Ties go to the smaller offset, then the larger number. Scores of -100 or less lose."""
    base = F.when(F.col("is_catalog"), 100).when(F.col("has_pages"), 25)
    pages = F.when(~F.col("has_pages"), 0).when(F.col("tree_score") <= 0, -150).otherwise(F.col("tree_score"))
    scored = candidates.withColumn("_s", base + pages + 2 * F.col("n_extras")).where("_s > -100")
    best = F.max(F.struct("_s", (-F.col("offset")).alias("o"), "number", "generation")).alias("_b")
    return scored.groupBy(*keys).agg(best).select(*keys, "_b.number", "_b.generation")


def outcomes(files: DataFrame, error: str = "error") -> DataFrame:
    """total, succeeded, failed, success_rate in per cent and exit_code of a batch; a file failed if it has an error."""
    done = F.count_if(F.col(error).isNull())
    total = F.count("*")
    return files.agg(total.alias("total"), done.alias("succeeded"), (total - done).alias("failed"), F.try_divide(done * 100, total).alias("success_rate"), F.when((total == 0) | (done < total), 1).otherwise(0).alias("exit_code"))


def file_records(pages: DataFrame, keys: list[str], page: str, extra: dict[str, str] | None = None) -> DataFrame:
    """keys, text, metadata: one record for each file, its pages in order with a line break between;
    ``extra`` goes over the file's own metadata."""
    rows = F.array_sort(F.collect_list(F.struct(page, "text")))
    own = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("string"))])
    more = {k: v for k, v in (extra or {}).items()}
    kept = F.map_filter(own, lambda k, _: ~k.isin(*more)) if more else own
    both = F.map_concat(kept, F.create_map(*[F.lit(x) for kv in more.items() for x in kv])) if more else kept
    return pages.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r["text"], F.lit(""))), "\n").alias("text")).withColumn("metadata", both)
