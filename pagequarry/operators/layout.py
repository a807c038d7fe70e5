"""Reading order and block classes. Order within a page depends on earlier choices, so
these run on one page's boxes at a time; a page is a small group."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import per_group


def largest_gap(spans: list[tuple[float, float]], last: bool) -> tuple[float, float] | None:
    """(size, middle) of the largest gap between intervals; of equals the last or the first."""
    best, reach = None, None
    for lo, hi in sorted(spans):
        if reach is not None and lo > reach:
            gap = lo - reach
            if best is None or gap > best[0] or (last and gap == best[0]):
                best = (gap, (lo + reach) / 2)
        reach = hi if reach is None else max(reach, hi)
    return best


def xy_cut(boxes: list[tuple[float, float, float, float]], least_x: float = 10.0, least_y: float = 2.0, depth: int = 32) -> list[int]:
    """Indexes of boxes (x0, top, x1, bottom) in reading order: cut along the widest
    gap, rows weighing 1.15 times columns, until none is left; then by top and left."""

    def order(ids: list[int], left: int) -> list[int]:
        if len(ids) < 2 or not left:
            return sorted(ids, key=lambda i: (boxes[i][1], boxes[i][0], i))
        across = largest_gap([(boxes[i][1], boxes[i][3]) for i in ids], last=True)
        down = largest_gap([(boxes[i][0], boxes[i][2]) for i in ids], last=False)
        rows = across[0] * 1.15 if across and across[0] >= least_y else 0.0
        columns = down[0] if down and down[0] >= least_x else 0.0
        if not rows and not columns:
            return sorted(ids, key=lambda i: (boxes[i][1], boxes[i][0], i))
        side, at = (1, across[1]) if rows >= columns else (0, down[1])
        first = [i for i in ids if boxes[i][side] < at]
        return order(first, left - 1) + order([i for i in ids if boxes[i][side] >= at], left - 1)

    return order(list(range(len(boxes))), depth)


def topological(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """Above before below where boxes overlap in x, left before right where they overlap
    in y; among the free ones the highest, then the leftmost."""
    n = len(boxes)
    after: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n
    for i in range(n):
        for j in range(n):
            a, b = boxes[i], boxes[j]
            if i != j and ((min(a[2], b[2]) > max(a[0], b[0]) and a[3] <= b[1]) or (min(a[3], b[3]) > max(a[1], b[1]) and a[2] <= b[0])):
                after[i].append(j)
                waits[j] += 1
    ready = [(boxes[i][1], boxes[i][0], i) for i in range(n) if not waits[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)[2]
        out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, (boxes[j][1], boxes[j][0], j))
    done = set(out)
    return out + sorted((i for i in range(n) if i not in done), key=lambda i: (boxes[i][1], boxes[i][0], i))


def reading_order(blocks: DataFrame, keys: list[str], ident: str, method: str = "xy") -> DataFrame:
    """keys, ident, order of each block of a page."""
    by, kind = (xy_cut if method == "xy" else topological), dict(blocks.dtypes)

    def run(rows: list[dict]) -> list[tuple]:
        at = by([(r["x0"], r["top"], r["x1"], r["bottom"]) for r in rows])
        return [(rows[i][ident], n) for n, i in enumerate(at)]

    return per_group(blocks, keys, [ident, "x0", "top", "x1", "bottom"], run, f"{ident} {kind[ident]}, `order` long")


def columns_of(words: DataFrame, keys: list[str], least_gap: float = 24.0) -> DataFrame:
    """Vertical bands of a page: merged x extents of its words, split at gaps."""
    from .cluster import merge_intervals

    return merge_intervals(words, keys, "x0", "x1", least_gap)


def headings(blocks: DataFrame, keys: list[str], size: str = "size", ratio: float = 1.2) -> DataFrame:
    """kind and level: a block at least ``ratio`` times the median size is a heading, its
    level the rank of its size from the largest, at most 3."""
    page = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    body = blocks.groupBy(*keys).agg(F.percentile(size, F.lit(0.5)).alias("body"))
    with_body = blocks.join(body, keys) if keys else blocks.crossJoin(body)
    big = F.col(size) >= F.col("body") * ratio
    sizes = with_body.where(big).select(*keys, size).distinct().withColumn("rank", F.dense_rank().over(page.orderBy(F.desc(size))))
    out = with_body.join(sizes, [*keys, size], "left")
    return out.withColumns({"kind": F.when(big, "heading").otherwise("paragraph"), "level": F.when(big, F.least(F.lit(3), F.col("rank"))).cast("int")}).drop("rank", "body")


def neighbour_lines(lines: DataFrame, keys: list[str], ident: str, ratio: float = 0.5) -> DataFrame:
    """Pairs of lines of a page that belong together: they share some width, lie within
    ``ratio`` of the first one's height, are as high and align at left, right or middle."""
    other = lines.select(*keys, *[F.col(c).alias(f"r_{c}") for c in (ident, "x0", "top", "x1", "bottom")])
    c, height = F.col, F.col("bottom") - F.col("top")
    t = height * ratio
    wide = (c("r_x1") > c("x0")) & (c("x1") > c("r_x0"))
    high = (c("r_bottom") > c("top") - t) & (c("bottom") + t > c("r_top"))
    even = F.abs(c("r_bottom") - c("r_top") - height) <= t
    aligned = (F.abs(c("r_x0") - c("x0")) <= t) | (F.abs(c("r_x1") - c("x1")) <= t) | (F.abs(c("r_x0") + c("r_x1") - c("x0") - c("x1")) / 2 <= t)
    return lines.join(other, keys).where((c(ident) != c(f"r_{ident}")) & wide & high & even & aligned).select(*keys, ident, f"r_{ident}")


def spaced_lines(chars: DataFrame, keys: list[str], order: str, margin: float = 0.1) -> DataFrame:
    """The text of each line: its characters in order, with a space where the gap before one
    exceeds ``margin`` times its larger side."""
    gap = F.col("x0") - F.lag("x1").over(Window.partitionBy(*keys).orderBy(order))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top"))
    piece = F.concat(F.when(gap > side * margin, " ").otherwise(""), F.col("text"))
    rows = chars.select(*keys, F.col(order).alias("_o"), piece.alias("_p"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_p"))), lambda r: r["_p"]), "").alias("text"))
