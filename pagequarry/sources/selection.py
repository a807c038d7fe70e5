"""Selection of pages by number, checked before any work starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_numbers(selection: str, count: int) -> list[int]:
    """Zero-based pages of a selection such as "1-3,5,9-7": in the order asked for, each
    once; ranges may descend. An empty selection is a ValueError, a page outside 1 .. count an IndexError."""
    out: dict[int, None] = {}
    for part in selection.split(","):
        ends = [int(v) for v in part.strip().split("-")]
        if len(ends) > 2:
            raise ValueError(f"not a range: {part}")
        first, last = ends[0], ends[-1]
        for page in range(first, last + (1 if last >= first else -1), 1 if last >= first else -1):
            if not 1 <= page <= count:
                raise IndexError(f"no page {page} of {count}")
            out[page - 1] = None
    return list(out)


def selected(pages: DataFrame, selection: str, count: int, page: str = "page_index") -> DataFrame:
    """Rows of the selected pages with ``place``, the position of their page in the selection.
    The filter is on literals, so it reaches the scan."""
    numbers = page_numbers(selection, count)
    place = F.array_position(F.array(*[F.lit(n).cast("long") for n in numbers]), F.col(page).cast("long")) - 1
    return pages.where(F.col(page).isin(numbers)).withColumn("place", place)


def page_range(spec: Column, pages: Column) -> Column:
    """The page indices, from 0, that a range such as ``3``, ``:-1`` or ``::2`` takes of so many
    pages; null where it is none. Negative numbers count from the end."""
    whole = r"^(-?\d+)$|^(-?\d*):(-?\d*)(?::(-?\d*))?$"
    part = lambda i: F.nullif(F.regexp_extract(spec, whole, i), F.lit("")).try_cast("long")
    single, first, last, by = part(1), part(2), part(3), F.coalesce(part(4), F.lit(1).cast("long"))
    n = pages.cast("long")
    start = F.coalesce(single, first)
    stop = F.when(single.isNull(), last).when(single != -1, single + 1)
    low, high = F.when(by > 0, 0).otherwise(-1), F.when(by > 0, n).otherwise(n - 1)
    placed = lambda v: F.when(v < 0, F.greatest(v + n, low)).when(v >= 0, F.least(v, high))
    a = F.coalesce(placed(start), F.when(by > 0, 0).otherwise(n - 1))
    b = F.coalesce(placed(stop), F.when(by > 0, n).otherwise(-1))
    some = F.when(by > 0, a < b).otherwise(a > b)
    listed = F.when(some, F.sequence(a, b - F.signum(by).cast("long"), by)).otherwise(F.array().cast("array<bigint>"))
    return F.when(spec.rlike(whole) & ~spec.rlike("(^|:)-(:|$)") & (by != 0), listed)
