"""Rules of an XML report, and objects as lines of CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field

# The column that every line has and those that come first, in order.
REQUIRED = ["object_type"]
FIRST = ["page_number", "x0", "x1", "y0", "y1", "doctop", "top", "bottom", "width", "height"]

_RULE = "_specification string, _clause string, _testNumber string, _status string, description string"


def rules(reports: DataFrame, xml: str) -> DataFrame:
    """A row for each rule of the reports: specification, clause, test, status, description.
    A report that is no XML gives none."""
    keys = [c for c in reports.columns if c != xml]
    parsed = F.from_xml(F.col(xml), f"details struct<rule: array<struct<{', '.join(c.replace(' ', ': ', 1) for c in _RULE.split(', '))}>>>", {"mode": "PERMISSIVE"})
    rows = reports.select(*keys, parsed.alias("_r")).select(*keys, F.explode("_r.details.rule").alias("_r"))
    names = {"_specification": "specification", "_clause": "clause", "_testNumber": "test", "_status": "status", "description": "description"}
    return rows.select(*keys, *[F.col(f"_r.{a}").alias(b) for a, b in names.items()])


def kept_columns(columns: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """The columns of a CSV in order: the required one, places, the rest by name. Either those
    included or all but those excluded; both at once, or a required one excluded, is an error."""
    if include is not None and exclude is not None:
        raise ValueError("include and exclude exclude each other")
    if set(exclude or ()) & set(REQUIRED):
        raise ValueError(f"cannot exclude {sorted(set(exclude) & set(REQUIRED))}")
    ordered = REQUIRED + [c for c in FIRST if c in columns] + sorted(set(columns) - {*REQUIRED, *FIRST})
    return [c for c in ordered if c in REQUIRED or (c in include if include is not None else c not in (exclude or ()))]


def csv_line(objects: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """One line of CSV for each object; null is empty."""
    return F.array_join(F.array(*[F.coalesce(csv_field(F.col(c).cast("string")), F.lit("")) for c in kept_columns(objects.columns, include, exclude)]), ",")


def serialized(objects: DataFrame, precision: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Objects with plain values only: truth as 0 and 1, bytes as text (null where they are not UTF-8),
    fractions rounded to the precision, in the columns kept and their order."""

    def plain(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "boolean":
            return c.cast("int").alias(name)
        if kind == "binary":
            return F.when(F.is_valid_utf8(c.cast("string")), F.decode(c, "UTF-8")).alias(name)
        return F.round(c, precision).alias(name) if kind in ("double", "float") and precision is not None else c

    kinds = dict(objects.dtypes)
    return objects.select(*[plain(c, kinds[c]) for c in kept_columns(objects.columns, include, exclude) if c in kinds])


def json_line(objects: DataFrame, precision: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """One object of JSON for each row, nulls written out."""
    rows = serialized(objects, precision, include, exclude)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
