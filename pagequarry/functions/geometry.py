"""Boxes as four flat columns (x0, top, x1, bottom), so predicates push down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "top", "x1", "bottom")


@dataclass(frozen=True)
class Box:
    x0: Column
    top: Column
    x1: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(prefix + s) for s in SIDES])

    @classmethod
    def at(cls, x0: float, top: float, x1: float, bottom: float) -> Box:
        return cls(*[F.lit(float(v)) for v in (x0, top, x1, bottom)])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def area(self) -> Column:
        """Never negative."""
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    def meet(self, other: Box) -> Box:
        return Box(F.greatest(self.x0, other.x0), F.greatest(self.top, other.top), F.least(self.x1, other.x1), F.least(self.bottom, other.bottom))

    def overlaps(self, other: Box) -> Column:
        """Sharing an edge counts; touching in one point does not."""
        m = self.meet(other)
        return (m.width >= 0) & (m.height >= 0) & (m.width + m.height > 0)

    def inside(self, other: Box) -> Column:
        return (self.x0 >= other.x0) & (self.top >= other.top) & (self.x1 <= other.x1) & (self.bottom <= other.bottom)

    def common_area(self, other: Box) -> Column:
        return self.meet(other).area

    def share_of_smaller(self, other: Box) -> Column:
        return F.try_divide(self.common_area(other), F.least(self.area, other.area))

    def share_of_self(self, other: Box) -> Column:
        return F.try_divide(self.common_area(other), self.area)

    def horizontal_share(self, other: Box) -> Column:
        common = F.greatest(F.lit(0.0), F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0))
        return F.try_divide(common, F.least(self.width, other.width))

    def ordered(self) -> Box:
        return Box(F.least(self.x0, self.x1), F.least(self.top, self.bottom), F.greatest(self.x0, self.x1), F.greatest(self.top, self.bottom))

    def flipped(self, page_height: Column) -> Box:
        """Between bottom-left and top-left origin."""
        return Box(self.x0, page_height - self.bottom, self.x1, page_height - self.top)

    def turned(self, rotation: Column, width: Column, height: Column) -> Box:
        """As displayed on a page of the given size, turned by 0, 90, 180 or 270 degrees."""
        pick = lambda a, b, c, d: F.when(rotation == 90, b).when(rotation == 180, c).when(rotation == 270, d).otherwise(a)
        return Box(
            pick(self.x0, height - self.bottom, width - self.x1, self.top),
            pick(self.top, self.x0, height - self.bottom, width - self.x1),
            pick(self.x1, height - self.top, width - self.x0, self.bottom),
            pick(self.bottom, self.x1, height - self.top, width - self.x0),
        )

    def finite(self) -> Column:
        bad = [F.isnan(s) | (F.abs(s) == float("inf")) for s in (self.x0, self.top, self.x1, self.bottom)]
        return ~(bad[0] | bad[1] | bad[2] | bad[3]) & (self.width > 0) & (self.height > 0)


def crop(objects: DataFrame, box: Box) -> DataFrame:
    """Objects cut to the box, without those that do not overlap it; other size columns follow."""
    own = Box.of()
    m = own.meet(box)
    kept = objects.where(own.overlaps(box))
    out = kept.withColumns(dict(zip(SIDES, (m.x0, m.top, m.x1, m.bottom))))
    if "doctop" in objects.columns:
        out = kept.withColumns({**dict(zip(SIDES, (m.x0, m.top, m.x1, m.bottom))), "doctop": F.col("doctop") + m.top - F.col("top")})
    return out


def within(objects: DataFrame, box: Box) -> DataFrame:
    return objects.where(Box.of().inside(box))


def outside(objects: DataFrame, box: Box) -> DataFrame:
    return objects.where(~Box.of().overlaps(box))


def union_box(objects: DataFrame, *keys: str) -> DataFrame:
    """The smallest box around the objects of each key."""
    return objects.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def move(objects: DataFrame, axis: str, by: float) -> DataFrame:
    names = ("x0", "x1") if axis == "h" else tuple(c for c in ("top", "bottom", "doctop") if c in objects.columns)
    return objects.withColumns({c: F.col(c) + F.lit(float(by)) for c in names})


def resize(objects: DataFrame, side: str, value: Column) -> DataFrame:
    """Set one side; where width or height is a column, it follows."""
    out = objects.withColumn(side, value)
    sizes = {"width": F.col("x1") - F.col("x0"), "height": F.col("bottom") - F.col("top")}
    return out.withColumns({k: v for k, v in sizes.items() if k in objects.columns})


@dataclass(frozen=True)
class Affine:
    """x' = a x + c y + e, y' = b x + d y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    e: float = 0.0
    f: float = 0.0

    def then(self, n: Affine) -> Affine:
        return Affine(self.a * n.a + self.b * n.c, self.a * n.b + self.b * n.d, self.c * n.a + self.d * n.c, self.c * n.b + self.d * n.d, self.e * n.a + self.f * n.c + n.e, self.e * n.b + self.f * n.d + n.f)

    def inverse(self) -> Affine | None:
        det = self.a * self.d - self.b * self.c
        if not det:
            return None
        return Affine(self.d / det, -self.b / det, -self.c / det, self.a / det, (self.c * self.f - self.d * self.e) / det, (self.b * self.e - self.a * self.f) / det)

    def box(self, b: Box) -> Box:
        """Bounds of the four moved corners."""
        xs = [self.a * x + self.c * y + self.e for x in (b.x0, b.x1) for y in (b.top, b.bottom)]
        ys = [self.b * x + self.d * y + self.f for x in (b.x0, b.x1) for y in (b.top, b.bottom)]
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
