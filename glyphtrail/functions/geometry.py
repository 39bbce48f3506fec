"""Rectangles as four-element arrays (left, top, right, bottom) and as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_HEIGHT = 16.0
AGREEMENT_HEIGHTS = 3.0


@dataclass(frozen=True)
class Box:
    """The four edges of a rectangle, each a column."""

    left: Column
    top: Column
    right: Column
    bottom: Column

    @staticmethod
    def of(rect: Column) -> Box:
        return Box(*[F.get(rect, F.lit(i)) for i in range(4)])

    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return self.left + self.width / 2

    @property
    def center_y(self) -> Column:
        return self.top + self.height / 2

    @property
    def empty(self) -> Column:
        return (self.left >= self.right) | (self.top >= self.bottom)

    def shift(self, dx: Column | float, dy: Column | float) -> Box:
        return Box(self.left + dx, self.top + dy, self.right + dx, self.bottom + dy)

    def grow(self, by: Column | float) -> Box:
        return Box(self.left - by, self.top - by, self.right + by, self.bottom + by)

    def intersect(self, other: Box) -> Box:
        """May be inverted; test :attr:`empty`."""
        return Box(F.greatest(self.left, other.left), F.greatest(self.top, other.top), F.least(self.right, other.right), F.least(self.bottom, other.bottom))

    def union(self, other: Box) -> Box:
        return Box(F.least(self.left, other.left), F.least(self.top, other.top), F.greatest(self.right, other.right), F.greatest(self.bottom, other.bottom))

    def overlaps(self, other: Box) -> Column:
        """Touching edges do not overlap."""
        return (self.right > other.left) & (other.right > self.left) & (self.bottom > other.top) & (other.bottom > self.top)

    def lerp(self, other: Box, t: Column) -> Box:
        return Box(*[a * (1 - t) + b * t for a, b in zip(self.edges, other.edges)])

    @property
    def edges(self) -> tuple[Column, Column, Column, Column]:
        return self.left, self.top, self.right, self.bottom

    @property
    def array(self) -> Column:
        return F.array(*self.edges)

    def common_area(self, other: Box) -> Column:
        """Area of the intersection, 0 if there is none."""
        both = self.intersect(other)
        return F.when(both.empty, 0.0).otherwise(both.area)

    def contains(self, x: Column, y: Column) -> Column:
        """Bounds included."""
        return (x >= self.left) & (x <= self.right) & (y >= self.top) & (y <= self.bottom)


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def block_height(h: Column) -> Column:
    """Unusable heights count as the default."""
    good = h.isNotNull() & ~F.isnan(h) & (h > 0) & (h < float("inf"))
    return F.when(good, h).otherwise(DEFAULT_HEIGHT)


def agreement_scale(existing_height: Column) -> Column:
    return AGREEMENT_HEIGHTS * block_height(existing_height)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (F.lit(v) if isinstance(v, int | float) else v for v in (low, high))
    return F.least(F.greatest(x, low), high)


def overlap_ratio(a: Box, b: Box, margin: Column | float = 0.0) -> Column:
    """Common area of ``a`` grown by the margin and ``b``, over the smaller own area."""
    smaller = F.least(a.area, b.area)
    return F.when(a.empty | b.empty, 0.0).otherwise(clamp(F.try_divide(a.grow(margin).common_area(b), smaller), 0.0, 1.0))


def inverse_transform(box: Box, m: list[Column]) -> Box:
    """Undo an affine map (a, b, c, d, tx, ty); bounding box of the four corners.

    A near-identity linear part only shifts; a singular one leaves the box unchanged.
    """
    a, b, c, d, tx, ty = m
    plain = (F.abs(a - 1) < 1e-3) & (F.abs(b) < 1e-3) & (F.abs(c) < 1e-3) & (F.abs(d - 1) < 1e-3)
    det = a * d - b * c
    singular = F.abs(det) < 1e-6
    moved = box.shift(-tx, -ty)

    def undo(x: Column, y: Column) -> tuple[Column, Column]:
        u, v = x - tx, y - ty
        return F.try_divide(d * u - c * v, det), F.try_divide(a * v - b * u, det)

    corners = [undo(x, y) for x in (box.left, box.right) for y in (box.top, box.bottom)]
    xs, ys = zip(*corners)
    turned = Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    return Box(*[F.when(plain, p).when(singular, q).otherwise(r) for p, q, r in zip(moved.edges, box.edges, turned.edges)])
