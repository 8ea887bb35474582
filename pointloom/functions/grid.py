"""Integer arithmetic and the sampling grid: every conversion is a column expression.

Undefined values are NULL, never NaN: comparisons with NaN hold in Spark, those with NULL don't.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2**31 - 1


def div_up(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, b: int) -> int:
    return div_up(a, b) * b


def mul_div(a: int, b: int, c: int) -> int:
    """a * b / c rounded down, without overflow."""
    return a * b // c


def mul_sat(a: int, b: int, top: int = 2**64 - 1) -> int:
    """a * b, or the largest value that fits."""
    return min(a * b, top)


def div_down(a: Column, b: int) -> Column:
    """Integer division rounded towards minus infinity."""
    return F.floor(a.cast("double") / F.lit(float(b))).cast("long")


def col_div_up(a: Column, b: int) -> Column:
    return F.ceil(a.cast("double") / F.lit(float(b))).cast("long")


def col_round_up(a: Column, b: int) -> Column:
    return col_div_up(a, b) * F.lit(b)


def defined(*values: Column) -> Column:
    """All values are finite numbers."""
    out = F.lit(True)
    for v in values:
        d = v.cast("double")
        out = out & d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    return out


@dataclass(frozen=True)
class Grid:
    """Vertices at ``reference + spacing * i``, i within the inclusive extents of each axis."""

    reference: tuple[float, float, float]
    spacing: float
    extents: tuple[tuple[int, int], tuple[int, int], tuple[int, int]]

    def __post_init__(self) -> None:
        if not (self.spacing > 0 and math.isfinite(self.spacing)):
            raise ValueError("spacing must be positive")
        if any(lo > hi for lo, hi in self.extents):
            raise ValueError("extents are empty")

    def num_vertices(self, axis: int) -> int:
        return self.extents[axis][1] - self.extents[axis][0] + 1

    def num_cells(self, axis: int) -> int:
        return self.extents[axis][1] - self.extents[axis][0]

    def sub_grid(self, boxes: tuple[tuple[int, int], ...]) -> Grid:
        """The part whose extents, counted from this grid's lower corner, are ``boxes``."""
        return Grid(self.reference, self.spacing, tuple((lo + a, lo + b) for (lo, _), (a, b) in zip(self.extents, boxes, strict=True)))

    def world_to_vertex(self, p: Column, axis: int) -> Column:
        """Position in units of cells from the lower corner."""
        return (p.cast("double") - F.lit(self.reference[axis])) * F.lit(1.0 / self.spacing) - F.lit(float(self.extents[axis][0]))

    def world_to_cell(self, p: Column, axis: int) -> Column:
        """The cell that holds a position; an error where it is not finite or too far away."""
        cell = F.floor((p.cast("double") - F.lit(self.reference[axis])) * F.lit(1.0 / self.spacing)) - F.lit(self.extents[axis][0])
        good = defined(p) & (F.abs((p.cast("double") - F.lit(self.reference[axis])) / F.lit(self.spacing)) < F.lit(float(INT_MAX)))
        return F.when(good, cell).otherwise(F.raise_error(F.lit("a position is not finite or outside the integer range")).cast("long")).cast("long")

    def vertex_to_world(self, i: Column, axis: int) -> Column:
        return F.lit(self.reference[axis]) + F.lit(self.spacing) * (i.cast("double") + F.lit(float(self.extents[axis][0])))

    def scale(self, r: Column) -> Column:
        """A world length in cells."""
        return r.cast("double") * F.lit(1.0 / self.spacing)


def inside(values: tuple[Column, Column, Column], boxes: tuple[tuple[float, float], ...]) -> Column:
    """Half-open containment on every axis."""
    out = F.lit(True)
    for v, (lo, hi) in zip(values, boxes, strict=True):
        out = out & (v >= F.lit(lo)) & (v < F.lit(hi))
    return out
