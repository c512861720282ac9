"""Rectangles with fields x0, y0, x1, y1 as plain column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


class Box:
    """Four columns that make a rectangle."""

    def __init__(self, x0: Column, y0: Column, x1: Column, y1: Column):
        self.x0, self.y0, self.x1, self.y1 = x0, y0, x1, y1

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(prefix + s) for s in SIDES])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    def valid(self) -> Column:
        """Finite with positive sides."""
        finite = F.lit(True)
        for c in (self.x0, self.y0, self.x1, self.y1):
            finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.coalesce(finite & (self.width > 0) & (self.height > 0), F.lit(False))

    def grown(self, by: float) -> Box:
        return Box(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def clipped(self, to: Box) -> Box:
        return Box(
            F.greatest(self.x0, to.x0), F.greatest(self.y0, to.y0), F.least(self.x1, to.x1), F.least(self.y1, to.y1)
        )

    def clamped(self, to: Box) -> Box:
        """Moved inside ``to``, size kept."""
        x = F.greatest(to.x0, F.least(self.x0, to.x1 - self.width))
        y = F.greatest(to.y0, F.least(self.y0, to.y1 - self.height))
        return Box(x, y, x + self.width, y + self.height)

    def contains(self, other: Box) -> Column:
        return (self.x0 <= other.x0) & (self.y0 <= other.y0) & (self.x1 >= other.x1) & (self.y1 >= other.y1)

    def overlaps(self, other: Box, clearance: float = 0.0) -> Column:
        return (
            (self.x0 < other.x1 + clearance)
            & (other.x0 - clearance < self.x1)
            & (self.y0 < other.y1 + clearance)
            & (other.y0 - clearance < self.y1)
        )

    def gap(self, other: Box) -> Column:
        """Distance between the rectangles, 0 when they touch."""
        zero = F.lit(0.0)
        return F.hypot(
            F.greatest(other.x0 - self.x1, self.x0 - other.x1, zero), F.greatest(other.y0 - self.y1, self.y0 - other.y1, zero)
        )

    def centre_distance(self, other: Box) -> Column:
        return F.hypot(
            (self.x0 + self.x1) / 2 - (other.x0 + other.x1) / 2, (self.y0 + self.y1) / 2 - (other.y0 + other.y1) / 2
        )

    def overlap_area(self, other: Box) -> Column:
        return self.clipped(other).area

    def struct(self) -> Column:
        return F.struct(*[c.alias(s) for c, s in zip((self.x0, self.y0, self.x1, self.y1), SIDES, strict=True)])

    def columns(self, prefix: str = "") -> dict[str, Column]:
        return {prefix + s: c for c, s in zip((self.x0, self.y0, self.x1, self.y1), SIDES, strict=True)}


def distance_ratio(a: Box, b: Box, diagonal: Column) -> Column:
    """Centre distance over the page diagonal; infinite where a box is missing."""
    return F.coalesce(a.centre_distance(b) / diagonal, F.lit(float("inf")))


def grid_cells(box: Box, size: float) -> Column:
    """Array of (cx, cy): the cells of a square grid that a rectangle touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.flatten(
        F.transform(
            span(box.x0, box.x1), lambda cx: F.transform(span(box.y0, box.y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))
        )
    )


def scaled(box: Box, width: Column, height: Column) -> Box:
    """From a 0..1000 page to points."""
    return Box(box.x0 * width / 1000, box.y0 * height / 1000, box.x1 * width / 1000, box.y1 * height / 1000)


def bounded_font(value: Column) -> Column:
    """Half steps, half to even, between 5 and 7."""
    return F.least(F.lit(7.0), F.greatest(F.lit(5.0), F.bround(value * 2) / 2))


def light_neutral(r: Column, g: Column, b: Column) -> Column:
    return (F.least(r, g, b) >= 0.85) & (F.greatest(r, g, b) - F.least(r, g, b) <= 0.04)


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether segments ab and cd share a point."""
    t1, t2, t3, t4 = _turn(*a, *b, *c), _turn(*a, *b, *d), _turn(*c, *d, *a), _turn(*c, *d, *b)

    def on(p, q, r, turn):
        return (
            (turn == 0)
            & r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0]))
            & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
        )

    return ((t1 != t2) & (t3 != t4)) | on(a, b, c, t1) | on(a, b, d, t2) | on(c, d, a, t3) | on(c, d, b, t4)


def segment_hits_box(a: tuple[Column, Column], b: tuple[Column, Column], box: Box) -> Column:
    inside = a[0].between(box.x0, box.x1) & a[1].between(box.y0, box.y1)
    corners = [(box.x0, box.y0), (box.x1, box.y0), (box.x1, box.y1), (box.x0, box.y1)]
    for p, q in zip(corners, corners[1:] + corners[:1], strict=True):
        inside = inside | segments_cross(a, b, p, q)
    return inside


def segment_hits_boxes(ax, ay, bx, by, x0, y0, x1, y1):
    """:func:`segment_hits_box` over arrays."""
    between = lambda v, p, q: (v >= np.minimum(p, q)) & (v <= np.maximum(p, q))
    turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    hit = (ax >= x0) & (ax <= x1) & (ay >= y0) & (ay <= y1)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    for (cx, cy), (dx, dy) in zip(corners, corners[1:] + corners[:1], strict=True):
        t1, t2, t3, t4 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy), turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
        hit |= (t1 != t2) & (t3 != t4)
        for t, (px, py), (qx, qy), (rx, ry) in (
            (t1, (ax, ay), (bx, by), (cx, cy)), (t2, (ax, ay), (bx, by), (dx, dy)), (t3, (cx, cy), (dx, dy), (ax, ay)), (t4, (cx, cy), (dx, dy), (bx, by)),
        ):
            hit |= (t == 0) & between(rx, px, qx) & between(ry, py, qy)
    return hit


def bezier(points: list[tuple[Column, Column]], steps: int = 16) -> Column:
    """Array of (x, y): a cubic curve sampled at ``steps`` + 1 even parameters."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = points

    def at(i: Column) -> Column:
        t = i / steps
        u = 1 - t
        blend = lambda a, b, c, d: u * u * u * a + 3 * u * u * t * b + 3 * u * t * t * c + t * t * t * d
        return F.struct(blend(ax, bx, cx, dx).alias("x"), blend(ay, by, cy, dy).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def stroke_edges(box: Box, width: Column) -> Column:
    """Array of four thin rectangles along the outline."""
    h = width / 2
    return F.array(
        Box(box.x0 - h, box.y0 - h, box.x1 + h, box.y0 + h).struct(),
        Box(box.x1 - h, box.y0 - h, box.x1 + h, box.y1 + h).struct(),
        Box(box.x0 - h, box.y1 - h, box.x1 + h, box.y1 + h).struct(),
        Box(box.x0 - h, box.y0 - h, box.x0 + h, box.y1 + h).struct(),
    )
