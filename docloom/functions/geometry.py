"""Predicates and measures of boxes x0, y0, x1, y1 (y grows downwards) and of positioned words."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BORDER_SHARE = 0.03
TITLE_X, TITLE_Y = 0.62, 0.72


def center(lo: str = "x0", hi: str = "x1") -> Column:
    return (F.col(lo) + F.col(hi)) / 2


def in_band(lo: float, hi: float) -> Column:
    """The word's centre lies in a closed band."""
    return center().between(lo, hi)


def border_label(w: str = "w", h: str = "h") -> Column:
    """A single letter or digit whose centre is within 3 % of an edge of the page."""
    cx, cy, mx, my = center(), center("y0", "y1"), F.col(w) * BORDER_SHARE, F.col(h) * BORDER_SHARE
    return F.col("text").rlike("^[A-Za-z0-9]$") & ((cx < mx) | (cx > F.col(w) - mx) | (cy < my) | (cy > F.col(h) - my))


def title_block(w: str = "w", h: str = "h") -> Column:
    return (center() >= F.col(w) * TITLE_X) & (center("y0", "y1") >= F.col(h) * TITLE_Y)


def overlaps(a: str, b: str) -> Column:
    """Closed intersection of the boxes in columns a_x0.. and b_x0..: touching counts."""
    return (F.col(f"{a}_x0") <= F.col(f"{b}_x1")) & (F.col(f"{b}_x0") <= F.col(f"{a}_x1")) & (F.col(f"{a}_y0") <= F.col(f"{b}_y1")) & (F.col(f"{b}_y0") <= F.col(f"{a}_y1"))


def overlap_area(a: str, b: str) -> Column:
    width = F.least(f"{a}_x1", f"{b}_x1") - F.greatest(f"{a}_x0", f"{b}_x0")
    height = F.least(f"{a}_y1", f"{b}_y1") - F.greatest(f"{a}_y0", f"{b}_y0")
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def nearest_point(x: Column, y: Column, box: str = "") -> tuple[Column, Column]:
    """The point of the box that is nearest to (x, y): the point itself where it lies inside."""
    return F.least(F.greatest(x, F.col(f"{box}x0")), F.col(f"{box}x1")), F.least(F.greatest(y, F.col(f"{box}y0")), F.col(f"{box}y1"))


def edge_distance(x: Column, y: Column, box: str = "") -> Column:
    """How far (x, y) is from the box; 0 inside."""
    px, py = nearest_point(x, y, box)
    return F.hypot(px - x, py - y)


def clockwise(dx: Column, dy: Column) -> Column:
    """Angle from 12 o'clock, clockwise, in [0, 2 pi); pi at the centre itself."""
    angle = F.atan2(dx, -dy)
    return F.when((dx == 0) & (dy == 0), F.lit(math.pi)).when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def micro_angle(dx: Column, dy: Column) -> Column:
    """Angle from 12 o'clock, clockwise, in [0, 2 pi); pi / 2 at the centre itself."""
    return F.pmod(F.atan2(dy, dx) + math.pi / 2, F.lit(2 * math.pi))


def normalised_box(w: str = "w", h: str = "h") -> tuple[Column, Column]:
    """(keep, box): corners in order, thin sides widened by 0.5; dots and the page's frame aren't kept."""
    x0, x1 = F.least("x0", "x1"), F.greatest("x0", "x1")
    y0, y1 = F.least("y0", "y1"), F.greatest("y0", "y1")
    keep = ~((x1 - x0 < 0.5) & (y1 - y0 < 0.5)) & ~((x1 - x0 >= 0.9 * F.col(w)) & (y1 - y0 >= 0.9 * F.col(h)))
    px, py = F.when(x1 - x0 < 0.5, 0.5).otherwise(0.0), F.when(y1 - y0 < 0.5, 0.5).otherwise(0.0)
    return keep, F.struct((x0 - px).alias("x0"), (y0 - py).alias("y0"), (x1 + px).alias("x1"), (y1 + py).alias("y1"))
