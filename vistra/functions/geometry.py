"""Box algebra as column expressions.  A box is four columns x1, y1, x2, y2 under a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + s) for s in SIDES)


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def center(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def area_clamped(b) -> Column:
    """Sides count as one pixel at least."""
    return F.greatest(F.lit(1.0), b[2] - b[0]) * F.greatest(F.lit(1.0), b[3] - b[1])


def intersection(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou_plain(a, b) -> Column:
    """0 where the union is empty."""
    inter = intersection(a, b)
    union = F.greatest(F.lit(0.0), area(a)) + F.greatest(F.lit(0.0), area(b)) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def iou_clamped(a, b) -> Column:
    """Areas with sides of one pixel at least."""
    inter = intersection(a, b)
    return inter / F.greatest(F.lit(1e-6), area_clamped(a) + area_clamped(b) - inter)


def iou_eps(a, b) -> Column:
    """Plain areas, the union at least 1e-6."""
    inter = intersection(a, b)
    return inter / F.greatest(F.lit(1e-6), area(a) + area(b) - inter)


def edge_gap(a, b) -> Column:
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return length(dx, dy)


def center_distance(a, b) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return length(ax - bx, ay - by)


def center_distance_scaled(a, b) -> Column:
    """In units of the root of the first box's area, one pixel at least."""
    return center_distance(a, b) / F.sqrt(F.greatest(F.lit(1.0), area(a)))


def clip(b, width: float, height: float) -> tuple[Column, ...]:
    """Corners sorted and clipped to the frame; sides of one pixel at least."""
    x_lo, x_hi = F.least(b[0], b[2]), F.greatest(b[0], b[2])
    y_lo, y_hi = F.least(b[1], b[3]), F.greatest(b[1], b[3])
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    x1, y1 = inside(x_lo, width - 1), inside(y_lo, height - 1)
    return x1, y1, F.greatest(inside(x_hi, width - 1), x1 + 1), F.greatest(inside(y_hi, height - 1), y1 + 1)


def effective(box: str, seen: str) -> Column:
    """The observed box where there is one, else the other; null unless it has four numbers."""
    chosen = F.when(F.coalesce(F.size(seen), F.lit(-1)) > 0, F.col(seen)).otherwise(F.col(box))
    return F.when(F.size(chosen) == 4, F.transform(chosen, lambda v: v.cast("double")))
