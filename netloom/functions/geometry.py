"""Planar geometry as Column expressions; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | str | int | float


def col(x: Number) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def cross(ax: Number, ay: Number, bx: Number, by: Number, cx: Number, cy: Number) -> Column:
    """Twice the signed area of a, b, c: positive if c is on the left of a-b."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def boxes_overlap(a: str, b: str, tolerance: Number = 0.0) -> Column:
    """Do the boxes of lines with columns {a}x1..{a}y2 and {b}x1..{b}y2 touch, within a tolerance?"""
    t = col(tolerance)
    lo, hi = (lambda p, k: F.least(f"{p}{k}1", f"{p}{k}2")), (lambda p, k: F.greatest(f"{p}{k}1", f"{p}{k}2"))
    return (lo(a, "x") <= hi(b, "x") + t) & (lo(b, "x") <= hi(a, "x") + t) & (lo(a, "y") <= hi(b, "y") + t) & (lo(b, "y") <= hi(a, "y") + t)


def lines_intersect(a: str, b: str, tolerance: Number = 0.0) -> Column:
    """Do two lines meet, ends included? Cheap box terms come first."""
    t = col(tolerance)
    one = [cross(f"{a}x1", f"{a}y1", f"{a}x2", f"{a}y2", f"{b}x{k}", f"{b}y{k}") for k in (1, 2)]
    two = [cross(f"{b}x1", f"{b}y1", f"{b}x2", f"{b}y2", f"{a}x{k}", f"{a}y{k}") for k in (1, 2)]
    return boxes_overlap(a, b, tolerance) & (one[0] * one[1] <= t) & (two[0] * two[1] <= t)


def lines_cross(a: str, b: str) -> Column:
    """Do two lines cross inside both, so that a touch doesn't count?"""
    one = [cross(f"{a}x1", f"{a}y1", f"{a}x2", f"{a}y2", f"{b}x{k}", f"{b}y{k}") for k in (1, 2)]
    two = [cross(f"{b}x1", f"{b}y1", f"{b}x2", f"{b}y2", f"{a}x{k}", f"{a}y{k}") for k in (1, 2)]
    return boxes_overlap(a, b) & (one[0] * one[1] < 0) & (two[0] * two[1] < 0)


def touch_kind(a: str, b: str) -> Column:
    """0: apart, 1: they touch, 2: they cross."""
    return F.when(lines_cross(a, b), 2).when(lines_intersect(a, b), 1).otherwise(0)


def meeting_point(a: str, b: str) -> tuple[Column, Column, Column]:
    """Where the lines through two segments meet, and how far along a (0 to 1); null if parallel."""
    dx, dy = F.col(f"{a}x2") - F.col(f"{a}x1"), F.col(f"{a}y2") - F.col(f"{a}y1")
    ex, ey = F.col(f"{b}x2") - F.col(f"{b}x1"), F.col(f"{b}y2") - F.col(f"{b}y1")
    along = F.try_divide((F.col(f"{b}x1") - F.col(f"{a}x1")) * ey - (F.col(f"{b}y1") - F.col(f"{a}y1")) * ex, dx * ey - dy * ex)
    return F.col(f"{a}x1") + along * dx, F.col(f"{a}y1") + along * dy, along


def length(x1: Number, y1: Number, x2: Number, y2: Number) -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt(dx * dx + dy * dy)


def point_line_distance(px: Number, py: Number, x1: Number, y1: Number, x2: Number, y2: Number) -> Column:
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - x1) * dx + (py - y1) * dy, square))))
    return length(px, py, x1 + t * dx, y1 + t * dy)


def _edges(points: str | Column) -> Column:
    """Pairs of successive points of a ring, the last joined to the first."""
    p = col(points)
    turned = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    return F.zip_with(p, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, e: acc + f(e))


def signed_area(points: str | Column) -> Column:
    return _sum(_edges(points), lambda e: (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def centroid(points: str | Column) -> tuple[Column, Column]:
    area = signed_area(points)
    part = lambda k: _sum(_edges(points), lambda e: (e["a"][k] + e["b"][k]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.try_divide(part("x"), 6 * area), F.try_divide(part("y"), 6 * area)


def perimeter(points: str | Column, closed: bool = True) -> Column:
    edges = _edges(points)
    edges = edges if closed else F.slice(edges, 1, F.size(edges) - 1)
    return _sum(edges, lambda e: length(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def angular_deviation(points: str | Column) -> Column:
    """Of a polyline: the turns at its inner points, a right angle counting 1."""
    p = col(points)
    inner = F.sequence(F.lit(1), F.size(p) - 2)

    def turn(i: Column) -> Column:
        a, b, c = (F.get(p, i + k) for k in (-1, 0, 1))
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        cosine = F.try_divide(ux * vx + uy * vy, F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)))
        return F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))), F.lit(0.0)) / (math.pi / 2)

    return F.when(F.size(p) < 3, 0.0).otherwise(_sum(inner, turn))


def point_in_polygon(px: Number, py: Number, points: str | Column) -> Column:
    """By parity of the edges that a ray to the right crosses; a point on an edge's lower or left side is inside."""
    px, py = col(px), col(py)

    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (py - a["y"]) * F.try_divide(b["x"] - a["x"], b["y"] - a["y"])
        return F.when(((a["y"] > py) != (b["y"] > py)) & (px < at), 1).otherwise(0)

    return F.aggregate(_edges(points), F.lit(0), lambda acc, e: acc + crossing(e)) % 2 == 1


def turn_weight(ux: Number, uy: Number, vx: Number, vy: Number) -> Column:
    """Turn from direction u to direction v: 0 straight on, 1 a right angle, 2 back."""
    ux, uy, vx, vy = map(col, (ux, uy, vx, vy))
    cosine = F.try_divide(ux * vx + uy * vy, F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)))
    return 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / math.pi


def pack_ref(x: Number, y: Number) -> Column:
    """One int for a grid cell: x in the high 16 bits, y in the low."""
    return F.shiftleft(col(x).cast("int"), 16) + col(y).cast("int").bitwiseAND(65535)


def unpack_ref(ref: Number) -> tuple[Column, Column]:
    ref = col(ref)
    low = ref.bitwiseAND(65535)
    return F.shiftright(ref, 16), F.when(low > 32767, low - 65536).otherwise(low)


#: Tangents that bound the bins within an octant.
_FLAT, _LOW, _HIGH = 1e-12, math.tan(math.radians(15)), math.tan(math.radians(30))


def which_bin(dx: Number, dy: Number) -> Column:
    """Angular bin 0 to 31 of a direction, counter-clockwise from the x axis; axes and diagonals have bins of their own."""
    dx, dy = col(dx).cast("double"), col(dy).cast("double")
    wide = F.abs(dx) >= F.abs(dy)
    big, small = F.when(wide, F.abs(dx)).otherwise(F.abs(dy)), F.when(wide, F.abs(dy)).otherwise(F.abs(dx))
    ratio = F.coalesce(F.try_divide(small, big), F.lit(0.0))
    step = F.when(ratio < _FLAT, 0).when(ratio < _LOW, 1).when(ratio < _HIGH, 2).when(ratio < 1 - _FLAT, 3).otherwise(4)
    quarter = F.when(wide & (dx >= 0), 0).when(~wide & (dy > 0), 8).when(wide & (dx < 0), 16).otherwise(24)
    forward = F.when(quarter == 0, dy >= 0).when(quarter == 8, dx <= 0).when(quarter == 16, dy <= 0).otherwise(dx >= 0)
    return F.pmod(quarter + F.when(forward, step).otherwise(-step), F.lit(32)).cast("int")


def grid_spacing_limits(largest: Number) -> tuple[Column, Column, Column]:
    """Least, greatest and default spacing of a grid over a drawing whose longer side is `largest`."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(col(largest))))
    return power / 100, power, power / 10


def circle_points(cx: Number, cy: Number, radius: Number, n: int) -> Column:
    """n points around a centre, counter-clockwise from the x axis."""
    cx, cy, radius = map(col, (cx, cy, radius))
    angle = lambda i: i * (2 * math.pi / n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((cx + radius * F.cos(angle(i))).alias("x"), (cy + radius * F.sin(angle(i))).alias("y")))
