"""Geometry as column expressions. A polygon is array<struct<x,y>>, closed implicitly."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon(*points: tuple[float, float]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def edges(poly: Column) -> Column:
    """array<struct<a,b>>: each vertex with the next."""
    after = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))
    return F.zip_with(poly, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


#: How far from an edge a point still lies on it, for rounding.
NEAR = 1e-9


def _turn(x: Column, y: Column, e) -> Column:
    return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])


def _on(x: Column, y: Column, e) -> Column:
    a, b = e["a"], e["b"]
    box = x.between(F.least(a["x"], b["x"]) - NEAR, F.greatest(a["x"], b["x"]) + NEAR) & y.between(F.least(a["y"], b["y"]) - NEAR, F.greatest(a["y"], b["y"]) + NEAR)
    return box & (F.abs(_turn(x, y, e)) < NEAR)


def _crosses(x: Column, y: Column, e) -> Column:
    a, b = e["a"], e["b"]
    at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
    return F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < at), F.lit(False))


def _constant_edges(poly) -> list[dict]:
    """Edges of a polygon given as points (numbers): each becomes a few arithmetic expressions, which Spark compiles."""
    at = [{"x": F.lit(float(x)), "y": F.lit(float(y))} for x, y in poly]
    return [{"a": a, "b": b} for a, b in zip(at, at[1:] + at[:1], strict=True)]


def _orientation(poly) -> int:
    """1 or -1 if the points make a convex polygon, by its sense, else 0."""
    around = [*poly, *poly[:2]]
    turns = [(bx - ax) * (cy - by) - (by - ay) * (cx - bx) for (ax, ay), (bx, by), (cx, cy) in zip(around, around[1:], around[2:], strict=False)]
    return 1 if all(t > 0 for t in turns) and len(poly) < 5 else -1 if all(t < 0 for t in turns) and len(poly) < 5 else 0


def on_border(x: Column, y: Column, poly) -> Column:
    if isinstance(poly, Column):
        return F.exists(edges(poly), lambda e: _on(x, y, e))
    return reduce(lambda p, q: p | q, [_on(x, y, e) for e in _constant_edges(poly)])


def _odd_crossings(x: Column, y: Column, poly) -> Column:
    if isinstance(poly, Column):
        return F.size(F.filter(edges(poly), lambda e: _crosses(x, y, e))) % 2 == 1
    return sum((_crosses(x, y, e).cast("int") for e in _constant_edges(poly)), F.lit(0)) % 2 == 1


def strictly_inside(x: Column, y: Column, poly) -> Column:
    """Null for a missing position; the border is outside. poly: a column, or a list of points (faster).

    A convex triangle or quadrangle of points is one comparison for each edge.
    """
    if not isinstance(poly, Column) and (sense := _orientation(poly)):
        return reduce(lambda p, q: p & q, [_turn(x, y, e) * float(sense) >= NEAR for e in _constant_edges(poly)])
    return F.when(x.isNotNull() & y.isNotNull(), _odd_crossings(x, y, poly) & ~on_border(x, y, poly))


def inside_or_border(x: Column, y: Column, poly) -> Column:
    if not isinstance(poly, Column) and (sense := _orientation(poly)):
        return reduce(lambda p, q: p & q, [_turn(x, y, e) * float(sense) > -NEAR for e in _constant_edges(poly)])
    return F.when(x.isNotNull() & y.isNotNull(), _odd_crossings(x, y, poly) | on_border(x, y, poly))


def in_zones(x: Column, y: Column, zones: list, invert: bool = False) -> Column:
    """In any of the zones; invert negates."""
    found = strictly_inside(x, y, zones[0])
    for z in zones[1:]:
        found = found | strictly_inside(x, y, z)
    return ~found if invert else found


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def area(*points: tuple[Column, Column]) -> Column:
    """Shoelace area of points (x, y)."""
    total = F.lit(0.0)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        total = total + (ax * by - bx * ay)
    return F.abs(total) / 2


def polygon_area(poly: Column) -> Column:
    return F.abs(F.aggregate(edges(poly), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def centre(poly: Column) -> tuple[Column, Column]:
    """The mean of the vertices."""
    mean = lambda k: F.aggregate(poly, F.lit(0.0), lambda s, p: s + p[k]) / F.size(poly)
    return mean("x"), mean("y")


def scaled(poly: Column, factor: float) -> Column:
    cx, cy = centre(poly)
    return F.transform(poly, lambda p: F.struct((cx + (p["x"] - cx) * factor).alias("x"), (cy + (p["y"] - cy) * factor).alias("y")))


def recentred(poly: Column, x: Column, y: Column) -> Column:
    cx, cy = centre(poly)
    return F.transform(poly, lambda p: F.struct((p["x"] - cx + x).alias("x"), (p["y"] - cy + y).alias("y")))


def rotated(x: Column, y: Column, theta: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(theta) - dy * F.sin(theta), cy + dx * F.sin(theta) + dy * F.cos(theta)


def line_distance(x: Column, y: Column, poly) -> Column:
    """The least distance to the infinite lines through the edges; edges of no length are left out."""
    one = lambda e: F.try_divide(F.abs(_turn(x, y, e)), distance(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    if isinstance(poly, Column):
        return F.array_min(F.transform(edges(poly), one))
    return F.when(x.isNotNull() & y.isNotNull(), F.least(*map(one, _constant_edges(poly))))


def segment_distance(x: Column, y: Column, poly) -> Column:
    """The least distance to the edges themselves."""

    def one(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        along = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return distance(x, y, e["a"]["x"] + t * dx, e["a"]["y"] + t * dy)

    least = F.array_min(F.transform(edges(poly), one)) if isinstance(poly, Column) else F.least(*map(one, _constant_edges(poly)))
    return F.when(x.isNotNull() & y.isNotNull(), least)


def angle_clockwise(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From vector a to vector b, in (-pi, pi]."""
    return F.atan2(ax * by - ay * bx, ax * bx + ay * by)


def angle_total(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The unsigned angle; null for a vector of no length. The cosine is clamped to [-1, 1]."""
    cos = F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)) + cos * 0)


def angle_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return angle_total(ax, ay, bx, by) * (180.0 / math.pi)


def circular_diff_deg(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def wrapped(angle: Column) -> Column:
    """Into (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def grid_cell(v: Column, size: float, n: int) -> Column:
    """0 .. n-1, clamped."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v / (size / n)))).cast("int")
