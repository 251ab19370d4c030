"""Zones: named polygons of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawprint.functions.geometry import recentred, scaled


def point_medians(frames: DataFrame, keys: tuple[str, ...] = ("file", "point")) -> DataFrame:
    """Exact medians of x and y, nulls ignored."""
    return frames.groupBy(*keys).agg(F.median("x").alias("x"), F.median("y").alias("y"))


def zones_from_points(medians: DataFrame, corners: DataFrame) -> DataFrame:
    """file, zone, poly: corners has zone, pos and point (vertex order); blank points are dropped."""
    named = corners.withColumn("point", F.trim("point")).filter(F.col("point") != "")
    placed = medians.join(F.broadcast(named), "point")  # a zone map is a handful of rows
    vertices = F.sort_array(F.collect_list(F.struct("pos", "x", "y")))
    return placed.groupBy("file", "zone").agg(F.transform(vertices, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("poly"))


def open_field_zones(arena, centre_scale: float = 0.5, corner_scale: float = 0.4, periphery_scale: float = 0.8) -> dict[str, list]:
    """centre, periphery (to be inverted) and corners of a four-cornered arena: a polygon column, or a list of points."""
    if isinstance(arena, Column):
        small = scaled(arena, corner_scale)
        return {
            "centre": [scaled(arena, centre_scale)],
            "periphery": [scaled(arena, periphery_scale)],
            "corners": [recentred(small, arena[i]["x"], arena[i]["y"]) for i in range(4)],
        }
    if len(arena) != 4:
        raise ValueError("an open field has four corners")
    cx, cy = (sum(p[i] for p in arena) / 4 for i in (0, 1))
    about = lambda f, x, y: [(x + (px - cx) * f, y + (py - cy) * f) for px, py in arena]
    return {"centre": [about(centre_scale, cx, cy)], "periphery": [about(periphery_scale, cx, cy)], "corners": [about(corner_scale, x, y) for x, y in arena]}


def zone_state(in_centre: Column, in_corner: Column, in_periphery: Column) -> Column:
    """centre, then corner, then periphery, else other; null flags fall through."""
    return F.when(in_centre, "center").when(in_corner, "corner").when(in_periphery, "periphery").otherwise("other")
