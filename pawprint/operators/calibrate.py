"""From pixels to centimetres, and rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawprint.functions.geometry import distance, polygon_area, rotated


def calibration_factor(medians: DataFrame, method: str, known: float, points: list[str] | None = None) -> DataFrame:
    """file, px_to_cm. method: distance (between two points), area (of a polygon of points) or ratio (given).

    Null for points on one place, and for a polygon whose area is 0 to nine digits: what is left then is rounding.
    """
    if method == "ratio":
        return medians.select("file").distinct().withColumn("px_to_cm", F.lit(float(known)))
    wide = medians.filter(F.col("point").isin(points)).groupBy("file").pivot("point", points).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    at = lambda p: (F.col(f"{p}_x"), F.col(f"{p}_y"))
    if method == "distance":
        return wide.select("file", F.try_divide(F.lit(float(known)), distance(*at(points[0]), *at(points[1]))).alias("px_to_cm"))
    if method == "area":
        poly = F.array(*[F.struct(at(p)[0].alias("x"), at(p)[1].alias("y")) for p in points])
        return wide.select("file", polygon_area(poly).alias("__a")).select("file", F.when(F.round("__a", 9) > 0, F.sqrt(F.lit(float(known)) / F.col("__a"))).alias("px_to_cm"))
    raise ValueError(f"method is distance, area or ratio, not {method}")


def calibrate(frames: DataFrame, factors: DataFrame) -> DataFrame:
    """x and y in cm; tracks without a factor stay as they are. factors has one row a file."""
    scale = F.coalesce("px_to_cm", F.lit(1.0))
    return frames.join(factors, "file", "left").withColumn("x", F.col("x") * scale).withColumn("y", F.col("y") * scale)


def arena_calibration(corners: DataFrame, width_cm: float, height_cm: float) -> DataFrame:
    """file and the anisotropic calibration of tl, tr, br, bl medians (wide: tl_x, ...)."""
    side = lambda a, b: distance(F.col(f"{a}_x"), F.col(f"{a}_y"), F.col(f"{b}_x"), F.col(f"{b}_y"))
    out = corners.withColumn("width_px", (side("tl", "tr") + side("bl", "br")) / 2).withColumn("height_px", (side("tl", "bl") + side("tr", "br")) / 2)
    out = out.withColumn("cm_per_px_x", F.try_divide(F.lit(float(width_cm)), F.col("width_px"))).withColumn("cm_per_px_y", F.try_divide(F.lit(float(height_cm)), F.col("height_px")))
    mean = (F.col("cm_per_px_x") + F.col("cm_per_px_y")) / 2
    return out.withColumn("cm_per_px_mean", mean).withColumn("anisotropy_percent", F.try_divide(F.abs(F.col("cm_per_px_x") - F.col("cm_per_px_y")), mean) * 100)


def rotate(frames: DataFrame, theta: float, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """About the mean position of each track."""
    means = frames.groupBy(*keys).agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"))
    x, y = rotated(F.col("x"), F.col("y"), F.lit(float(theta)), F.col("__cx"), F.col("__cy"))
    return frames.join(means, list(keys)).withColumn("__x", x).withColumn("y", y).withColumn("x", F.col("__x")).drop("__x", "__cx", "__cy")


#: Columns of a transform: x' = m00 x + m01 y + tx, y' = m10 x + m11 y + ty.
COEFFICIENTS = ("m00", "m01", "m10", "m11", "tx", "ty")


def _transform(df: DataFrame, m00, m01, m10, m11, tx, ty, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    as_column = lambda c: F.lit(float(c)) if isinstance(c, (int, float)) else c
    return df.select(*keys, *[as_column(c).alias(n) for c, n in zip((m00, m01, m10, m11, tx, ty), COEFFICIENTS, strict=True)])


def scaling(factors: DataFrame) -> DataFrame:
    """The transform of calibration_factor()'s px_to_cm: the same in both directions, about the origin. Tracks without a factor stay as they are."""
    f = F.coalesce("px_to_cm", F.lit(1.0))
    return _transform(factors, f, 0, 0, f, 0, 0)


def arena_scaling(corners: DataFrame, width_cm: float, height_cm: float) -> DataFrame:
    """The transform of arena_calibration(): each direction by its own factor, about the medians of the corners' x and y.

    corners is wide (tl_x, ... bl_y). A track whose corners give no positive mean factor has no transform: what is
    applied to it becomes null.
    """
    middle = lambda c: F.array_sort(F.filter(F.array(*[F.col(f"{p}_{c}") for p in ("tl", "tr", "br", "bl")]), lambda v: v.isNotNull()))
    median = lambda c: (F.element_at(middle(c), F.floor((F.size(middle(c)) + 1) / 2).cast("int")) + F.element_at(middle(c), F.floor((F.size(middle(c)) + 2) / 2).cast("int"))) / 2
    c = arena_calibration(corners, width_cm, height_cm)
    c = c.withColumn("__ox", median("x")).withColumn("__oy", median("y"))
    ok = F.coalesce(F.col("cm_per_px_mean") > 0, F.lit(False))
    sx, sy = (F.when(ok, F.col(f"cm_per_px_{a}")) for a in "xy")
    return _transform(c, sx, 0, 0, sy, -F.col("__ox") * sx, -F.col("__oy") * sy)


def rotation(medians: DataFrame, centre_of: list[str], theta_deg: float = 0.0, straight: tuple[str, str] | None = None) -> DataFrame:
    """The transform that turns about the mean of the medians (file, point, x, y) of some points, by an angle, or so far that the line of two points lies along x.

    The angle of a line is that between it and x, always turned back (negative). Tracks without all the points have no transform.
    """
    from functools import reduce

    named = list(dict.fromkeys([*centre_of, *(straight or ())]))
    wide = medians.filter(F.col("point").isin(named)).groupBy("file").pivot("point", named).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    mean = lambda c: reduce(lambda a, b: a + b, [F.col(f"{p}_{c}") for p in centre_of]) / len(centre_of)
    theta = F.radians(F.lit(float(theta_deg)))
    if straight:
        ax, ay = (F.col(f"{straight[1]}_{c}") - F.col(f"{straight[0]}_{c}") for c in "xy")
        theta = -F.acos(F.least(F.lit(1.0), F.try_divide(F.abs(ax), F.sqrt(ax * ax + ay * ay))))
    w = wide.select("file", mean("x").alias("__cx"), mean("y").alias("__cy"), F.cos(theta).alias("__c"), F.sin(theta).alias("__s"))
    cx, cy, c, s = (F.col(n) for n in ("__cx", "__cy", "__c", "__s"))
    return _transform(w, c, -s, s, c, cx - cx * c + cy * s, cy - cx * s - cy * c)


def then(first: DataFrame, second: DataFrame) -> DataFrame:
    """One transform that does what two do one after the other, for tracks that have both."""
    b = second.select("file", *[F.col(n).alias(f"__{n}") for n in COEFFICIENTS])
    a00, a01, a10, a11, ax, ay = (F.col(n) for n in COEFFICIENTS)
    b00, b01, b10, b11, bx, by = (F.col(f"__{n}") for n in COEFFICIENTS)
    return _transform(first.join(b, "file"), b00 * a00 + b01 * a10, b00 * a01 + b01 * a11, b10 * a00 + b11 * a10, b10 * a01 + b11 * a11, b00 * ax + b01 * ay + bx, b10 * ax + b11 * ay + by)


def applied(df: DataFrame, transform: DataFrame, points: list[str] | None = None, poly: str | None = None) -> DataFrame:
    """df with transformed places: x and y, or <point>_x and <point>_y of points, or a polygon column. So frames, medians and zones take the same transform.

    transform has a row for each file that is to move; places of other files become null.
    """
    columns = df.columns
    out = df.join(transform.select("file", *[F.col(n).alias(f"__{n}") for n in COEFFICIENTS]), "file", "left")
    m00, m01, m10, m11, tx, ty = (F.col(f"__{n}") for n in COEFFICIENTS)
    moved = lambda x, y: (m00 * x + m01 * y + tx, m10 * x + m11 * y + ty)
    if poly:
        new = F.transform(F.col(poly), lambda p: F.struct(moved(p["x"], p["y"])[0].alias("x"), moved(p["x"], p["y"])[1].alias("y")))
        return out.withColumn(poly, F.when(m00.isNotNull(), new)).select(*columns)
    pairs = [("x", "y")] if points is None else [(f"{p}_x", f"{p}_y") for p in points]
    changes = {}
    for x, y in pairs:
        changes[x], changes[y] = moved(F.col(x), F.col(y))
    return out.withColumns(changes).select(*columns)
