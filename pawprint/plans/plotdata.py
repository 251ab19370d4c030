"""The rows behind plots; drawing is left to others."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def density(frames: DataFrame, cell: float = 0.1) -> DataFrame:
    """file, cx, cy, n: positions by cell."""
    known = frames.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return known.groupBy("file", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def kernel_density(frames: DataFrame, cell: float = 0.1, grid: int = 100) -> DataFrame:
    """file, gx, gy (from 0), x, y, density: a Gaussian kernel estimate at grid x grid places between each track's least and greatest position.

    Positions count by the lower edges of their cells. Bandwidths are by the normal reference rule, 1.06 times the
    smaller of deviation and interquartile range / 1.34, times n to the power -1/5, for each direction. The kernel is a product, so that first
    the cells of a row are spread over the grid's columns, then these over its rows: grid + grid places for a cell,
    not grid * grid. Tracks whose positions don't vary have no rows.
    """
    edge = lambda c: F.floor(F.col(c) / cell) * cell
    known = frames.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("file", edge("x").alias("x"), edge("y").alias("y"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    n = F.count(F.lit(1))
    width = lambda c: F.least(F.stddev_samp(c), (F.percentile(c, 0.75) - F.percentile(c, 0.25)) / 1.34) * 1.06 * F.pow(n, F.lit(-0.2))
    of = known.groupBy("file").agg(n.alias("__n"), *[f(c).alias(f"__{k}_{c}") for c in "xy" for k, f in (("w", width), ("lo", F.min))], *[F.max(f"__{c}").alias(f"__hi_{c}") for c in "xy"])
    of = of.filter("__w_x > 0 and __w_y > 0")
    cells = known.groupBy("file", "x", "y").agg(n.alias("__m")).join(of, "file")
    place = lambda c, g: F.col(f"__lo_{c}") + (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")) * F.col(g) / (grid - 1)
    weight = lambda c, g: F.exp(-F.pow((place(c, g) - F.col(c)) / F.col(f"__w_{c}"), 2) / 2) / (F.col(f"__w_{c}") * math.sqrt(2 * math.pi))
    each = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    keep = ["__n", "__w_y", "__lo_x", "__hi_x", "__lo_y", "__hi_y"]
    columns = cells.withColumn("gx", each).groupBy("file", "gx", "y").agg(F.sum(F.col("__m") * weight("x", "gx")).alias("__m"), *[F.first(c).alias(c) for c in keep])
    rows = columns.withColumn("gy", each).groupBy("file", "gx", "gy").agg((F.sum(F.col("__m") * weight("y", "gy")) / F.first("__n")).alias("density"), *[F.first(c).alias(c) for c in keep[2:]])
    return rows.select("file", "gx", "gy", place("x", "gx").alias("x"), place("y", "gy").alias("y"), "density")


def path(moved: DataFrame, sd_cutoff: float = 4.0) -> DataFrame:
    """file, frame, x, y, speed_clamped at the track's mean + sd_cutoff deviations."""
    w = Window.partitionBy("file")
    top = F.avg("speed").over(w) + sd_cutoff * F.stddev_samp("speed").over(w)
    return moved.select("file", "frame", "x", "y", F.least(F.col("speed"), F.coalesce(top, F.col("speed"))).alias("speed_clamped"))


def outline(zones: DataFrame) -> DataFrame:
    """file, zone, pos, x, y: the vertices of file, zone, poly, closed by the first again."""
    closed = F.concat("poly", F.slice("poly", 1, 1))
    return zones.select("file", "zone", F.posexplode(closed).alias("pos", "p")).select("file", "zone", "pos", "p.x", "p.y")


def flags_long(t: DataFrame, flags: dict[str, Column], fps: float) -> DataFrame:
    """file, seconds, name, value of frames where the flag is known."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in flags.items()])).alias("s")
    return t.select("file", (F.col("frame") / F.lit(float(fps))).alias("seconds"), each).select("file", "seconds", "s.*").filter("value is not null")


def mean_trajectory(bins: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and standard error of metrics by group and bin."""
    return bins.groupBy(*by, "bin_start_s").agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], *[(F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_se") for m in metrics])


def points_in_range(frames: DataFrame, first: float | None = None, last: float | None = None, fps: float | None = None, points: list[str] | None = None, kind: str | None = None, info: DataFrame | None = None) -> DataFrame:
    """file, point, frame, x, y, likelihood between two frames, both included; with fps, between the frames at or after two times in s.

    points, or kind with a table of points (point, type), choose the points; else all are taken.
    """
    frame = F.col("frame")
    out = frames
    for bound, low in ((first, True), (last, False)):
        if bound is not None:
            at = F.lit(float(bound)) if fps is None else F.ceil(F.lit(bound * fps - 1e-9))  # the first frame at this time or later
            out = out.filter(frame >= at if low else frame <= at)
    if kind is not None:
        out = out.join(info.filter(F.col("type") == kind).select("point").distinct(), "point", "left_semi")
    elif points is not None:
        out = out.filter(F.col("point").isin(points))
    return out.select("file", "point", "frame", "x", "y", "likelihood")


def correlations(long: DataFrame, name: str, value: str, names: list[str], keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """a, b, r for each pair of names (a before b, and each with itself): Pearson's correlation of their values over keys; what a key lacks is 0. One aggregate for each key, then one for all pairs."""
    wide = long.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(name) == n, F.col(value))), F.lit(0)).cast("double").alias(f"__v{i}") for i, n in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = wide.agg(*[F.corr(f"__v{i}", f"__v{j}").alias(f"__r{i}_{j}") for i, j in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"__r{i}_{j}").alias("r")) for i, j in pairs])))
