"""Long and wide tracks, cuts, bins, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def points_wide(frames: DataFrame, points: list[str], values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One row per file and frame, <point>_<value> columns; the schema doesn't depend on the data."""
    out = frames.groupBy("file", "frame").pivot("point", points).agg(*[F.first(v).alias(v) for v in values])
    if len(values) == 1:
        out = out.select("file", "frame", *[F.col(p).alias(f"{p}_{values[0]}") for p in points])
    return out


def points_long(wide: DataFrame, points: list[str], likelihood: float = 1.0) -> DataFrame:
    """The frame schema from <point>_x and <point>_y columns, with a constant likelihood."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("point"), F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y")) for p in points])).alias("p")
    return wide.select("file", "frame", each).select("file", "p.point", "frame", "p.x", "p.y", F.lit(float(likelihood)).alias("likelihood"))


def cut(df: DataFrame, start: int = 0, end: int = 0, keys: list[str] | None = None, legacy_end: bool = True) -> DataFrame:
    """Drops start leading and end trailing rows of each track; legacy_end drops one trailing row more, if any."""
    keys = keys or ["file"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    more = end + (1 if legacy_end and end else 0)
    return df.withColumn("__i", i).withColumn("__n", n).filter((F.col("__i") > start) & (F.col("__i") <= F.col("__n") - more)).drop("__i", "__n")


def scaled_features(df: DataFrame, factor: float, select: list[str] | None = None, keys: tuple[str, ...] = ("file", "frame")) -> DataFrame:
    """Multiplies the selected (all other than keys) columns."""
    chosen = select if select is not None else [c for c in df.columns if c not in keys]
    return df.select(*[(F.col(c) * factor).alias(c) if c in chosen else F.col(c) for c in df.columns])


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, by name, null where a table lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def equal_bins(df: DataFrame, length: int, keys: list[str] | None = None) -> DataFrame:
    """Adds bin: bin.1, bin.2, ... of length frames from each track's first."""
    first = F.min("frame").over(Window.partitionBy(*(keys or ["file"])))
    return df.withColumn("bin", F.concat(F.lit("bin."), (F.floor((F.col("frame") - first) / length) + 1).cast("string")))


def explicit_bins(df: DataFrame, bins: DataFrame) -> DataFrame:
    """Joins bins (file, bin, from_frame, to_frame, both included); frames of overlapping bins are repeated.

    Bins become the frames they cover, so that the join is an equi-join.
    """
    covered = bins.select("file", "bin", F.explode(F.sequence("from_frame", "to_frame")).alias("frame"))
    return df.join(covered, ["file", "frame"])


def with_point_info(points: DataFrame, info: DataFrame) -> DataFrame:
    """points (by point) with the columns of info, null for a point that info lacks."""
    return points.join(info, "point", "left")


def missing_points(points: DataFrame, info: DataFrame) -> DataFrame:
    """point: what info names and points lack."""
    return info.select("point").distinct().join(points.select("point").distinct(), "point", "left_anti")


def shuffled(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """The rows in an order by a hash of their keys and the seed: the same one on every run."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def legacy_flat(wide: DataFrame, animals: list[str], points: list[str]) -> DataFrame:
    """file, row, <point>_x, <point>_y: the animals of a frame one after the other, no frame column. wide has <animal>_<point>_x and _y."""
    one = [F.struct(F.lit(i).alias("k"), *[F.col(f"{a}_{p}_{c}").alias(f"{p}_{c}") for p in points for c in "xy"]) for i, a in enumerate(animals)]
    rows = wide.select("file", "frame", F.explode(F.array(*one)).alias("s"))
    row = (F.dense_rank().over(Window.partitionBy("file").orderBy("frame")) - 1) * len(animals) + F.col("s.k")
    return rows.select("file", row.alias("row"), *[F.col(f"s.{p}_{c}") for p in points for c in "xy"])


def with_geometry(animal: DataFrame, geometry: DataFrame) -> DataFrame:
    """Geometry columns beside the animal's, by file and frame; a geometry file is that of the animal whose name has animal for geom."""
    named = geometry.withColumn("file", F.regexp_replace("file", "geom", "animal"))
    return named.join(animal, ["file", "frame"])


def pivoted(df: DataFrame, keys: list[str], of: str, names: dict, values: list[str], empty=None) -> DataFrame:
    """One row per keys with <value>_<name> for each value of the column of (names: its values and what they are called), by one aggregate.

    Combinations without a row are empty; of several rows the largest value is taken.
    """
    cells = [(F.max(F.when(F.col(of) == F.lit(k), F.col(v))), f"{v}_{name}") for k, name in names.items() for v in values]
    return df.groupBy(*keys).agg(*[(c if empty is None else F.coalesce(c, F.lit(empty))).alias(n) for c, n in cells])


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = ".enh") -> DataFrame:
    """Left join on keys; columns of right whose names left has too (in any case) get the suffix."""
    taken = {c.lower() for c in left.columns} - {k.lower() for k in keys}
    return left.join(right.withColumnsRenamed({c: c + suffix for c in right.columns if c.lower() in taken}), keys, "left")
