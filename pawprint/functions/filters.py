"""Savitzky-Golay smoothing and derivatives along a track, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weights(window: int = 25, degree: int = 3, derivative: int = 0) -> np.ndarray:
    """Row p: the weights of a window's values for the fitted polynomial's derivative at place p of the window."""
    x = np.arange(window, dtype=float)
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    out = np.zeros((window, window))
    for k in range(derivative, degree + 1):
        out += np.outer(x ** (k - derivative), fit[k]) * (math.factorial(k) / math.factorial(k - derivative))
    return out


def smoothed(df: DataFrame, cols: dict[str, str], window: int = 25, degree: int = 3, derivative: int = 0, keys: tuple[str, ...] = ("file",), order: str = "frame") -> DataFrame:
    """df with further columns: cols maps a column to the name of its smoothed one. One exchange and sort for all columns.

    Frames inside a track are sums of window neighbours with fixed weights, as lags of one window order. The first and
    the last half window use the polynomial of the track's first and last window: they are computed from the rows near
    the ends alone. Null for tracks shorter than a window. Values have to be complete (see interpolate()): a window
    with a null gives null.
    """
    w, half, near = Window.partitionBy(*keys).orderBy(order), window // 2, window + window // 2
    table = weights(window, degree, derivative)
    placed = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    inner = placed
    for col, name in cols.items():
        terms = [F.lag(col, half - k).over(w) * float(table[half, k]) for k in range(window)]
        inner = inner.withColumn(name, reduce(lambda a, b: a + b, terms))
    inner = inner.filter((F.col("__i") >= half) & (F.col("__i") < F.col("__n") - half))
    ends = placed.filter((F.col("__i") < near) | (F.col("__i") >= F.col("__n") - near))
    values = F.collect_list(F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(cols)])).over(w.rowsBetween(1 - window, window - 1))
    ends = ends.withColumn("__v", values).filter((F.col("__i") < half) | (F.col("__i") >= F.col("__n") - half))
    start = F.least(F.greatest(F.col("__i") - half, F.lit(0)), F.col("__n") - window)
    part = F.slice("__v", (start - F.greatest(F.col("__i") - (window - 1), F.lit(0)) + 1).cast("int"), F.lit(window))
    row = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in table]), (F.col("__i") - start).cast("int"))
    for k, name in enumerate(cols.values()):
        dot = F.aggregate(F.zip_with(part, row, lambda p, x: p[f"v{k}"] * x), F.lit(0.0), lambda s, p: s + p)  # noqa: B023
        ends = ends.withColumn(name, F.when(F.col("__n") >= window, dot))
    return inner.drop("__i", "__n").unionByName(ends.drop("__i", "__n", "__v"))


def savitzky_golay(df: DataFrame, col: str, name: str, window: int = 25, degree: int = 3, derivative: int = 0, keys: tuple[str, ...] = ("file",), order: str = "frame") -> DataFrame:
    """smoothed() of one column."""
    return smoothed(df, {col: name}, window, degree, derivative, keys, order)


def joint_speeds(df: DataFrame, points: list[str], fps: float = 1.0, window: int = 25, degree: int = 3, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Adds <point>_speed of wide points: the lengths of their smoothed velocities, a frame (or a second with fps)."""
    names = {f"{p}_{c}": f"__d_{p}_{c}" for p in points for c in "xy"}
    out = smoothed(df, names, window, degree, 1, keys)
    return out.withColumns({f"{p}_speed": F.sqrt(F.col(f"__d_{p}_x") ** 2 + F.col(f"__d_{p}_y") ** 2) * fps for p in points}).drop(*names.values())


def smooth_speed(df: DataFrame, fps: float, window: int = 25, degree: int = 3, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Adds smooth_speed: the length of the smoothed velocity of x and y, a second."""
    out = smoothed(df, {"x": "__dx", "y": "__dy"}, window, degree, 1, keys)
    return out.withColumn("smooth_speed", F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2) * fps).drop("__dx", "__dy")
