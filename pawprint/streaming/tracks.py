"""Tracks as streams: an extension; the batch operators have no streaming counterpart to follow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(frames: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Per track and time window: frames, valid, mean_x, mean_y. Needs ts (timestamp), file, x, y."""
    w = F.window("ts", f"{seconds} seconds")
    out = frames.withWatermark("ts", late).groupBy("file", w).agg(F.count(F.lit(1)).alias("frames"), F.count("x").alias("valid"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    return out.select("file", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "frames", "valid", "mean_x", "mean_y")


def bouts(frames: DataFrame, flag: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of true frames as session windows: file, start, end, frames."""
    s = F.session_window("ts", gap)
    out = frames.filter(F.col(flag)).withWatermark("ts", late).groupBy("file", s).agg(F.count(F.lit(1)).alias("frames"))
    return out.select("file", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames")


def steps(frames: DataFrame) -> DataFrame:
    """file, n, distance: a running path length per track, with the last position as state."""

    def update(key, batches, state):
        n, dist, x, y = state.get if state.exists else (0, 0.0, None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "frame"])
        for px, py in zip(rows.x, rows.y, strict=True):
            n += 1
            if pd.notna(px) and pd.notna(py):
                if x is not None:
                    dist += ((px - x) ** 2 + (py - y) ** 2) ** 0.5
                x, y = float(px), float(py)
        state.update((n, dist, x, y))
        yield pd.DataFrame({"file": [key[0]], "n": [n], "distance": [dist]})

    return frames.select("file", "ts", "frame", "x", "y").groupBy("file").applyInPandasWithState(update, "file string, n long, distance double", "n long, distance double, x double, y double", "update", "NoTimeout")
