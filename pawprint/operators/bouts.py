"""Runs of true flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_runs(df: DataFrame, flag: Column, keys: list[str], order: str = "frame") -> DataFrame:
    """Adds on (flag, null as false), idx (from 0) and run (constant within a run of equal flags, with on)."""
    w, w_on = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, "on").orderBy(order)
    out = df.withColumn("on", F.coalesce(flag, F.lit(False))).withColumn("idx", F.row_number().over(w) - 1)
    return out.withColumn("run", F.col("idx") - F.row_number().over(w_on))


def bouts(df: DataFrame, flag: Column, fps: float, min_s: float = 0.0, keys: list[str] | None = None, order: str = "frame") -> DataFrame:
    """keys, start and end (row index), frames, duration_s, for runs of at least min_s."""
    keys = keys or ["file"]
    found = with_runs(df, flag, keys, order).filter("on").groupBy(*keys, "run").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count(F.lit(1)).alias("frames"))
    return found.withColumn("duration_s", F.col("frames") / F.lit(float(fps))).filter(F.col("duration_s") >= min_s).drop("run")


def bout_summary(df: DataFrame, flag: Column, fps: float, min_s: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """A row for each track: bouts, total_s, mean_s, max_s, latency_s (of any true row, null if none)."""
    keys = keys or ["file"]
    runs = with_runs(df, flag, keys)
    each = runs.groupBy(*keys, "on", "run").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("frames"))
    long = F.col("on") & (F.col("frames") / F.lit(float(fps)) >= min_s)
    seconds = F.when(long, F.col("frames") / F.lit(float(fps)))
    return each.groupBy(*keys).agg(
        F.count(F.when(long, 1)).alias("bouts"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_s"),
        F.avg(seconds).alias("mean_s"),
        F.max(seconds).alias("max_s"),
        (F.min(F.when(F.col("on"), F.col("start"))) / F.lit(float(fps))).alias("latency_s"),
    )


def suppress_short(df: DataFrame, flag: Column, min_frames: int, keys: list[str], name: str) -> DataFrame:
    """Adds name: the flag without its runs of fewer than min_frames."""
    runs = with_runs(df, flag, keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "on", "run"))
    return runs.withColumn(name, F.col("on") & (n >= min_frames)).drop("on", "idx", "run")


def intervals_between(df: DataFrame, flag: Column, fps: float, min_s: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """keys, n, mean_s, median_s of the gaps between bouts that follow each other."""
    keys = keys or ["file"]
    gap = (F.col("start") - F.lag("end").over(Window.partitionBy(*keys).orderBy("start")) - 1) / F.lit(float(fps))
    gaps = bouts(df, flag, fps, min_s, keys).withColumn("gap_s", gap)
    return gaps.groupBy(*keys).agg(F.count("gap_s").alias("n"), F.avg("gap_s").alias("mean_s"), F.median("gap_s").alias("median_s"))
