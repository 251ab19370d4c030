"""Steps, speeds and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawprint.functions.windows import changed, first_difference, majority, track


def movement(df: DataFrame, fps: float, cutoff: float = 5.0, integration: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Adds delta_x, delta_y, speed and acceleration (a frame), is_moving (majority of speed > cutoff / fps)."""
    w = track(*(keys or ["file"]))
    out = df.withColumn("delta_x", first_difference(F.col("x"), w)).withColumn("delta_y", first_difference(F.col("y"), w))
    out = out.withColumn("speed", F.sqrt(F.col("delta_x") ** 2 + F.col("delta_y") ** 2))
    out = out.withColumn("acceleration", first_difference(F.col("speed"), w))
    return out.withColumn("is_moving", majority(F.col("speed") > cutoff / fps, integration, w))


def clean(df: DataFrame, likelihood: float = 0.95, max_step: float | None = None, existence: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Nulls positions of low likelihood, after jumps over max_step, or where existence is false. Rows stay."""
    w = track(*(keys or ["file"]))
    bad = F.coalesce(F.col("likelihood") < likelihood, F.lit(False))
    if existence is not None:
        bad = bad | ~F.coalesce(existence, F.lit(True))
    if max_step is not None:
        step = F.sqrt(first_difference(F.col("x"), w) ** 2 + first_difference(F.col("y"), w) ** 2)
        bad = bad | F.coalesce(step > max_step, F.lit(False))
    return df.withColumn("__bad", bad).withColumn("x", F.when(~F.col("__bad"), F.col("x"))).withColumn("y", F.when(~F.col("__bad"), F.col("y"))).drop("__bad")


def summary(moved: DataFrame, fps: float, keys: list[str] | None = None, where: Column | None = None, more: list[Column] | None = None) -> DataFrame:
    """raw_distance, distance_moving, raw_speed, speed_moving, time_moving, total_time, time_stationary, percentage_moving; where: only its rows.

    more: further aggregates of all rows.
    """
    on = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    speed, moving = F.when(on, F.col("speed")), F.when(on & F.col("is_moving"), F.col("speed"))
    n, m = F.count(F.when(on, 1)), F.count(F.when(on & F.col("is_moving"), 1))
    still = F.count(F.when(on & ~F.col("is_moving"), 1))
    return moved.groupBy(*(keys or ["file"])).agg(
        F.coalesce(F.sum(speed), F.lit(0.0)).alias("raw_distance"),
        F.coalesce(F.sum(moving), F.lit(0.0)).alias("distance_moving"),
        (F.avg(speed) * fps).alias("raw_speed"),
        (F.avg(moving) * fps).alias("speed_moving"),
        (m / F.lit(float(fps))).alias("time_moving"),
        (n / F.lit(float(fps))).alias("total_time"),
        (still / F.lit(float(fps))).alias("time_stationary"),
        (F.try_divide(m, n) * 100).alias("percentage_moving"),
        *(more or []),
    )


def transitions(df: DataFrame, flag: Column, integration: int, keys: list[str] | None = None) -> DataFrame:
    """keys, transitions: changes of the smoothed flag."""
    keys = keys or ["file"]
    w = track(*keys)
    return df.withColumn("__s", majority(flag, integration, w)).withColumn("__c", changed(F.col("__s"), w)).groupBy(*keys).agg(F.count_if("__c").alias("transitions"))


def zone_report(moved: DataFrame, zones: dict[str, Column], fps: float, integration: int, keys: list[str] | None = None) -> DataFrame:
    """One row per track and zone: summary() of the rows in the zone, and transitions. One pass over the frames."""
    keys = keys or ["file"]
    flagged = moved.select(*keys, "frame", "speed", "is_moving", F.explode(F.create_map(*[x for n, z in zones.items() for x in (F.lit(n), z)])).alias("zone", "inside"))
    by = [*keys, "zone"]
    w = track(*by)
    flagged = flagged.withColumn("__s", majority(F.col("inside"), integration, w)).withColumn("__c", changed(F.col("__s"), w))
    return summary(flagged, fps, by, F.col("inside"), [F.count_if("__c").alias("transitions")])
