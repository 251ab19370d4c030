"""Open field: per-frame flags, summaries, bins, epochs and derived metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pawprint.functions.geometry import grid_cell, in_zones, line_distance, wrapped
from pawprint.functions.stats import slopes
from pawprint.functions.windows import entered, entropy_bits, track
from pawprint.operators.bouts import bout_summary
from pawprint.operators.movement import movement
from pawprint.operators.reshape import pivoted
from pawprint.operators.zones import open_field_zones, zone_state
from pawprint.schema import OftConfig
from pawprint.sources.adapters import ARENA


def frame_table(frames: DataFrame, cfg: OftConfig, arena: list[tuple[float, float]] = ARENA) -> DataFrame:
    """Adds time, speed and acceleration in cm and s, zone flags, state and wall distance. One exchange, on file."""
    zones = open_field_zones(arena, cfg.centre_scale, cfg.corner_scale, cfg.periphery_scale)
    x, y = F.col("x"), F.col("y")
    out = movement(frames, cfg.fps, cfg.move_cm_s, cfg.integration)
    out = (
        out.withColumn("time_s", F.col("frame") / F.lit(cfg.fps))
        .withColumn("speed_cm_s", F.col("speed") * cfg.fps)
        .withColumn("acceleration_cm_s2", F.col("acceleration") * cfg.fps**2)
        .withColumn("is_immobile", ~F.col("is_moving"))
        .withColumn("in_arena", in_zones(x, y, [arena]))
        .withColumn("in_center", in_zones(x, y, zones["centre"]))
        .withColumn("in_periphery", in_zones(x, y, zones["periphery"], invert=True))
        .withColumn("in_corners", in_zones(x, y, zones["corners"]))
        .withColumn("wall_distance_cm", line_distance(x, y, arena))
    )
    return out.withColumn("zone", F.when(x.isNotNull(), zone_state(F.col("in_center"), F.col("in_corners"), F.col("in_periphery"))).otherwise("unknown"))


def _time(flag: str, fps: float) -> Column:
    return F.count_if(F.col(flag)) / F.lit(fps)


def bin_table(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """One row per track and bin of bin_s."""
    b = t.withColumn("bin_start_s", F.floor(F.col("time_s") / cfg.bin_s) * cfg.bin_s)
    b = b.withColumn("__in", entered(F.col("in_center"), track("file", "bin_start_s")))
    return b.groupBy("file", "bin_start_s").agg(
        F.count(F.lit(1)).alias("frames"),
        _time("in_center", cfg.fps).alias("center_time_s"),
        _time("in_periphery", cfg.fps).alias("periphery_time_s"),
        _time("in_corners", cfg.fps).alias("corner_time_s"),
        _time("is_moving", cfg.fps).alias("moving_time_s"),
        _time("is_immobile", cfg.fps).alias("immobile_time_s"),
        F.sum(F.col("speed_cm_s") / cfg.fps).alias("distance_cm"),
        F.avg("speed_cm_s").alias("mean_speed_cm_s"),
        F.avg("wall_distance_cm").alias("mean_wall_distance_cm"),
        F.count_if("__in").alias("center_entries"),
    )


def epochs(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """One row per track and epoch: the first and last epoch_s, or half of the track if it is shorter than both."""
    end = F.max("time_s").over(Window.partitionBy("file"))
    e = t.withColumn("__end", end).withColumn("__len", F.least(F.lit(cfg.epoch_s), F.col("__end") / 2))
    name = F.when(F.col("time_s") < F.col("__len"), "first_epoch").when(F.col("time_s") >= F.col("__end") - F.col("__len"), "last_epoch")
    e = e.withColumn("epoch", name).filter(F.col("epoch").isNotNull()).withColumn("__in", entered(F.col("in_center"), track("file", "epoch")))
    n = F.count(F.lit(1))
    return e.groupBy("file", "epoch").agg(
        (n / F.lit(cfg.fps)).alias("duration_s"),
        (F.count_if("in_center") / n * 100).alias("center_percent"),
        F.count_if("__in").alias("center_entries"),
        F.sum(F.col("speed_cm_s") / cfg.fps).alias("distance_cm"),
        F.avg("speed_cm_s").alias("mean_speed_cm_s"),
        F.avg("wall_distance_cm").alias("mean_wall_distance_cm"),
        _time("is_immobile", cfg.fps).alias("immobile_time_s"),
    )


def epoch_deltas(e: DataFrame, metrics: list[str]) -> DataFrame:
    """file, <metric>_delta: last less first."""
    last = lambda m: F.max(F.when(F.col("epoch") == "last_epoch", F.col(m)))
    first = lambda m: F.max(F.when(F.col("epoch") == "first_epoch", F.col(m)))
    return e.groupBy("file").agg(*[(last(m) - first(m)).alias(f"{m}_delta") for m in metrics])


def wall_thresholds(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """file, threshold_cm, near_wall_time_s, near_wall_percent, near_wall_entries."""
    each = t.select("file", "frame", "wall_distance_cm", F.explode(F.array(*[F.lit(float(w)) for w in cfg.wall_cm])).alias("threshold_cm"))
    each = each.withColumn("near", F.coalesce(F.col("wall_distance_cm") <= F.col("threshold_cm"), F.lit(False))).withColumn("__in", entered(F.col("near"), track("file", "threshold_cm")))
    n = F.count_if("near")
    return each.groupBy("file", "threshold_cm").agg((n / F.lit(cfg.fps)).alias("near_wall_time_s"), (n / F.count(F.lit(1)) * 100).alias("near_wall_percent"), F.count_if("__in").alias("near_wall_entries"))


def velocity_states(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """file, velocity_state, time_s, percent, mean_speed_cm_s, of rows with a speed."""
    state = F.when(F.col("speed_cm_s") < cfg.slow_cm_s, "low_speed_or_rest").when(F.col("speed_cm_s") < cfg.fast_cm_s, "moderate_speed").otherwise("high_speed")
    n = t.filter(F.col("speed_cm_s").isNotNull()).withColumn("velocity_state", state).groupBy("file", "velocity_state").agg(F.count(F.lit(1)).alias("n"), F.avg("speed_cm_s").alias("mean_speed_cm_s"))
    total = F.sum("n").over(Window.partitionBy("file"))
    return n.select("file", "velocity_state", (F.col("n") / F.lit(cfg.fps)).alias("time_s"), (F.col("n") / total * 100).alias("percent"), "mean_speed_cm_s")


def path_geometry(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """file, path_length_cm, net_displacement_cm, turn angles and speeds, sharp_turn_fraction, tortuosity.

    Steps and turns are between neighbouring frames: next to a missing frame there are none. The net displacement is between the first and the last valid frame, null if there are not two.
    """
    w = track("file")
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    v = t.select("file", "frame", "x", "y", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    v = v.withColumn("heading", F.atan2("dy", "dx"))
    v = v.withColumn("turn", F.abs(wrapped(F.col("heading") - F.lag("heading").over(w))) * (180 / math.pi))
    v = v.withColumn("step", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).withColumn("at", F.when(ok, F.col("frame")))
    first, last = (lambda c: F.min_by(c, "at")), (lambda c: F.max_by(c, "at"))  # null places are left out
    net = F.when(F.count("at") >= 2, F.sqrt((last("x") - first("x")) ** 2 + (last("y") - first("y")) ** 2))
    return (
        v.groupBy("file")
        .agg(
            F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length_cm"),
            net.alias("net_displacement_cm"),
            F.avg("turn").alias("mean_turn_deg"),
            F.median("turn").alias("median_turn_deg"),
            (F.avg("turn") * cfg.fps).alias("mean_angular_velocity_deg_s"),
            F.avg((F.col("turn") >= 90).cast("int")).alias("sharp_turn_fraction"),
        )
        .withColumn("tortuosity", F.try_divide("path_length_cm", "net_displacement_cm"))
    )


def occupancy(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """file, valid_fraction, cells, coverage_percent, entropy_bits, entropy_norm over a grid of the arena."""
    n = t.withColumn("ok", F.col("x").isNotNull() & F.col("y").isNotNull())
    cell = F.when(F.col("ok"), grid_cell(F.col("x"), cfg.arena_cm, cfg.grid) * cfg.grid + grid_cell(F.col("y"), cfg.arena_cm, cfg.grid))
    counts = n.groupBy("file", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    valid = F.col("cell").isNotNull()
    used = F.when(valid, F.col("n"))
    out = counts.groupBy("file").agg((F.coalesce(F.sum(used), F.lit(0)) / F.sum("n")).alias("valid_fraction"), F.count(used).alias("cells"), entropy_bits(used).alias("entropy_bits"))
    return out.withColumn("coverage_percent", F.col("cells") / F.lit(cfg.grid**2) * 100).withColumn("entropy_norm", F.col("entropy_bits") / math.log2(cfg.grid**2))


def transition_matrix(t: DataFrame, state: str = "zone", keys: list[str] | None = None, order: str = "frame") -> DataFrame:
    """keys, from, to, n, probability of first-order transitions, staying included; null and unknown rows are left out first."""
    keys = keys or ["file"]
    known = t.filter(F.col(state).isNotNull() & (F.col(state) != "unknown"))
    pairs = known.select(*keys, F.col(state).alias("from"), F.lead(state).over(Window.partitionBy(*keys).orderBy(order)).alias("to")).filter("to is not null")
    n = pairs.groupBy(*keys, "from", "to").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from")))


def fragmentation(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """file, switches, switches_per_min, moving_to_immobile, immobile_to_moving."""
    s = t.select("file", "frame", "is_moving", F.lag("is_moving").over(track("file")).alias("was"))
    n = F.count_if(F.col("is_moving") != F.col("was"))
    return s.groupBy("file").agg(n.alias("switches"), (n / (F.count(F.lit(1)) / F.lit(cfg.fps * 60))).alias("switches_per_min"), F.count_if(F.col("was") & ~F.col("is_moving")).alias("moving_to_immobile"), F.count_if(~F.col("was") & F.col("is_moving")).alias("immobile_to_moving"))


def bursts(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """file, bursts (and their s), rate a minute, p95 and p99 of the speed."""
    n = bout_summary(t, F.col("speed_cm_s") >= cfg.burst_cm_s, cfg.fps, cfg.burst_s).select("file", "bouts", "total_s")
    q = t.groupBy("file").agg(F.percentile("speed_cm_s", 0.95).alias("p95"), F.percentile("speed_cm_s", 0.99).alias("p99"), (F.count(F.lit(1)) / F.lit(cfg.fps * 60)).alias("__min"))
    return n.join(q, "file").withColumn("bursts_per_min", F.try_divide("bouts", "__min")).drop("__min")


def oft_summary(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """One row per track: locomotion, zones, immobility and wall distance, in one aggregate and the bouts."""
    w = track("file")
    e = t
    for z in ("in_center", "in_periphery", "in_corners"):
        e = e.withColumn(f"__{z}", entered(F.col(z), w))
    n = F.count(F.lit(1))
    out = e.groupBy("file").agg(
        (n / F.lit(cfg.fps)).alias("total_time_s"),
        F.sum("speed").alias("distance_cm"),
        F.avg("speed_cm_s").alias("mean_speed_cm_s"),
        F.avg(F.when(F.col("is_moving"), F.col("speed_cm_s"))).alias("moving_speed_cm_s"),
        _time("is_moving", cfg.fps).alias("moving_time_s"),
        _time("in_center", cfg.fps).alias("center_time_s"),
        (F.count_if("in_center") / n * 100).alias("center_time_percent"),
        F.sum(F.when(F.col("in_center"), F.col("speed"))).alias("center_distance_cm"),
        F.count_if("__in_center").alias("center_entries"),
        (F.min(F.when(F.col("in_center"), F.col("frame"))) / F.lit(cfg.fps)).alias("center_latency_s"),
        _time("in_periphery", cfg.fps).alias("periphery_time_s"),
        F.count_if("__in_periphery").alias("periphery_entries"),
        _time("in_corners", cfg.fps).alias("corner_time_s"),
        F.count_if("__in_corners").alias("corner_entries"),
        F.avg("wall_distance_cm").alias("mean_wall_distance_cm"),
        F.median("wall_distance_cm").alias("median_wall_distance_cm"),
        F.min("wall_distance_cm").alias("min_wall_distance_cm"),
        F.max("wall_distance_cm").alias("max_wall_distance_cm"),
    )
    for flag, name, least in (("in_center", "center", 0.0), ("is_immobile", "immobility", cfg.immobility_s)):
        b = bout_summary(t, F.col(flag), cfg.fps, least).select("file", F.col("bouts").alias(f"{name}_bouts"), F.col("mean_s").alias(f"{name}_mean_bout_s"), F.col("max_s").alias(f"{name}_max_bout_s"))
        out = out.join(b, "file")
    return out


def locomotion_normalised(s: DataFrame, cols: list[str]) -> DataFrame:
    """file, <col>_per_m: metrics of a summary for each metre moved."""
    return s.select("file", *[F.try_divide(F.col(c), F.col("distance_cm") / 100).alias(f"{c}_per_m") for c in cols])


def centre_score(s: DataFrame, by: list[str]) -> DataFrame:
    """Adds center_score: the mean of the known z-scores (centre %, entries, -latency, wall distance) within by."""
    signs = {"center_time_percent": 1.0, "center_entries": 1.0, "center_latency_s": -1.0, "mean_wall_distance_cm": 1.0}
    columns = s.columns
    # a row of moments for each group (one in all without groups), joined back
    keys = {f"__k{i}": F.col(c) for i, c in enumerate(by)} or {"__k0": F.lit(0)}
    moments = s.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(*[f(c).alias(f"__{n}_{c}") for c in signs for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    if not by:
        moments = F.broadcast(moments)
    same = [k.eqNullSafe(moments[n]) for n, k in keys.items()]
    s = s.join(moments, same)
    parts = [F.when(F.col(f"__s_{c}") > 0, sign * (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")) for c, sign in signs.items()]
    known = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    score = F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), known)
    return s.select(*columns, score.alias("center_score"))


def enhanced_row(t: DataFrame, cfg: OftConfig, slope_metrics: tuple[str, ...] = ("distance_cm", "center_time_s", "mean_speed_cm_s")) -> DataFrame:
    """One row per track: slopes over bins, epoch changes, wall thresholds and velocity states in columns, path geometry and occupancy.

    A track without rows for a part has nulls there; times, percents, frames and entries of states that don't occur are 0.
    """
    long = slopes(bin_table(t, cfg), "bin_start_s", list(slope_metrics), ["file"])
    out = occupancy(t, cfg).join(path_geometry(t, cfg), "file", "left")
    out = out.join(pivoted(long, ["file"], "metric", {m: m for m in slope_metrics}, ["slope_per_min", "intercept", "r_squared"]), "file", "left")
    deltas = ["center_percent", "center_entries", "distance_cm", "mean_speed_cm_s", "mean_wall_distance_cm", "immobile_time_s"]
    out = out.join(epoch_deltas(epochs(t, cfg), deltas), "file", "left")
    walls = wall_thresholds(t, cfg)
    out = out.join(pivoted(walls, ["file"], "threshold_cm", {float(w): f"{w:g}cm" for w in cfg.wall_cm}, ["near_wall_time_s", "near_wall_percent", "near_wall_entries"], empty=0), "file", "left")
    states = {s: s for s in ("low_speed_or_rest", "moderate_speed", "high_speed")}
    found = velocity_states(t, cfg)
    return out.join(pivoted(found, ["file"], "velocity_state", states, ["time_s", "percent"], empty=0).join(pivoted(found, ["file"], "velocity_state", states, ["mean_speed_cm_s"]), "file"), "file", "left")


def scored(enhanced: DataFrame, scores: DataFrame, keys: list[str], min_valid: float) -> DataFrame:
    """enhanced with the scores of its keys, if any, and enhanced_qc_flag: flagged, too few valid frames, or no occupancy.

    scores has the keys, qc_flag and further columns of other names than enhanced's. Unknown flags and fractions count as bad.
    """
    bad = F.coalesce("qc_flag", F.lit(True)) | F.coalesce(F.col("valid_fraction") < min_valid, F.lit(True)) | F.col("entropy_norm").isNull()
    return enhanced.join(scores, keys, "left").withColumn("enhanced_qc_flag", bad)
