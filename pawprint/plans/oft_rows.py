"""Open field: the whole summary and enhanced rows of a track, from few passes over its frame table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pawprint.functions.geometry import wrapped
from pawprint.functions.stats import t_p_value
from pawprint.functions.windows import entered, majority, track
from pawprint.plans.oft import bin_table, occupancy
from pawprint.schema import OftConfig

SLOPE_METRICS = ("distance_cm", "mean_speed_cm_s", "center_time_s", "periphery_time_s", "corner_time_s", "moving_time_s", "immobile_time_s", "mean_wall_distance_cm", "center_entries")
#: Metrics of an epoch whose change is told.
DELTA_METRICS = ("distance_cm", "mean_speed_cm_s", "center_time_s", "center_time_percent", "mean_wall_distance_cm", "wall_5cm_percent", "wall_10cm_percent", "moving_time_s", "immobile_time_s")
STATES = ("low_speed_or_rest", "moderate_speed", "high_speed")


def with_bouts(t: DataFrame, flags: dict[str, Column], keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Adds <name>_start (a bout begins) and <name>_frames (its length, in its last frame, else null) for each flag. Null flags are false; one sort for all."""
    w = track(*keys)
    now = {n: F.coalesce(f, F.lit(False)) for n, f in flags.items()}
    out = t.withColumns({"__idx": F.row_number().over(w), **{f"__on_{n}": c for n, c in now.items()}})
    out = out.withColumns({f"{n}_start": F.col(f"__on_{n}") & ~F.coalesce(F.lag(f"__on_{n}").over(w), F.lit(False)) for n in flags} | {f"__end_{n}": F.col(f"__on_{n}") & ~F.coalesce(F.lead(f"__on_{n}").over(w), F.lit(False)) for n in flags})
    since = w.rowsBetween(Window.unboundedPreceding, 0)
    first = {n: F.last(F.when(F.col(f"{n}_start"), F.col("__idx")), ignorenulls=True).over(since) for n in flags}
    out = out.withColumns({f"__first_{n}": c for n, c in first.items()})
    out = out.withColumns({f"{n}_frames": F.when(F.col(f"__end_{n}"), F.col("__idx") - F.col(f"__first_{n}") + 1) for n in flags})
    return out.drop("__idx", *[f"__{k}_{n}" for n in flags for k in ("on", "end", "first")])


def summary_row(t: DataFrame, cfg: OftConfig, ids: DataFrame | None = None, high_missing: float = 0.2, high_low_likelihood: float = 0.2) -> DataFrame:
    """One row per track with all of its summary: locomotion, centre, periphery, corners, immobility, wall, quality.

    ids has a row for each file and columns (ID, Batch, Code) that are put beside it. One exchange, on file. Bouts of
    immobility under cfg.immobility_s don't count; unknown quality figures flag a track.
    """
    w, fps = track("file"), F.lit(float(cfg.fps))
    zones = {"center": F.col("in_center"), "periphery": F.col("in_periphery"), "corner": F.col("in_corners")}
    t = t.withColumns({"__s": majority(F.col("in_center"), cfg.integration, w), "__dx": F.col("x") - F.lag("x").over(w), "__dy": F.col("y") - F.lag("y").over(w)})
    t = t.withColumns({"__c": F.coalesce(F.col("__s") != F.lag("__s").over(w), F.lit(False)), "__step": F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2)})
    t = with_bouts(t, {**zones, "immobility": F.col("is_immobile")})
    n = F.count(F.lit(1))
    seconds = lambda c: F.count_if(c) / fps
    still = F.col("immobility_frames") / fps
    long = F.when(still >= cfg.immobility_s, still)
    out = [
        (n / fps).alias("total_time_s"),
        F.coalesce(F.sum("speed"), F.lit(0.0)).alias("distance_cm"),
        F.avg("speed_cm_s").alias("mean_speed_cm_s"),
        F.avg(F.when(F.col("is_moving"), F.col("speed_cm_s"))).alias("moving_speed_cm_s"),
        seconds(F.col("is_moving")).alias("moving_time_s"),
        ((n - F.count_if("is_moving")) / fps).alias("stationary_time_s"),
        (F.count_if("is_moving") / n * 100).alias("percent_moving"),
    ]
    for name, flag in zones.items():
        bout = F.col(f"{name}_frames") / fps
        out += [seconds(flag).alias(f"{name}_time_s"), (F.count_if(flag) / n * 100).alias(f"{name}_time_percent"), F.count_if(f"{name}_start").alias(f"{name}_entries"), F.avg(bout).alias(f"{name}_mean_bout_s"), F.max(bout).alias(f"{name}_max_bout_s")]
        if name != "corner":
            out.append(F.coalesce(F.sum(F.when(flag, F.col("speed"))), F.lit(0.0)).alias(f"{name}_distance_cm"))
    out += [
        F.count_if("__c").alias("center_transitions"),
        (F.min(F.when(F.col("in_center"), F.col("frame"))) / fps).alias("center_latency_s"),
        F.count(long).alias("immobility_bouts"),
        F.coalesce(F.sum(long), F.lit(0.0)).alias("immobility_time_s"),
        F.avg(long).alias("immobility_mean_bout_s"),
        F.max(long).alias("immobility_max_bout_s"),
        *[f("wall_distance_cm").alias(f"{k}_wall_distance_cm") for k, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))],
        (F.count_if(F.col("x").isNull() | F.col("y").isNull()) / n).alias("bodycentre_missing_fraction"),
        (F.count_if(F.coalesce(F.col("likelihood") < cfg.likelihood, F.lit(True))) / n).alias("bodycentre_low_likelihood_fraction"),
        F.count_if(F.col("__step") > cfg.jump_cm).alias("bodycentre_impossible_jump_n"),
    ]
    s = t.groupBy("file").agg(*out).withColumn("fps", fps).withColumn("center_distance_percent", F.try_divide("center_distance_cm", "distance_cm") * 100)
    bad = lambda c, most: F.coalesce(F.col(f"bodycentre_{c}") > most, F.lit(True))
    s = s.withColumn("qc_flag", bad("missing_fraction", high_missing) | bad("low_likelihood_fraction", high_low_likelihood) | bad("impossible_jump_n", 0))
    return s if ids is None else s.join(ids, "file", "left")


def epoch_metrics(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """One row per track and epoch (the first and last cfg.epoch_s, or half of the track if it is shorter than both) with 14 metrics."""
    end = F.max("time_s").over(Window.partitionBy("file"))
    size = F.least(F.lit(float(cfg.epoch_s)), end / 2)
    name = F.when(F.col("time_s") < size, "first_epoch").when(F.col("time_s") >= end - size, "last_epoch")
    fps, n = F.lit(float(cfg.fps)), F.count(F.lit(1))
    near = lambda cm: F.count_if(F.col("wall_distance_cm") <= cm)
    return (
        t.withColumn("epoch", name)
        .filter(F.col("epoch").isNotNull())
        .groupBy("file", "epoch")
        .agg(
            (n / fps).alias("epoch_time_s"),
            F.coalesce(F.sum(F.col("speed_cm_s") / fps), F.lit(0.0)).alias("distance_cm"),
            F.avg("speed_cm_s").alias("mean_speed_cm_s"),
            *[(F.count_if(c) / fps).alias(f"{k}_time_s") for k, c in (("center", "in_center"), ("periphery", "in_periphery"), ("corner", "in_corners"), ("moving", "is_moving"), ("immobile", "is_immobile"))],
            (F.count_if("in_center") / n * 100).alias("center_time_percent"),
            F.avg("wall_distance_cm").alias("mean_wall_distance_cm"),
            *[(near(cm) / fps).alias(f"wall_{cm}cm_time_s") for cm in (5, 10)],
            *[(near(cm) / n * 100).alias(f"wall_{cm}cm_percent") for cm in (5, 10)],
        )
    )


def epochs_wide(e: DataFrame) -> DataFrame:
    """file, <metric>_first_epoch, <metric>_last_epoch and delta_<metric> (last less first) of epoch_metrics()."""
    of = lambda m, name: F.max(F.when(F.col("epoch") == name, F.col(m)))
    wide = e.groupBy("file").agg(*[of(m, name).alias(f"{m}_{name}") for m in DELTA_METRICS for name in ("first_epoch", "last_epoch")])
    return wide.withColumns({f"delta_{m}": F.col(f"{m}_last_epoch") - F.col(f"{m}_first_epoch") for m in DELTA_METRICS})


def wide_slopes(bins: DataFrame, x: str, metrics: tuple[str, ...], keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """keys, and slope_per_min, intercept, r_squared, p_value of each metric ~ x (s, distinct within keys), as columns <value>_<metric>. Null under three rows."""
    xs = F.col(x).cast("double")
    each = []
    for m in metrics:
        y = F.col(m).cast("double")
        n = F.count(F.when(xs.isNotNull() & y.isNotNull(), 1))
        each += [n.alias(f"__n_{m}"), *[F.when(n >= 3, f(y, xs)).alias(f"{k}_{m}") for k, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r_squared", F.regr_r2))]]
    fit = bins.groupBy(*keys).agg(*each)
    out = list(keys)
    for m in metrics:
        r2, rest = F.col(f"r_squared_{m}"), F.col(f"__n_{m}") - 2
        p = F.when((r2 >= 1) & (F.col(f"slope_{m}") != 0), 0.0).otherwise(t_p_value(F.sqrt(F.try_divide(r2 * rest, 1 - r2)), rest.cast("double")))
        out += [(F.col(f"slope_{m}") * 60).alias(f"slope_per_min_{m}"), f"intercept_{m}", f"r_squared_{m}", p.alias(f"p_value_{m}")]
    return fit.select(*out)


def frame_metrics(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """One row per track, in one aggregate: path and turns, time and entries near walls, velocity states."""
    w, fps, n = track("file"), F.lit(float(cfg.fps)), F.count(F.lit(1))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    t = t.withColumns({"__dx": F.col("x") - F.lag("x").over(w), "__dy": F.col("y") - F.lag("y").over(w), "__at": F.when(ok, F.col("frame")), **{f"__near_{cm:g}": F.coalesce(F.col("wall_distance_cm") <= cm, F.lit(False)) for cm in cfg.wall_cm}})
    t = t.withColumn("__h", F.atan2("__dy", "__dx"))
    t = t.withColumns({"__turn": F.abs(wrapped(F.col("__h") - F.lag("__h").over(w))) * (180 / math.pi), "__step": F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2), **{f"__in_{cm:g}": entered(F.col(f"__near_{cm:g}"), w) for cm in cfg.wall_cm}})
    v = F.col("speed_cm_s")
    t = t.withColumn("__state", F.when(v < cfg.slow_cm_s, STATES[0]).when(v < cfg.fast_cm_s, STATES[1]).when(v.isNotNull(), STATES[2]))
    first, last = (lambda c: F.min_by(c, "__at")), (lambda c: F.max_by(c, "__at"))
    net = F.when(F.count("__at") >= 2, F.sqrt((last("x") - first("x")) ** 2 + (last("y") - first("y")) ** 2))
    out = [
        (F.count("__at") / n).alias("valid_frame_fraction"),
        F.coalesce(F.sum("__step"), F.lit(0.0)).alias("total_distance_from_frames_cm"),
        net.alias("net_displacement_cm"),
        F.avg("__turn").alias("mean_turn_angle_deg"),
        F.median("__turn").alias("median_turn_angle_deg"),
        (F.avg("__turn") * fps).alias("mean_angular_velocity_deg_s"),
        F.avg((F.col("__turn") >= 90).cast("int")).alias("high_turn_fraction_90deg"),
    ]
    for cm in cfg.wall_cm:
        near = F.count_if(f"__near_{cm:g}")
        out += [(near / fps).alias(f"wall_time_s_{cm:g}cm"), (near / n * 100).alias(f"wall_time_percent_{cm:g}cm"), F.count_if(f"__in_{cm:g}").alias(f"wall_entries_{cm:g}cm")]
    for s in STATES:
        here = F.col("__state") == s
        out += [(F.count_if(here) / fps).alias(f"state_time_s_{s}"), (F.try_divide(F.count_if(here), F.count("__state")) * 100).alias(f"state_time_percent_{s}"), F.avg(F.when(here, v)).alias(f"state_mean_speed_cm_s_{s}")]
    return t.groupBy("file").agg(*out).withColumn("tortuosity_distance_over_displacement", F.try_divide("total_distance_from_frames_cm", "net_displacement_cm"))


def enhanced_full(t: DataFrame, cfg: OftConfig) -> DataFrame:
    """One row per track: nine slopes over bins with their p, nine metrics of both epochs and their changes, path, walls, states, occupancy.

    All parts keep the frame table's partitioning by file. On a table bucketed by file (see suite.bucketed) none of them has an exchange.
    """
    out = frame_metrics(t, cfg).join(epochs_wide(epoch_metrics(t, cfg)), "file", "left")
    out = out.join(wide_slopes(bin_table(t, cfg), "bin_start_s", SLOPE_METRICS), "file", "left")
    o = occupancy(t, cfg).select("file", F.lit(cfg.grid).alias("occupancy_grid_n"), F.when(F.col("cells") > 0, F.col("cells")).alias("occupied_bins_n"), F.lit(cfg.grid**2).alias("total_bins_n"), F.when(F.col("cells") > 0, F.col("coverage_percent")).alias("arena_coverage_percent"), F.when(F.col("cells") > 0, F.col("entropy_bits")).alias("occupancy_entropy"), F.when(F.col("cells") > 0, F.col("entropy_norm")).alias("occupancy_entropy_normalized"))
    return out.join(o, "file", "left")
