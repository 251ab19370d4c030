"""Two animals: distances, directed events, event summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawprint.functions.geometry import angle_deg, circular_diff_deg, distance
from pawprint.functions.windows import track
from pawprint.operators.bouts import with_runs
from pawprint.schema import SocIntConfig


def _at(p: str) -> tuple[Column, Column]:
    return F.col(f"{p}_x"), F.col(f"{p}_y")


def _facing(i: int, target: str) -> Column:
    """The angle at animal i's nose between its heading and the target, in degrees."""
    (nx, ny), (bx, by), (tx, ty) = _at(f"nose{i}"), _at(f"body{i}"), _at(target)
    return angle_deg(nx - bx, ny - by, tx - nx, ty - ny)


def _heading(i: int) -> Column:
    (nx, ny), (bx, by) = _at(f"nose{i}"), _at(f"body{i}")
    return F.when((nx == bx) & (ny == by), None).otherwise(F.pmod(F.degrees(F.atan2(ny - by, nx - bx)), F.lit(360.0)))


def dyad_measures(d: DataFrame, cfg: SocIntConfig) -> DataFrame:
    """Adds distances, facing angles, heading difference and speeds (null in the first frame)."""
    w = track("file")
    cols = {f"d_{a}_{b}": distance(*_at(a), *_at(b)) for a, b in (("nose1", "nose2"), ("body1", "body2"), ("tail1", "tail2"), ("nose1", "body2"), ("nose1", "tail2"), ("nose2", "body1"), ("nose2", "tail1"))}
    cols |= {f"ang_{i}_{t}": _facing(i, t) for i, o in ((1, 2), (2, 1)) for t in (f"nose{o}", f"body{o}", f"tail{o}")}
    cols["heading_diff"] = circular_diff_deg(_heading(1), _heading(2))
    for i in (1, 2):
        x, y = _at(f"body{i}")
        cols[f"speed{i}"] = distance(x, y, F.lag(x).over(w), F.lag(y).over(w)) * cfg.fps
    return d.withColumns(cols)


def events(m: DataFrame, cfg: SocIntConfig) -> DataFrame:
    """Adds the 17 base events as nullable booleans."""
    w = track("file")
    c, body = F.col, F.col("d_body1_body2")
    # rounded, since an angle at the limit may come out to either side of it
    facing = lambda a: F.round(c(a), 9) <= cfg.facing_deg
    contact = lambda d, a: (c(d) <= cfg.contact) & facing(a)
    ago, ahead = F.lag(body, cfg.lag).over(w), F.lead(body, cfg.lag).over(w)
    s1, s2 = c("speed1") > cfg.move, c("speed2") > cfg.move
    out = {
        "a1_nose_to_nose2": contact("d_nose1_nose2", "ang_1_nose2"),
        "a1_nose_to_body2": contact("d_nose1_body2", "ang_1_body2"),
        "a1_nose_to_tail2": contact("d_nose1_tail2", "ang_1_tail2"),
        "a2_nose_to_nose1": contact("d_nose1_nose2", "ang_2_nose1"),
        "a2_nose_to_body1": contact("d_nose2_body1", "ang_2_body1"),
        "a2_nose_to_tail1": contact("d_nose2_tail1", "ang_2_tail1"),
        "side_by_side_parallel": (c("d_nose1_nose2") <= cfg.side) & (body <= cfg.side) & (c("d_tail1_tail2") <= cfg.side) & (F.round("heading_diff", 9) <= cfg.parallel_deg),
        "side_by_side_antiparallel": (c("d_nose1_tail2") <= cfg.side) & (body <= cfg.side) & (c("d_nose2_tail1") <= cfg.side) & (F.round("heading_diff", 9) >= cfg.anti_deg),
        "close_proximity": body <= cfg.close,
        "medium_proximity": (body > cfg.close) & (body <= cfg.medium),
        "mutually_facing": facing("ang_1_nose2") & facing("ang_2_nose1") & (body <= cfg.medium),
        "a1_following_a2": (body <= cfg.follow) & (F.lag("speed2", cfg.lag).over(w) > cfg.move) & s1,
        "a2_following_a1": (body <= cfg.follow) & (F.lag("speed1", cfg.lag).over(w) > cfg.move) & s2,
        "a1_avoidance_from_a2": (body <= cfg.avoid_start) & (ahead - body >= cfg.avoid_delta) & s1,
        "a2_avoidance_from_a1": (body <= cfg.avoid_start) & (ahead - body >= cfg.avoid_delta) & s2,
        "approach_event": (ago >= cfg.approach_start) & (ago - body >= cfg.approach_delta) & (s1 | s2),
        "retreat_event": (body <= cfg.retreat_start) & (ahead - body >= cfg.retreat_delta) & (s1 | s2),
    }
    return m.withColumns(out)


#: The base events.
BASE_EVENTS = [
    "a1_nose_to_nose2", "a1_nose_to_body2", "a1_nose_to_tail2", "a2_nose_to_nose1", "a2_nose_to_body1", "a2_nose_to_tail1",
    "side_by_side_parallel", "side_by_side_antiparallel", "close_proximity", "medium_proximity", "mutually_facing",
    "a1_following_a2", "a2_following_a1", "a1_avoidance_from_a2", "a2_avoidance_from_a1", "approach_event", "retreat_event",
]


def suppressed(e: DataFrame, names: list[str], min_frames: int) -> DataFrame:
    """The named events as plain booleans: null is false, and runs of fewer than min_frames are. All in two windows over one order.

    A frame stays if some stretch of min_frames true frames holds it.
    """
    w = track("file")
    ahead, back = w.rowsBetween(0, min_frames - 1), w.rowsBetween(1 - min_frames, 0)
    e = e.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})
    if min_frames <= 1:
        return e
    begins = {f"__b_{n}": F.count_if(n).over(ahead) == min_frames for n in names}
    return e.withColumns(begins).withColumns({n: F.bool_or(f"__b_{n}").over(back) for n in names}).drop(*begins)


def combined_events() -> dict[str, Column]:
    """The 15 events made of base events, which suppressed() has to have made plain before."""
    c = F.col
    face1, face2, body1, body2, tail1, tail2 = c("a1_nose_to_nose2"), c("a2_nose_to_nose1"), c("a1_nose_to_body2"), c("a2_nose_to_body1"), c("a1_nose_to_tail2"), c("a2_nose_to_tail1")
    any1, any2 = face1 | body1 | tail1, face2 | body2 | tail2
    return {
        "a1_face_investigation": face1, "a2_face_investigation": face2, "face_investigation": face1 | face2,
        "a1_body_investigation": body1, "a2_body_investigation": body2, "body_investigation": body1 | body2,
        "a1_anogenital_investigation": tail1, "a2_anogenital_investigation": tail2, "anogenital_investigation": tail1 | tail2,
        "a1_any_directed_contact": any1, "a2_any_directed_contact": any2,
        "mutual_directed_contact": any1 & any2, "a1_only_directed_contact": any1 & ~any2, "a2_only_directed_contact": any2 & ~any1,
        "any_social_contact": any1 | any2 | c("side_by_side_parallel") | c("side_by_side_antiparallel"),
    }


def event_summary(e: DataFrame, names: list[str], cfg: SocIntConfig) -> DataFrame:
    """file, event_type, event_frames, duration_s, percent_time, bout_n, mean_bout_s, max_bout_s, latency_s.

    Runs under min_event_frames don't count. All events go through one pass over long rows.
    """
    long = e.select("file", "frame", F.explode(F.array(*[F.struct(F.lit(n).alias("event_type"), F.coalesce(F.col(n), F.lit(False)).alias("flag")) for n in names])).alias("s")).select("file", "frame", "s.*")
    keys = ["file", "event_type"]
    runs = with_runs(long, F.col("flag"), keys).groupBy(*keys, "on", "run").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("frames"))
    counts = F.col("on") & (F.col("frames") >= cfg.min_event_frames)
    frames, fps = F.when(counts, F.col("frames")), F.lit(float(cfg.fps))
    total = F.coalesce(F.sum(frames), F.lit(0)).cast("long")
    return runs.groupBy(*keys).agg(
        total.alias("event_frames"),
        (total / fps).alias("duration_s"),
        (total / F.sum("frames") * 100).alias("percent_time"),  # the runs of a track make up all its frames
        F.count(frames).alias("bout_n"),
        (F.avg(frames) / fps).alias("mean_bout_s"),
        (F.max(frames) / fps).alias("max_bout_s"),
        (F.min(F.when(counts, F.col("start"))) / fps).alias("latency_s"),
    )


def proximity_bins(m: DataFrame, cfg: SocIntConfig) -> DataFrame:
    """file, bin (left-closed), time_s, percent of the frames with a distance; bins without frames have 0."""
    edges = [*cfg.proximity, float("inf")]
    names = [f"{a:g}_{b:g}" for a, b in zip(edges, edges[1:], strict=False)]
    d = F.col("d_body1_body2")
    one = F.array(*[F.struct(F.lit(n).alias("bin"), F.coalesce((d >= a) & (d < b), F.lit(False)).alias("inside")) for n, a, b in zip(names, edges, edges[1:], strict=False)])
    long = m.select("file", d.isNotNull().alias("ok"), F.explode(one).alias("s")).select("file", "ok", "s.*")
    n = F.count_if("inside")
    return long.groupBy("file", "bin").agg((n / F.lit(cfg.fps)).alias("time_s"), (F.try_divide(n, F.count_if("ok")) * 100).alias("percent"))


def overlap(e: DataFrame, a: str, b: str) -> DataFrame:
    """file, n_both, a_given_b, b_given_a."""
    both, na, nb = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a)), F.count_if(F.col(b))
    return e.groupBy("file").agg(both.alias("n_both"), F.try_divide(both, nb).alias("a_given_b"), F.try_divide(both, na).alias("b_given_a"))


def directional_bias(s: DataFrame, a: str, b: str) -> DataFrame:
    """file, bias: (a - b) / (a + b) of two events' durations."""
    of = lambda n: F.sum(F.when(F.col("event_type") == n, F.col("duration_s")))
    return s.groupBy("file").agg(of(a).alias("a1_s"), of(b).alias("a2_s")).withColumn("bias", F.try_divide(F.col("a1_s") - F.col("a2_s"), F.col("a1_s") + F.col("a2_s")))


#: The durations that a file's summary has, and their events.
SUMMARY_EVENTS = {
    "any_social_contact_s": "any_social_contact", "close_proximity_s": "close_proximity", "a1_directed_contact_s": "a1_any_directed_contact", "a2_directed_contact_s": "a2_any_directed_contact",
    "face_investigation_s": "face_investigation", "body_investigation_s": "body_investigation", "anogenital_investigation_s": "anogenital_investigation", "mutual_directed_contact_s": "mutual_directed_contact",
    "a1_only_directed_contact_s": "a1_only_directed_contact", "a2_only_directed_contact_s": "a2_only_directed_contact", "approach_event_s": "approach_event", "retreat_event_s": "retreat_event",
}


def file_summary(measures: DataFrame, summary: DataFrame, cfg: SocIntConfig, qc: DataFrame | None = None) -> DataFrame:
    """A row for each file: durations of events, shares and rates of directed contact, distances, speeds.

    summary is event_summary()'s table. qc has a row for each file and part (frac_missing_original, flag_high_missing,
    impossible_jump_n, qc_fail) and adds the worst of them.
    """
    fps = F.lit(float(cfg.fps))
    of = summary.groupBy("file").agg(*[F.max(F.when(F.col("event_type") == e, F.col("duration_s"))).alias(n) for n, e in SUMMARY_EVENTS.items()])
    moved = F.coalesce(F.sum(F.col("speed1") / fps), F.lit(0.0)) + F.coalesce(F.sum(F.col("speed2") / fps), F.lit(0.0))
    body = F.col("d_body1_body2")
    out = measures.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_frames"),
        (F.count(F.lit(1)) / fps).alias("duration_video_s"),
        (F.count(body) / fps).alias("duration_analyzed_s"),
        moved.alias("total_distance_moved"),
        F.avg(body).alias("mean_body_distance"),
        F.median(body).alias("median_body_distance"),
        F.avg("speed1").alias("mean_speed_a1"),
        F.avg("speed2").alias("mean_speed_a2"),
    ).join(of, "file", "left")
    a1, a2 = F.col("a1_directed_contact_s"), F.col("a2_directed_contact_s")
    out = out.withColumns({
        "directional_bias_a1_minus_a2": F.try_divide(a1 - a2, a1 + a2),
        "a1_minus_a2_directed_contact_s": a1 - a2,
        "a1_over_a2_directed_contact_ratio": F.try_divide(a1, a2),
        "a1_fraction_of_total_directed_contact": F.try_divide(a1, a1 + a2),
        "directed_contact_per_distance_moved": F.try_divide(a1 + a2, "total_distance_moved"),
        "close_proximity_per_distance_moved": F.try_divide("close_proximity_s", "total_distance_moved"),
    })
    if qc is None:
        return out
    worst = qc.groupBy("file").agg(F.max("frac_missing_original").alias("qc_max_missing_fraction"), F.bool_or("flag_high_missing").alias("qc_any_high_missing"), F.sum("impossible_jump_n").alias("qc_total_impossible_jumps"), F.bool_or("qc_fail").alias("qc_fail"))
    return out.join(worst, "file", "left")


def file_chain(e: DataFrame, cfg: SocIntConfig, qc: DataFrame | None = None, others: tuple[str, str] = ("close_proximity", "approach_event")) -> DataFrame:
    """The file's summary with proximity bins, overlaps and gaps between bouts of contact beside it: one row for each file.

    e has the measures and base events of each frame; short runs go, and combined events come of what stays.
    """
    from pawprint.operators.bouts import intervals_between
    from pawprint.operators.reshape import pivoted

    more = combined_events()
    kept = suppressed(e, BASE_EVENTS, cfg.min_event_frames).withColumns(more)
    out = file_summary(e, event_summary(kept, [*BASE_EVENTS, *more], cfg), cfg, qc)
    edges = [f"{a:g}_{b:g}" for a, b in zip(cfg.proximity, [*cfg.proximity[1:], float("inf")], strict=True)]
    bins = pivoted(proximity_bins(e, cfg), ["file"], "bin", {b: b for b in edges}, ["time_s", "percent"])
    bins = bins.withColumnsRenamed({f"{v}_{b}": f"proximity_{b}_cm_{v}" for v in ("time_s", "percent") for b in edges})
    gaps = intervals_between(kept, F.col("any_social_contact"), cfg.fps, cfg.min_event_frames / cfg.fps).select("file", *[F.col(c).alias(f"any_social_contact_{c.replace('_s', '_interbout_s')}") for c in ("mean_s", "median_s")])
    return out.join(bins, "file", "left").join(overlap(kept, *others), "file", "left").join(gaps, "file", "left")
