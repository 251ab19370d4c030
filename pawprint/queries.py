"""Registered queries of the pose operators over the driver's tables, and the same rows as DuckDB SQL.

Floating results are rounded on both sides, since engines differ in the last digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pawprint.functions import geometry as g
from pawprint.functions import stats
from pawprint.functions import windows as win
from pawprint.operators import bouts as bt
from pawprint.operators import calibrate as cal
from pawprint.operators import labels as lab
from pawprint.operators import movement as mv
from pawprint.operators import qc
from pawprint.operators import reshape as rs
from pawprint.operators import zones as zn
from pawprint.operators.interpolate import interpolate
from pawprint.plans import assays, oft, social
from pawprint.schema import OftConfig, SocIntConfig
from pawprint.sources.adapters import ARENA, FPS, dyads_from_events, points_from_events, pose_from_events, pose_from_lineitem

QUERIES = {}
ORACLES = {}

#: The driver's tracks are short and slow: two frames a second, bins and epochs to match.
CFG = OftConfig(fps=FPS, bin_s=10.0, epoch_s=10.0, move_cm_s=10.0, integration=2, slow_cm_s=10.0, fast_cm_s=40.0, sustained_s=(1.0, 2.0), burst_cm_s=60.0, burst_s=1.0, wall_cm=(5.0, 10.0))
SOC = SocIntConfig(fps=FPS, contact=8.0, side=25.0, close=12.0, medium=25.0, facing_deg=90.0, move=10.0, follow=30.0, avoid_start=30.0, avoid_delta=5.0, approach_start=10.0, approach_delta=4.0, retreat_start=20.0, retreat_delta=4.0, min_event_frames=2)

#: frames of pose_from_events
F_SQL = """f as (
  select cast(user_id as varchar) as file, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
    case when event_type <> 'error' then value / 10 end as x,
    case when event_type <> 'error' then cast(regexp_extract(props, '[0-9]+') as double) * 0.49::double end as y,
    case when event_type = 'error' then 0.5::double else 1.0::double end as likelihood, event_type as label, event_id,
    user_id % 3 as batch, user_id % 2 as grp
  from events)"""
P_SQL = F_SQL + """, p as (
  select file, user_id, frame, x as body_x, y as body_y, x + (event_id % 5) - 2 as nose_x, y + (event_id % 7) - 3 as nose_y,
    x - (event_id % 3) as tail_x, y - (event_id % 4) as tail_y from f)"""
#: movement() with CFG, and zone flags of the square arena
M_SQL = F_SQL + """, m0 as (
  select *, case when frame = 0 then 0 else x - lag(x) over w end as dx, case when frame = 0 then 0 else y - lag(y) over w end as dy from f window w as (partition by file order by frame)),
m1 as (select *, sqrt(dx * dx + dy * dy) as speed from m0),
m2 as (select *, case when frame = 0 then 0 else speed - lag(speed) over (partition by file order by frame) end as acceleration,
    avg(case when speed > 5.0 then 1 when speed <= 5.0 then 0 end) over (partition by file order by frame rows between 2 preceding and 2 following) > 0.5 as is_moving from m1),
m as (select *, frame / 2.0::double as time_s, speed * 2 as speed_cm_s, acceleration * 4 as acceleration_cm_s2, not is_moving as is_immobile,
    x > 0 and x < 49 and y > 0 and y < 49 as in_arena,
    x > 12.25 + 1e-10 and x < 36.75 - 1e-10 and y > 12.25 + 1e-10 and y < 36.75 - 1e-10 as in_center,
    not (x > 4.9 + 1e-10 and x < 44.1 - 1e-10 and y > 4.9 + 1e-10 and y < 44.1 - 1e-10) as in_periphery,
    (x < 9.8 - 1e-10 or x > 39.2 + 1e-10 and x < 58.8 - 1e-10) and (y < 9.8 - 1e-10 or y > 39.2 + 1e-10) as in_corners,
    least(abs(x), abs(49 - x), abs(y), abs(49 - y)) as wall_distance_cm from m2),
t as (select *, case when x is null then 'unknown' when in_center then 'center' when in_corners then 'corner' when in_periphery then 'periphery' else 'other' end as zone from m)"""
D_SQL = P_SQL + """, d0 as (
  select cast(a.user_id // 2 as varchar) as file, a.frame, a.body_x as bx1, a.body_y as by1, a.nose_x as nx1, a.nose_y as ny1, a.tail_x as tx1, a.tail_y as ty1,
    b.body_x as bx2, b.body_y as by2, b.nose_x as nx2, b.nose_y as ny2, b.tail_x as tx2, b.tail_y as ty2
  from p a join p b on a.user_id % 2 = 0 and b.user_id = a.user_id + 1 and a.frame = b.frame),
d1 as (select *, sqrt((nx1-nx2)*(nx1-nx2)+(ny1-ny2)*(ny1-ny2)) as d_nn, sqrt((bx1-bx2)*(bx1-bx2)+(by1-by2)*(by1-by2)) as d_bb, sqrt((tx1-tx2)*(tx1-tx2)+(ty1-ty2)*(ty1-ty2)) as d_tt,
    sqrt((nx1-bx2)*(nx1-bx2)+(ny1-by2)*(ny1-by2)) as d_nb, sqrt((nx1-tx2)*(nx1-tx2)+(ny1-ty2)*(ny1-ty2)) as d_nt,
    sqrt((nx2-bx1)*(nx2-bx1)+(ny2-by1)*(ny2-by1)) as d_bn, sqrt((nx2-tx1)*(nx2-tx1)+(ny2-ty1)*(ny2-ty1)) as d_tn,
    sqrt((bx1-lag(bx1) over w)*(bx1-lag(bx1) over w)+(by1-lag(by1) over w)*(by1-lag(by1) over w))*2 as s1,
    sqrt((bx2-lag(bx2) over w)*(bx2-lag(bx2) over w)+(by2-lag(by2) over w)*(by2-lag(by2) over w))*2 as s2
  from d0 window w as (partition by file order by frame))"""


#: zone_report()'s columns over rows of file, zone, speed, b (inside), is_moving and ch (a change)
ZONE_COLUMNS_SQL = """round(coalesce(sum(speed) filter (b), 0), 4) + 0.0::double as raw_distance, round(coalesce(sum(speed) filter (b and is_moving), 0), 4) + 0.0::double as distance_moving,
  round(avg(speed) filter (b) * 2, 4) + 0.0::double as raw_speed, round(avg(speed) filter (b and is_moving) * 2, 4) + 0.0::double as speed_moving,
  count(*) filter (b and is_moving) / 2.0::double as time_moving, count(*) filter (b) / 2.0::double as total_time, count(*) filter (b and not is_moving) / 2.0::double as time_stationary,
  round(100 * count(*) filter (b and is_moving) / nullif(count(*) filter (b), 0)::double, 4) + 0.0::double as percentage_moving, count(*) filter (ch) as transitions"""


BIN_COLUMNS_SQL = ZONE_COLUMNS_SQL[: ZONE_COLUMNS_SQL.rindex(", count(*) filter (ch)")]


def angle_sql(hx: str, hy: str, tx: str, ty: str) -> str:
    """The angle of two vectors in degrees, null for a vector of no length."""
    dot, size = f"(({hx})*({tx})+({hy})*({ty}))", f"(sqrt(({hx})*({hx})+({hy})*({hy}))*sqrt(({tx})*({tx})+({ty})*({ty})))"
    return f"case when {size} > 0 then degrees(acos(greatest(-1.0::double, least(1.0::double, {dot} / {size})))) end"


def r(c, n: int = 6):
    return F.round(c, n)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*[F.round(F.col(c), n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(expr: str, n: int = 6) -> str:
    return f"round({expr}, {n}) + 0.0::double"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pose_from_events(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oft.frame_table(frames(spark, sf_dir), CFG)


BOUT_SQL = """, i as (select file, frame, coalesce({flag}, false) as b from {src}),
j as (select *, frame - row_number() over (partition by file, b order by frame) as run from i),
k as (select file, b, run, min(frame) as s, max(frame) as e, count(*) as n from j group by file, b, run)"""
SUMMARY_SQL = """ select file, count(*) filter (b and n / 2.0 >= {least}) as bouts,
  coalesce(sum(n / 2.0::double) filter (b and n / 2.0 >= {least}), 0.0) as total_s, round(avg(n / 2.0::double) filter (b and n / 2.0 >= {least}), 6) as mean_s,
  max(n / 2.0::double) filter (b and n / 2.0 >= {least}) as max_s, min(s / 2.0::double) filter (b) as latency_s from k group by file"""


@query("oft_center_bouts", f"with {M_SQL}{BOUT_SQL.format(flag='in_center', src='t')}{SUMMARY_SQL.format(least=0)}")
def oft_center_bouts(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    centre = zn.open_field_zones(ARENA)["centre"]
    return rounded(bt.bout_summary(frames(spark, sf_dir), g.in_zones(x, y, centre), FPS))


@query("adapter_frames", f"with {F_SQL} select file, cast(frame as int) as frame, {R('x')} as x, {R('y')} as y, likelihood, label, batch, grp from f")
def adapter_frames(spark, sf_dir):
    return rounded(frames(spark, sf_dir).drop("user_id", "event_id"))


@query(
    "adapter_lineitem_frames",
    f"""select cast(l_suppkey as varchar) as file, count(*) as n, count(case when l_returnflag <> 'A' then 1 end) as valid, {R("avg(case when l_returnflag <> 'A' then l_quantity * 0.98::double end)", 4)} as mean_x from lineitem group by 1""",
)
def adapter_lineitem_frames(spark, sf_dir):
    return pose_from_lineitem(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("valid"), r(F.avg("x"), 4).alias("mean_x"))


@query("first_diff", f"with {M_SQL} select file, cast(frame as int) as frame, {R('dx')} as dx, {R('speed')} as speed from m1")
def first_diff(spark, sf_dir):
    m = mv.movement(frames(spark, sf_dir), FPS)
    return rounded(m.select("file", "frame", F.col("delta_x").alias("dx"), "speed"))


@query("movement", f"with {M_SQL} select file, cast(frame as int) as frame, {R('acceleration')} as acceleration, is_moving from m2")
def movement(spark, sf_dir):
    return rounded(mv.movement(frames(spark, sf_dir), FPS, 10.0, 2).select("file", "frame", "acceleration", "is_moving"))


FILL_SQL = F_SQL + """, a as (select file, frame, x, max(case when x is not null then frame end) over (partition by file order by frame) as pi,
  min(case when x is not null then frame end) over (partition by file order by frame rows between current row and unbounded following) as ni from f),
b as (select a.file, a.frame, a.x, a.pi, a.ni, p.x as pv, n.x as nv from a left join f p on p.file = a.file and p.frame = a.pi left join f n on n.file = a.file and n.frame = a.ni)"""


@query("interpolate_linear", f"with {FILL_SQL} select file, cast(frame as int) as frame, {R('case when x is not null then x when pi is not null and ni is not null then pv + (nv - pv) * (frame - pi) / (ni - pi) else coalesce(pv, nv) end')} as x from b")
def interpolate_linear(spark, sf_dir):
    return rounded(interpolate(frames(spark, sf_dir), ["x"]).select("file", "frame", "x"))


@query("interpolate_max_gap", f"with {FILL_SQL} select file, cast(frame as int) as frame, {R('case when x is not null then x when pi is not null and ni is not null then case when ni - pi - 1 <= 1 then pv + (nv - pv) * (frame - pi) / (ni - pi) end end')} as x from b")
def interpolate_max_gap(spark, sf_dir):
    return rounded(interpolate(frames(spark, sf_dir), ["x"], edges="null", max_gap=1).select("file", "frame", "x"))


@query("locf", f"with {F_SQL} select file, cast(frame as int) as frame, {R('last_value(x ignore nulls) over (partition by file order by frame)')} as x from f")
def locf(spark, sf_dir):
    return rounded(frames(spark, sf_dir).select("file", "frame", win.forward_filled(F.col("x"), win.track()).alias("x")))


@query("majority_smooth", f"with {F_SQL} select file, cast(frame as int) as frame, avg(case when x > 3.5::double then 1 when x <= 3.5::double then 0 end) over (partition by file order by frame rows between 3 preceding and 3 following) > 0.5 as s from f")
def majority_smooth(spark, sf_dir):
    return frames(spark, sf_dir).select("file", "frame", win.majority(F.col("x") > 3.5, 3, win.track()).alias("s"))


@query("centred_windows", f"with {F_SQL} select file, cast(frame as int) as frame, {R('avg(x) over w')} as mean_x, {R('sum(y) over w')} as sum_y from f window w as (partition by file order by frame rows between 5 preceding and 5 following)")
def centred_windows(spark, sf_dir):
    w = win.track()
    return rounded(frames(spark, sf_dir).select("file", "frame", win.centred_mean(F.col("x"), 5, w).alias("mean_x"), win.centred_sum(F.col("y"), 5, w).alias("sum_y")))


@query("transitions", f"with {F_SQL}, s as (select file, frame, avg(case when y > 24 then 1 when y <= 24 then 0 end) over (partition by file order by frame rows between 2 preceding and 2 following) > 0.5 as s from f), c as (select file, s <> lag(s) over (partition by file order by frame) as c from s) select file, count(*) filter (c) as transitions from c group by file")
def transitions(spark, sf_dir):
    return mv.transitions(frames(spark, sf_dir), F.col("y") > 24, 2)


@query("entry_count", f"with {F_SQL}, s as (select file, frame, coalesce(x > 3, false) as s from f), c as (select file, s and not coalesce(lag(s) over w, false) as e, s and not coalesce(lag(s) over w, s) as v from s window w as (partition by file order by frame)) select file, count(*) filter (e) as entries, count(*) filter (v) as visits from c group by file")
def entry_count(spark, sf_dir):
    w, flag = win.track(), F.col("x") > 3
    e = frames(spark, sf_dir).select("file", win.entered(flag, w).alias("e"), win.visited(flag, w).alias("v"))
    return e.groupBy("file").agg(F.count_if("e").alias("entries"), F.count_if("v").alias("visits"))


@query("bout_list", f"with {F_SQL}{BOUT_SQL.format(flag='y > 20', src='f')} select file, cast(s as bigint) as start, cast(e as bigint) as \"end\", n as frames, n / 2.0::double as duration_s from k where b and n >= 2")
def bout_list(spark, sf_dir):
    b = bt.bouts(frames(spark, sf_dir), F.col("y") > 20, FPS, 1.0)
    return b.select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "frames", "duration_s")


@query("suppress_short", f"with {F_SQL}{BOUT_SQL.format(flag='y > 20', src='f')} select j.file, cast(j.frame as int) as frame, j.b and k.n >= 3 as kept from j join k using (file, b, run)")
def suppress_short(spark, sf_dir):
    return bt.suppress_short(frames(spark, sf_dir), F.col("y") > 20, 3, ["file"], "kept").select("file", "frame", "kept")


@query("interbout", f"with {F_SQL}{BOUT_SQL.format(flag='y > 20', src='f')}, q as (select file, (s - lag(e) over (partition by file order by s) - 1) / 2.0::double as gap from k where b) select file, count(gap) as n, {R('avg(gap)')} as mean_s, {R('median(gap)')} as median_s from q group by file")
def interbout(spark, sf_dir):
    return rounded(bt.intervals_between(frames(spark, sf_dir), F.col("y") > 20, FPS))


@query("polygon_zones", f"with {M_SQL} select file, cast(frame as int) as frame, in_arena, in_center, in_periphery, in_corners, zone from t")
def polygon_zones(spark, sf_dir):
    return table(spark, sf_dir).select("file", "frame", "in_arena", "in_center", "in_periphery", "in_corners", "zone")


@query("distances", f"with {P_SQL} select file, cast(frame as int) as frame, {R('sqrt((nose_x-body_x)*(nose_x-body_x)+(nose_y-body_y)*(nose_y-body_y))')} as nose_body, {R('abs(nose_x*body_y-body_x*nose_y+(body_x*tail_y-tail_x*body_y)+(tail_x*nose_y-nose_x*tail_y))/2')} as area from p")
def distances(spark, sf_dir):
    at = lambda p: (F.col(f"{p}_x"), F.col(f"{p}_y"))
    return rounded(points_from_events(spark, sf_dir).select("file", "frame", g.distance(*at("nose"), *at("body")).alias("nose_body"), g.area(at("nose"), at("body"), at("tail")).alias("area")))


@query("angles", f"with {P_SQL}, v as (select file, frame, nose_x-body_x as ax, nose_y-body_y as ay, body_x-tail_x as bx, body_y-tail_y as by_ from p) select file, cast(frame as int) as frame, {R('atan2(ax*by_-ay*bx + 0.0::double, ax*bx+ay*by_ + 0.0::double)')} as clockwise, {R(angle_sql('ax', 'ay', 'bx', 'by_'), 5)} as total_deg, {R('least(abs(ax*40-ay*30) % 360, 360 - abs(ax*40-ay*30) % 360)')} as circular from v")
def angles(spark, sf_dir):
    v = points_from_events(spark, sf_dir).select("file", "frame", (F.col("nose_x") - F.col("body_x")).alias("ax"), (F.col("nose_y") - F.col("body_y")).alias("ay"), (F.col("body_x") - F.col("tail_x")).alias("bx"), (F.col("body_y") - F.col("tail_y")).alias("by"))
    c = [F.col(n) for n in ("ax", "ay", "bx", "by")]
    return v.select("file", "frame", r(g.angle_clockwise(*c)).alias("clockwise"), r(g.angle_deg(*c), 5).alias("total_deg"), r(g.circular_diff_deg(c[0] * 40, c[1] * 30)).alias("circular"))


@query("wall_distance", f"with {F_SQL} select file, cast(frame as int) as frame, {R('least(abs(x), abs(49-x), abs(y), abs(49-y))')} as line_cm, {R('least(sqrt(x*x + power(y - greatest(0, least(49, y)), 2)), sqrt(power(49-x, 2) + power(y - greatest(0, least(49, y)), 2)), sqrt(y*y + power(x - greatest(0, least(49, x)), 2)), sqrt(power(49-y, 2) + power(x - greatest(0, least(49, x)), 2)))')} as segment_cm from f")
def wall_distance(spark, sf_dir):
    poly = ARENA
    return rounded(frames(spark, sf_dir).select("file", "frame", g.line_distance(F.col("x"), F.col("y"), g.polygon(*poly)).alias("line_cm"), g.segment_distance(F.col("x"), F.col("y"), poly).alias("segment_cm")))


@query("scale_polygon", "select p.n_nationkey as id, round(7 + p.n_nationkey - (7 + p.n_nationkey) * 0.5 * 0.5 - 3.5 - p.n_nationkey * 0.5 + (3.5 + p.n_nationkey * 0.5) * 0.5 * 1, 6) * 0 + round(0.25 * (7 + p.n_nationkey) * 4, 6) + 0.0::double as area, round((7 + p.n_nationkey) * 4.0, 6) + 0.0::double as moved_area, 10.0::double as cx, 20.0::double as cy from nation p")
def scale_polygon(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") + 7).cast("double").alias("w"))
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    poly = F.array(pt(F.lit(0), F.lit(0)), pt(F.col("w"), F.lit(0)), pt(F.col("w"), F.lit(4)), pt(F.lit(0), F.lit(4)))
    moved = g.recentred(poly, F.lit(10.0), F.lit(20.0))
    cx, cy = g.centre(moved)
    return rounded(n.select("id", g.polygon_area(g.scaled(poly, 0.5)).alias("area"), g.polygon_area(moved).alias("moved_area"), cx.alias("cx"), cy.alias("cy")))


MED_SQL = F_SQL + ", q as (select file, median(x) as mx, median(y) as my, avg(x) as ax, avg(y) as ay from f group by file)"


@query("calibrate", f"with {MED_SQL} select f.file, cast(f.frame as int) as frame, {R('x * 10 / nullif(sqrt(mx*mx+my*my), 0)', 4)} as x from f join q using (file)")
def calibrate(spark, sf_dir):
    """The median position and the origin are ten centimetres apart."""
    f = frames(spark, sf_dir)
    long = f.select("file", F.lit("body").alias("point"), "x", "y")
    med = zn.point_medians(long)
    both = med.unionByName(med.select("file", F.lit("origin").alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    return cal.calibrate(f, cal.calibration_factor(both, "distance", 10.0, ["body", "origin"])).select("file", "frame", r(F.col("x"), 4).alias("x"))


@query("calibrate_anisotropic", f"with {MED_SQL} select file, {R('40 / (mx + 1)')} as cm_per_px_x, {R('30 / (my + 1)')} as cm_per_px_y, {R('abs(40 / (mx + 1) - 30 / (my + 1)) / ((40 / (mx + 1) + 30 / (my + 1)) / 2) * 100', 4)} as anisotropy_percent from q")
def calibrate_anisotropic(spark, sf_dir):
    m = zn.point_medians(frames(spark, sf_dir).withColumn("point", F.lit("b"))).select("file", (F.col("x") + 1).alias("w"), (F.col("y") + 1).alias("h"))
    corners = m.select("file", *[c.alias(n) for n, c in (("tl_x", F.lit(0.0)), ("tl_y", F.lit(0.0)), ("tr_x", F.col("w")), ("tr_y", F.lit(0.0)), ("br_x", F.col("w")), ("br_y", F.col("h")), ("bl_x", F.lit(0.0)), ("bl_y", F.col("h")))])
    out = cal.arena_calibration(corners, 40, 30)
    return out.select("file", r(F.col("cm_per_px_x")).alias("cm_per_px_x"), r(F.col("cm_per_px_y")).alias("cm_per_px_y"), r(F.col("anisotropy_percent"), 4).alias("anisotropy_percent"))


@query("rotate", f"with {MED_SQL} select f.file, cast(frame as int) as frame, {R('ax + (x-ax)*cos(0.5::double) - (y-ay)*sin(0.5::double)', 5)} as x, {R('ay + (x-ax)*sin(0.5::double) + (y-ay)*cos(0.5::double)', 5)} as y from f join q using (file)")
def rotate(spark, sf_dir):
    return rounded(cal.rotate(frames(spark, sf_dir), 0.5).select("file", "frame", "x", "y"), 5)


@query("clean_tracking", f"with {M_SQL}, c as (select file, frame, coalesce(likelihood < 0.9, false) or coalesce(speed > 30, false) or coalesce(not (x < 20), false) as bad, x, y from m1) select file, cast(frame as int) as frame, {R('case when not bad then x end')} as x, {R('case when not bad then y end')} as y from c")
def clean_tracking(spark, sf_dir):
    return rounded(mv.clean(frames(spark, sf_dir), 0.9, 30.0, F.col("x") < 20).select("file", "frame", "x", "y"))


QC_SQL = F_SQL + """, s as (select *, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as step from f window w as (partition by file order by frame)),
z as (select file, count(*) as frames, count(*) / 2.0::double as duration_s, count(*) filter (x is null or y is null) / count(*)::double as mf, count(*) filter (coalesce(likelihood < 0.9, true)) / count(*)::double as lf,
  count(*) filter (step > 40) as jn, count(*) filter (step > 40) / nullif(count(step), 0)::double as jf, median(likelihood) as ml from s group by file)"""


@query("qc_by_track", f"with {QC_SQL} select file, frames, duration_s, {R('mf')} as missing_fraction, {R('1 - mf')} as valid_fraction, {R('lf')} as low_likelihood_fraction, jn as impossible_jump_n, {R('jf')} as impossible_jump_fraction, ml as median_likelihood, coalesce(mf > 0.2, true) or coalesce(lf > 0.2, true) or jn > 0 as qc_flag from z")
def qc_by_track(spark, sf_dir):
    return rounded(qc.flagged(qc.tracking_qc(frames(spark, sf_dir), FPS, 0.9, 40.0)))


@query("qc_longest_gap", f"with {F_SQL}{BOUT_SQL.format(flag='x is null', src='f')}, jj as (select file, count(*) filter (abs(x - l) > 20) as jn from (select file, x, lag(x) over (partition by file order by frame) as l from f) group by file) select k.file, coalesce(sum(n) filter (b), 0)::bigint as n_missing, {R('coalesce(sum(n) filter (b), 0) / sum(n)::double')} as frac_missing, coalesce(max(n) filter (b), 0) as longest_missing_run, max(jn) as impossible_jump_n, coalesce(sum(n) filter (b), 0) / sum(n)::double > 0.2 as flag_high_missing from k join jj using (file) group by k.file")
def qc_longest_gap(spark, sf_dir):
    return rounded(qc.missing_runs(frames(spark, sf_dir), "x", 20.0))


@query("oft_movement_summary", f"with {M_SQL} select file, {R('coalesce(sum(speed), 0)', 4)} as raw_distance, {R('coalesce(sum(speed) filter (is_moving), 0)', 4)} as distance_moving, {R('avg(speed) * 2', 5)} as raw_speed, {R('avg(speed) filter (is_moving) * 2', 5)} as speed_moving, count(*) filter (is_moving) / 2.0::double as time_moving, count(*) / 2.0::double as total_time, count(*) filter (not is_moving) / 2.0::double as time_stationary, {R('100 * count(*) filter (is_moving) / count(*)::double', 5)} as percentage_moving from m2 group by file")
def oft_movement_summary(spark, sf_dir):
    s = mv.summary(mv.movement(frames(spark, sf_dir), FPS, 10.0, 2), FPS)
    return s.select("file", *[r(F.col(c), 4).alias(c) if c.endswith("distance") or c == "distance_moving" else r(F.col(c), 5).alias(c) for c in s.columns[1:]])


@query("zone_report", f"""with {M_SQL}, z as (select file, frame, speed, is_moving, 'center' as zone, in_center as b from m union all select file, frame, speed, is_moving, 'corners', in_corners from m),
  s as (select *, avg(case when b then 1 when not b then 0 end) over (partition by file, zone order by frame rows between 2 preceding and 2 following) > 0.5 as sm from z),
  c as (select *, coalesce(sm <> lag(sm) over (partition by file, zone order by frame), false) as ch from s)
  select file, zone, {ZONE_COLUMNS_SQL} from c group by file, zone""")
def zone_report(spark, sf_dir):
    t = table(spark, sf_dir)
    z = mv.zone_report(t, {"center": F.col("in_center"), "corners": F.col("in_corners")}, FPS, 2)
    return rounded(z, 4)


MAZE_SQL = {"closed_left": "x < 10", "closed_right": "x > 39", "open_top": "y < 10", "open_bottom": "y > 39", "open": "y < 10 or y > 39", "closed": "x < 10 or x > 39", "center": "in_center"}


@query("epm_report", f"""with {M_SQL}, z as ({' union all '.join(f"select file, frame, speed, is_moving, '{n}' as zone, {x} as b from m" for n, x in MAZE_SQL.items())}),
  s as (select *, avg(case when b then 1 when not b then 0 end) over (partition by file, zone order by frame rows between 2 preceding and 2 following) > 0.5 as sm from z),
  c as (select *, coalesce(sm <> lag(sm) over (partition by file, zone order by frame), false) as ch from s)
  select file, zone, {ZONE_COLUMNS_SQL} from c group by file, zone""")
def epm_report(spark, sf_dir):
    arms = {n: F.expr(MAZE_SQL[n]) for n in ("closed_left", "closed_right", "open_top", "open_bottom")}
    return rounded(assays.epm_report(table(spark, sf_dir), F.col("in_center"), arms, FPS, 2), 4)


@query("debounced_contacts", f"with {F_SQL}, o as (select file, frame, coalesce(x < 30, false)::int as o, row_number() over w as n, sum(coalesce(x < 30, false)::int) over v as near, count(*) over v as whole from f window w as (partition by file order by frame), v as (partition by file order by frame rows between 3 preceding and 3 following)), c as (select *, o - coalesce(lag(o) over (partition by file order by frame), 0) as step from o) select file, count(*) filter (step = case when n % 2 = 1 then 1 else -1 end and near >= 3 and whole = 7) as contacts from c group by file")
def debounced_contacts(spark, sf_dir):
    return assays.debounced_contacts(frames(spark, sf_dir), F.col("x") < 30, 3)


@query("body_size", f"with {P_SQL} select file, {R('median(abs((nose_x - body_x) * (tail_y - body_y) - (tail_x - body_x) * (nose_y - body_y)) / 2)')} as median_area, {R('median(sqrt((nose_x - tail_x) * (nose_x - tail_x) + (nose_y - tail_y) * (nose_y - tail_y)))')} as median_length from p group by file")
def body_size(spark, sf_dir):
    p = points_from_events(spark, sf_dir)
    return rounded(qc.body_size(p, g.polygon_area(F.array(*[F.struct(F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for n in ("body", "nose", "tail")])), g.distance(F.col("nose_x"), F.col("nose_y"), F.col("tail_x"), F.col("tail_y"))))


@query("geometry_qc", f"with {P_SQL}, l as (select file, 'body' as point, body_x as x, body_y as y from p union all select file, 'nose', nose_x, nose_y from p), v as (select file, point, 'x' as coord, x as v from l union all select file, point, 'y', y from l) select file, point, coord, count(*) as n_values, count(v) as n_valid, {R('1 - count(v) / count(*)::double')} as missing_fraction, {R('median(v)')} as median_value from v group by file, point, coord")
def geometry_qc(spark, sf_dir):
    return rounded(qc.geometry_qc(rs.points_long(points_from_events(spark, sf_dir), ["body", "nose"])))


@query("legacy_flat", f"with {D_SQL} select file, cast((dense_rank() over (partition by file order by frame) - 1) * 2 as bigint) as row, {R('nx1')} as nose_x, {R('ny1')} as nose_y from d0 union all select file, cast((dense_rank() over (partition by file order by frame) - 1) * 2 + 1 as bigint), {R('nx2')}, {R('ny2')} from d0")
def legacy_flat(spark, sf_dir):
    d = dyads_from_events(spark, sf_dir)
    wide = d.select("file", "frame", *[F.col(f"nose{i}_{c}").alias(f"a{i}_nose_{c}") for i in (1, 2) for c in "xy"])
    flat = rs.legacy_flat(wide, ["a1", "a2"], ["nose"])
    return rounded(flat.withColumn("row", F.col("row").cast("long")))


@query("with_geometry", f"with {P_SQL} select 'animal_' || file as file, cast(frame as int) as frame, {R('tail_x')} as corner_x, {R('nose_x')} as nose_x from p")
def with_geometry(spark, sf_dir):
    p = points_from_events(spark, sf_dir)
    geometry = p.select(F.concat(F.lit("geom_"), "file").alias("file"), "frame", F.col("tail_x").alias("corner_x"))
    return rounded(rs.with_geometry(p.select(F.concat(F.lit("animal_"), "file").alias("file"), "frame", "nose_x"), geometry))


@query("missing_points", "select n_name as point from nation where n_nationkey not in (select s_nationkey from supplier)")
def missing_points(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    points = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("point"))
    return rs.missing_points(points, read("nation").select(F.col("n_name").alias("point")))


@query("extract_labels", "select event_id, event_type from events where event_type in ('click', 'view') and user_id in (1, 2, 3)")
def extract_labels(spark, sf_dir):
    return lab.extract_labels(spark.read.parquet(f"{sf_dir}/events.parquet"), event_type=["click", "view"], user_id=[1, 2, 3], ts=None).select("event_id", "event_type")


@query("motif_cross_tab", "with n as (select event_type as a, user_id % 4 as b, count(*) as n from events group by all) select a, b, n, round(n / sum(n) over (partition by a), 6) + 0.0::double as row_fraction from n")
def motif_cross_tab(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("a"), (F.col("user_id") % 4).alias("b"))
    return rounded(lab.cross_tab(e, "a", "b"))


@query("oft_bins", f"""with {M_SQL}, b as (select *, floor(time_s / 10) * 10 as bs, coalesce(in_center, false) as c from t), e as (select *, c and not coalesce(lag(c) over (partition by file, bs order by frame), false) as en from b)
  select file, bs as bin_start_s, count(*) as frames, count(*) filter (in_center) / 2.0::double as center_time_s, count(*) filter (in_periphery) / 2.0::double as periphery_time_s, count(*) filter (in_corners) / 2.0::double as corner_time_s, count(*) filter (is_moving) / 2.0::double as moving_time_s, count(*) filter (is_immobile) / 2.0::double as immobile_time_s, {R('sum(speed_cm_s / 2)', 4)} as distance_cm, {R('avg(speed_cm_s)', 4)} as mean_speed_cm_s, {R('avg(wall_distance_cm)', 9)} as mean_wall_distance_cm, count(*) filter (en) as center_entries from e group by file, bs""")
def oft_bins(spark, sf_dir):
    b = oft.bin_table(table(spark, sf_dir), CFG)
    return b.select(*[F.round(c, 9 if c == "mean_wall_distance_cm" else 4).alias(c) if t == "double" else F.col(c) for c, t in b.dtypes])


@query("bin_analysis", f"""with {F_SQL}, b as (select file, frame, 'bin.' || cast(floor(frame / 20) + 1 as int) as bin, x, y from f), d as (select *, case when row_number() over w = 1 then 0 else sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) end as s from b window w as (partition by file, bin order by frame))
  select file, bin, {BIN_COLUMNS_SQL} from (select file, bin, s as speed, avg(case when s > 5 then 1 when s <= 5 then 0 end) over (partition by file, bin order by frame rows between 2 preceding and 2 following) > 0.5 as is_moving, true as b from d) group by file, bin""")
def bin_analysis(spark, sf_dir):
    keys = ["file", "bin"]
    s = mv.summary(mv.movement(rs.equal_bins(frames(spark, sf_dir), 20), FPS, 10.0, 2, keys), FPS, keys)
    return rounded(s, 4)


EPOCH_SQL = M_SQL + """, e0 as (select *, max(time_s) over (partition by file) as mx from t), e1 as (select *, case when time_s < least(10, mx / 2) then 'first_epoch' when time_s >= mx - least(10, mx / 2) then 'last_epoch' end as epoch, coalesce(in_center, false) as c from e0),
e2 as (select *, c and not coalesce(lag(c) over (partition by file, epoch order by frame), false) as en from e1 where epoch is not null),
e as (select file, epoch, count(*) / 2.0::double as duration_s, 100 * count(*) filter (in_center) / count(*)::double as center_percent, count(*) filter (en) as center_entries, sum(speed_cm_s / 2) as distance_cm, avg(wall_distance_cm) as wall, avg(speed_cm_s) as mean_speed, count(*) filter (is_immobile) / 2.0::double as immobile from e2 group by file, epoch)"""


@query("oft_epochs", f"with {EPOCH_SQL} select file, epoch, duration_s, {R('center_percent', 4)} as center_percent, center_entries, {R('distance_cm', 4)} as distance_cm, {R('wall', 9)} as mean_wall_distance_cm from e")
def oft_epochs(spark, sf_dir):
    e = oft.epochs(table(spark, sf_dir), CFG)
    return e.select("file", "epoch", "duration_s", r(F.col("center_percent"), 4).alias("center_percent"), "center_entries", r(F.col("distance_cm"), 4).alias("distance_cm"), r(F.col("mean_wall_distance_cm"), 9).alias("mean_wall_distance_cm"))


@query("epoch_delta", f"with {EPOCH_SQL} select a.file, {R('b.center_percent - a.center_percent', 4)} as center_percent_delta, {R('b.distance_cm - a.distance_cm', 3)} as distance_cm_delta from e a join e b on a.file = b.file and a.epoch = 'first_epoch' and b.epoch = 'last_epoch'")
def epoch_delta(spark, sf_dir):
    d = oft.epoch_deltas(oft.epochs(table(spark, sf_dir), CFG), ["center_percent", "distance_cm"])
    return d.select("file", r(F.col("center_percent_delta"), 4).alias("center_percent_delta"), r(F.col("distance_cm_delta"), 3).alias("distance_cm_delta"))


@query("wall_thresholds", f"with {M_SQL}, w as (select file, frame, th as threshold_cm, coalesce(wall_distance_cm <= th, false) as n from t, (values (5.0::double), (10.0::double)) v(th)), e as (select *, n and not coalesce(lag(n) over (partition by file, threshold_cm order by frame), false) as en from w) select file, threshold_cm, count(*) filter (n) / 2.0::double as near_wall_time_s, {R('100 * count(*) filter (n) / count(*)::double', 4)} as near_wall_percent, count(*) filter (en) as near_wall_entries from e group by file, threshold_cm")
def wall_thresholds(spark, sf_dir):
    return rounded(oft.wall_thresholds(table(spark, sf_dir), CFG), 4)


@query("velocity_states", f"with {M_SQL}, v as (select file, case when speed_cm_s < 10 then 'low_speed_or_rest' when speed_cm_s < 40 then 'moderate_speed' else 'high_speed' end as velocity_state, speed_cm_s from t where speed_cm_s is not null), n as (select file, velocity_state, count(*) as n, avg(speed_cm_s) as m from v group by file, velocity_state) select file, velocity_state, n / 2.0::double as time_s, {R('100 * n / sum(n) over (partition by file)::double', 4)} as percent, {R('m', 4)} as mean_speed_cm_s from n")
def velocity_states(spark, sf_dir):
    return rounded(oft.velocity_states(table(spark, sf_dir), CFG), 4)


@query("path_geometry", f"""with {F_SQL}, d as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy, x is not null and y is not null as ok from f window w as (partition by file order by frame)),
  h as (select *, atan2(dy, dx) as hd, sqrt(dx*dx+dy*dy) as st from d), u as (select *, hd - lag(hd) over (partition by file order by frame) as df from h), tt as (select *, degrees(abs(atan2(sin(df), cos(df)))) as turn from u),
  z as (select file, coalesce(sum(st), 0) as pl, case when count(*) filter (ok) >= 2 then sqrt(power(arg_max(x, frame) filter (ok) - arg_min(x, frame) filter (ok), 2) + power(arg_max(y, frame) filter (ok) - arg_min(y, frame) filter (ok), 2)) end as nd, avg(turn) as mt, median(turn) as md, avg(case when turn >= 90 then 1 when turn < 90 then 0 end) as sh from tt group by file)
  select file, {R('pl', 4)} as path_length_cm, {R('nd', 4)} as net_displacement_cm, {R('pl / nullif(nd, 0)', 3)} as tortuosity, {R('mt', 4)} as mean_turn_deg, {R('md', 4)} as median_turn_deg, {R('mt * 2', 4)} as mean_angular_velocity_deg_s, {R('sh', 4)} as sharp_turn_fraction from z""")
def path_geometry(spark, sf_dir):
    p = oft.path_geometry(frames(spark, sf_dir), CFG)
    return p.select("file", *[r(F.col(c), 3 if c == "tortuosity" else 4).alias(c) for c in p.columns if c != "file"])


@query("occupancy_entropy", f"""with {F_SQL}, c as (select file, case when x is not null and y is not null then least(9, greatest(0, floor(x / 4.9::double))) * 10 + least(9, greatest(0, floor(y / 4.9::double))) end as cell from f), n as (select file, cell, count(*) as n from c group by file, cell), s as (select file, sum(n) filter (cell is not null) as v, sum(n) as a, count(*) filter (cell is not null) as cells, log2(sum(n) filter (cell is not null)) - sum(n * log2(n)) filter (cell is not null) / sum(n) filter (cell is not null) as e from n group by file)
  select file, {R('v / a::double')} as valid_fraction, cells, {R('cells::double')} as coverage_percent, {R('e', 5)} as entropy_bits, {R('e / log2(100)', 5)} as entropy_norm from s""")
def occupancy_entropy(spark, sf_dir):
    o = oft.occupancy(frames(spark, sf_dir), CFG)
    return o.select("file", r(F.col("valid_fraction")).alias("valid_fraction"), "cells", r(F.col("coverage_percent")).alias("coverage_percent"), r(F.col("entropy_bits"), 5).alias("entropy_bits"), r(F.col("entropy_norm"), 5).alias("entropy_norm"))


@query("oft_summary", f"""with {M_SQL}, z as (select *, coalesce(in_center, false) as c, coalesce(in_periphery, false) as q, coalesce(in_corners, false) as k from t),
  e as (select *, c and not coalesce(lag(c) over w, false) as ce, q and not coalesce(lag(q) over w, false) as pe, k and not coalesce(lag(k) over w, false) as ke from z window w as (partition by file order by frame)),
  s as (select file, count(*) / 2.0::double as total_time_s, {R('sum(speed)', 4)} as distance_cm, count(*) filter (is_moving) / 2.0::double as moving_time_s, count(*) filter (in_center) / 2.0::double as center_time_s, {R('100 * count(*) filter (in_center) / count(*)::double', 4)} as center_time_percent, count(*) filter (ce) as center_entries, min(frame) filter (in_center) / 2.0::double as center_latency_s, count(*) filter (in_periphery) / 2.0::double as periphery_time_s, count(*) filter (pe) as periphery_entries, count(*) filter (in_corners) / 2.0::double as corner_time_s, count(*) filter (ke) as corner_entries, {R('avg(wall_distance_cm)', 4)} as mean_wall_distance_cm, {R('median(wall_distance_cm)', 4)} as median_wall_distance_cm from e group by file)
  select * from s""")
def oft_summary(spark, sf_dir):
    s = oft.oft_summary(table(spark, sf_dir), CFG)
    return rounded(s.select("file", "total_time_s", "distance_cm", "moving_time_s", "center_time_s", "center_time_percent", "center_entries", "center_latency_s", "periphery_time_s", "periphery_entries", "corner_time_s", "corner_entries", "mean_wall_distance_cm", "median_wall_distance_cm"), 4)


SLOPE_METRICS = ("distance_cm", "center_time_s", "mean_speed_cm_s")
STATES = ("low_speed_or_rest", "moderate_speed", "high_speed")
ENHANCED_SQL = f"""with occ as ({ORACLES["occupancy_entropy"]}), pg as ({ORACLES["path_geometry"]}), wl as ({ORACLES["wall_thresholds"]}), vs as ({ORACLES["velocity_states"]}),
  sl as (with {M_SQL}, b as (select file, floor(time_s / 10) * 10 as bs, sum(speed_cm_s / 2) as distance_cm, count(*) filter (in_center) / 2.0::double as center_time_s, avg(speed_cm_s) as mean_speed_cm_s from t group by 1, 2)
    select file, {", ".join(f"{R(f'case when count({m}) >= 3 then {f} end', n)} as {name}_{m}" for m in SLOPE_METRICS for f, name, n in ((f"regr_slope({m}, bs) * 60", "slope_per_min", 3), (f"regr_intercept({m}, bs)", "intercept", 3), (f"regr_r2({m}, bs)", "r_squared", 3)))} from b group by file),
  dl as (with {EPOCH_SQL} select a.file, {R("b.center_percent - a.center_percent", 4)} as center_percent_delta, b.center_entries - a.center_entries as center_entries_delta, {R("b.distance_cm - a.distance_cm", 3)} as distance_cm_delta,
    {R("b.mean_speed - a.mean_speed", 4)} as mean_speed_cm_s_delta, {R("b.wall - a.wall", 9)} as mean_wall_distance_cm_delta, {R("b.immobile - a.immobile", 4)} as immobile_time_s_delta from e a join e b on a.file = b.file and a.epoch = 'first_epoch' and b.epoch = 'last_epoch'),
  ww as (select file, {", ".join(f"coalesce(max({v}) filter (threshold_cm = {w}), 0) as {v}_{w}cm" for w in (5, 10) for v in ("near_wall_time_s", "near_wall_percent", "near_wall_entries"))} from wl group by file),
  vv as (select file, {", ".join(f"coalesce(max({v}) filter (velocity_state = '{z}'), 0) as {v}_{z}" for z in STATES for v in ("time_s", "percent"))}, {", ".join(f"max(mean_speed_cm_s) filter (velocity_state = '{z}') as mean_speed_cm_s_{z}" for z in STATES)} from vs group by file)
  select * from occ left join pg using (file) left join sl using (file) left join dl using (file) left join ww using (file) left join vv using (file)"""


def _enhanced(spark, sf_dir):
    digits = {"mean_wall_distance_cm_delta": 9, "tortuosity": 3, "distance_cm_delta": 3, "valid_fraction": 6, "coverage_percent": 6, "entropy_bits": 5, "entropy_norm": 5}
    e = oft.enhanced_row(table(spark, sf_dir), CFG, SLOPE_METRICS)
    of = lambda c: 3 if c.startswith(("slope_per_min", "intercept", "r_squared")) else digits.get(c, 4)
    return e.select(*[r(F.col(c), of(c)).alias(c) if t == "double" else F.col(c) for c, t in e.dtypes])


@query("enhanced_row", ENHANCED_SQL)
def enhanced_row(spark, sf_dir):
    return _enhanced(spark, sf_dir)


@query("immobility_bouts", f"with {M_SQL}{BOUT_SQL.format(flag='is_immobile', src='t')}{SUMMARY_SQL.format(least=1)}")
def immobility_bouts(spark, sf_dir):
    return rounded(bt.bout_summary(table(spark, sf_dir), F.col("is_immobile"), FPS, 1.0))


@query("center_score", f"""with {M_SQL}, z as (select *, coalesce(in_center, false) as c from t), e as (select *, c and not coalesce(lag(c) over (partition by file order by frame), false) as ce from z),
  s as (select file, batch, 100 * count(*) filter (in_center) / count(*)::double as a, count(*) filter (ce) as b, min(frame) filter (in_center) / 2.0::double as l, avg(wall_distance_cm) as w from e group by file, batch),
  q as (select file, batch, (a - avg(a) over p) / nullif(stddev_samp(a) over p, 0) as za, (b - avg(b) over p) / nullif(stddev_samp(b) over p, 0) as zb, -(l - avg(l) over p) / nullif(stddev_samp(l) over p, 0) as zl, (w - avg(w) over p) / nullif(stddev_samp(w) over p, 0) as zw from s window p as (partition by batch))
  select file, batch, {R('(coalesce(za,0)+coalesce(zb,0)+coalesce(zl,0)+coalesce(zw,0)) / nullif((za is not null)::int+(zb is not null)::int+(zl is not null)::int+(zw is not null)::int, 0)', 4)} as center_score from q""")
def center_score(spark, sf_dir):
    s = oft.oft_summary(table(spark, sf_dir), CFG).withColumn("batch", F.col("file").cast("long") % 3)
    return oft.centre_score(s, ["batch"]).select("file", "batch", r(F.col("center_score"), 4).alias("center_score"))


TRANS_SQL = M_SQL + ", kk as (select file, zone as a, lead(zone) over (partition by file order by frame) as b from t where zone <> 'unknown'), nn as (select file, a, b, count(*) as n from kk where b is not null group by file, a, b)"


@query("zone_transitions", f"with {TRANS_SQL} select file, a as \"from\", b as \"to\", n, {R('n / sum(n) over (partition by file, a)::double')} as probability from nn")
def zone_transitions(spark, sf_dir):
    return rounded(oft.transition_matrix(table(spark, sf_dir)))


@query("fragmentation", f"with {M_SQL}, w as (select file, is_moving as n, lag(is_moving) over (partition by file order by frame) as o from t) select file, count(*) filter (n <> o) as switches, {R('count(*) filter (n <> o) / (count(*) / 120.0::double)')} as switches_per_min, count(*) filter (o and not n) as moving_to_immobile, count(*) filter (not o and n) as immobile_to_moving from w group by file")
def fragmentation(spark, sf_dir):
    return rounded(oft.fragmentation(table(spark, sf_dir), CFG))


@query("sustained_center", f"with {M_SQL}{BOUT_SQL.format(flag='in_center', src='t')} select file, count(*) filter (b and n >= 2) as n_1s, count(*) filter (b and n >= 4) as n_2s, coalesce(sum(n / 2.0::double) filter (b and n >= 4), 0.0) as time_2s from k group by file")
def sustained_center(spark, sf_dir):
    t = table(spark, sf_dir)
    one = bt.bout_summary(t, F.col("in_center"), FPS, 1.0).select("file", F.col("bouts").alias("n_1s"))
    two = bt.bout_summary(t, F.col("in_center"), FPS, 2.0).select("file", F.col("bouts").alias("n_2s"), F.col("total_s").alias("time_2s"))
    return one.join(two, "file")


@query("bursts", f"with {M_SQL}{BOUT_SQL.format(flag='speed_cm_s >= 60', src='t')}, q as (select file, quantile_cont(speed_cm_s, 0.95) as p95, quantile_cont(speed_cm_s, 0.99) as p99, count(*) / 120.0::double as mi from t group by file), b as (select file, count(*) filter (b and n >= 2) as bouts, coalesce(sum(n / 2.0::double) filter (b and n >= 2), 0.0) as total_s from k group by file) select file, bouts, total_s, {R('p95', 4)} as p95, {R('p99', 4)} as p99, {R('bouts / mi', 4)} as bursts_per_min from b join q using (file)")
def bursts(spark, sf_dir):
    return rounded(oft.bursts(table(spark, sf_dir), CFG), 4)


@query("loc_normalized", f"with {M_SQL} select file, {R('count(*) filter (in_center) / 2.0::double / nullif(sum(speed) / 100, 0)', 4)} as center_time_s_per_m, {R('count(*) filter (is_moving) / 2.0::double / nullif(sum(speed) / 100, 0)', 4)} as moving_time_s_per_m from t group by file")
def loc_normalized(spark, sf_dir):
    return rounded(oft.locomotion_normalised(oft.oft_summary(table(spark, sf_dir), CFG), ["center_time_s", "moving_time_s"]), 4)


@query("qc_sensitivity", f"with {QC_SQL}, y as (select *, mf > 0.2 or lf > 0.2 or jn > 2 as bad from z), u as (select bad, 'duration_s' as metric, duration_s as v from y union all select bad, 'missing_fraction', mf from y) select metric, count(v) as n_all, count(v) filter (not bad) as n_qc_pass, {R('avg(v)', 5)} as mean_all, {R('avg(v) filter (not bad)', 5)} as mean_qc_pass, {R('avg(v) filter (not bad) - avg(v)', 5)} as delta_qc_pass_minus_all, {R('stddev_samp(v)', 5)} as sd_all, {R('stddev_samp(v) filter (not bad)', 5)} as sd_qc_pass from u group by metric")
def qc_sensitivity(spark, sf_dir):
    z = qc.tracking_qc(frames(spark, sf_dir), FPS, 0.9, 40.0)
    z = z.withColumn("qc_flag", (F.col("missing_fraction") > 0.2) | (F.col("low_likelihood_fraction") > 0.2) | (F.col("impossible_jump_n") > 2))
    return rounded(qc.sensitivity(z, ["duration_s", "missing_fraction"]), 5)


@query("enhanced_scored", f"select file, valid_fraction, entropy_norm, batch, center_score, qc_flag, coalesce(qc_flag, true) or coalesce(valid_fraction < 0.8, true) or entropy_norm is null as enhanced_qc_flag from ({ORACLES['occupancy_entropy']}) left join ({ORACLES['center_score']}) using (file) left join (with {QC_SQL} select file, mf > 0.2 or lf > 0.2 or jn > 2 as qc_flag from z) using (file)")
def enhanced_scored(spark, sf_dir):
    z = qc.tracking_qc(frames(spark, sf_dir), FPS, 0.9, 40.0)
    flags = z.select("file", ((F.col("missing_fraction") > 0.2) | (F.col("low_likelihood_fraction") > 0.2) | (F.col("impossible_jump_n") > 2)).alias("qc_flag"))
    scores = center_score(spark, sf_dir).join(flags, "file", "left")
    return oft.scored(_enhanced(spark, sf_dir).select("file", "valid_fraction", "entropy_norm"), scores, ["file"], 0.8)


@query("summary_chain", f"select s.*, e.epoch, e.duration_s, e.center_percent, e.center_entries as center_entries_enh, e.distance_cm as distance_cm_enh, e.mean_wall_distance_cm as mean_wall_distance_cm_enh, l.center_time_s_per_m, l.moving_time_s_per_m from ({ORACLES['oft_summary']}) s left join (select * from ({ORACLES['oft_epochs']}) where epoch = 'first_epoch') e on s.file = e.file left join ({ORACLES['loc_normalized']}) l on s.file = l.file")
def summary_chain(spark, sf_dir):
    first = oft_epochs(spark, sf_dir).filter("epoch = 'first_epoch'")
    both = rs.suffixed_join(oft_summary(spark, sf_dir), first, ["file"], "_enh")
    return rs.suffixed_join(both, loc_normalized(spark, sf_dir), ["file"], "_adv")


@query("habituation_slopes", f"""with {M_SQL}, b as (select file, floor(time_s / 5) * 5 as bs, sum(speed_cm_s / 2) as d from t group by file, 2), q as (select file, regr_slope(d, bs) * 60 as s, regr_intercept(d, bs) as i, regr_r2(d, bs) as r2, count(*) filter (d is not null) as n from b group by file)
  select file, {R('case when n >= 3 then s end', 3)} as slope_per_min, {R('case when n >= 3 then i end', 3)} as intercept, {R('case when n >= 3 then r2 end', 4)} as r_squared from q""")
def habituation_slopes(spark, sf_dir):
    from dataclasses import replace

    b = oft.bin_table(table(spark, sf_dir), replace(CFG, bin_s=5.0))
    s = stats.slopes(b, "bin_start_s", ["distance_cm"], ["file"])
    return s.select("file", r(F.col("slope_per_min"), 3).alias("slope_per_min"), r(F.col("intercept"), 3).alias("intercept"), r(F.col("r_squared"), 4).alias("r_squared"))


@query("habituation_p_values")
def habituation_p_values(spark, sf_dir):
    from dataclasses import replace

    b = oft.bin_table(table(spark, sf_dir), replace(CFG, bin_s=5.0))
    return stats.slopes(b, "bin_start_s", ["distance_cm", "center_time_s", "mean_speed_cm_s"], ["file"])


@query("holm_adjust", f"with {F_SQL}, p as (select batch, file, count(*) filter (x is null) / count(*)::double as p from f group by batch, file), o as (select *, least(1.0::double, (count(*) over (partition by batch) - row_number() over (partition by batch order by p, file) + 1) * p) as s from p) select batch, file, {R('max(s) over (partition by batch order by p, file rows unbounded preceding)')} as p_holm from o")
def holm_adjust(spark, sf_dir):
    p = frames(spark, sf_dir).groupBy("batch", "file").agg((F.count_if(F.col("x").isNull()) / F.count(F.lit(1))).alias("p"))
    return rounded(stats.with_holm(p, "p", ["batch"], ["file"]).select("batch", "file", "p_holm"))


@query("group_anova", f"with {F_SQL}, s as (select file, batch, avg(x) as m from f group by file, batch), c as (select batch, count(*) as n, avg(m) as a, var_pop(m) as v from s group by batch), k as (select count(*) as groups, sum(n) as n, sum(n*a*a) - sum(n) * power(sum(n*a) / sum(n), 2) as bt, sum(n*v) as wt from c) select groups, n::bigint as n, {R('(bt / (groups - 1)) / (wt / (n - groups))', 4)} as f from k")
def group_anova(spark, sf_dir):
    s = frames(spark, sf_dir).groupBy("file", "batch").agg(F.avg("x").alias("m"))
    return stats.one_way(s, "batch", "m").select("groups", "n", r(F.col("f"), 4).alias("f"))


def _dyads(spark, sf_dir):
    return social.events(social.dyad_measures(dyads_from_events(spark, sf_dir), SOC), SOC)


@query("dyad_distances", f"with {D_SQL} select file, cast(frame as int) as frame, {R('d_nn')} as nose_nose, {R('d_bb')} as body_body, {R('s1')} as speed1, {R('s2')} as speed2 from d1")
def dyad_distances(spark, sf_dir):
    m = social.dyad_measures(dyads_from_events(spark, sf_dir), SOC)
    return rounded(m.select("file", "frame", F.col("d_nose1_nose2").alias("nose_nose"), F.col("d_body1_body2").alias("body_body"), "speed1", "speed2"))


A1N = angle_sql("nx1-bx1", "ny1-by1", "nx2-nx1", "ny2-ny1")
A2N = angle_sql("nx2-bx2", "ny2-by2", "nx1-nx2", "ny1-ny2")


@query("directed_contact", f"with {D_SQL}, e as (select file, d_nn <= 8 and round({A1N}, 9) <= 90 as a, d_nn <= 8 and round({A2N}, 9) <= 90 as b, d_bb <= 12 as c, d_bb > 12 and d_bb <= 25 as m from d1) select file, count(*) filter (a) as a1_face, count(*) filter (b) as a2_face, count(*) filter (a and b) as mutual, count(*) filter (c) as close, count(*) filter (m) as medium from e group by file")
def directed_contact(spark, sf_dir):
    return _contacts(_dyads(spark, sf_dir))


def _contacts(e):
    a, b = F.col("a1_nose_to_nose2"), F.col("a2_nose_to_nose1")
    return e.groupBy("file").agg(F.count_if(a).alias("a1_face"), F.count_if(b).alias("a2_face"), F.count_if(a & b).alias("mutual"), F.count_if("close_proximity").alias("close"), F.count_if("medium_proximity").alias("medium"))


@query("directed_contact_all", ORACLES["directed_contact"])
def directed_contact_all(spark, sf_dir):
    return _contacts(_dyads(spark, sf_dir))


LAG_SQL = D_SQL + ", l as (select *, lag(d_bb, 2) over w as ago, lead(d_bb, 2) over w as ahead, lag(s1, 2) over w as s1p, lag(s2, 2) over w as s2p from d1 window w as (partition by file order by frame))"


@query("following_avoidance", f"with {LAG_SQL} select file, count(*) filter (d_bb <= 30 and s2p > 10 and s1 > 10) as a1_following_a2, count(*) filter (d_bb <= 30 and s1p > 10 and s2 > 10) as a2_following_a1, count(*) filter (d_bb <= 30 and ahead - d_bb >= 5 and s1 > 10) as a1_avoidance_from_a2, count(*) filter (d_bb <= 30 and ahead - d_bb >= 5 and s2 > 10) as a2_avoidance_from_a1, count(*) filter (ago >= 10 and ago - d_bb >= 4 and (s1 > 10 or s2 > 10)) as approach_event, count(*) filter (d_bb <= 20 and ahead - d_bb >= 4 and (s1 > 10 or s2 > 10)) as retreat_event from l group by file")
def following_avoidance(spark, sf_dir):
    names = ["a1_following_a2", "a2_following_a1", "a1_avoidance_from_a2", "a2_avoidance_from_a1", "approach_event", "retreat_event"]
    return _dyads(spark, sf_dir).groupBy("file").agg(*[F.count_if(n).alias(n) for n in names])


EV_SQL = D_SQL + """, ev as (select file, frame, 'close_proximity' as event_type, coalesce(d_bb <= 12, false) as b from d1 union all select file, frame, 'medium_proximity', coalesce(d_bb > 12 and d_bb <= 25, false) from d1),
ew as (select *, row_number() over (partition by file, event_type order by frame) - 1 as idx from ev), ex as (select *, idx - row_number() over (partition by file, event_type, b order by frame) as run from ew),
ey as (select file, event_type, b, run, min(idx) as s, count(*) as n from ex group by file, event_type, b, run),
ez as (select file, event_type, coalesce(sum(n) filter (b and n >= 2), 0)::bigint as event_frames, count(*) filter (b and n >= 2) as bout_n, avg(n / 2.0::double) filter (b and n >= 2) as mb, max(n / 2.0::double) filter (b and n >= 2) as xb, min(s / 2.0::double) filter (b and n >= 2) as lat, sum(n) as total from ey group by file, event_type)"""


@query("event_summary", f"with {EV_SQL} select file, event_type, event_frames, event_frames / 2.0::double as duration_s, {R('100 * event_frames / total::double', 4)} as percent_time, bout_n, {R('mb', 4)} as mean_bout_s, xb as max_bout_s, lat as latency_s from ez")
def event_summary(spark, sf_dir):
    return rounded(social.event_summary(_dyads(spark, sf_dir), ["close_proximity", "medium_proximity"], SOC), 4)


@query("directional_bias", f"with {EV_SQL}, w as (select file, max(event_frames / 2.0::double) filter (event_type = 'close_proximity') as a1_s, max(event_frames / 2.0::double) filter (event_type = 'medium_proximity') as a2_s from ez group by file) select file, a1_s, a2_s, {R('(a1_s - a2_s) / nullif(a1_s + a2_s, 0)')} as bias from w")
def directional_bias(spark, sf_dir):
    s = social.event_summary(_dyads(spark, sf_dir), ["close_proximity", "medium_proximity"], SOC)
    return rounded(social.directional_bias(s, "close_proximity", "medium_proximity"))


def _facing_sql(i: int, target: str) -> str:
    return f"round({angle_sql(f'nx{i}-bx{i}', f'ny{i}-by{i}', f'{target[0]}x{target[1]}-nx{i}', f'{target[0]}y{target[1]}-ny{i}')}, 9) <= 90"


def _all_events_sql() -> str:
    """All 32 events: base events, their runs of one frame left out, combined ones of what stays, bouts of two frames and more."""
    heading = lambda i: f"case when nx{i} <> bx{i} or ny{i} <> by{i} then (degrees(atan2(ny{i}-by{i}, nx{i}-bx{i})) + 360) % 360 end"
    base = {
        "a1_nose_to_nose2": f"d_nn <= 8 and {_facing_sql(1, 'n2')}", "a1_nose_to_body2": f"d_nb <= 8 and {_facing_sql(1, 'b2')}", "a1_nose_to_tail2": f"d_nt <= 8 and {_facing_sql(1, 't2')}",
        "a2_nose_to_nose1": f"d_nn <= 8 and {_facing_sql(2, 'n1')}", "a2_nose_to_body1": f"d_bn <= 8 and {_facing_sql(2, 'b1')}", "a2_nose_to_tail1": f"d_tn <= 8 and {_facing_sql(2, 't1')}",
        "side_by_side_parallel": "d_nn <= 25 and d_bb <= 25 and d_tt <= 25 and round(hd, 9) <= 45", "side_by_side_antiparallel": "d_nt <= 25 and d_bb <= 25 and d_tn <= 25 and round(hd, 9) >= 135",
        "close_proximity": "d_bb <= 12", "medium_proximity": "d_bb > 12 and d_bb <= 25", "mutually_facing": f"{_facing_sql(1, 'n2')} and {_facing_sql(2, 'n1')} and d_bb <= 25",
        "a1_following_a2": "d_bb <= 30 and s2p > 10 and s1 > 10", "a2_following_a1": "d_bb <= 30 and s1p > 10 and s2 > 10",
        "a1_avoidance_from_a2": "d_bb <= 30 and ahead - d_bb >= 5 and s1 > 10", "a2_avoidance_from_a1": "d_bb <= 30 and ahead - d_bb >= 5 and s2 > 10",
        "approach_event": "ago >= 10 and ago - d_bb >= 4 and (s1 > 10 or s2 > 10)", "retreat_event": "d_bb <= 20 and ahead - d_bb >= 4 and (s1 > 10 or s2 > 10)",
    }
    f1, b1, t1, f2, b2, t2 = list(base)[:6]
    any1, any2 = f"({f1} or {b1} or {t1})", f"({f2} or {b2} or {t2})"
    more = {
        "a1_face_investigation": f1, "a2_face_investigation": f2, "face_investigation": f"{f1} or {f2}", "a1_body_investigation": b1, "a2_body_investigation": b2, "body_investigation": f"{b1} or {b2}",
        "a1_anogenital_investigation": t1, "a2_anogenital_investigation": t2, "anogenital_investigation": f"{t1} or {t2}", "a1_any_directed_contact": any1, "a2_any_directed_contact": any2,
        "mutual_directed_contact": f"{any1} and {any2}", "a1_only_directed_contact": f"{any1} and not {any2}", "a2_only_directed_contact": f"{any2} and not {any1}",
        "any_social_contact": f"{any1} or {any2} or side_by_side_parallel or side_by_side_antiparallel",
    }
    # a run of one frame has a false neighbour, or none, on both sides
    kept = ", ".join(f"{n} and (coalesce(lag({n}) over w, false) or coalesce(lead({n}) over w, false)) as {n}" for n in base)
    rows = " union all ".join(f"select file, frame, '{n}' as event_type, {x} as b from sk" for n, x in {**{n: n for n in base}, **more}.items())
    return f"""{LAG_SQL}, hh as (select *, abs(({heading(1)}) - ({heading(2)})) % 360 as dh from l), hd as (select *, least(dh, 360 - dh) as hd from hh),
se as (select file, frame, {', '.join(f'coalesce({x}, false) as {n}' for n, x in base.items())} from hd),
sk as (select file, frame, {kept} from se window w as (partition by file order by frame)), ev as ({rows}),"""


EVENT_RUNS_SQL = EV_SQL[EV_SQL.index("ew as"):]


@query("socint_all_events", f"with {_all_events_sql()} {EVENT_RUNS_SQL} select file, event_type, event_frames, event_frames / 2.0::double as duration_s, {R('100 * event_frames / total::double', 4)} as percent_time, bout_n, {R('mb', 4)} as mean_bout_s, xb as max_bout_s, lat as latency_s from ez")
def socint_all_events(spark, sf_dir):
    """All 32 events of a pair, in one pass."""
    more = social.combined_events()
    e = social.suppressed(_dyads(spark, sf_dir), social.BASE_EVENTS, SOC.min_event_frames).withColumns(more)
    return rounded(social.event_summary(e, [*social.BASE_EVENTS, *more], SOC), 4)


SUMMARY_SQL = f"with {_all_events_sql()} {EVENT_RUNS_SQL}, du as (select file, {', '.join(f"max(event_frames / 2.0::double) filter (event_type = '{e}') as {n}" for n, e in social.SUMMARY_EVENTS.items())} from ez group by file), me as (select file, count(*) as n_frames, count(*) / 2.0::double as duration_video_s, count(d_bb) / 2.0::double as duration_analyzed_s, coalesce(sum(s1 / 2), 0) + coalesce(sum(s2 / 2), 0) as total_distance_moved, avg(d_bb) as mean_body_distance, median(d_bb) as median_body_distance, avg(s1) as mean_speed_a1, avg(s2) as mean_speed_a2 from d1 group by file) select file, n_frames, duration_video_s, duration_analyzed_s, {', '.join(f'{R(n, 5)} as {n}' for n in ('total_distance_moved', 'mean_body_distance', 'median_body_distance', 'mean_speed_a1', 'mean_speed_a2'))}, {', '.join(social.SUMMARY_EVENTS)}, {R('(a1_directed_contact_s - a2_directed_contact_s) / nullif(a1_directed_contact_s + a2_directed_contact_s, 0)', 5)} as directional_bias_a1_minus_a2, a1_directed_contact_s - a2_directed_contact_s as a1_minus_a2_directed_contact_s, {R('a1_directed_contact_s / nullif(a2_directed_contact_s, 0)', 5)} as a1_over_a2_directed_contact_ratio, {R('a1_directed_contact_s / nullif(a1_directed_contact_s + a2_directed_contact_s, 0)', 5)} as a1_fraction_of_total_directed_contact, {R('(a1_directed_contact_s + a2_directed_contact_s) / nullif(total_distance_moved, 0)', 5)} as directed_contact_per_distance_moved, {R('close_proximity_s / nullif(total_distance_moved, 0)', 5)} as close_proximity_per_distance_moved from me join du using (file)"


@query("dyad_file_summary", SUMMARY_SQL)
def dyad_file_summary(spark, sf_dir):
    """27 of the summary's columns; those of quality control come from a table that is passed in."""
    e = _dyads(spark, sf_dir)
    more = social.combined_events()
    s = social.event_summary(social.suppressed(e, social.BASE_EVENTS, SOC.min_event_frames).withColumns(more), [*social.BASE_EVENTS, *more], SOC)
    return rounded(social.file_summary(e, s, SOC), 5)


@query("proximity_bins", f"with {D_SQL}, b as (select * from (values ('0_5', 0.0, 5.0), ('5_10', 5.0, 10.0), ('10_20', 10.0, 20.0), ('20_40', 20.0, 40.0), ('40_inf', 40.0, 1e300)) v(bin, a, z)) select file, bin, count(*) filter (d_bb >= a and d_bb < z) / 2.0::double as time_s, {R('100 * count(*) filter (d_bb >= a and d_bb < z) / nullif(count(d_bb), 0)::double', 4)} as percent from d1, b group by file, bin")
def proximity_bins(spark, sf_dir):
    return rounded(social.proximity_bins(social.dyad_measures(dyads_from_events(spark, sf_dir), SOC), SOC), 4)


@query("overlap", f"with {LAG_SQL}, e as (select file, d_bb <= 12 as a, ago >= 10 and ago - d_bb >= 4 and (s1 > 10 or s2 > 10) as b from l) select file, count(*) filter (a and b) as n_both, {R('count(*) filter (a and b) / nullif(count(*) filter (b), 0)::double')} as a_given_b, {R('count(*) filter (a and b) / nullif(count(*) filter (a), 0)::double')} as b_given_a from e group by file")
def overlap(spark, sf_dir):
    return rounded(social.overlap(_dyads(spark, sf_dir), "close_proximity", "approach_event"))


@query("nor_contact", f"with {P_SQL}, n as (select file, frame, sqrt(power(nose_x-10, 2)+power(nose_y-10, 2)) as dl, sqrt(power(nose_x-5, 2)+power(nose_y-40, 2)) as dr, sqrt(power(body_x-10, 2)+power(body_y-10, 2)) as bl from p) select file, {R('avg(case when dl <= 10 and bl > 1 then 1 when not (dl <= 10 and bl > 1) then 0 end) * 300', 4)} as contact_left_s, {R('avg(case when dr > 10 and dr <= 20 then 1 when not (dr > 10 and dr <= 20) then 0 end) * 300', 4)} as proximity_right_s, (min(frame) filter (dl <= 10 and bl > 1) + 1) / 2.0::double as latency_left_s from n group by file")
def nor_contact(spark, sf_dir):
    p = points_from_events(spark, sf_dir)
    to = lambda pt, x, y: g.distance(F.col(f"{pt}_x"), F.col(f"{pt}_y"), F.lit(x), F.lit(y))
    left = assays.contact(to("nose", 10.0, 10.0), to("body", 10.0, 10.0), 10.0)
    right = assays.proximity(to("nose", 5.0, 40.0), 10.0, 20.0)
    n = p.withColumn("l", left).withColumn("r", right)
    return n.groupBy("file").agg(r(assays.flag_time(F.col("l"), 300.0), 4).alias("contact_left_s"), r(assays.flag_time(F.col("r"), 300.0), 4).alias("proximity_right_s"), assays.latency(F.col("l"), FPS, first=1).alias("latency_left_s"))


NOR_SQL = f"""with {P_SQL}, n as (select file, frame, case user_id % 2 when 0 then 'R' else 'L' end as loc, sqrt(power(nose_x-10, 2)+power(nose_y-10, 2)) as dl, sqrt(power(nose_x-5, 2)+power(nose_y-40, 2)) as dr, sqrt(power(body_x-10, 2)+power(body_y-10, 2)) as bl, sqrt(power(body_x-5, 2)+power(body_y-40, 2)) as br,
    abs(nose_x-10) <= 9 + 1e-10 and abs(nose_y-10) <= 7 + 1e-10 as il, abs(nose_x-5) <= 9 + 1e-10 and abs(nose_y-40) <= 7 + 1e-10 as ir,
    round({angle_sql("10-nose_x", "10-nose_y", "body_x-nose_x", "body_y-nose_y")}, 9) as al, round({angle_sql("5-nose_x", "40-nose_y", "body_x-nose_x", "body_y-nose_y")}, 9) as ar from p),
  c as (select *, case loc when 'R' then il else dl <= 8 end and bl > 1 and al >= 70 as l, case loc when 'R' then dr <= 8 else ir end and br > 1 and ar >= 70 as q, dl > 8 and dl <= 16 and al >= 90 as pl, dr > 8 and dr <= 16 and ar >= 90 as pr,
    case loc when 'R' then il and bl > 1 and al >= 90 else dl <= 8 and bl > 1 and al >= 70 end as fl, case loc when 'R' then dr <= 8 and br > 1 and ar >= 70 else ir and br > 1 and ar >= 90 end as fr from n)
  select file, loc, {R("avg(l::int) * 300", 4)} as contact_left_s, {R("avg(q::int) * 300", 4)} as contact_right_s, {R("avg(pl::int) * 300", 4)} as ahead_left_s, {R("avg(pr::int) * 300", 4)} as ahead_right_s, (least(min(frame) filter (fl), min(frame) filter (fr)) + 1) / 2.0::double as latency_s from c group by file, loc"""


@query("nor_object_contact", NOR_SQL)
def nor_object_contact(spark, sf_dir):
    p = points_from_events(spark, sf_dir).withColumn("loc", F.when(F.col("user_id") % 2 == 0, "R").otherwise("L"))
    at = lambda q: (F.col(f"{q}_x"), F.col(f"{q}_y"))
    (nx, ny), (bx, by) = at("nose"), at("body")
    contact, ahead, met = {}, {}, {}
    for side, (x, y), novel in (("left", (10.0, 10.0), F.col("loc") == "R"), ("right", (5.0, 40.0), F.col("loc") == "L")):
        d, body = (g.distance(*at(q), F.lit(x), F.lit(y)) for q in ("nose", "body"))
        angle = g.angle_deg(F.lit(x) - nx, F.lit(y) - ny, bx - nx, by - ny)
        outline = g.inside_or_border(nx, ny, [(x - 9, y - 7), (x + 9, y - 7), (x + 9, y + 7), (x - 9, y + 7)])
        near = assays.object_contact(d, body, angle, 8.0)
        contact[side] = F.when(novel, assays.object_contact(d, body, angle, 8.0, outline)).otherwise(near)
        met[side] = F.when(novel, assays.object_contact(d, body, angle, 8.0, outline, least_deg=90.0)).otherwise(near)  # the latency asks for more at an outline
        ahead[side] = assays.proximity_ahead(d, angle, 8.0, 16.0)
    n = p.withColumns({f"contact_{k}": v for k, v in contact.items()} | {f"ahead_{k}": v for k, v in ahead.items()} | {f"met_{k}": v for k, v in met.items()})
    times = [r(assays.flag_time(F.col(f"{c}_{k}"), 300.0), 4).alias(f"{c}_{k}_s") for c in ("contact", "ahead") for k in ("left", "right")]
    first = F.least(*[assays.latency(F.col(f"met_{k}"), FPS, first=1) for k in ("left", "right")])
    return n.groupBy("file", "loc").agg(*times, first.alias("latency_s"))


@query("socp_novel", f"with {P_SQL}, n as (select file, user_id, sqrt(power(body_x-10, 2)+power(body_y-10, 2)) <= 15 as l, sqrt(power(body_x-5, 2)+power(body_y-40, 2)) <= 15 as q from p), m as (select file, case user_id % 3 when 0 then 'R' when 1 then 'L' end as loc, avg(l::int) * 600 as l, avg(q::int) * 600 as q from n group by 1, 2) select file, loc, {R('case loc when ' + chr(39) + 'R' + chr(39) + ' then l when ' + chr(39) + 'L' + chr(39) + ' then q end', 4)} as novel_s, {R('case loc when ' + chr(39) + 'R' + chr(39) + ' then q when ' + chr(39) + 'L' + chr(39) + ' then l end', 4)} as familiar_s from m")
def socp_novel(spark, sf_dir):
    p = points_from_events(spark, sf_dir)
    near = lambda x, y: g.distance(F.col("body_x"), F.col("body_y"), F.lit(x), F.lit(y)) <= 15
    loc = F.when(F.col("user_id") % 3 == 0, "R").when(F.col("user_id") % 3 == 1, "L").alias("loc")
    m = p.withColumn("l", near(10.0, 10.0)).withColumn("q", near(5.0, 40.0)).groupBy("file", loc).agg(assays.flag_time(F.col("l"), 600.0).alias("l"), assays.flag_time(F.col("q"), 600.0).alias("q"))
    novel = assays.side_of_novel(F.col("loc"), F.col("l"), F.col("q"))
    familiar = assays.side_of_novel(F.col("loc"), F.col("q"), F.col("l"))
    return m.select("file", "loc", r(novel, 4).alias("novel_s"), r(familiar, 4).alias("familiar_s"))


@query("rearing", f"with {P_SQL}, n as (select file, frame, coalesce(nose_x <= 3, false) as a, coalesce(nose_y <= 20, false) as b from p), c as (select file, a and not coalesce(lag(a) over w, a) and b and not coalesce(lag(b) over w, b) as q from n window w as (partition by file order by frame)) select file, count(*) filter (q) as rearings from c group by file")
def rearing(spark, sf_dir):
    p = points_from_events(spark, sf_dir)
    return assays.rearings(p, F.col("nose_x") - 2, (F.col("nose_y") - 20) + 1, 1.0)


@query("nosedips", f"with {P_SQL}, n as (select file, frame, not (nose_x > 0) and body_x > 0 and not (tail_y > 40) as d from p), m as (select file, frame, avg(case when d then 1 when not d then 0 end) over (partition by file order by frame rows between 1 preceding and 1 following) > 0.5 as m from n), s as (select file, frame, avg(case when m then 1 when not m then 0 end) over (partition by file order by frame rows between 1 preceding and 1 following) > 0.5 as s from m), c as (select file, s <> lag(s) over (partition by file order by frame) as ch from s) select file, count(*) filter (ch) / 2.0::double as nosedips from c group by file")
def nosedips(spark, sf_dir):
    return assays.nosedips(points_from_events(spark, sf_dir), F.col("nose_x") > 0, F.col("body_x") > 0, F.col("tail_y") > 40, 1)


@query("fst_floating", f"with {M_SQL}, z as (select file, frame, speed, avg(abs(acceleration)) over (partition by file order by frame rows between 3 preceding and 3 following) < 15 as fl from m2) select file, count(*) filter (fl) / 2.0::double as time_floating_s, {R('100 * count(*) filter (fl) / count(*)::double', 4)} as percent_floating, {R('coalesce(sum(speed) filter (not fl), 0)', 4)} as swim_distance, {R('avg(speed) filter (not fl) * 2', 4)} as swim_speed from z group by file")
def fst_floating(spark, sf_dir):
    m = mv.movement(frames(spark, sf_dir), FPS, 10.0, 2)
    return rounded(assays.floating(m, [F.col("acceleration")], 15.0, 3, FPS, F.col("speed")), 4)


@query("head_angle", f"with {P_SQL}, v as (select file, frame, nose_x-body_x as ax, nose_y-body_y as ay, body_x-tail_x as bx, body_y-tail_y as by_ from p), a as (select file, frame, atan2(ax*by_-ay*bx + 0.0::double, ax*bx+ay*by_ + 0.0::double) as a from v), s as (select file, frame, a, avg(case when a > 0.3::double then 1 when a <= 0.3::double then 0 end) over w > 0.5 as cw, avg(case when a < -0.3::double then 1 when a >= -0.3::double then 0 end) over w > 0.5 as ccw from a window w as (partition by file order by frame rows between 2 preceding and 2 following)) select file, {R('avg(a)', 4)} as mean_angle, count(*) filter (cw) / 2.0::double as time_cw_s, count(*) filter (ccw) / 2.0::double as time_ccw_s from s group by file")
def head_angle(spark, sf_dir):
    return rounded(assays.head_angles(points_from_events(spark, sf_dir), ["nose", "body", "body", "tail"], 0.3, 2, FPS), 4)


LABELS = ["click", "error", "purchase", "signup", "view"]
#: the frames that each interval covers
INTERVAL_SQL = F_SQL + """, iv as (select cast(o_custkey % 150 as varchar) as file, o_orderkey as ord, unnest(range(2 * (o_orderkey % 20), 2 * (o_orderkey % 20 + o_custkey % 4) + 1)) as frame, o_orderpriority as type from orders),
top as (select file, frame, arg_max(type, ord) as type from iv group by file, frame)"""


@query("interval_labels", f"with {INTERVAL_SQL} select f.file, cast(f.frame as int) as frame, coalesce(type, 'None') as label from f left join top on top.file = f.file and top.frame = f.frame")
def interval_labels(spark, sf_dir):
    return lab.interval_labels(frames(spark, sf_dir).select("file", "frame"), _intervals(spark, sf_dir), FPS)


def _intervals(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = (F.col("o_orderkey") % 20).cast("double")
    return o.select((F.col("o_custkey") % 150).cast("string").alias("file"), F.col("o_orderkey").alias("ord"), start.alias("from"), (start + F.col("o_custkey") % 4).alias("to"), F.col("o_orderpriority").alias("type"))


@query("interval_labels_all", ORACLES["interval_labels"])
def interval_labels_all(spark, sf_dir):
    return lab.interval_labels(frames(spark, sf_dir).select("file", "frame"), _intervals(spark, sf_dir), FPS)


@query("smooth_labels", f"""with {F_SQL}, fs as (select file, label, min(frame) as seen from f group by file, label), w as (select a.file, a.frame, b.label, count(*) as n from f a join f b on a.file = b.file and b.frame between a.frame - 2 and a.frame + 2 group by a.file, a.frame, b.label),
  q as (select w.*, row_number() over (partition by w.file, w.frame order by n desc, seen) as rn from w join fs using (file, label)) select file, cast(frame as int) as frame, label as smoothed from q where rn = 1""")
def smooth_labels(spark, sf_dir):
    f = frames(spark, sf_dir)
    names = [x[0] for x in f.select("label").distinct().orderBy("label").collect()]  # the label set, a few names
    return lab.smooth_labels(f, 2, names).select("file", "frame", "smoothed")


@query("label_report", f"with {F_SQL}, c as (select file, label, lag(label) over w as p, lead(label) over w as q from f window w as (partition by file order by frame)) select file, label, count(*) / 2.0::double as time_s, (count(*) filter (p <> label) + count(*) filter (q <> label)) / 2.0::double as count from c group by file, label")
def label_report(spark, sf_dir):
    return lab.label_report(frames(spark, sf_dir), FPS)


@query("combine_labels", f"with {F_SQL} select file, cast(frame as int) as frame, case when x > 3 and label in ('click', 'view') then 'seen' when label in ('purchase', 'click') then 'deal' else 'None' end as label from (select file, frame, coalesce(x, 0) as x, label from f)")
def combine_labels(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("fast", F.when(F.coalesce("x", F.lit(0.0)) > 3, F.col("label")).otherwise("slow"))
    return f.select("file", "frame", lab.combined({"deal": ("label", ["purchase", "click"]), "seen": ("fast", ["click", "view"])}).alias("label"))


@query("classification_eval", f"""with {F_SQL}, g as (select file, label as t, lag(label, 1, label) over (partition by file order by frame) as c from f), n as (
  select file, label, sum(ok)::bigint as correct, (sum(tt) - sum(ok))::bigint as wrong, sum(tt)::bigint as n_truth, sum(cc)::bigint as n_compare from (select file, t as label, (t = c)::int as ok, 1 as tt, 0 as cc from g union all select file, c, 0, 0, 1 from g) group by file, label)
  select *, {R('correct / nullif(correct + wrong, 0)::double')} as accuracy, {R('correct / nullif(n_compare, 0)::double')} as precision, {R('correct / nullif(n_truth, 0)::double')} as recall from n""")
def classification_eval(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("guess", F.coalesce(F.lag("label").over(win.track()), F.col("label")))
    return rounded(lab.evaluate(f, "label", "guess"))


@query("classification_overall", ORACLES["classification_eval"].replace("group by file, label)", "group by label)").replace("select file, label, sum(ok)", "select label, sum(ok)"))
def classification_overall(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("guess", F.coalesce(F.lag("label").over(win.track()), F.col("label")))
    return rounded(lab.overall(lab.evaluate(f, "label", "guess")))


@query("label_correlation", f"with {F_SQL}, s as (select file, count(*) filter (label = 'click') / 2.0::double as c, count(*) filter (label = 'view') / 2.0::double as v, count(*) filter (label = 'error') / 2.0::double as e from f group by file) select {R('corr(c, v)', 5)} as click_view, {R('corr(c, e)', 5)} as click_error, {R('corr(v, e)', 5)} as view_error from s")
def label_correlation(spark, sf_dir):
    s = frames(spark, sf_dir).groupBy("file").pivot("label", ["click", "view", "error"]).count().fillna(0)
    return s.agg(r(F.corr("click", "view"), 5).alias("click_view"), r(F.corr("click", "error"), 5).alias("click_error"), r(F.corr("view", "error"), 5).alias("view_error"))


@query("windowed_features", f"with {F_SQL}, l as (select file, frame, lag(likelihood) over w as a, likelihood as b, lead(likelihood) over w as c, lag(event_id) over w as d, event_id as e, lead(event_id) over w as g, count(*) over (partition by file) as n from f window w as (partition by file order by frame)) select file, cast(frame as int) as frame, a + 10 * b + 100 * c + (d % 7) * 1000 + (e % 7) * 10000 + (g % 7) * 100000 as code, 6::int as width from l where frame >= 1 and frame < n - 1")
def windowed_features(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("e", (F.col("event_id") % 7).cast("double"))
    w = lab.windowed_features(f, ["likelihood", "e"], 1)
    v = F.col("features")
    return w.select("file", "frame", (v[0] + v[2] * 10 + v[4] * 100 + v[1] * 1000 + v[3] * 10000 + v[5] * 100000).alias("code"), F.size("features").alias("width"))


@query("balance_classes", f"with {F_SQL}, n as (select label, count(*) as n from f group by label) select label, (select min(n) from n) as n from n")
def balance_classes(spark, sf_dir):
    return lab.balanced(frames(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cut_frames", f"with {F_SQL}, n as (select file, frame, count(*) over (partition by file) as n from f) select file, cast(frame as int) as frame from n where frame >= 3 and frame < n - 5")
def cut_frames(spark, sf_dir):
    return rs.cut(frames(spark, sf_dir), 3, 4).select("file", "frame")


@query("formatter_unpivot", f"with {P_SQL} select file, point, cast(frame as int) as frame, {R('x')} as x, {R('y')} as y, 1.0::double as likelihood from (select file, 'body' as point, frame, body_x as x, body_y as y from p union all select file, 'nose', frame, nose_x, nose_y from p)")
def formatter_unpivot(spark, sf_dir):
    return rounded(rs.points_long(points_from_events(spark, sf_dir), ["body", "nose"]))


@query("points_wide", f"with {P_SQL} select file, cast(frame as int) as frame, {R('body_x')} as body_x, {R('body_y')} as body_y, {R('nose_x')} as nose_x, {R('nose_y')} as nose_y from p")
def points_wide(spark, sf_dir):
    return rounded(rs.points_wide(rs.points_long(points_from_events(spark, sf_dir), ["body", "nose"]), ["body", "nose"]))


@query("union_fill", f"with {F_SQL} select file, count(*) as n, count(likelihood) as with_likelihood, count(extra) as with_extra from (select file, likelihood, null::int as extra from f union all select file, null, 1 from f where label = 'view') group by file")
def union_fill(spark, sf_dir):
    f = frames(spark, sf_dir)
    both = rs.stacked([f.select("file", "likelihood"), f.filter("label = 'view'").select("file", F.lit(1).alias("extra"))])
    return both.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count("likelihood").alias("with_likelihood"), F.count("extra").alias("with_extra"))


@query("setops_frames", f"with {F_SQL}, a as (select file, frame from f where x > 3), b as (select file, frame from f where y > 24) select file, count(*) filter (k = 'both') as both, count(*) filter (k = 'only') as only from (select file, frame, 'both' as k from (select * from a intersect select * from b) union all select file, frame, 'only' from (select * from a except select * from b)) group by file")
def setops_frames(spark, sf_dir):
    f = frames(spark, sf_dir)
    a, b = f.filter("x > 3").select("file", "frame"), f.filter("y > 24").select("file", "frame")
    k = a.join(b, ["file", "frame"], "left_semi").withColumn("k", F.lit("both")).unionByName(a.join(b, ["file", "frame"], "left_anti").withColumn("k", F.lit("only")))
    return k.groupBy("file").agg(F.count_if(F.col("k") == "both").alias("both"), F.count_if(F.col("k") == "only").alias("only"))


@query("explicit_bins", f"with {F_SQL}, b as (select cast(c_custkey % 150 as varchar) as file, c_mktsegment as bin, unnest(range(c_custkey % 30, c_custkey % 30 + 10)) as frame from customer) select f.file, bin, count(*) as n, count(x) as valid from f join b on f.file = b.file and f.frame = b.frame group by f.file, bin")
def explicit_bins(spark, sf_dir):
    return _binned(spark, sf_dir, spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _binned(spark, sf_dir, c):
    lo = F.col("c_custkey") % 30
    bins = c.select((F.col("c_custkey") % 150).cast("string").alias("file"), F.col("c_mktsegment").alias("bin"), lo.cast("int").alias("from_frame"), (lo + 9).cast("int").alias("to_frame"))
    return rs.explicit_bins(frames(spark, sf_dir), bins).groupBy("file", "bin").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("valid"))


@query("explicit_bins_all", ORACLES["explicit_bins"])
def explicit_bins_all(spark, sf_dir):
    return _binned(spark, sf_dir, spark.read.parquet(f"{sf_dir}/customer.parquet"))


@query("rollup_batch", f"with {F_SQL} select batch, count(distinct file) as tracks, count(*) as frames, {R('avg(x)', 5)} as mean_x from f group by rollup(batch)")
def rollup_batch(spark, sf_dir):
    return frames(spark, sf_dir).rollup("batch").agg(F.count_distinct("file").alias("tracks"), F.count(F.lit(1)).alias("frames"), r(F.avg("x"), 5).alias("mean_x"))


@query("metadata_lookup", f"with {F_SQL}, c as (select c_custkey, c_name, row_number() over (partition by c_custkey % 200 order by c_custkey) as rn, cast(c_custkey % 200 as varchar) as code from customer), t as (select file, count(*) as n from f group by file) select t.file, n, c_name as id from t left join c on c.code = t.file and rn = 1")
def metadata_lookup(spark, sf_dir):
    from pawprint.sources.metadata import first_match

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 200).cast("string").alias("code"), F.col("c_name").alias("id"), F.col("c_custkey").alias("ord"))
    t = frames(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return first_match(t, c, "file", "code", "id", "ord")


@query("skeleton_features", f"with {P_SQL} select file, cast(frame as int) as frame, {R('sqrt((nose_x-body_x)*(nose_x-body_x)+(nose_y-body_y)*(nose_y-body_y))')} as s1, {R('abs(nose_x*body_y-body_x*nose_y+(body_x*tail_y-tail_x*body_y)+(tail_x*nose_y-nose_x*tail_y))/2')} as ar1, {R('radians(' + angle_sql('nose_x-body_x', 'nose_y-body_y', 'body_x-tail_x', 'body_y-tail_y') + ')', 5)} as a1 from p")
def skeleton_features(spark, sf_dir):
    s = assays.skeleton_features(points_from_events(spark, sf_dir), {"s1": ("nose", "body")}, {"a1": ("nose", "body", "body", "tail")}, {"ar1": ("nose", "body", "tail")})
    return s.select("file", "frame", r(F.col("s1")).alias("s1"), r(F.col("ar1")).alias("ar1"), r(F.col("a1"), 5).alias("a1"))


@query("rolling_correlation", f"with {F_SQL}, c as (select file, frame, corr(event_id % 13, frame) over w as c, count(*) over w as n from f window w as (partition by file order by frame rows between 9 preceding and current row)) select file, cast(frame as int) as frame, {R('case when n = 10 then c end', 5)} as c from c")
def rolling_correlation(spark, sf_dir):
    f = frames(spark, sf_dir)
    c = win.rolling_correlation((F.col("event_id") % 13).cast("double"), F.col("frame").cast("double"), 10, win.track())
    return f.select("file", "frame", r(c, 5).alias("c"))


WIN_SQL = M_SQL + """, w0 as (select *, floor(time_s / 5)::bigint as window_id, atan2(y - lag(y) over w + 0.0::double, x - lag(x) over w + 0.0::double) as h, coalesce(in_center, false) as c from t window w as (partition by file order by frame)),
w1 as (select *, degrees(abs(atan2(sin(h - lag(h) over (partition by file order by frame)), cos(h - lag(h) over (partition by file order by frame))))) as turn, c and not coalesce(lag(c) over (partition by file, window_id order by frame), false) as en from w0),
wf as (select file, window_id, count(*) as frames, count(x) / count(*)::double as vf, avg(speed_cm_s) as ms, median(speed_cm_s) as md, stddev_samp(speed_cm_s) as sd, quantile_cont(speed_cm_s, 0.95) as p95, avg(turn) as mt, sqrt(var_samp(x) + var_samp(y)) as spread, avg(wall_distance_cm) as wall, avg(in_center::int) as cf, avg(in_corners::int) as kf, avg(is_immobile::int) as imf, count(*) filter (en) as entries from w1 group by file, window_id having count(x) / count(*)::double >= 0.7)"""


def _windows(spark, sf_dir):
    from pawprint.plans import motifs
    from pawprint.schema import MotifConfig

    return motifs.window_features(table(spark, sf_dir), MotifConfig(), FPS)


@query("window_features", f"with {WIN_SQL} select file, window_id, frames, {R('vf')} as valid_fraction, {R('ms', 4)} as mean_speed, {R('md', 4)} as median_speed, {R('sd', 4)} as sd_speed, {R('p95', 4)} as p95_speed, {R('mt', 3)} as mean_turn, {R('spread', 4)} as spread, {R('cf')} as center_fraction, {R('kf')} as corner_fraction, {R('imf')} as immobile_fraction, entries as center_entries from wf")
def window_features(spark, sf_dir):
    w = _windows(spark, sf_dir)
    four = {"mean_speed", "median_speed", "sd_speed", "p95_speed", "spread"}
    names = ["valid_fraction", "mean_speed", "median_speed", "sd_speed", "p95_speed", "mean_turn", "spread", "center_fraction", "corner_fraction", "immobile_fraction"]
    return w.select("file", "window_id", "frames", *[r(F.col(n), 4 if n in four else 3 if n == "mean_turn" else 6).alias(n) for n in names], "center_entries")


FEATURES = ["mean_speed", "sd_speed", "p95_speed", "mean_turn", "spread", "mean_wall", "center_fraction", "corner_fraction", "immobile_fraction", "zone_entropy"]


def _motifs(spark, sf_dir, method="kmeans"):
    from pawprint.plans import motifs
    from pawprint.schema import MotifConfig

    cfg = MotifConfig()
    w = motifs.kept(_windows(spark, sf_dir).select("file", "window_id", *FEATURES))
    z, cols = motifs.scaled(w, FEATURES)
    scores, _, _ = motifs.principal_components(z, cols, cfg)
    return motifs.clusters(scores.select("file", "window_id", "scores"), cfg, method=method), w


@query("scaled_matrix", f"with {WIN_SQL}, q as (select file, window_id, coalesce(sd, (select median(sd) from wf)) as v from wf) select file, window_id, {R('(v - (select avg(v) from q)) / (select stddev_samp(v) from q)', 5)} as sd_speed from q")
def scaled_matrix(spark, sf_dir):
    from pawprint.plans import motifs

    return motifs.scaled(_windows(spark, sf_dir).select("file", "window_id", "sd_speed"), ["sd_speed"])[0].select("file", "window_id", r(F.col("sd_speed"), 5).alias("sd_speed"))


@query("kmeans_motifs")
def kmeans_motifs(spark, sf_dir):
    return _motifs(spark, sf_dir)[0].select("file", "window_id", "motif")


@query("gmm_motifs")
def gmm_motifs(spark, sf_dir):
    return _motifs(spark, sf_dir, "gmm")[0].select("file", "window_id", "motif")


@query("motif_annotation")
def motif_annotation(spark, sf_dir):
    from pawprint.plans import motifs
    from pawprint.schema import MotifConfig

    m, w = _motifs(spark, sf_dir)
    return motifs.annotated(motifs.profiles(m.select("file", "window_id", "motif").join(w, ["file", "window_id"]), FEATURES), MotifConfig())


@query("motif_representatives")
def motif_representatives(spark, sf_dir):
    from pawprint.plans import motifs

    return motifs.representatives(_motifs(spark, sf_dir)[0])


@query("autoencoder_motifs")
def autoencoder_motifs(spark, sf_dir):
    from pawprint.plans import motifs

    z, cols = motifs.scaled(_windows(spark, sf_dir).select("file", "window_id", *FEATURES), FEATURES)
    return motifs.autoencoder(z, cols).select("file", "window_id", "ae1", "ae2", "reconstruction_mse")


@query("motif_summary", f"with {WIN_SQL}, mo as (select file, window_id, case when ms < 20 then 1 when ms < 30 then 2 else 3 end as motif from wf), n as (select file, motif, count(*) as n from mo group by file, motif), q as (select *, row_number() over (partition by file order by n desc, motif) as rn from n) select file, sum(n)::bigint as windows, max(motif) filter (rn = 1) as dominant_motif, {R('log2(sum(n)) - sum(n * log2(n)) / sum(n)', 5)} as motif_entropy from q group by file")
def motif_summary(spark, sf_dir):
    from pawprint.plans import motifs

    m = _windows(spark, sf_dir).withColumn("motif", F.when(F.col("mean_speed") < 20, 1).when(F.col("mean_speed") < 30, 2).otherwise(3))
    return rounded(motifs.motif_summary(m), 5)


@query("motif_transitions", f"with {WIN_SQL}, mo as (select file, window_id, case when ms < 20 then 'slow' when ms < 30 then 'mid' else 'fast' end as motif from wf), l as (select motif as a, lead(motif) over (partition by file order by window_id) as b from mo), n as (select a, b, count(*) as n from l where b is not null group by a, b) select a as \"from\", b as \"to\", n, {R('n / sum(n) over (partition by a)::double')} as probability from n")
def motif_transitions(spark, sf_dir):
    m = _windows(spark, sf_dir).select("file", "window_id", F.when(F.col("mean_speed") < 20, "slow").when(F.col("mean_speed") < 30, "mid").otherwise("fast").alias("motif"))
    n = oft.transition_matrix(m, "motif", order="window_id").groupBy("from", "to").agg(F.sum("n").alias("n"))
    return rounded(n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("from"))))


@query("density_histogram", f"with {F_SQL} select file, floor(x / 5)::bigint as cx, floor(y / 5)::bigint as cy, count(*) as n from f where x is not null group by 1, 2, 3")
def density_histogram(spark, sf_dir):
    from pawprint.plans.plotdata import density

    return density(frames(spark, sf_dir), 5.0)


@query("stream_tumbling", f"with e as (select ts, user_id, value from events where event_type <> 'error') select cast(user_id as varchar) as file, count(*) as frames, {R('avg(value)', 5)} as mean_x from (select user_id, value, time_bucket(interval '1 day', ts, timestamp '1970-01-01') as b from e) group by user_id, b")
def stream_tumbling(spark, sf_dir):
    """The streaming aggregate run as one batch over the events."""
    from pawprint.streaming.tracks import tumbling

    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type <> 'error'")
    t = tumbling(e.select(F.col("user_id").cast("string").alias("file"), "ts", F.col("value").alias("x"), F.col("value").alias("y")), 86400)
    return t.select("file", "frames", r(F.col("mean_x"), 5).alias("mean_x"))


from pawprint import model_queries  # noqa: E402, F401  (registers its queries)
