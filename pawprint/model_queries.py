"""Registered queries of models over tracks: group statistics, prepared sets, classification, clusters, motifs of two models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawprint.functions.models import group_statistics
from pawprint.operators import labels as lab
from pawprint.operators import training as tr
from pawprint.queries import F_SQL, M_SQL, ORACLES, P_SQL, R, WIN_SQL, frames, query, r
from pawprint.sources.adapters import points_from_events

#: Means of each track, with its group and covariates.
TRACKS_SQL = F_SQL + ", s as (select file, 'g' || batch as grp, grp as sex, count(*)::double as frames, avg(x) as mx, stddev_samp(y) as sy from f group by file, batch, grp)"
METRICS = ["mean_x", "sd_y"]


def _tracks(spark, sf_dir) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.groupBy("file", F.concat(F.lit("g"), "batch").alias("grp"), F.col("grp").cast("string").alias("sex")).agg(F.count(F.lit(1)).cast("double").alias("frames"), F.avg("x").alias("mean_x"), F.stddev_samp("y").alias("sd_y"))


def _covariate_sql() -> str:
    """F, estimates and standard errors with one number as covariate: from the sums within groups."""
    long = " union all ".join(f"select '{m}' as metric, grp, frames as a, {c} as y from s where {c} is not null" for m, c in zip(METRICS, ("mx", "sy"), strict=True))
    return f"""with {TRACKS_SQL}, l as ({long}),
      g as (select metric, grp, count(*) as n, avg(a) as ma, avg(y) as my, count(*) * var_pop(a) as saa, count(*) * var_pop(y) as syy, count(*) * covar_pop(a, y) as say from l group by metric, grp),
      w as (select metric, sum(n) as n, count(*) as k, sum(saa) as saa, sum(say) / sum(saa) as slope, (sum(syy) - sum(say) * sum(say) / sum(saa)) / (sum(n) - count(*) - 1) as s2,
        sum(n * my * my) - sum(n * my) * sum(n * my) / sum(n) as between_ from g group by metric)
      select metric, 'lm' as model, 'grp' as term, null as contrast, null::double as estimate, null::double as se, null::double as df, {R('between_ / (k - 1) / s2', 4)} as statistic, n::bigint as n_used from w
      union all select metric, 'lm', 'grp pairwise', a.grp || ' - ' || b.grp, {R('a.my - b.my - slope * (a.ma - b.ma)', 5)}, {R('sqrt(s2 * (1 / a.n::double + 1 / b.n::double + (a.ma - b.ma) * (a.ma - b.ma) / w.saa))', 5)}, (w.n - w.k - 1)::double,
        {R('(a.my - b.my - slope * (a.ma - b.ma)) / sqrt(s2 * (1 / a.n::double + 1 / b.n::double + (a.ma - b.ma) * (a.ma - b.ma) / w.saa))', 4)}, w.n::bigint from g a join g b using (metric) join w using (metric) where a.grp < b.grp"""


@query("group_covariates", _covariate_sql())
def group_covariates(spark, sf_dir):
    """Without p, which SQL has no function for."""
    s = group_statistics(_tracks(spark, sf_dir), METRICS, "grp", ("frames",))
    return s.select("metric", "model", "term", "contrast", r(F.col("estimate"), 5).alias("estimate"), r(F.col("se"), 5).alias("se"), "df", r(F.col("statistic"), 4).alias("statistic"), "n_used")


@query("group_random_intercept")
def group_random_intercept(spark, sf_dir):
    """Means of each track's windows of 20 frames by group, the tracks as identities."""
    f = frames(spark, sf_dir)
    w = f.groupBy("file", F.concat(F.lit("g"), "batch").alias("grp"), F.col("grp").cast("string").alias("sex"), F.floor(F.col("frame") / 20).alias("window")).agg(F.avg("x").alias("mean_x"), F.stddev_samp("y").alias("sd_y"))
    return group_statistics(w, METRICS, "grp", ("sex",), "file")


SET_SQL = F_SQL + """, l as (select file, frame, label, lag(likelihood) over w as a, likelihood as b, lead(likelihood) over w as c, (lag(event_id) over w) % 7 as d, event_id % 7 as e, (lead(event_id) over w) % 7 as g, row_number() over w as i, count(*) over (partition by file) as n from f window w as (partition by file order by frame)),
  k as (select list(label order by label) as names from (select distinct label from l where i > 1 and i < n))"""


def _windows(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("e", (F.col("event_id") % 7).cast("double"))


@query("prepared_sets", f"with {SET_SQL} select file, cast(frame as int) as frame, label, (list_position(names, label) - 1)::int as level, array_to_string([case when x = label then 1 else 0 end for x in names], '') as one_hot, a + 10 * b + 100 * c + d * 1000 + e * 10000 + g * 100000 as code from l, k where i > 1 and i < n")
def prepared_sets(spark, sf_dir):
    v = F.col("features")
    p = tr.prepared(lab.windowed_features(_windows(spark, sf_dir), ["likelihood", "e"], 1))
    return p.select("file", "frame", "label", "level", F.array_join(F.col("one_hot").cast("array<string>"), "").alias("one_hot"), (v[0] + v[2] * 10 + v[4] * 100 + v[1] * 1000 + v[3] * 10000 + v[5] * 100000).alias("code"))


@query("classify_behaviors")
def classify_behaviors(spark, sf_dir):
    """A perceptron fitted on the windows of four tracks of five, and the labels it gives to all frames."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    f = _windows(spark, sf_dir).fillna(0.0, ["x", "y"])
    cols = ["x", "y", "likelihood"]
    fit = tr.prepared(lab.windowed_features(f.filter("user_id % 5 <> 0"), cols, 2)).select("level", "label", array_to_vector("features").alias("features")).persist()
    try:
        levels = tr.label_levels(fit).first()[0]  # a few names
        model = MultilayerPerceptronClassifier(layers=[5 * len(cols), 12, max(2, len(levels))], labelCol="level", maxIter=40, seed=1).fit(fit)
    finally:
        fit.unpersist()
    return tr.classified(f, cols, 2, model, levels)


@query("label_kmeans")
def label_kmeans(spark, sf_dir):
    """20 clusters of the windows of all tracks, by 5 left singular vectors."""
    return tr.label_clusters(_windows(spark, sf_dir).fillna(0.0, ["x", "y"]), ["x", "y", "likelihood", "e"], 2, 20, dimensions=5)


def _taps_sql(col: str, derivative: int) -> str:
    from pawprint.functions.filters import weights

    return " + ".join(f"{w!r}::double * lag({col}, {12 - k}) over w" if k <= 12 else f"{w!r}::double * lead({col}, {k - 12}) over w" for k, w in enumerate(map(float, weights(25, 3, derivative)[12])))


@query("smoothed_velocity", f"""with {F_SQL}, v as (select file, frame, event_id % 13 + frame / 10.0::double as a, event_id % 7 as b, count(*) over (partition by file) as n from f),
  d as (select file, frame, n, {_taps_sql('a', 0)} as a, {_taps_sql('a', 1)} as da, {_taps_sql('b', 1)} as db from v window w as (partition by file order by frame))
  select file, cast(frame as int) as frame, {R('a', 5)} as smooth, {R('sqrt(da * da + db * db) * 2', 5)} as speed from d where frame >= 12 and frame < n - 12""")
def smoothed_velocity(spark, sf_dir):
    """The frames inside the tracks, as SQL has them; the tests have those at the ends."""
    from pyspark.sql import Window

    from pawprint.functions.filters import joint_speeds, savitzky_golay

    f = frames(spark, sf_dir).select("file", "frame", ((F.col("event_id") % 13) + F.col("frame") / 10).cast("double").alias("a_x"), (F.col("event_id") % 7).cast("double").alias("a_y"))
    out = joint_speeds(savitzky_golay(f, "a_x", "smooth"), ["a"], 2.0)
    out = out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file"))).filter("frame >= 12 and frame < n - 12")
    return out.select("file", "frame", r(F.col("smooth"), 5).alias("smooth"), r(F.col("a_speed"), 5).alias("speed"))


@query("velocity_ethogram")
def velocity_ethogram(spark, sf_dir):
    """Ten states of all frames by the speeds of three joints."""
    from pawprint.plans.ethogram import velocity_ethogram

    return velocity_ethogram(points_from_events(spark, sf_dir), ["body", "nose", "tail"])


@query("autoencoder_pca_motifs")
def autoencoder_pca_motifs(spark, sf_dir):
    """Windows by the motif of either model, counted: components' clusters against the network's."""
    from pawprint.plans import motifs
    from pawprint.queries import FEATURES, _windows
    from pawprint.schema import MotifConfig

    z, cols = motifs.scaled(motifs.kept(_windows(spark, sf_dir).select("file", "window_id", *FEATURES)), FEATURES)
    return lab.cross_tab(motifs.two_motifs(z, cols, MotifConfig()), "autoencoder_motif", "pca_motif")


#: Medians of three points of each track.
POINTS_SQL = P_SQL + """, md as (select file, median(body_x) as bx, median(body_y) as by_, median(nose_x) as nx, median(nose_y) as ny, median(tail_x) as tx, median(tail_y) as ty from p group by file),
  turn as (select file, (bx + nx + tx) / 3 as cx, (by_ + ny + ty) / 3 as cy, -acos(least(1.0::double, abs(nx - bx) / nullif(sqrt((nx - bx) * (nx - bx) + (ny - by_) * (ny - by_)), 0))) as th from md),
  area as (select file, case when round(a, 9) > 0 then sqrt(25.0::double / a) end as k from (select file, abs(bx * ny - nx * by_ + nx * ty - tx * ny + tx * by_ - bx * ty) / 2 as a from md)),
  arena(pos, ax, ay) as (values (0, 0.0::double, 0.0::double), (1, 49.0::double, 0.0::double), (2, 49.0::double, 49.0::double), (3, 0.0::double, 49.0::double))"""


def _medians(spark, sf_dir) -> DataFrame:
    from pawprint.operators.reshape import points_long
    from pawprint.operators.zones import point_medians

    return point_medians(points_long(points_from_events(spark, sf_dir), ["body", "nose", "tail"]))


def _zones(df: DataFrame) -> DataFrame:
    from pawprint.sources.adapters import ARENA

    return df.select("file").distinct().withColumn("poly", F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ARENA]))


@query("straightened_frames", f"with {POINTS_SQL} select p.file, cast(frame as int) as frame, {R('cx + (body_x - cx) * cos(th) - (body_y - cy) * sin(th)', 5)} as body_x, {R('cy + (body_x - cx) * sin(th) + (body_y - cy) * cos(th)', 5)} as body_y, {R('cx + (nose_x - cx) * cos(th) - (nose_y - cy) * sin(th)', 5)} as nose_x, {R('cy + (nose_x - cx) * sin(th) + (nose_y - cy) * cos(th)', 5)} as nose_y from p join turn using (file)")
def straightened_frames(spark, sf_dir):
    from pawprint.operators.calibrate import applied, rotation

    turn = rotation(_medians(spark, sf_dir), ["body", "nose", "tail"], straight=("body", "nose"))
    p = applied(points_from_events(spark, sf_dir), turn, ["body", "nose"])
    return p.select("file", "frame", *[r(F.col(f"{q}_{c}"), 5).alias(f"{q}_{c}") for q in ("body", "nose") for c in "xy"])


@query("calibrated_geometry", f"""with {POINTS_SQL}, places as (select file, 'zone' as kind, cast(pos as varchar) as name, ax as x, ay as y from md, arena union all select file, 'median', 'body', bx, by_ from md union all select file, 'median', 'nose', nx, ny from md union all select file, 'median', 'tail', tx, ty from md)
  select file, kind, name, {R('(cx + (x - cx) * cos(th) - (y - cy) * sin(th)) * coalesce(k, 1)', 4)} as x, {R('(cy + (x - cx) * sin(th) + (y - cy) * cos(th)) * coalesce(k, 1)', 4)} as y from places left join turn using (file) left join area using (file)""")
def calibrated_geometry(spark, sf_dir):
    """Medians and zones, straightened and then scaled by a known area, as frames would be."""
    from pawprint.operators.calibrate import applied, calibration_factor, rotation, scaling, then

    medians = _medians(spark, sf_dir)
    both = then(rotation(medians, ["body", "nose", "tail"], straight=("body", "nose")), scaling(calibration_factor(medians, "area", 25.0, ["body", "nose", "tail"])))
    zones = applied(_zones(medians), both, poly="poly").select("file", F.lit("zone").alias("kind"), F.posexplode_outer("poly").alias("name", "p")).select("file", "kind", F.col("name").cast("string").alias("name"), "p.x", "p.y")
    moved = applied(medians, both).select("file", F.lit("median").alias("kind"), F.col("point").alias("name"), "x", "y")
    return zones.unionByName(moved).select("file", "kind", "name", r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"))


@query("calibrated_frames", f"with {F_SQL}, q as (select file, median(x) + 1 as w, median(y) + 1 as h from f group by file) select f.file, cast(frame as int) as frame, {R('(x - w / 2) * 40 / w', 5)} as x, {R('(y - h / 2) * 30 / h', 5)} as y from f join q using (file)")
def calibrated_frames(spark, sf_dir):
    """Each direction by its own factor, about the middle of the corners."""
    from pawprint.operators.calibrate import applied, arena_scaling
    from pawprint.operators.zones import point_medians

    f = frames(spark, sf_dir)
    m = point_medians(f.withColumn("point", F.lit("b"))).select("file", (F.col("x") + 1).alias("w"), (F.col("y") + 1).alias("h"))
    corners = m.select("file", *[c.alias(n) for n, c in (("tl_x", F.lit(0.0)), ("tl_y", F.lit(0.0)), ("tr_x", F.col("w")), ("tr_y", F.lit(0.0)), ("br_x", F.col("w")), ("br_y", F.col("h")), ("bl_x", F.lit(0.0)), ("bl_y", F.col("h")))])
    return applied(f, arena_scaling(corners, 40, 30)).select("file", "frame", r(F.col("x"), 5).alias("x"), r(F.col("y"), 5).alias("y"))


@query("kernel_density", f"""with {F_SQL}, k as (select file, floor(x / 0.1::double) * 0.1::double as ex, floor(y / 0.1::double) * 0.1::double as ey, x, y from f where x is not null and y is not null),
  o as (select file, count(*) as n, least(stddev_samp(ex), (quantile_cont(ex, 0.75) - quantile_cont(ex, 0.25)) / 1.34::double) * 1.06::double * power(count(*), -0.2::double) as wx, least(stddev_samp(ey), (quantile_cont(ey, 0.75) - quantile_cont(ey, 0.25)) / 1.34::double) * 1.06::double * power(count(*), -0.2::double) as wy,
    min(ex) as lx, max(x) as hx, min(ey) as ly, max(y) as hy from k group by file),
  g as (select file, gx, gy, lx + (hx - lx) * gx / 19 as px, ly + (hy - ly) * gy / 19 as py, n, wx, wy from o, range(20) a(gx), range(20) b(gy) where wx > 0 and wy > 0)
  select file, gx::int as gx, gy::int as gy, {R('sum(exp(-power((px - ex) / wx, 2) / 2 - power((py - ey) / wy, 2) / 2)) / (2 * pi() * wx * wy * any_value(n))', 5)} as density from g join k using (file) group by file, gx, gy, wx, wy""")
def kernel_density(spark, sf_dir):
    from pawprint.plans.plotdata import kernel_density

    return kernel_density(frames(spark, sf_dir), 0.1, 20).select("file", "gx", "gy", r(F.col("density"), 5).alias("density"))


def _chain_sql() -> str:
    from pawprint.queries import EVENT_RUNS_SQL, _all_events_sql

    bins = ["0_5", "5_10", "10_20", "20_40", "40_inf"]
    wide = ", ".join(f"max({v}) filter (bin = '{b}') as \"proximity_{b}_cm_{v}\"" for v in ("time_s", "percent") for b in bins)
    runs = f"{_all_events_sql()} {EVENT_RUNS_SQL}"
    return f"""select s.*, {', '.join(f'"proximity_{b}_cm_{v}"' for v in ('time_s', 'percent') for b in bins)}, n_both, a_given_b, b_given_a, any_social_contact_mean_interbout_s, any_social_contact_median_interbout_s
      from ({ORACLES["dyad_file_summary"]}) s left join (select file, {wide} from ({ORACLES["proximity_bins"]}) group by file) using (file)
      left join (with {runs} select file, count(*) filter (a and b) as n_both, {R("count(*) filter (a and b) / nullif(count(*) filter (b), 0)::double", 5)} as a_given_b, {R("count(*) filter (a and b) / nullif(count(*) filter (a), 0)::double", 5)} as b_given_a
        from (select file, frame, bool_or(b) filter (event_type = 'close_proximity') as a, bool_or(b) filter (event_type = 'approach_event') as b from ev group by file, frame) group by file) using (file)
      left join (with {runs}, c as (select file, s, s + n - 1 as e from ey where event_type = 'any_social_contact' and b and n >= 2), q as (select file, (s - lag(e) over (partition by file order by s) - 1) / 2.0::double as gap from c)
        select file, {R("avg(gap)", 5)} as any_social_contact_mean_interbout_s, {R("median(gap)", 5)} as any_social_contact_median_interbout_s from q group by file) using (file)"""


@query("dyad_file_chain", _chain_sql())
def dyad_file_chain(spark, sf_dir):
    """A file's summary with proximity bins, overlap and gaps."""
    from pawprint.plans import social
    from pawprint.queries import SOC, _dyads

    c = social.file_chain(_dyads(spark, sf_dir), SOC)
    return c.select(*[r(F.col(f"`{n}`"), 4 if n.startswith("proximity") else 5).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in c.dtypes])


#: Zones of the summary, and their flags.
_ZONES = {"center": "in_center", "periphery": "in_periphery", "corner": "in_corners"}


def _summary_row_sql() -> str:
    flags = {**_ZONES, "immobility": "is_immobile"}
    on = ", ".join(f"coalesce({c}, false) as on_{n}" for n, c in flags.items())
    starts = ", ".join(f"on_{n} and not coalesce(lag(on_{n}) over w, false) as start_{n}" for n in flags)
    runs = ", ".join(f"sum(start_{n}::int) over (partition by file order by frame) as run_{n}" for n in flags)
    bouts = " union all ".join(f"select file, '{n}' as flag, run_{n} as run, count(*) / 2.0::double as s from r where on_{n} group by file, run_{n}" for n in flags)
    cols = []
    for n, c in _ZONES.items():
        cols += [f"count(*) filter ({c}) / 2.0::double as {n}_time_s", f"{R(f'100 * count(*) filter ({c}) / count(*)::double', 4)} as {n}_time_percent", f"count(*) filter (start_{n}) as {n}_entries"]
        if n != "corner":
            cols.append(f"{R(f'coalesce(sum(speed) filter ({c}), 0)', 4)} as {n}_distance_cm")
    wide = ", ".join([*[f"{R(f'{f}(s) filter (flag = {chr(39)}{n}{chr(39)})', 4)} as {n}_{k}_bout_s" for n in _ZONES for k, f in (("mean", "avg"), ("max", "max"))], "count(*) filter (flag = 'immobility' and s >= 1) as immobility_bouts", f"{R('coalesce(sum(s) filter (flag = ' + chr(39) + 'immobility' + chr(39) + ' and s >= 1), 0)', 4)} as immobility_time_s", *[f"{R(f'{f}(s) filter (flag = {chr(39)}immobility{chr(39)} and s >= 1)', 4)} as immobility_{k}_bout_s" for k, f in (("mean", "avg"), ("max", "max"))]])
    return f"""with {M_SQL}, o as (select *, {on}, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as step, avg(case when in_center then 1 when not in_center then 0 end) over (partition by file order by frame rows between 2 preceding and 2 following) > 0.5 as sm from t window w as (partition by file order by frame)),
      s as (select *, {starts}, coalesce(sm <> lag(sm) over w, false) as ch from o window w as (partition by file order by frame)), r as (select *, {runs} from s), b as ({bouts}), bw as (select file, {wide} from b group by file),
      a as (select file, 2.0::double as fps, count(*) / 2.0::double as total_time_s, {R('coalesce(sum(speed), 0)', 4)} as distance_cm, {R('avg(speed_cm_s)', 4)} as mean_speed_cm_s, {R('avg(speed_cm_s) filter (is_moving)', 4)} as moving_speed_cm_s, count(*) filter (is_moving) / 2.0::double as moving_time_s,
        (count(*) - count(*) filter (is_moving)) / 2.0::double as stationary_time_s, {R('100 * count(*) filter (is_moving) / count(*)::double', 4)} as percent_moving, {', '.join(cols)}, {R('100 * coalesce(sum(speed) filter (in_center), 0) / nullif(sum(speed), 0)', 3)} as center_distance_percent,
        count(*) filter (ch) as center_transitions, min(frame) filter (in_center) / 2.0::double as center_latency_s, {', '.join(f"{R(f'{f}(wall_distance_cm)', 4)} as {k}_wall_distance_cm" for k, f in (('mean', 'avg'), ('median', 'median'), ('min', 'min'), ('max', 'max')))},
        {R('count(*) filter (x is null or y is null) / count(*)::double', 4)} as bodycentre_missing_fraction, {R('count(*) filter (coalesce(likelihood < 0.9, true)) / count(*)::double', 4)} as bodycentre_low_likelihood_fraction, count(*) filter (step > 40) as bodycentre_impossible_jump_n,
        count(*) filter (x is null or y is null) / count(*)::double > 0.2 or count(*) filter (coalesce(likelihood < 0.9, true)) / count(*)::double > 0.2 or count(*) filter (step > 40) > 0 as qc_flag from r group by file)
      select a.*, coalesce(immobility_bouts, 0) as immobility_bouts, coalesce(immobility_time_s, 0) as immobility_time_s, {', '.join(f'{n}_{k}_bout_s' for n in (*_ZONES, 'immobility') for k in ('mean', 'max'))} from a left join bw using (file)"""


@query("oft_summary_row", _summary_row_sql())
def oft_summary_row(spark, sf_dir):
    """All columns of a track's summary."""
    from dataclasses import replace

    from pawprint.plans.oft_rows import summary_row
    from pawprint.queries import CFG, table

    s = summary_row(table(spark, sf_dir), replace(CFG, jump_cm=40.0))
    return s.select(*[r(F.col(c), 3 if c == "center_distance_percent" else 4).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


EPOCH_METRICS_SQL = f"""with {M_SQL}, e0 as (select *, max(time_s) over (partition by file) as mx from t), e1 as (select *, case when time_s < least(10, mx / 2) then 'first_epoch' when time_s >= mx - least(10, mx / 2) then 'last_epoch' end as epoch from e0)
  select file, epoch, count(*) / 2.0::double as epoch_time_s, {R('coalesce(sum(speed_cm_s / 2), 0)', 4)} as distance_cm, {R('avg(speed_cm_s)', 4)} as mean_speed_cm_s, {', '.join(f'count(*) filter ({c}) / 2.0::double as {k}_time_s' for k, c in (*_ZONES.items(), ('moving', 'is_moving'), ('immobile', 'is_immobile')))},
    {R('100 * count(*) filter (in_center) / count(*)::double', 4)} as center_time_percent, {R('avg(wall_distance_cm)', 9)} as mean_wall_distance_cm, {', '.join(f'count(*) filter (wall_distance_cm <= {cm}) / 2.0::double as wall_{cm}cm_time_s, {R(f"100 * count(*) filter (wall_distance_cm <= {cm}) / count(*)::double", 4)} as wall_{cm}cm_percent' for cm in (5, 10))} from e1 where epoch is not null group by file, epoch"""


@query("oft_epoch_metrics", EPOCH_METRICS_SQL)
def oft_epoch_metrics(spark, sf_dir):
    from pawprint.plans.oft_rows import epoch_metrics
    from pawprint.queries import CFG, table

    e = epoch_metrics(table(spark, sf_dir), CFG)
    return e.select(*[r(F.col(c), 9 if c == "mean_wall_distance_cm" else 4).alias(c) if t == "double" else F.col(c) for c, t in e.dtypes])


def _enhanced_sql() -> str:
    from pawprint.plans.oft_rows import DELTA_METRICS, SLOPE_METRICS, STATES

    bins = f"""select file, floor(time_s / 10) * 10 as bs, count(*) filter (in_center) / 2.0::double as center_time_s, count(*) filter (in_periphery) / 2.0::double as periphery_time_s, count(*) filter (in_corners) / 2.0::double as corner_time_s, count(*) filter (is_moving) / 2.0::double as moving_time_s,
      count(*) filter (is_immobile) / 2.0::double as immobile_time_s, sum(speed_cm_s / 2) as distance_cm, avg(speed_cm_s) as mean_speed_cm_s, avg(wall_distance_cm) as mean_wall_distance_cm, count(*) filter (en)::double as center_entries from
      (select *, coalesce(in_center, false) and not coalesce(lag(coalesce(in_center, false)) over (partition by file, floor(time_s / 10) order by frame), false) as en from t) group by file, bs"""
    fits = ", ".join(f"{R(f'case when count({m}) >= 3 then {f} end', n)} as {k}_{m}" for m in SLOPE_METRICS for k, f, n in (("slope_per_min", f"regr_slope({m}, bs) * 60", 3), ("intercept", f"regr_intercept({m}, bs)", 3), ("r_squared", f"regr_r2({m}, bs)", 5)))
    ep = EPOCH_METRICS_SQL[EPOCH_METRICS_SQL.index("select file, epoch, count"):].replace("round(", "(").replace(", 4) + 0.0::double", ")").replace(", 9) + 0.0::double", ")")
    wide = ", ".join(f"max({m}) filter (epoch = '{e}') as {m}_{e}" for m in DELTA_METRICS for e in ("first_epoch", "last_epoch"))
    n = lambda m: 9 if "wall_distance" in m else 3
    told = ", ".join(f"{R(f'{m}_{e}', n(m))} as {m}_{e}" for m in DELTA_METRICS for e in ("first_epoch", "last_epoch")) + ", " + ", ".join(f"{R(f'{m}_last_epoch - {m}_first_epoch', n(m))} as delta_{m}" for m in DELTA_METRICS)
    cases = {"low_speed_or_rest": "speed_cm_s < 10", "moderate_speed": "speed_cm_s >= 10 and speed_cm_s < 40", "high_speed": "speed_cm_s >= 40"}
    states = ", ".join(f"count(*) filter ({c}) / 2.0::double as state_time_s_{s}, {R(f'100 * count(*) filter ({c}) / nullif(count(speed_cm_s), 0)::double', 4)} as state_time_percent_{s}, {R(f'avg(speed_cm_s) filter ({c})', 4)} as state_mean_speed_cm_s_{s}" for s, c in ((s, cases[s]) for s in STATES))
    walls = ", ".join(f"count(*) filter (n{cm}) / 2.0::double as wall_time_s_{cm}cm, {R(f'100 * count(*) filter (n{cm}) / count(*)::double', 4)} as wall_time_percent_{cm}cm, count(*) filter (e{cm}) as wall_entries_{cm}cm" for cm in (5, 10))
    return f"""with {M_SQL}, e0 as (select *, max(time_s) over (partition by file) as mx from t), e1 as (select *, case when time_s < least(10, mx / 2) then 'first_epoch' when time_s >= mx - least(10, mx / 2) then 'last_epoch' end as epoch from e0),
      ep as ({ep}), ew as (select file, {wide} from ep group by file), et as (select file, {told} from ew), sl as (select file, {fits} from ({bins}) group by file),
      n as (select file, frame, speed_cm_s, x, y, coalesce(wall_distance_cm <= 5, false) as n5, coalesce(wall_distance_cm <= 10, false) as n10 from t), i as (select *, n5 and not coalesce(lag(n5) over w, false) as e5, n10 and not coalesce(lag(n10) over w, false) as e10 from n window w as (partition by file order by frame)),
      fm as (select file, {R("count(*) filter (x is not null and y is not null) / count(*)::double", 4)} as valid_frame_fraction, {walls}, {states} from i group by file)
      select fm.*, path_length_cm as total_distance_from_frames_cm, net_displacement_cm, tortuosity as tortuosity_distance_over_displacement, mean_turn_deg as mean_turn_angle_deg, median_turn_deg as median_turn_angle_deg, mean_angular_velocity_deg_s, sharp_turn_fraction as high_turn_fraction_90deg,
        et.* exclude (file), sl.* exclude (file), 10::int as occupancy_grid_n, nullif(cells, 0) as occupied_bins_n, 100::int as total_bins_n, case when cells > 0 then coverage_percent end as arena_coverage_percent, case when cells > 0 then entropy_bits end as occupancy_entropy, case when cells > 0 then entropy_norm end as occupancy_entropy_normalized
      from fm left join ({ORACLES["path_geometry"]}) using (file) left join et using (file) left join sl using (file) left join ({ORACLES["occupancy_entropy"]}) using (file)"""


@query("enhanced_full", _enhanced_sql())
def enhanced_full(spark, sf_dir):
    """All columns of the enhanced row but p, which SQL has no function for."""
    from pawprint.plans.oft_rows import enhanced_full
    from pawprint.queries import CFG, table

    e = enhanced_full(table(spark, sf_dir), CFG)
    digits = {"arena_coverage_percent": 6, "occupancy_entropy": 5, "occupancy_entropy_normalized": 5, "tortuosity_distance_over_displacement": 3}

    def of(c):
        if "wall_distance" in c and c.endswith(("_epoch", "distance_cm")) and not c.startswith(("slope", "intercept", "r_squared")):
            return 9
        return 5 if c.startswith("r_squared") else 3 if c.startswith(("slope", "intercept", "delta_")) or c.endswith("_epoch") else digits.get(c, 4)

    return e.select(*[r(F.col(c), of(c)).alias(c) if t == "double" else F.col(c) for c, t in e.dtypes if not c.startswith("p_value")])


@query("motif_shares_wide", f"""with {WIN_SQL}, mo as (select file, case when ms < 20 then 'slow' when ms < 30 then 'mid' else 'fast' end as motif from wf), n as (select file, motif, count(*) as n from mo group by file, motif)
  select file, sum(n)::bigint as windows, {', '.join(f"{R(f'coalesce(sum(n) filter (motif = {chr(39)}{m}{chr(39)}), 0) / sum(n)::double')} as motif_fraction_{m}" for m in ('slow', 'mid', 'fast'))}, {R('log2(sum(n)) - sum(n * log2(n)) / sum(n)', 5)} as motif_entropy, arg_min(motif, {{'n': -n, 'm': motif}}) as dominant_motif from n group by file""")
def motif_shares_wide(spark, sf_dir):
    from pawprint.plans.motifs import motif_shares
    from pawprint.queries import _windows as windows

    m = windows(spark, sf_dir).withColumn("motif", F.when(F.col("mean_speed") < 20, "slow").when(F.col("mean_speed") < 30, "mid").otherwise("fast"))
    s = motif_shares(m, ["slow", "mid", "fast"])
    return s.select(*[r(F.col(c), 5 if c == "motif_entropy" else 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


_LABELS = ["click", "error", "purchase", "signup", "view"]


@query("label_correlations", f"with {F_SQL}, s as (select file, {', '.join(f"count(*) filter (label = '{x}')::double as {x}" for x in _LABELS)} from f group by file) " + " union all ".join(f"select '{a}' as a, '{b}' as b, {R(f'corr({a}, {b})', 5)} as r from s" for i, a in enumerate(_LABELS) for b in _LABELS[i:]))
def label_correlations(spark, sf_dir):
    """All pairs of labels, by the frames that tracks have of them."""
    from pawprint.plans.plotdata import correlations

    n = frames(spark, sf_dir).groupBy("file", "label").agg(F.count(F.lit(1)).alias("n"))
    return correlations(n, "label", "n", _LABELS).select("a", "b", r(F.col("r"), 5).alias("r"))


@query("point_data", f"with {P_SQL} select file, point, cast(frame as int) as frame, {R('x')} as x, {R('y')} as y, 1.0::double as likelihood from (select file, 'nose' as point, frame, nose_x as x, nose_y as y from p union all select file, 'tail', frame, tail_x, tail_y from p) where frame between 5 and 20")
def point_data(spark, sf_dir):
    """Two points from 2.3 s (the frame at 2.5 s) to 10 s."""
    from pawprint.operators.reshape import points_long
    from pawprint.plans.plotdata import points_in_range

    out = points_in_range(points_long(points_from_events(spark, sf_dir), ["body", "nose", "tail"]), 2.3, 10.0, 2.0, ["nose", "tail"])
    return out.select("file", "point", "frame", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), "likelihood")


@query("polygon_of_each_track", f"""with {F_SQL}, m as (select file, median(x) as mx, median(y) as my from f group by file), c as (select f.file, f.frame, f.x, f.y, mx - 2 as x0, mx + 2 as x1, my - 15 as y0, my + 15 as y1 from f join m using (file))
  select file, count(*) filter (x > x0 + 1e-9 and x < x1 - 1e-9 and y > y0 + 1e-9 and y < y1 - 1e-9) as inside, count(*) filter (x is not null and y is not null) as known from c group by file""")
def polygon_of_each_track(spark, sf_dir):
    """Frames strictly within a rectangle about each track's own medians, a polygon column."""
    from pawprint.functions import geometry as g
    from pawprint.operators.zones import point_medians

    f = frames(spark, sf_dir)
    m = point_medians(f.withColumn("point", F.lit("b"))).select("file", F.col("x").alias("mx"), F.col("y").alias("my"))
    at = lambda dx, dy: F.struct((F.col("mx") + dx).alias("x"), (F.col("my") + dy).alias("y"))
    zones = m.select("file", "mx", "my", F.array(at(-2, -15), at(2, -15), at(2, 15), at(-2, 15)).alias("poly"))
    x, y = F.col("x"), F.col("y")
    j = f.join(zones, "file")
    return j.groupBy("file").agg(F.count_if(g.in_zones(x, y, [F.col("poly")])).alias("inside"), F.count_if(x.isNotNull() & y.isNotNull()).alias("known"))
