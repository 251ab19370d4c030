"""Small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from pawprint.functions import geometry as g
from pawprint.functions import windows as win
from pawprint.functions.stats import incomplete_beta, one_way, slopes, with_holm
from pawprint.operators import bouts, calibrate, labels, movement, qc, reshape, zones
from pawprint.operators.interpolate import interpolate
from pawprint.plans import motifs, oft, plotdata, social
from pawprint.schema import SocIntConfig

SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]


def series(spark, values, kind="double"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"file string, frame int, v {kind}")


def column(df, c):
    return [r[0] for r in df.orderBy("frame").select(c).collect()]


def test_first_difference_and_majority(spark):
    w = win.track()
    assert column(series(spark, [1.0, 4.0, 6.0]).withColumn("d", win.first_difference(F.col("v"), w)), "d") == [0, 3, 2]
    flags = series(spark, [True, False, True, True, False], "boolean")
    assert column(flags.withColumn("m", win.majority(F.col("v"), 1, w)), "m") == [False, True, True, True, False]
    assert movement.transitions(flags, F.col("v"), 0).first().transitions == 3


def test_entries_and_visits_differ_in_the_first_row(spark):
    w, e = win.track(), series(spark, [True, True, False, True, None, True], "boolean")
    assert e.withColumn("e", win.entered(F.col("v"), w)).agg(F.count_if("e")).first()[0] == 3
    v = series(spark, [True, True, False, True, False, True], "boolean")
    assert v.withColumn("e", win.visited(F.col("v"), w)).agg(F.count_if("e")).first()[0] == 2


def test_bouts(spark):
    f = series(spark, [True, True, False, True, False, True, True, True], "boolean")
    r = bouts.bout_summary(f, F.col("v"), 2.0, 1.0).first()
    assert (r.bouts, r.total_s, r.mean_s, r.max_s, r.latency_s) == (2, 2.5, 1.25, 1.5, 0.0)
    s = bouts.suppress_short(series(spark, [True, False, True, True], "boolean"), F.col("v"), 2, ["file"], "k")
    assert column(s, "k") == [False, False, True, True]
    r = bouts.intervals_between(series(spark, [True, False, False, True], "boolean"), F.col("v"), 1.0, 1.0).first()
    assert (r.n, r.mean_s) == (1, 2.0)


@pytest.mark.parametrize("edges, gap, want", [("nearest", None, [1, 1, 2, 3, 4, 4]), ("null", None, [None, 1, 2, 3, 4, None]), ("nearest", 1, [1, 1, None, None, 4, 4]), ("median", None, [2.5, 1, 2, 3, 4, 2.5])])
def test_interpolation(spark, edges, gap, want):
    f = series(spark, [None, 1.0, None, None, 4.0, None])
    assert column(interpolate(f, ["v"], edges=edges, max_gap=gap), "v") == want
    with pytest.raises(ValueError):
        interpolate(f, ["v"], edges="guess")


def test_interpolation_of_nothing(spark):
    assert column(interpolate(series(spark, [None, None]), ["v"]), "v") == [None, None]
    assert column(interpolate(series(spark, [None, 3.0, None]), ["v"]), "v") == [3, 3, 3]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("as_column", [True, False])
def test_inside_is_strict(spark, as_column):
    poly = g.polygon(*SQUARE) if as_column else SQUARE
    at = [(1.0, 1.0), (0.0, 1.0), (2.0, 2.0), (3.0, 1.0), (1.0, 2.0)]
    r = one(spark, *[g.strictly_inside(F.lit(x), F.lit(y), poly).alias(f"s{i}") for i, (x, y) in enumerate(at)], *[g.inside_or_border(F.lit(x), F.lit(y), poly).alias(f"b{i}") for i, (x, y) in enumerate(at)], g.strictly_inside(F.lit(None).cast("double"), F.lit(1.0), poly).alias("n"))
    assert list(r) == [True, False, False, False, False, True, True, True, False, True, None]
    r = one(spark, g.line_distance(F.lit(3.0), F.lit(1.0), poly), g.line_distance(F.lit(3.0), F.lit(2.0), poly), g.segment_distance(F.lit(3.0), F.lit(2.0), poly))
    assert list(r) == [1, 0, 1]


def test_shapes_and_angles(spark):
    poly = g.polygon(*SQUARE)
    r = one(spark, g.polygon_area(poly), g.scaled(poly, 0.5).alias("p"), g.angle_clockwise(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), g.circular_diff_deg(F.lit(350.0), F.lit(10.0)), g.angle_deg(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), g.wrapped(F.lit(1.5 * math.pi)))
    assert r[0] == 4 and [(p.x, p.y) for p in r.p] == [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
    assert r[2] == pytest.approx(math.pi / 2) and r[3] == 20 and r[4] is None and r[5] == pytest.approx(-math.pi / 2)
    both = zones.open_field_zones([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), zones.open_field_zones(g.polygon((0, 0), (10, 0), (10, 10), (0, 10)))
    for k in both[0]:
        found = one(spark, *both[1][k])
        assert [[(p.x, p.y) for p in z] for z in found] == [[tuple(map(pytest.approx, p)) for p in z] for z in both[0][k]]


def test_calibration_and_rotation(spark):
    m = spark.createDataFrame([("a", p, x * 5, y * 5) for p, (x, y) in zip("abcd", SQUARE, strict=True)], "file string, point string, x double, y double")
    assert calibrate.calibration_factor(m, "area", 400.0, list("abcd")).first().px_to_cm == 2
    assert calibrate.calibration_factor(m, "distance", 5.0, ["a", "b"]).first().px_to_cm == 0.5
    f = spark.createDataFrame([("a", 0, 1.0, 0.0), ("a", 1, -1.0, 0.0)], "file string, frame int, x double, y double")
    assert [(round(r.x, 9), round(r.y, 9)) for r in calibrate.rotate(f, math.pi / 2).orderBy("frame").collect()] == [(0, 1), (0, -1)]


def test_labels(spark):
    f = spark.createDataFrame([("a", i) for i in range(4)], "file string, frame int")
    iv = spark.createDataFrame([("a", 0, 1.0, 2.0, "a"), ("a", 1, 2.0, 3.0, "b")], "file string, ord int, from double, to double, type string")
    assert column(labels.interval_labels(f, iv, 1.0), "label") == ["None", "a", "b", "b"]
    e = {r.label: r for r in labels.evaluate(spark.createDataFrame([("f", "a", "a"), ("f", "a", "b"), ("f", "b", "b")], "file string, t string, c string"), "t", "c").collect()}
    assert (e["a"].correct, e["a"].wrong, e["a"].precision, e["a"].recall) == (1, 1, 1, 0.5) and (e["b"].precision, e["b"].recall) == (0.5, 1)
    s = series(spark, ["a", "b", "b", "a", "b"], "string").withColumnRenamed("v", "label")
    assert column(labels.smooth_labels(s, 1, ["a", "b"]), "smoothed") == ["a", "b", "b", "b", "a"]
    assert column(reshape.cut(series(spark, [1.0] * 5), end=1), "frame") == [0, 1, 2] and column(reshape.cut(series(spark, [1.0] * 5), end=1, legacy_end=False), "frame") == [0, 1, 2, 3]


def test_entropy_and_transitions(spark):
    n = spark.createDataFrame([("x", 2), ("y", 2)], "k string, n int")
    assert n.agg(win.entropy_bits(F.col("n"))).first()[0] == 1
    t = {(r["from"], r["to"]): (r.n, r.probability) for r in oft.transition_matrix(series(spark, ["A", "A", "B", "A"], "string"), "v").collect()}
    assert t == {("A", "A"): (1, 0.5), ("A", "B"): (1, 0.5), ("B", "A"): (1, 1.0)}


def test_statistics(spark):
    p = spark.createDataFrame([("t", 0.01), ("t", 0.04), ("t", 0.03), ("t", None)], "f string, p double")
    assert [round(r.h, 9) if r.h else None for r in with_holm(p, "p", ["f"], ["f"], "h").orderBy(F.asc_nulls_last("p")).collect()] == [0.03, 0.06, 0.06, None]
    # fixed values of the t and F distributions
    assert incomplete_beta(5, 0.5, 10 / (10 + 2.228138852**2)) == pytest.approx(0.05, abs=1e-8)
    d = spark.createDataFrame([("a", float(x), y) for x, y in enumerate([1.0, 2.1, 2.9, 4.2, 5.1])] + [("b", 0.0, 1.0), ("b", 1.0, 2.0)], "file string, x double, y double")
    s = {r.file: r for r in slopes(d, "x", ["y"], ["file"]).collect()}
    assert s["a"].slope_per_min == pytest.approx(61.8) and s["a"].p_value == pytest.approx(1.5e-4, abs=1e-4) and s["b"].slope_per_min is None
    a = one_way(spark.createDataFrame([(k, float(v)) for k, vs in (("a", [6.0, 8, 4, 5, 3, 4]), ("b", [8.0, 12, 9, 11, 6, 8]), ("c", [13.0, 9, 11, 8, 7, 12])) for v in vs], "g string, v double"), "g", "v").first()
    assert (a.groups, a.n) == (3, 18) and a.f == pytest.approx(9.264706) and a.p == pytest.approx(0.0023988, abs=1e-6)


def test_qc_and_cleaning(spark):
    f = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0), ("a", 1, 100.0, 0.0, 1.0), ("a", 2, None, None, None), ("a", 3, 1.0, 0.0, 0.2)], "file string, frame int, x double, y double, likelihood double")
    r = qc.flagged(qc.tracking_qc(f, 1.0, 0.9, 15.0)).first()
    assert (r.missing_fraction, r.low_likelihood_fraction, r.impossible_jump_n, r.qc_flag) == (0.25, 0.5, 1, True)
    assert column(movement.clean(f, 0.9, 50.0), "x") == [0.0, None, None, None]


def test_proximity_bins_are_left_closed(spark):
    m = spark.createDataFrame([("a", 5.0), ("a", 4.9), ("a", None)], "file string, d_body1_body2 double")
    got = {r.bin: (r.time_s, r.percent) for r in social.proximity_bins(m, SocIntConfig(fps=1.0)).collect()}
    assert got["5_10"] == (1.0, 50.0) and got["0_5"] == (1.0, 50.0) and got["40_inf"] == (0.0, 0.0)


def test_motif_helpers(spark):
    df = spark.createDataFrame([(f"f{i}", i, [float(i % 2) * 10 + i * 0.01, float(i % 3)], i % 2) for i in range(40)], "file string, window_id int, scores array<double>, motif int")
    assert motifs.silhouette(df, "scores", "motif") > 0.7
    reps = motifs.representatives(df, 3).collect()
    assert len(reps) == 6 and {r["rank"] for r in reps} == {1, 2, 3}
    flat = spark.createDataFrame([(float(i), 1.0, None if i == 3 else float(i % 4)) for i in range(8)], "a double, b double, c double")
    z, cols = motifs.scaled(flat, ["a", "b", "c"])
    assert cols == ["a", "c"] and abs(z.agg(F.avg("a")).first()[0]) < 1e-9
    zone = spark.createDataFrame([("f", "z", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "file string, zone string, poly array<struct<x:double,y:double>>")
    assert [r.pos for r in plotdata.outline(zone).orderBy("pos").collect()] == [0, 1, 2, 3]
