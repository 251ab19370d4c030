"""Transforms, kernel densities, suites of analyses and the chain of a file's tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from pawprint.operators import calibrate as cal
from pawprint.plans import oft, plotdata
from pawprint.plans.suite import bucketed, run_suite
from pawprint.schema import OftConfig

MEDIANS = [("f", "tl", 0.0, 0.0), ("f", "tr", 4.0, 3.0), ("f", "c", 2.0, 0.0), ("g", "tl", 1.0, 1.0)]


def medians(spark):
    return spark.createDataFrame(MEDIANS, "file string, point string, x double, y double")


def test_straightening_and_its_composition(spark):
    m = medians(spark)
    turn = cal.rotation(m, ["tl", "tr", "c"], straight=("tl", "tr"))
    theta, cx, cy = -math.acos(4 / 5), 2.0, 1.0
    want = lambda x, y: (cx + (x - cx) * math.cos(theta) - (y - cy) * math.sin(theta), cy + (x - cx) * math.sin(theta) + (y - cy) * math.cos(theta))
    got = {r.point: (r.x, r.y) for r in cal.applied(m.filter("file = 'f'"), turn).collect()}
    assert all(np.allclose(got[p], want(x, y)) for f, p, x, y in MEDIANS if f == "f")
    assert math.isclose(got["tl"][1], got["tr"][1])  # the line lies along x
    both = cal.then(turn, cal.scaling(spark.createDataFrame([("f", 2.0)], "file string, px_to_cm double")))
    zone = spark.createDataFrame([("f", "z", [(0.0, 0.0), (4.0, 3.0)]), ("h", "z", [(0.0, 0.0)])], "file string, zone string, poly array<struct<x:double,y:double>>")
    moved = {r.file: r.poly for r in cal.applied(zone, both, poly="poly").collect()}
    assert np.allclose([tuple(p) for p in moved["f"]], [np.multiply(want(0, 0), 2), np.multiply(want(4, 3), 2)]) and moved["h"] is None
    wide = spark.createDataFrame([("f", 0, 4.0, 3.0, None, 1.0)], "file string, frame int, a_x double, a_y double, b_x double, b_y double")
    row = cal.applied(wide, both, ["a", "b"]).first()
    assert np.allclose((row.a_x, row.a_y), np.multiply(want(4, 3), 2)) and row.b_x is None and list(row.asDict()) == wide.columns
    ninety = cal.applied(m.filter("file = 'f'"), cal.rotation(m, ["tl"], 90.0)).filter("point = 'tr'").first()
    assert np.allclose((ninety.x, ninety.y), (-3.0, 4.0))
    assert cal.rotation(m, ["tr"]).count() == 1 and cal.applied(m.filter("file = 'g'"), cal.rotation(m, ["tr"])).first().x is None  # g has no tr


def test_directions_by_their_own_factors(spark):
    corners = spark.createDataFrame([("f", 10.0, 20.0, 30.0, 20.0, 30.0, 60.0, 10.0, 60.0), ("g", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "file string, tl_x double, tl_y double, tr_x double, tr_y double, br_x double, br_y double, bl_x double, bl_y double")
    df = spark.createDataFrame([("f", 30.0, 60.0), ("f", 20.0, 40.0), ("g", 1.0, 1.0)], "file string, x double, y double")
    got = cal.applied(df, cal.arena_scaling(corners, 40, 20)).collect()
    assert sorted((r.x, r.y) for r in got if r.file == "f") == [(0.0, 0.0), (20.0, 10.0)] and [r.x for r in got if r.file == "g"] == [None]


def test_density_equals_sums_of_kernels(spark):
    r = np.random.default_rng(5)
    xy = r.normal(0, 1, (40, 2)) * [3, 1]
    rows = [("f", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("f", 99, None, 1.0), ("g", 0, 1.0, 1.0)] + [("h", i, 1.0, float(i)) for i in range(9)]
    got = plotdata.kernel_density(spark.createDataFrame(rows, "file string, frame int, x double, y double"), 0.1, 15).collect()
    assert {q.file for q in got} == {"f"} and len(got) == 225
    cells = np.floor(xy / 0.1) * 0.1
    sd = [1.06 * min(c.std(ddof=1), (np.quantile(c, 0.75) - np.quantile(c, 0.25)) / 1.34) * 40**-0.2 for c in cells.T]
    kernel = lambda t, s: np.exp(-((t / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi))
    assert all(math.isclose(q.density, (kernel(q.x - cells[:, 0], sd[0]) * kernel(q.y - cells[:, 1], sd[1])).mean(), rel_tol=1e-9) for q in got)
    wide = plotdata.kernel_density(spark.createDataFrame([*rows[:40], ("f", 100, -60.0, -60.0), ("f", 101, 60.0, 60.0)], "file string, frame int, x double, y double"), 0.1, 241)
    mass = wide.agg(F.sum("density")).first()[0] * (120 / 240) ** 2
    assert abs(mass - 40 / 42 - 0.5 * 2 / 42) < 0.02  # about all but what lies beyond the grid's corners


def suite_frames(spark, files=("a", "b", "c")):
    rows = [(f, i, None if f == "b" else float(i % 7) * 5, float(i % 5) * 6, 1.0) for f in files for i in range(30)]
    return spark.createDataFrame(rows, "file string, frame int, x double, y double, likelihood double")


def test_suite_goes_on_and_splits_failures(spark, tmp_path):
    cfg = OftConfig(fps=2.0, bin_s=5.0)
    runs = []
    analyses = {"summary": lambda t: oft.oft_summary(t, cfg), "bins": lambda t: runs.append(1) or oft.bin_table(t, cfg)}
    go = lambda df, names=analyses: run_suite(spark, df, names, str(tmp_path), "suite_frames", lambda t: oft.frame_table(t, cfg))
    got = go(suite_frames(spark))
    assert {r.file for r in got["summary"].collect()} == {"a", "c"} and [tuple(r) for r in got["failures"].collect()] == [("b", "no frames with a position")]
    assert got["bins"].groupBy("file").count().filter("count = 3").count() == 2
    again = go(suite_frames(spark, ("a", "b", "c", "d")))
    assert sorted(r.file for r in again["summary"].collect()) == ["a", "c", "d"] and again["failures"].count() == 1 and again["bins"].count() == 9
    more = go(suite_frames(spark, ("a", "d")), {**analyses, "path": lambda t: oft.path_geometry(t, cfg)})
    assert sorted(r.file for r in more["path"].collect()) == ["a", "d"] and more["summary"].count() == 3
    alone = oft.oft_summary(oft.frame_table(suite_frames(spark, ("a",)), cfg), cfg).first()
    assert [r for r in got["summary"].collect() if r.file == "a"] == [alone]
    spark.sql("drop table suite_frames")


def test_analyses_of_a_bucketed_table_exchange_nothing(spark):
    cfg = OftConfig(fps=2.0, bin_s=5.0)
    t = bucketed(oft.frame_table(suite_frames(spark), cfg), "bucketed_frames", 4)
    for f in (oft.bin_table, oft.path_geometry, oft.fragmentation, oft.bursts, oft.oft_summary):
        plan = f(t, cfg)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, f
    spark.sql("drop table bucketed_frames")
