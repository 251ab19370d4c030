"""Cases with missing frames, worked out by hand."""

from pawprint.functions.stats import slopes
from pawprint.plans import assays, oft
from pawprint.schema import OftConfig


def test_path_has_no_step_across_a_gap(spark):
    rows = [("f", 0, 0.0, 0.0), ("f", 1, 1.0, 0.0), ("f", 2, None, None), ("f", 3, 1.0, 5.0), ("f", 4, 1.0, 6.0), ("g", 0, None, None), ("g", 1, 2.0, 2.0)]
    got = {r.file: r for r in oft.path_geometry(spark.createDataFrame(rows, "file string, frame int, x double, y double"), OftConfig(fps=2.0)).collect()}
    assert (got["f"].path_length_cm, round(got["f"].net_displacement_cm, 9), got["f"].mean_turn_deg) == (2.0, round(37**0.5, 9), None)
    assert (got["g"].path_length_cm, got["g"].net_displacement_cm, got["g"].tortuosity) == (0.0, None, None)


def test_angular_velocity(spark):
    rows = [("f", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 1.0)])]
    got = oft.path_geometry(spark.createDataFrame(rows, "file string, frame int, x double, y double"), OftConfig(fps=2.0)).first()
    assert (round(got.mean_turn_deg, 9), round(got.mean_angular_velocity_deg_s, 9), got.sharp_turn_fraction) == (90.0, 180.0, 1.0)


def majority(x, k):
    return [sum(x[max(0, i - k) : i + k + 1]) * 2 > len(x[max(0, i - k) : i + k + 1]) for i in range(len(x))]


def test_nosedips_smooth_twice(spark):
    dips = [bool(int(c)) for c in "00110100111011010000110110"]
    df = spark.createDataFrame([("f", i, not d, True, False) for i, d in enumerate(dips)], "file string, frame int, head boolean, body boolean, neck boolean")
    twice = majority(majority(dips, 2), 2)
    want = sum(a != b for a, b in zip(twice, twice[1:], strict=False)) / 2
    assert [tuple(r) for r in assays.nosedips(df, df["head"], df["body"], df["neck"], 2).collect()] == [("f", want)]


def test_perfect_fit_has_no_doubt(spark):
    df = spark.createDataFrame([("f", float(i), 2.0 * i + 1, 5.0) for i in range(5)], "file string, t double, y double, z double")
    got = {r.metric: r for r in slopes(df, "t", ["y", "z"], ["file"]).collect()}
    assert got["y"].p_value == 0.0 and got["y"].slope_per_min == 120.0 and got["z"].p_value is None
