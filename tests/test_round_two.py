"""Small cases of operators whose queries have SQL over the driver's tables."""

from pyspark.sql import functions as F

from pawprint.operators import labels as lab
from pawprint.operators.interpolate import interpolate
from pawprint.plans import motifs, oft, social


def test_suppressed_runs_and_nulls(spark):
    flags = [True, None, True, True, False, True, True, True, None, True]
    e = spark.createDataFrame([("f", i, x) for i, x in enumerate(flags)], "file string, frame int, a boolean")
    got = [r.a for r in social.suppressed(e, ["a"], 3).orderBy("frame").collect()]
    assert got == [False] * 5 + [True] * 3 + [False] * 2
    assert [r.a for r in social.suppressed(e, ["a"], 1).orderBy("frame").collect()] == [bool(x) for x in flags]


def test_label_count_halves_bouts_at_the_ends(spark):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate("aabbaab")], "file string, frame int, label string")
    got = {r.label: (r.time_s, r["count"]) for r in lab.label_report(df, 1.0).collect()}
    assert got == {"a": (4.0, 1.5), "b": (3.0, 1.5)}


def test_balanced_takes_the_same_number_of_each(spark):
    df = spark.createDataFrame([("f", i, "a" if i % 3 else "b") for i in range(3000)] + [("g", i, None) for i in range(1500)], "file string, frame int, label string")
    got = lab.balanced(df)
    assert got.columns == df.columns
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"a": 1000, "b": 1000, None: 1000}
    assert sorted(map(tuple, got.filter("label = 'a'").collect())) == sorted(map(tuple, lab.balanced(df.repartition(5)).filter("label = 'a'").collect()))
    assert lab.balanced(df.limit(0)).count() == 0


def test_scaled_takes_infinity_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, float("inf")), (4, 3.0), (5, float("nan")), (6, None)], "k int, v double")
    z, cols = motifs.scaled(df, ["v"])
    got = {r.k: r.v for r in z.collect()}
    assert cols == ["v"] and got[3] == got[5] == got[6] == got[2] == 0 and got[4] == -got[1] > 0


def test_interpolation_of_several_columns(spark):
    df = spark.createDataFrame([("f", 0, None, 1.0), ("f", 1, 2.0, None), ("f", 2, None, None), ("f", 3, 4.0, None)], "file string, frame int, x double, y double")
    got = [(r.x, r.y) for r in interpolate(df, ["x", "y"]).orderBy("frame").collect()]
    assert got == [(2.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 1.0)]


def test_score_over_all_rows(spark):
    rows = [("a", 10.0, 1, 5.0, 1.0), ("b", 30.0, 3, 1.0, 3.0), ("c", None, 2, 3.0, 2.0)]
    s = spark.createDataFrame(rows, "file string, center_time_percent double, center_entries int, center_latency_s double, mean_wall_distance_cm double")
    got = {r.file: r.center_score for r in oft.centre_score(s, []).collect()}
    assert got["c"] == 0 and round(got["a"] + got["b"], 9) == 0 and got["b"] > 0


def test_debounced_contacts(spark):
    from pawprint.plans.assays import debounced_contacts

    df = spark.createDataFrame([("f", i, 10 <= i < 20) for i in range(40)], "file string, frame int, on boolean")
    assert [tuple(r) for r in debounced_contacts(df, F.col("on"), 5).collect()] == [("f", 1)]
