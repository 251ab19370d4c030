import numpy as np
import pytest
from pyspark.sql import functions as F

from pawprint.functions.filters import savitzky_golay, smooth_speed
from pawprint.sources.sinks import not_done, split_failures, split_sets, write_tables


@pytest.mark.parametrize("derivative", [0, 1])
def test_savitzky_golay_equals_polynomial_fits(spark, derivative):
    r = np.random.default_rng(4)
    v = np.cumsum(r.normal(size=40))
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 0, 1.0)], "file string, frame int, v double")
    got = {(x.file, x.frame): x.s for x in savitzky_golay(df, "v", "s", 9, 3, derivative).collect()}
    assert got["b", 0] is None
    for i in range(40):
        start = min(max(i - 4, 0), 31)
        p = np.polynomial.Polynomial.fit(np.arange(9), v[start : start + 9], 3, domain=[0, 8], window=[0, 8])
        assert got["a", i] == pytest.approx(p.deriv(derivative)(i - start) if derivative else p(i - start))


def test_smooth_speed_of_a_straight_line(spark):
    df = spark.createDataFrame([("a", i, 3.0 * i, 4.0 * i) for i in range(30)], "file string, frame int, x double, y double")
    assert [round(r.smooth_speed, 6) for r in smooth_speed(df, 2.0).collect()] == [10.0] * 30


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f, i, float(i)) for f in "abc" for i in range(5 if f != "c" else 1)], "file string, frame int, x double")
    good, bad = split_failures(df, {"too short": F.count(F.lit(1)) >= 3, "no position": F.count("x") > 0})
    assert {r.file for r in good.collect()} == {"a", "b"} and [tuple(r) for r in bad.collect()] == [("c", "too short")]
    files = df.select("file").distinct()
    assert not_done(files, spark, str(tmp_path / "frames")).count() == 3
    write_tables({"frames": df.filter("file = 'a'")}, str(tmp_path), ("file",))
    assert {r.file for r in not_done(files, spark, str(tmp_path / "frames")).collect()} == {"b", "c"}
    write_tables({"frames": good}, str(tmp_path), ("file",))
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 10
    train, test = split_sets(df)
    assert train.count() + test.count() == df.count() and train.join(test, ["file", "frame"], "left_semi").count() == 0
