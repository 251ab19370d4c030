"""Filters of many columns against polynomial fits, and the ethogram's states."""

import numpy as np
from pyspark.sql import functions as F

from pawprint.functions.filters import joint_speeds, smoothed
from pawprint.plans.ethogram import velocity_ethogram


def fitted(x, window, degree, derivative):
    """Each place by a polynomial fitted to its window, the ends by that of the first or last window."""
    n, half, out = len(x), window // 2, []
    for i in range(n):
        start = min(max(i - half, 0), n - window)
        poly = np.polynomial.Polynomial.fit(np.arange(window), x[start : start + window], degree)
        out.append((poly.deriv(derivative) if derivative else poly)(i - start))
    return out


def test_smoothed_equals_fits(spark):
    r = np.random.default_rng(1)
    data = {f: r.normal(0, 1, (n, 2)).cumsum(axis=0) for f, n in (("long", 140), ("mid", 40), ("one", 25), ("short", 24))}
    df = spark.createDataFrame([(f, i, float(a), float(b)) for f, x in data.items() for i, (a, b) in enumerate(x)], "file string, frame int, a_x double, a_y double").repartition(5)
    for derivative in (0, 1):
        got = smoothed(df, {"a_x": "sx", "a_y": "sy"}, derivative=derivative)
        assert got.count() == 140 + 40 + 25 + 24
        for f, x in data.items():
            rows = got.filter(F.col("file") == f).orderBy("frame").collect()
            assert [q.frame for q in rows] == list(range(len(x)))
            if f == "short":
                assert all(q.sx is None and q.sy is None for q in rows)
            else:
                assert np.allclose([q.sx for q in rows], fitted(x[:, 0], 25, 3, derivative)) and np.allclose([q.sy for q in rows], fitted(x[:, 1], 25, 3, derivative))
    speed = [q.a_speed for q in joint_speeds(df, ["a"], 30.0).filter("file = 'long'").orderBy("frame").collect()]
    assert np.allclose(speed, 30 * np.hypot(fitted(data["long"][:, 0], 25, 3, 1), fitted(data["long"][:, 1], 25, 3, 1)))


def test_one_exchange(spark):
    df = spark.range(100).selectExpr("cast(id % 3 as string) file", "cast(id as int) frame", "cast(id as double) a_x", "cast(id * id as double) a_y")
    plan = joint_speeds(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the ends read the same one


def test_states_follow_speed(spark):
    speed = [0.0, 3.0, 9.0]
    rows = [("f", i, float(sum(speed[k // 60 % 3] for k in range(i))), 1.0 * i) for i in range(360)] + [("g", i, None, 1.0) for i in range(40)] + [("s", i, 1.0, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "file string, frame int, a_x double, a_y double")
    got = {(r.file, r.frame): r.state for r in velocity_ethogram(df, ["a"], states=3).collect()}
    assert len(got) == len(rows) and {s for (f, _), s in got.items() if f != "f"} == {None}
    inner = [(i, got["f", i]) for i in range(360) if 15 < i % 60 < 45]
    assert all(s == i // 60 % 3 + 1 for i, s in inner)
