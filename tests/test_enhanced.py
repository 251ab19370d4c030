"""Small cases of wide rows, joins with suffixes, scores and contacts with an object."""

from pyspark.sql import functions as F

from pawprint.operators import reshape as rs
from pawprint.plans import assays, oft


def test_pivoted_fills_what_is_missing(spark):
    df = spark.createDataFrame([("f", "a", 2.0), ("g", "b", 3.0), ("h", "c", 4.0), ("h", None, 5.0)], "file string, k string, v double")
    got = rs.pivoted(df, ["file"], "k", {"a": "one", "b": "two"}, ["v"], empty=0)
    assert got.columns == ["file", "v_one", "v_two"]
    assert sorted(map(tuple, got.collect())) == [("f", 2.0, 0.0), ("g", 0.0, 3.0), ("h", 0.0, 0.0)]
    assert {tuple(r) for r in rs.pivoted(df, ["file"], "k", {"a": "one"}, ["v"]).collect()} == {("f", 2.0), ("g", None), ("h", None)}
    assert rs.pivoted(df.limit(0), ["file"], "k", {"a": "one"}, ["v"], empty=0).count() == 0


def test_suffixed_join_keeps_left_rows_and_names(spark):
    left = spark.createDataFrame([("f", 1, 2), ("g", 3, 4)], "file string, a int, b int")
    right = spark.createDataFrame([("f", 5, 6)], "file string, A int, c int")
    got = rs.suffixed_join(left, right, ["file"])
    assert got.columns == ["file", "a", "b", "A.enh", "c"]
    assert sorted(map(tuple, got.collect())) == [("f", 1, 2, 5, 6), ("g", 3, 4, None, None)]


def test_unknown_scores_are_flagged(spark):
    e = spark.createDataFrame([("f", 0.9, 1.0), ("g", 0.9, 1.0), ("h", 0.5, 1.0), ("i", 0.9, None)], "file string, valid_fraction double, entropy_norm double")
    s = spark.createDataFrame([("f", False), ("h", False), ("i", False)], "file string, qc_flag boolean")
    assert {r.file: r.enhanced_qc_flag for r in oft.scored(e, s, ["file"], 0.8).collect()} == {"f": False, "g": True, "h": True, "i": True}


def test_object_contact(spark):
    rows = [(0, 3.0, 2.0, 70.0, False), (1, 3.0, 2.0, 69.9, True), (2, 3.0, 1.0, 90.0, True), (3, 9.0, 2.0, 90.0, True), (4, 3.0, 2.0, None, True)]
    df = spark.createDataFrame(rows, "frame int, d double, b double, a double, inside boolean")
    c = [F.col(x) for x in ("d", "b", "a")]
    got = df.select("frame", assays.object_contact(*c, 4.0).alias("near"), assays.object_contact(*c, 4.0, F.col("inside")).alias("within")).orderBy("frame")
    assert [(r.near, r.within) for r in got.collect()] == [(True, False), (False, False), (False, False), (False, True), (None, None)]
    flags = df.withColumn("on", assays.object_contact(*c, 4.0, F.col("inside")))
    assert flags.agg(assays.latency(F.col("on"), 2.0)).first()[0] == 1.5
