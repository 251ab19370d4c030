from pyspark.sql import functions as F

from pawprint.operators.reshape import points_wide
from pawprint.sources import dlc_csv, metadata
from pawprint.streaming import tracks


def test_dlc_round_trip(spark, tmp_path):
    text = ["s,column_1,column_2,column_3,column_4,column_5,column_6", "bodyparts,nose,nose,nose,tail,tail,tail", "coords,x,y,likelihood,x,y,likelihood", "0,1.5,2,0.9,3,4,1", "1,,2.5,0.8,NA,5,1"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/M001_a.csv").write_text("\n".join(text))
    got = dlc_csv.read_dlc(spark, str(tmp_path / "in"))
    assert sorted((r.file, r.point, r.frame, r.x, r.y, r.likelihood) for r in got.fillna(-1).collect()) == [("M001_a", "nose", 0, 1.5, 2, 0.9), ("M001_a", "nose", 1, -1, 2.5, 0.8), ("M001_a", "tail", 0, 3, 4, 1), ("M001_a", "tail", 1, -1, 5, 1)]
    dlc_csv.write_dlc(points_wide(got, ["nose", "tail"]), ["nose", "tail"], str(tmp_path / "out"))
    lines = next((tmp_path / "out/file=M001_a").glob("part-*.txt")).read_text().splitlines()
    assert lines[1:3] == [text[1], text[2]] and lines[3] == "0,1.5,2.0,1.0,3.0,4.0,1.0" and lines[4].startswith("1,,2.5")


def test_metadata(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("Code ID\nM001  x1\nM002\tx2\n")
    assert [tuple(r) for r in metadata.read_codes(spark, str(tmp_path / "codes.txt")).orderBy("Code").collect()] == [("M001", "x1"), ("M002", "x2")]
    (tmp_path / "zones.csv").write_text("arena;open\ntl;a\ntr; \nbr;b\n")
    assert sorted(tuple(r) for r in metadata.read_zone_map(spark, str(tmp_path / "zones.csv")).select("zone", "point").collect()) == [("arena", "br"), ("arena", "tl"), ("arena", "tr"), ("open", "a"), ("open", "b")]
    r = spark.range(1).select(metadata.file_stem(F.lit("/d/M001_x.csv")).alias("s")).withColumn("c", metadata.code_of(F.col("s"))).first()
    assert tuple(r) == ("M001_x", "M001")
    cand = spark.createDataFrame([("M1", "M1_geom.csv", 1), ("M2", "none.csv", 1)], "file string, name string, priority int")
    files = spark.createDataFrame([("/g/M1_geom.csv",), ("/g/zz_M2.csv",), ("/g/aM1.csv",)], "path string")
    assert sorted(map(tuple, metadata.best_geometry(cand, files).collect())) == [("M1", "/g/M1_geom.csv"), ("M2", "/g/zz_M2.csv")]


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{i:02d}", i, float(i), 0.0, i % 5 != 4) for i in range(20)]
    df = spark.createDataFrame(rows, "file string, t string, frame int, x double, y double, on boolean").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("tumbling", tracks.tumbling(stream, 10), "complete"), ("bouts", tracks.bouts(stream, "on", "2 seconds"), "complete"), ("steps", tracks.steps(stream), "update")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.frames for r in spark.table("tumbling").collect()) == [10, 10]
    assert spark.table("steps").first().distance == 19
    assert spark.table("bouts").agg(F.sum("frames")).first()[0] == 16


def test_tracks_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    """A task's rows are bounded by the number of partitions, which adaptive execution doesn't merge again."""
    from pawprint.sources import adapters

    monkeypatch.setattr(adapters, "PART_ROWS", 50)
    for make in (adapters.pose_from_events, adapters.points_from_events, adapters.dyads_from_events):
        rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
        assert make(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-rows // 50) > 4
