"""Canonical tracks from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 2.0
#: The open field, corner by corner.
ARENA = [(0.0, 0.0), (49.0, 0.0), (49.0, 49.0), (0.0, 49.0)]
#: Rows of a partition of whole tracks, on average: windows and long rows multiply them within a task.
PART_ROWS = 100_000


def by_track(df: DataFrame, table: DataFrame) -> DataFrame:
    """df dealt by file, into partitions of at most PART_ROWS rows of the table on average. It stands for the exchange of the windows that follow, which would be coalesced by the bytes of narrow rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-table.count() // PART_ROWS)), "file")


def pose_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track per user. Errors are dropped detections."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    bad = F.col("event_type") == "error"
    e = by_track(e.withColumn("file", F.col("user_id").cast("string")), e)
    frame = F.row_number().over(Window.partitionBy("file").orderBy("ts", "event_id")) - 1  # by file, like all that follows
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        "file",
        "user_id",
        frame.alias("frame"),
        F.when(~bad, F.col("value") / 10).alias("x"),
        F.when(~bad, k * 0.49).alias("y"),
        F.when(bad, 0.5).otherwise(1.0).alias("likelihood"),
        F.col("event_type").alias("label"),
        "event_id",
        (F.col("user_id") % 3).alias("batch"),
        (F.col("user_id") % 2).alias("grp"),
    )


def pose_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long track per supplier, for volume."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    li = by_track(li.withColumn("file", F.col("l_suppkey").cast("string")), li)
    frame = F.row_number().over(Window.partitionBy("file").orderBy("l_shipdate", "l_orderkey", "l_linenumber")) - 1
    bad = F.col("l_returnflag") == "A"
    return li.select("file", frame.alias("frame"), F.when(~bad, F.col("l_quantity") * 0.98).alias("x"), F.when(~bad, F.col("l_discount") * 490).alias("y"), F.when(bad, 0.5).otherwise(1.0).alias("likelihood"), F.col("l_linestatus").alias("label"))


def points_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide: bodycentre, nose and tailbase of each frame."""
    f = pose_from_events(spark, sf_dir)
    i = F.col("event_id")
    return f.select("file", "user_id", "frame", F.col("x").alias("body_x"), F.col("y").alias("body_y"), (F.col("x") + (i % 5) - 2).alias("nose_x"), (F.col("y") + (i % 7) - 3).alias("nose_y"), (F.col("x") - (i % 3)).alias("tail_x"), (F.col("y") - (i % 4)).alias("tail_y"))


def dyads_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users 2k and 2k + 1 at the same frame, wide: body1_x ... tail2_y."""
    p = points_from_events(spark, sf_dir)
    cols = ["body_x", "body_y", "nose_x", "nose_y", "tail_x", "tail_y"]
    one = p.filter("user_id % 2 = 0").select(F.floor(F.col("user_id") / 2).alias("pair"), "frame", *[F.col(c).alias(c.replace("_", "1_")) for c in cols])
    two = p.filter("user_id % 2 = 1").select(F.floor(F.col("user_id") / 2).alias("pair"), "frame", *[F.col(c).alias(c.replace("_", "2_")) for c in cols])
    pairs = one.join(two, ["pair", "frame"]).withColumn("file", F.col("pair").cast("string")).drop("pair")
    return by_track(pairs, spark.read.parquet(f"{sf_dir}/events.parquet"))
