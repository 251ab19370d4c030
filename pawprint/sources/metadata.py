"""Small metadata tables: codes, locations, zone maps, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_codes(spark: SparkSession, path: str, columns: tuple[str, str] = ("Code", "ID"), sep: str = r"\s+") -> DataFrame:
    """Two columns of a text file with a header, parted by a regular expression; an empty table if there is no such file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    # one small file: its lines come in order, the first one is the header
    lines = spark.read.text(path).coalesce(1).filter(F.trim("value") != "").withColumn("no", F.monotonically_increasing_id()).filter("no > 0")
    return lines.withColumn("p", F.split(F.trim("value"), sep)).select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_zone_map(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """zone, pos, point from a ragged table whose columns are zones and whose cells are points in vertex order; blanks are dropped."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("zone"), F.col(f"`{c}`").alias("point")) for c in df.columns])).alias("s")
    # a zone map is one small file: its rows come in order
    rows = df.coalesce(1).withColumn("pos", F.monotonically_increasing_id()).select("pos", cells).select("s.zone", "pos", F.trim("s.point").alias("point"))
    return rows.filter(F.col("point").isNotNull() & (F.col("point") != ""))


def first_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, order: str) -> DataFrame:
    """left with value of the first row (by order) of right that has its key; null without one."""
    rank = F.row_number().over(Window.partitionBy(right_key).orderBy(order))
    one = right.withColumn("__r", rank).filter("__r = 1").select(F.col(right_key).alias("__k"), value)
    return left.join(one, F.col(left_key) == F.col("__k"), "left").drop("__k")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.csv$", "")


def code_of(stem: Column) -> Column:
    """The first four letters or digits; empty if the name doesn't begin with them."""
    return F.regexp_extract(stem, r"^[A-Za-z0-9]{4}", 0)


def best_geometry(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """file, path: the first existing of a file's candidate names (file, name, priority) among files (path), else any path whose name holds the file's id."""
    named = files.withColumn("base", F.regexp_extract("path", r"([^/\\]+)$", 1))
    exact = candidates.join(named, F.col("name") == F.col("base")).select("file", "path", "priority")
    ids = candidates.select("file").distinct()
    part = ids.join(F.broadcast(named), F.col("base").contains(F.col("file"))).select("file", "path", F.lit(1_000_000).alias("priority"))  # a folder's listing
    w = Window.partitionBy("file").orderBy("priority", "path")
    return exact.unionByName(part).withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("file", "path")
