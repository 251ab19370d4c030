"""CSV tracks with three header rows, as a Spark data source: format("dlc_csv").

Row 2 names the body part of each column, row 3 the coordinate; the first column is the frame. The rows become the
long frame schema. One partition reads one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

from pawprint.schema import FRAMES


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DlcCsvReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = files.get_file_info(base)
        found = files.get_file_info(fs.FileSelector(base, recursive=True)) if info.type == fs.FileType.Directory else [info]
        head = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        return [_File(head + i.path) for i in sorted(found, key=lambda i: i.path) if i.path.endswith(".csv")]

    def read(self, partition):
        import csv
        import io

        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        stem = name.rsplit("/", 1)[-1].removesuffix(".csv")
        number = lambda s: float(s) if s.strip() not in ("", "NA", "NaN", "nan") else None
        with files.open_input_stream(name, compression=None) as f:
            rows = csv.reader(io.TextIOWrapper(f, encoding="utf-8"))
            next(rows, None)
            parts, coords = next(rows, []), next(rows, [])
            at: dict[str, dict[str, int]] = {}
            for i, (p, c) in enumerate(zip(parts, coords, strict=False)):
                if i:
                    at.setdefault(p, {})[c] = i
            for row in rows:
                if row:
                    for p, c in at.items():
                        yield (stem, p, int(float(row[0])), *(number(row[c[k]]) if k in c and c[k] < len(row) else None for k in ("x", "y", "likelihood")))


class DlcCsv(DataSource):
    @classmethod
    def name(cls):
        return "dlc_csv"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return DlcCsvReader(self.options["path"])


def read_dlc(spark: SparkSession, path: str) -> DataFrame:
    """The long frame table of a file or a folder of files."""
    spark.dataSource.register(DlcCsv)
    return spark.read.format("dlc_csv").load(path)


def write_dlc(wide: DataFrame, points: list[str], path: str) -> None:
    """Rows of <point>_x and <point>_y as lines of the three-header format, a folder for each track, likelihood 1.

    Spark writes the lines; the three header lines are rows of their own, sorted before the frames.
    """
    cols = [c for p in points for c in (F.col(f"{p}_x").cast("string"), F.col(f"{p}_y").cast("string"), F.lit("1.0"))]
    line = F.concat_ws(",", F.col("frame").cast("string"), *[F.coalesce(c, F.lit("")) for c in cols])
    heads = [
        ",".join(["", *[f"column_{i + 1}" for i in range(3 * len(points))]]),
        ",".join(["bodyparts", *[p for p in points for _ in range(3)]]),
        ",".join(["coords", *["x", "y", "likelihood"] * len(points)]),
    ]
    head = wide.select("file").distinct().select("file", F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("i", "value")).select("file", (F.col("i") - 3).alias("frame"), "value")
    rows = wide.select("file", F.col("frame").cast("int").alias("frame"), line.alias("value")).unionByName(head)
    rows.repartition("file").sortWithinPartitions("file", "frame").select("file", "value").write.partitionBy("file").mode("overwrite").text(path)


def read_sleap(spark: SparkSession, path: str, points: list[str], layout: str = "T") -> DataFrame:
    """Long frames (animal 0 ... in the point's name) of SLEAP HDF5 files; needs h5py on the executors.

    layout T: the stored array is reversed (frames, nodes, coordinates, animals); frames_first: it is in this order.
    """
    import pandas as pd

    def run(batches):
        import io

        import h5py  # absent in many environments

        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                with h5py.File(io.BytesIO(content)) as f:
                    t = f["tracks"][:]
                t = t.T if layout == "T" else t
                if t.ndim != 4 or t.shape[1] < len(points) or t.shape[2] < 2:
                    raise ValueError(f"{name}: unexpected shape {t.shape}")
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for a in range(t.shape[3]):
                    for i, p in enumerate(points):
                        yield pd.DataFrame({"file": stem, "point": p if t.shape[3] == 1 else f"{p}_{a + 1}", "frame": range(t.shape[0]), "x": t[:, i, 0, a], "y": t[:, i, 1, a], "likelihood": 1.0})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.h5").load(path).select("path", "content")
    return raw.mapInPandas(run, FRAMES).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
