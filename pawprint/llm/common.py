"""Shared helpers: the shared scratch folder, written tables and Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join under this many bytes may be broadcast; the callers compute the bound first.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a new local one, with a local master only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pawprint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/pawprint-{name}-{uuid.uuid4().hex[:12]}"


_TEMPORARY: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors. Inside temporary() it goes at the end unless keep is set."""
    path = scratch(df.sparkSession, name)
    if _TEMPORARY and not keep:
        _TEMPORARY[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession):
    """Deletes at its end the tables that were written inside; what goes out of it has to be written with keep."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _TEMPORARY.pop()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark free the shuffles, broadcasts and plans of finished steps: its cleaner waits for the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


_WORKER: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps between tasks for one operator. Workers are used again for others: what those kept goes first."""
    if owner not in _WORKER:
        _WORKER.clear()
        _WORKER[owner] = {}
    return _WORKER[owner]


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows: documents are long, and Spark's own bound is for short rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def without(docs: DataFrame, gone: DataFrame, keys: list[Column], row_bytes: int) -> DataFrame:
    """docs without the rows whose keys (expressions over docs) equal a row of gone, a written table. Extra columns of docs may have any name."""
    taken, names = {c.lower() for c in docs.columns}, []
    for i in range(len(keys)):
        name = f"gone_{i}"
        while name in taken:
            name += "_"
        names.append(name)
    gone = gone.toDF(*names)
    same = reduce(lambda a, b: a & b, (key == gone[name] for key, name in zip(keys, names, strict=True)))
    return docs.join(bounded_broadcast(gone, gone.count(), row_bytes), same, "left_anti")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if rows * row_bytes is under BROADCAST_BYTES, else df as it is (a shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
