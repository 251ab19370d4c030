"""A suite of analyses over many files: one written frame table, failures apart, and what is done already left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pawprint.sources.sinks import not_done, split_failures


def basic_checks() -> dict[str, Column]:
    """What any analysis of a track needs."""
    return {"no frames with a position": F.count("x") > 0}


def bucketed(df: DataFrame, table: str, buckets: int, keys: tuple[str, ...] = ("file",), order: str = "frame") -> DataFrame:
    """df as a table of the warehouse, bucketed by its keys and sorted by frame: windows and aggregates by file read it without an exchange."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, order).saveAsTable(table)
    return df.sparkSession.table(table)


def run_suite(spark: SparkSession, frames: DataFrame, analyses: dict[str, Callable[[DataFrame], DataFrame]], path: str, table: str, prepare: Callable[[DataFrame], DataFrame] = lambda t: t, checks: dict[str, Column] | None = None, buckets: int | None = None) -> dict[str, DataFrame]:
    """The analyses' tables, by name, and failures: read from path, where each is appended to what is there.

    Files that failures or all of the analyses have already are left out, so that a suite goes on where it ended. Files
    that fail a check (an aggregate over their frames) go to failures with what they failed, and the others are not
    touched by it. prepare makes the frame table (zones, speeds, flags), which is written once, bucketed by file; each
    analysis takes that table and returns rows with a column file. What an analysis has of a file that an earlier run
    left unfinished is not written again.
    """
    todo = not_done(frames, spark, f"{path}/failures")
    started = {name: not_done(todo.select("file").distinct(), spark, f"{path}/{name}").select("file") for name in analyses}
    left = None
    for files in started.values():
        left = files if left is None else left.unionByName(files)
    todo = todo.join(left.distinct(), "file", "left_semi") if left is not None else todo.limit(0)
    good, failed = split_failures(todo, basic_checks() if checks is None else checks)
    t = bucketed(prepare(good), table, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    for name, analysis in analyses.items():
        out = not_done(analysis(t), spark, f"{path}/{name}")
        out.write.mode("append").parquet(f"{path}/{name}")
    failed.write.mode("append").parquet(f"{path}/failures")  # last: it tells that a run has ended
    return {name: spark.read.parquet(f"{path}/{name}") for name in (*analyses, "failures")}
