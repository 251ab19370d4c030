"""Writing results: tables by track, restart and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str, by: tuple[str, ...] = (), csv: bool = False) -> None:
    """Each table under path/name as Parquet (or CSV with a header). With by, only the written partitions are replaced."""
    for name, df in tables.items():
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out = out.partitionBy(*by) if by else out
        (out.option("header", True).csv if csv else out.parquet)(f"{path}/{name}")


def not_done(files: DataFrame, spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """files without those that the table at path has already; all of them if there is no table."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.parquet(path).select(F.col(key).cast("string").alias(key)).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return files
    return files.join(done, key, "left_anti")


def split_failures(df: DataFrame, checks: dict[str, Column], keys: tuple[str, ...] = ("file",)) -> tuple[DataFrame, DataFrame]:
    """(rows of tracks that pass all checks, keys and error of those that fail). A check is an aggregate over a track; null fails."""
    tested = df.groupBy(*keys).agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    error = F.concat_ws("; ", *[F.when(~F.col(n), F.lit(n)) for n in checks])
    failed = tested.select(*keys, error.alias("error")).filter("error <> ''")
    return df.join(failed, list(keys), "left_anti"), failed


def split_sets(df: DataFrame, share: float = 0.2, seed: int = 123, keys: tuple[str, ...] = ("file", "frame")) -> tuple[DataFrame, DataFrame]:
    """(training, validation) rows, by a seeded hash of the keys: the same however rows are partitioned."""
    held = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.filter(~held), df.filter(held)
