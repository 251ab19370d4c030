"""Quality control of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pawprint.operators.bouts import with_runs


def tracking_qc(df: DataFrame, fps: float, likelihood: float, jump: float, keys: list[str] | None = None) -> DataFrame:
    """frames, duration_s, missing/valid/low-likelihood fractions (null likelihood is low), impossible jumps, median likelihood."""
    keys = keys or ["file"]
    w = Window.partitionBy(*keys).orderBy("frame")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    missing = F.col("x").isNull() | F.col("y").isNull()
    low = F.coalesce(F.col("likelihood") < likelihood, F.lit(True))
    n = F.count(F.lit(1))
    return (
        df.withColumn("__step", step)
        .groupBy(*keys)
        .agg(
            n.alias("frames"),
            (n / F.lit(float(fps))).alias("duration_s"),
            (F.count_if(missing) / n).alias("missing_fraction"),
            (F.count_if(~missing) / n).alias("valid_fraction"),
            (F.count_if(low) / n).alias("low_likelihood_fraction"),
            F.count_if(F.col("__step") > jump).alias("impossible_jump_n"),
            F.try_divide(F.count_if(F.col("__step") > jump), F.count("__step")).alias("impossible_jump_fraction"),
            F.median("likelihood").alias("median_likelihood"),
        )
    )


def flagged(qc: DataFrame, missing: float = 0.20, low: float = 0.20) -> DataFrame:
    """Adds qc_flag; what is unknown counts as bad."""
    over = lambda c, t: F.coalesce(F.col(c) > t, F.lit(True))
    return qc.withColumn("qc_flag", over("missing_fraction", missing) | over("low_likelihood_fraction", low) | over("impossible_jump_n", 0))


def missing_runs(df: DataFrame, col: str, jump: float, missing: float = 0.20, keys: list[str] | None = None) -> DataFrame:
    """keys, n_missing, frac_missing, longest_missing_run, impossible_jump_n (along this coordinate), flag_high_missing."""
    keys = keys or ["file"]
    runs = with_runs(df, F.col(col).isNull(), keys)
    w = Window.partitionBy(*keys).orderBy("frame")
    jumped = runs.withColumn("__j", F.abs(F.col(col) - F.lag(col).over(w)) > jump)
    each = jumped.groupBy(*keys, "on", "run").agg(F.count(F.lit(1)).alias("n"), F.count_if("__j").alias("j"))
    gone = F.coalesce(F.sum(F.when(F.col("on"), F.col("n"))), F.lit(0))
    out = each.groupBy(*keys).agg(gone.alias("n_missing"), (gone / F.sum("n")).alias("frac_missing"), F.coalesce(F.max(F.when(F.col("on"), F.col("n"))), F.lit(0)).alias("longest_missing_run"), F.sum("j").alias("impossible_jump_n"))
    return out.withColumn("flag_high_missing", F.col("frac_missing") > missing)


def sensitivity(df: DataFrame, metrics: list[str], flag: str = "qc_flag") -> DataFrame:
    """metric, n, mean and sd over all rows and over those that pass, and the means' difference."""
    long = df.select(flag, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([flag], metrics, "metric", "value")
    ok = F.when(~F.col(flag), F.col("value"))
    return long.groupBy("metric").agg(
        F.count("value").alias("n_all"),
        F.count(ok).alias("n_qc_pass"),
        F.avg("value").alias("mean_all"),
        F.avg(ok).alias("mean_qc_pass"),
        (F.avg(ok) - F.avg("value")).alias("delta_qc_pass_minus_all"),
        F.stddev_samp("value").alias("sd_all"),
        F.stddev_samp(ok).alias("sd_qc_pass"),
    )


def geometry_qc(frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, point, coord, n_values, n_valid, missing_fraction, median_value of static points over all frames and instances."""
    keys = keys or ["file"]
    pairs = F.array(*[F.struct(F.lit(c).alias("coord"), F.col(c).alias("value")) for c in ("x", "y")])
    long = frames.select(*keys, "point", F.explode(pairs).alias("s")).select(*keys, "point", "s.*")
    return long.groupBy(*keys, "point", "coord").agg(F.count(F.lit(1)).alias("n_values"), F.count("value").alias("n_valid"), (1 - F.count("value") / F.count(F.lit(1))).alias("missing_fraction"), F.median("value").alias("median_value"))


def body_size(wide: DataFrame, area: Column, length: Column, keys: list[str] | None = None) -> DataFrame:
    """keys, median_area, median_length: of a body's polygon and of its ends' distance; nulls are left out."""
    return wide.groupBy(*(keys or ["file"])).agg(F.median(area).alias("median_area"), F.median(length).alias("median_length"))
