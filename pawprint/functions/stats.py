"""Distribution functions (numpy, Arrow batches) and regressions (aggregates)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function: the power series of the side whose terms, all positive, fall sooner."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x * (a + b) > a:
        return 1.0 - incomplete_beta(b, a, 1 - x) if (1 - x) * (a + b) <= b else _beta_series(a, b, x)
    return _beta_series(a, b, x)


def _beta_series(a: float, b: float, x: float) -> float:
    term = total = math.exp(math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    k = 0
    while term > total * 1e-17:
        term *= x * (a + b + k) / (a + 1 + k)
        total += term
        k += 1
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided."""
    return pd.Series([incomplete_beta(d / 2, 0.5, d / (d + v * v)) if np.isfinite(v) and d > 0 else None for v, d in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail."""
    return pd.Series([incomplete_beta(b / 2, a / 2, b / (b + a * v)) if np.isfinite(v) and a > 0 and b > 0 else None for v, a, b in zip(f, d1, d2, strict=True)], dtype="float64")


def slopes(df: DataFrame, x: str, metrics: list[str], keys: list[str]) -> DataFrame:
    """keys, metric, slope_per_min, intercept, r_squared, p_value of metric ~ x (s). Null under three rows or distinct x."""
    long = df.select(*keys, F.col(x).cast("double").alias("__x"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([*keys, "__x"], metrics, "metric", "__y")
    long = long.filter(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    enough = (F.count(F.lit(1)) >= 3) & (F.count_distinct("__x") >= 3)
    fit = long.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, F.regr_slope("__y", "__x")).alias("slope"),
        F.when(enough, F.regr_intercept("__y", "__x")).alias("intercept"),
        F.when(enough, F.regr_r2("__y", "__x")).alias("r_squared"),
    )
    r2 = F.col("r_squared")
    t = F.sqrt(F.try_divide(r2 * (F.col("n") - 2), 1 - r2))
    p = F.when((r2 >= 1) & (F.col("slope") != 0), 0.0).otherwise(t_p_value(t, (F.col("n") - 2).cast("double")))  # a perfect fit
    return fit.select(*keys, "metric", (F.col("slope") * 60).alias("slope_per_min"), "intercept", "r_squared", p.alias("p_value"))


def one_way(df: DataFrame, group: str, metric: str) -> DataFrame:
    """One row: groups, n, f, p of a one-way analysis of variance; null under four rows or two groups."""
    cells = df.filter(F.col(metric).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("m"), F.var_pop(metric).alias("v"))
    total = F.sum("n")
    grand = F.sum(F.col("n") * F.col("m")) / total
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    k = F.count(F.lit(1))
    out = cells.agg(k.alias("groups"), total.alias("n"), between.alias("between"), within.alias("within"))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.when((F.col("n") >= 4) & (F.col("groups") >= 2), F.try_divide(F.try_divide("between", d1), F.try_divide("within", d2)))
    return out.withColumn("f", f).select("groups", "n", "f", f_p_value("f", d1.cast("double"), d2.cast("double")).alias("p"))


def with_holm(df: DataFrame, p: str, family: list[str], tie: list[str], name: str = "p_holm") -> DataFrame:
    """Adds Holm's step-down adjustment of p within a family; null p stay null."""
    order = Window.partitionBy(*family).orderBy(F.asc_nulls_last(p), *tie)
    out = df.withColumn("__i", F.row_number().over(order)).withColumn("__m", F.count(p).over(Window.partitionBy(*family)))
    out = out.withColumn("__s", F.least(F.lit(1.0), (F.col("__m") - F.col("__i") + 1) * F.col(p)))
    top = F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.when(F.col(p).isNotNull(), top)).drop("__i", "__m", "__s")
