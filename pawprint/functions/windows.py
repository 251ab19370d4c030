"""Ordered expressions within a track. keys are the columns that part tracks, frames order them."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("file",)


def track(*keys: str, order: str = "frame") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def first_difference(c: Column, w: WindowSpec) -> Column:
    """0 in the first row."""
    return F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(c - F.lag(c).over(w))


def centred_mean(c: Column, k: int, w: WindowSpec) -> Column:
    return F.avg(c).over(w.rowsBetween(-k, k))


def centred_sum(c: Column, k: int, w: WindowSpec) -> Column:
    return F.sum(c).over(w.rowsBetween(-k, k))


def majority(flag: Column, k: int, w: WindowSpec) -> Column:
    """More than half of the non-null flags around; a tie is false."""
    return F.avg(flag.cast("int")).over(w.rowsBetween(-k, k)) > 0.5


def changed(c: Column, w: WindowSpec) -> Column:
    return F.coalesce(c != F.lag(c).over(w), F.lit(False))


def entered(flag: Column, w: WindowSpec) -> Column:
    """True after false or null; the first row counts."""
    now = F.coalesce(flag, F.lit(False))
    return now & ~F.coalesce(F.lag(now).over(w), F.lit(False))


def visited(flag: Column, w: WindowSpec) -> Column:
    """A rising edge; the first row doesn't count."""
    now = F.coalesce(flag, F.lit(False))
    return now & ~F.coalesce(F.lag(now).over(w), now)


def forward_filled(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def rolling_correlation(a: Column, b: Column, n: int, w: WindowSpec) -> Column:
    """Pearson's, over the last n rows; null until there are as many, and where one side doesn't vary."""
    over = w.rowsBetween(-(n - 1), 0)
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    sd = F.stddev_pop(x).over(over) * F.stddev_pop(y).over(over)
    return F.when(F.count(F.when(ok, 1)).over(over) == n, F.try_divide(F.covar_pop(x, y).over(over), sd))


def share(n: Column, *keys: str) -> Column:
    """Of the sum over the keys' group."""
    return F.try_divide(n, F.sum(n).over(Window.partitionBy(*keys)))


def z_score(c: Column, *keys: str) -> Column:
    """Null where the standard deviation is 0 or null."""
    w = Window.partitionBy(*(F.col(k) for k in keys)) if keys else Window.partitionBy(F.lit(0))
    sd = F.stddev_samp(c).over(w)
    return F.when(sd > 0, (c - F.avg(c).over(w)) / sd)


def entropy_bits(n: Column) -> Column:
    """An aggregate: Shannon entropy of counts n of one group."""
    total = F.sum(n)
    return F.log2(total) - F.try_divide(F.sum(n * F.log2(n)), total)
