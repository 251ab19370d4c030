"""Missing-value repair along a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate(df: DataFrame, cols: list[str], keys: list[str] | None = None, edges: str = "nearest", max_gap: int | None = None, order: str = "frame") -> DataFrame:
    """Fills nulls linearly on the row index. edges: nearest valid value, the track's median as the end value, or null.

    Inner gaps of more than max_gap rows stay null; edges don't count as gaps.
    """
    if edges not in ("nearest", "median", "null"):
        raise ValueError(f"edges is nearest, median or null, not {edges}")
    keys = keys or ["file"]
    w = Window.partitionBy(*keys).orderBy(order)
    before, after, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    out = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(whole))
    if edges == "median":
        for c in cols:
            ends = F.col("__i").isin(1) | (F.col("__i") == F.col("__n"))
            out = out.withColumn(f"__m_{c}", F.median(c).over(whole)).withColumn(c, F.when(F.col(c).isNull() & ends, F.col(f"__m_{c}")).otherwise(F.col(c))).drop(f"__m_{c}")
    at = {c: F.when(F.col(c).isNotNull(), F.col("__i")) for c in cols}
    # the next valid value is the last one in descending order: both ways take time in proportion to the track
    around = [(f"__{way}{kind}_{c}", F.last(F.col(c) if kind == "v" else at[c], True).over(over)) for way, over in (("p", before), ("n", after)) for kind in "vi" for c in cols]
    out = out.withColumns(dict(around))

    def filled(c: str) -> Column:
        pv, pi, nv, ni = (F.col(f"__{x}_{c}") for x in ("pv", "pi", "nv", "ni"))
        blend = pv + (nv - pv) * (F.col("__i") - pi) / (ni - pi)
        inner = pv.isNotNull() & nv.isNotNull()
        fits = F.lit(True) if max_gap is None else ni - pi - 1 <= max_gap
        end = F.lit(None).cast("double") if edges == "null" else F.coalesce(pv, nv)
        return F.when(F.col(c).isNotNull(), F.col(c)).when(inner & fits, blend).when(~inner, end)

    return out.withColumns({c: filled(c) for c in cols}).drop("__i", "__n", *[name for name, _ in around])
