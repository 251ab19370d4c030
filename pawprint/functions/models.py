"""Group comparisons of many metrics at once: linear models with covariates and a random intercept, contrasts, Holm.

The rows are only ever summed: an aggregate gives, for each metric, the products of all pairs of model columns, and
with a random intercept a second one gives the products of the identities' sums, for each number of rows that an
identity has. What is solved then, one metric at a time, has the size of the model, whatever the number of rows.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawprint.functions.stats import incomplete_beta, with_holm

RESULT = "metric string, model string, term string, contrast string, estimate double, se double, df double, statistic double, p_raw double, p_holm double, n_used bigint, note string"
NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


def factor_levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """The sorted values of each column: a few names, read in one job."""
    found = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cols]).first() if cols else {}
    return {c: list(found[c]) for c in cols}


def group_statistics(df: DataFrame, metrics: list[str], group: str, covariates: tuple[str, ...] = (), id_col: str | None = None, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """metric, model, term, contrast, estimate, se, df, statistic, p_raw, p_holm, n_used, note, p_holm_global.

    For each metric the model metric ~ group + covariates (+ (1|id) with id_col) has a row with the F of the group and
    a row for each pair of groups, whose p are adjusted by Holm's method within the metric; p_holm_global adjusts all
    of a term. Covariates that are no numbers are factors. Without id_col the F is that of the models of the mean
    alone and with groups, over the residual mean square of the whole model; with it, the fit is by restricted maximum
    likelihood, the F is Wald's, and degrees of freedom are Satterthwaite's (where the intercepts don't vary: those of
    the residuals). Rows without the metric or group are left out; n_used counts the others, of which the model leaves
    out those without a covariate or identity. A metric with under four rows or two groups has a row with a note.
    levels: the values of the group and factors in order, where they are known; else they are read first.
    """
    kinds = dict(df.dtypes)
    factors = [group, *(c for c in covariates if kinds[c] not in NUMBERS)]
    numbers = [c for c in covariates if c not in factors]
    levels = levels or factor_levels(df, factors)
    names, columns = ["(one)"], [F.lit(1.0)]
    for c in factors:
        for level in levels[c][1:]:
            names.append((c, level))
            columns.append(F.when(F.col(c) == level, 1.0).otherwise(0.0))
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in factors], *[F.col(c).cast("double").alias(c) for c in numbers], *([F.col(id_col).alias("__id")] if id_col else []), *[F.col(m).cast("double").alias(m) for m in metrics])
    keep = [c for c in rows.columns if c not in metrics]
    long = rows.unpivot(keep, metrics, "__metric", "__y").filter(F.col("__y").isNotNull() & F.col(group).isNotNull())
    known = [F.col(c).isNotNull() for c in (*covariates, *(["__id"] if id_col else []))]
    long = long.withColumn("__whole", reduce(lambda a, b: a & b, known, F.lit(True)))
    # about the means, since products of large numbers lose digits
    means = long.filter("__whole").groupBy(F.col("__metric").alias("__of")).agg(F.avg("__y").alias("__my"), *[F.avg(c).alias(f"__m_{c}") for c in numbers])
    long = long.join(F.broadcast(means), F.col("__metric") == F.col("__of"), "left")  # a row for each metric
    for c in numbers:
        names.append((c, None))
        columns.append(F.col(c) - F.col(f"__m_{c}"))
    parts = {f"__x{i}": c for i, c in enumerate([*columns, F.col("__y") - F.col("__my")])}
    long = long.select("__metric", group, "__whole", *(["__id"] if id_col else []), *[c.alias(n) for n, c in parts.items()])
    pairs = list(itertools.combinations_with_replacement(parts, 2))
    products = lambda rows, *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__k"), *[F.sum(F.col(a) * F.col(b)).alias(f"__p{i}") for i, (a, b) in enumerate(pairs)])
    packed = F.array(*[f"__p{i}" for i in range(len(pairs))])
    whole = products(long.filter("__whole"), "__metric").select(F.col("__metric").alias("__of"), F.col("__k").alias("n"), packed.alias("products"))
    used = long.groupBy("__metric").agg(F.count(F.lit(1)).alias("n_used"), F.count_distinct(group).alias("groups"))
    table = used.join(whole, F.col("__metric") == F.col("__of"), "left").select(F.col("__metric").alias("metric"), "n_used", "groups", "n", "products")
    if id_col:
        sums = long.filter("__whole").groupBy("__metric", "__id").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(p).alias(p) for p in parts])
        sizes = products(sums, "__metric", "__n").groupBy(F.col("__metric").alias("__of")).agg(F.collect_list(F.struct(F.col("__n").alias("size"), F.col("__k").alias("ids"), packed.alias("products"))).alias("sizes"))
        table = table.join(sizes, F.col("metric") == F.col("__of"), "left").drop("__of")  # as many entries as identities have different numbers of rows
    else:
        table = table.withColumn("sizes", F.lit(None).cast("array<struct<size:bigint,ids:bigint,products:array<double>>>"))
    missing = df.sparkSession.createDataFrame([(m,) for m in metrics], "metric string").join(table, "metric", "left")

    def run(batches):
        for b in batches:
            yield pd.DataFrame([row for r in b.to_dict("records") for row in _solved(r, names, group, levels[group], bool(id_col))], columns=[x.split()[0] for x in RESULT.split(", ")])

    return with_holm(missing.mapInPandas(run, RESULT), "p_raw", ["term"], ["metric", "contrast"], "p_holm_global")


def _square(products, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = products
    return out + np.triu(out, 1).T


def _solved(row, names, group, group_levels, random: bool) -> list[tuple]:
    """Result rows of one metric."""
    model, n_used = "lmer" if random else "lm", int(row["n_used"] or 0) if row["n_used"] == row["n_used"] else 0
    note = lambda text: [(row["metric"], None, None, None, *[None] * 6, n_used, text)]
    if n_used < 4 or row["groups"] < 2:
        return note("Insufficient data or fewer than two groups.")
    if row["products"] is None:
        return note("Model failed.")
    gram = _square(row["products"], len(names) + 1)
    there = [i for i in range(len(names)) if gram[i, i] > 0]  # levels without rows have no column
    there = _independent(gram, there)
    at = {names[i]: k for k, i in enumerate(there)}
    rows = [*there, len(names)]
    fit = Fit(gram[np.ix_(rows, rows)], int(row["n"]), [(int(s["size"]), int(s["ids"]), _square(s["products"], len(names) + 1)[np.ix_(rows, rows)]) for s in row["sizes"]] if random else None)
    if fit.rest <= 0:
        return note("Model failed.")
    place = {n[1]: i for i, n in enumerate(names) if n != "(one)" and n[0] == group and n[1] is not None}
    rows_of = {level: gram[place[level], place[level]] if level in place else gram[0, 0] - sum(gram[i, i] for i in place.values()) for level in group_levels}
    present = [level for level in group_levels if rows_of[level] > 0]
    term = [at[group, level] for level in group_levels[1:] if (group, level) in at]
    f, d1, d2 = fit.wald(term) if random else fit.sequential(term)
    out = [(row["metric"], model, group, None, None, None, None, f, f_tail(f, d1, d2), None, n_used, None)]
    found = []
    for a, b in itertools.combinations(present, 2):
        line = np.zeros(len(there))
        for level, sign in ((a, 1.0), (b, -1.0)):
            if (group, level) in at:
                line[at[group, level]] = sign
        estimate, se, df = fit.contrast(line)
        t = estimate / se if se > 0 else None
        found.append((f"{a} - {b}", estimate, se, df, t, t_tails(t, df)))
    for (name, estimate, se, df, t, _), p in zip(found, holm([x[-1] for x in found]), strict=True):
        out.append((row["metric"], model, f"{group} pairwise", name, estimate, se, df, t, p, p, n_used, None))
    return out


def _independent(gram: np.ndarray, columns: list[int]) -> list[int]:
    """Columns in order, without those that the earlier ones add up to."""
    kept: list[int] = []
    for i in columns:
        rest = gram[i, i]
        if kept:
            rest = rest - gram[i, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, i])
        if rest > 1e-10 * gram[i, i]:
            kept.append(i)
    return kept


class Fit:
    """A linear model from the products of its columns and response (last); sizes: (rows, identities, products of their sums)."""

    def __init__(self, gram: np.ndarray, n: int, sizes: list[tuple[int, int, np.ndarray]] | None = None):
        self.gram, self.n, self.p, self.sizes = gram, n, len(gram) - 1, sizes
        self.rest, self.ratio = n - self.p, 0.0
        if self.rest > 0:
            if sizes is not None:
                self.ratio = self._search()
            self.beta, self.inverse, rss, _ = self._at(self.ratio)
            self.variance = max(rss, 0.0) / self.rest
            self.cov = self.inverse * self.variance
            self.spread = self._spread() if self.ratio > 0 else None

    def _at(self, ratio: float):
        """Coefficients, inverse, weighted residual sum, log determinants at a ratio of variances (intercepts to residuals)."""
        g, log = self.gram, 0.0
        if self.sizes and ratio > 0:
            g = g - sum(ratio / (1 + ratio * size) * products for size, _, products in self.sizes)
            log = sum(ids * np.log1p(ratio * size) for size, ids, _ in self.sizes)
        a, b = g[:-1, :-1], g[:-1, -1]
        inverse = np.linalg.inv(a)
        beta = inverse @ b
        return beta, inverse, g[-1, -1] - b @ beta, log + np.linalg.slogdet(a)[1]

    def _criterion(self, ratio: float) -> float:
        """Minus twice the restricted log likelihood, the residual variance at its best."""
        _, _, rss, log = self._at(ratio)
        return self.rest * np.log(max(rss, 1e-300) / self.rest) + log

    def _search(self) -> float:
        """The ratio of least criterion: a grid of logarithms, then golden sections about its best; 0 if nothing is better."""
        grid = np.linspace(-14, 14, 113)
        values = [self._criterion(np.exp(t)) for t in grid]
        k = int(np.argmin(values))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        golden = (np.sqrt(5) - 1) / 2
        for _ in range(80):
            a, b = high - golden * (high - low), low + golden * (high - low)
            if self._criterion(np.exp(a)) <= self._criterion(np.exp(b)):
                high = b
            else:
                low = a
        best = float(np.exp((low + high) / 2))
        return best if best > 1e-6 and self._criterion(best) < self._criterion(0.0) - 1e-9 else 0.0

    def _deviance(self, v: np.ndarray) -> float:
        """Minus twice the restricted log likelihood at the variances of intercepts and residuals."""
        _, _, rss, log = self._at(v[0] / v[1])
        return self.rest * np.log(v[1]) + log + rss / v[1]

    def _spread(self) -> np.ndarray:
        """Covariance of the two variances' estimates, from the curvature of the likelihood."""
        v = np.array([self.ratio * self.variance, self.variance])
        h = v * 1e-3
        e = np.diag(h)
        d = self._deviance
        hess = np.array([[(d(v + e[i] + e[j]) - d(v + e[i] - e[j]) - d(v - e[i] + e[j]) + d(v - e[i] - e[j])) / (4 * h[i] * h[j]) for j in (0, 1)] for i in (0, 1)])
        return 2 * np.linalg.pinv(hess)

    def _freedom(self, line: np.ndarray) -> float:
        """Satterthwaite's degrees of freedom of a combination of coefficients."""
        if self.spread is None:
            return float(self.rest)
        v = np.array([self.ratio * self.variance, self.variance])
        size = lambda v: line @ self._at(v[0] / v[1])[1] @ line * v[1]
        slope = np.array([(size(v + e) - size(v - e)) / (2 * e.sum()) for e in np.diag(v * 1e-4)])
        under = slope @ self.spread @ slope
        return float(2 * (line @ self.cov @ line) ** 2 / under) if under > 0 else float(self.rest)

    def contrast(self, line: np.ndarray) -> tuple[float, float, float]:
        return float(line @ self.beta), float(np.sqrt(line @ self.cov @ line)), self._freedom(line)

    def sequential(self, term: list[int]) -> tuple[float | None, int, float]:
        """F of a term after the mean, before all others."""
        rss = lambda kept: self.gram[-1, -1] - self.gram[-1, kept] @ np.linalg.solve(self.gram[np.ix_(kept, kept)], self.gram[kept, -1])
        between = rss([0]) - rss([0, *term])
        return (between / len(term) / self.variance if self.variance > 0 and term else None), len(term), float(self.rest)

    def wald(self, term: list[int]) -> tuple[float | None, int, float]:
        q = len(term)
        values, vectors = np.linalg.eigh(self.cov[np.ix_(term, term)])
        lines = np.zeros((q, self.p))
        lines[:, term] = vectors.T
        if not q or values.min() <= 0:
            return None, q, float(self.rest)
        f = float(((lines @ self.beta) ** 2 / values).sum() / q)
        each = np.array([self._freedom(x) for x in lines])
        if self.spread is None or q == 1:
            return f, q, float(each[0])
        total = (each[each > 2] / (each[each > 2] - 2)).sum()
        return f, q, float(2 * total / (total - q)) if total > q else 0.0


def f_tail(f, d1, d2):
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f is not None and d1 > 0 and d2 > 0 else None


def t_tails(t, df):
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if t is not None and df > 0 else None


def holm(p: list[float | None]) -> list[float | None]:
    order = sorted((i for i, x in enumerate(p) if x is not None), key=lambda i: p[i])
    out, most = list(p), 0.0
    for rank, i in enumerate(order):
        out[i] = most = max(most, min(1.0, (len(order) - rank) * p[i]))
    return out
