"""Group statistics against plain numpy fits of the rows."""

import itertools
import math

import numpy as np
import pytest

from pawprint.functions.models import Fit, group_statistics, holm
from pawprint.functions.stats import incomplete_beta


def integral(a, b, x, n=400_000):
    """The incomplete beta function by midpoints in a variable that keeps the ends smooth."""
    edge = lambda y: math.asin(math.sqrt(y))
    t = (np.arange(n) + 0.5) / n
    f = lambda t: np.sin(t) ** (2 * a - 1) * np.cos(t) ** (2 * b - 1)
    return (f(t * edge(x)).sum() * edge(x)) / (f(t * math.pi / 2).sum() * math.pi / 2)


@pytest.mark.parametrize("a, b, x", [(0.5, 0.5, 0.3), (5, 0.5, 0.9), (5000, 0.5, 0.9998), (0.5, 7, 0.02), (3, 4, 0.5), (1.5, 60, 0.01), (60, 1.5, 0.999)])
def test_incomplete_beta(a, b, x):
    assert abs(incomplete_beta(a, b, x) - integral(a, b, x)) < 2e-6 and abs(incomplete_beta(a, b, x) + incomplete_beta(b, a, 1 - x) - 1) < 1e-12


def data(seed=1, n=90, ids=None):
    r = np.random.default_rng(seed)
    group = r.integers(0, 3, n)
    sex, age = r.integers(0, 2, n), r.normal(1e4, 3, n)
    who = r.integers(0, ids, n) if ids else np.arange(n)
    y = 1e5 + group * 1.5 + sex * 0.7 + age * 0.2 + r.normal(0, 1, n) + (r.normal(0, 2, ids)[who] if ids else 0)
    return group, sex, age, who, y


def frame(spark, group, sex, age, who, y, extra=()):
    rows = [("ABC"[g], "fm"[s], float(a), f"id{w}", float(v), float(v * 2 + i % 5)) for i, (g, s, a, w, v) in enumerate(zip(group, sex, age, who, y, strict=True))]
    return spark.createDataFrame([*rows, *extra], "grp string, sex string, age double, who string, y double, z double")


def design(group, sex, age):
    return np.column_stack([np.ones(len(group)), group == 1, group == 2, sex == 1, age - age.mean()]).astype(float)


def test_covariates_equal_least_squares(spark):
    group, sex, age, who, y = data()
    odd = [("A", "f", None, "q", 5.0, 1.0), (None, "f", 1.0, "q", 5.0, 1.0), ("B", "f", 1.0, "q", None, None)]
    got = group_statistics(frame(spark, group, sex, age, who, y, odd), ["y", "z"], "grp", ("sex", "age")).collect()
    for metric, v in (("y", y), ("z", y * 2 + np.arange(len(y)) % 5)):
        rows = {r.contrast: r for r in got if r.metric == metric}
        x = design(group, sex, age)
        fit = lambda x: float(((v - x @ np.linalg.lstsq(x, v, rcond=None)[0]) ** 2).sum())  # noqa: B023, E731
        beta, rest = np.linalg.lstsq(x, v, rcond=None)[0], len(v) - 5
        s2 = fit(x) / rest
        assert math.isclose(rows[None].statistic, (fit(x[:, :1]) - fit(x[:, :3])) / 2 / s2, rel_tol=1e-7)
        cov = np.linalg.inv(x.T @ x) * s2
        ps = []
        for a, b in itertools.combinations(range(3), 2):
            line = np.zeros(5)
            line[a], line[b] = line[a] + (a > 0), line[b] - (b > 0)
            row = rows["ABC"[a] + " - " + "ABC"[b]]
            assert math.isclose(row.estimate, line @ beta, rel_tol=1e-7) and math.isclose(row.se, math.sqrt(line @ cov @ line), rel_tol=1e-7) and row.df == rest
            ps.append(integral(rest / 2, 0.5, rest / (rest + row.statistic**2)))
        assert np.allclose([rows[c].p_raw for c in ("A - B", "A - C", "B - C")], holm(ps), atol=2e-6)
        assert {r.n_used for r in rows.values()} == {91} and {r.model for r in rows.values()} == {"lm"}
    pairs = [r for r in got if r.term == "grp pairwise"]
    assert np.allclose([r.p_holm_global for r in pairs], holm([r.p_raw for r in pairs]))


def restricted(ratio, x, y, who):
    """The restricted criterion with the covariance of all rows written out."""
    v = np.eye(len(y)) + ratio * (who[:, None] == who[None, :])
    inv = np.linalg.inv(v)
    a = x.T @ inv @ x
    beta = np.linalg.solve(a, x.T @ inv @ y)
    rss = (y - x @ beta) @ inv @ (y - x @ beta)
    rest = len(y) - x.shape[1]
    return rest * np.log(rss / rest) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, np.linalg.inv(a) * rss / rest


def test_random_intercept_equals_full_likelihood(spark):
    group, sex, age, who, y = data(4, 60, 10)
    y = y - 1e5
    x = design(group, sex, age)
    low, high = -6.0, 6.0
    for _ in range(5):  # finer grids
        grid = np.linspace(low, high, 13)
        k = int(np.argmin([restricted(np.exp(t), x, y, who)[0] for t in grid]))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, 12)]
    best = np.exp(grid[k])
    _, beta, cov = restricted(best, x, y, who)
    rows = {r.contrast: r for r in group_statistics(frame(spark, group, sex, age, who, y), ["y"], "grp", ("sex", "age"), "who").collect()}
    for name, line in (("A - B", [0, -1, 0, 0, 0]), ("A - C", [0, 0, -1, 0, 0]), ("B - C", [0, 1, -1, 0, 0])):
        assert math.isclose(rows[name].estimate, np.dot(line, beta), rel_tol=1e-3) and math.isclose(rows[name].se, math.sqrt(line @ cov @ line), rel_tol=1e-3)
        assert 30 < rows[name].df < 56
    part = np.array([1, 2])
    f = beta[part] @ np.linalg.solve(cov[np.ix_(part, part)], beta[part]) / 2
    assert math.isclose(rows[None].statistic, f, rel_tol=1e-3) and rows[None].model == "lmer" and rows[None].p_raw < 1e-4


def test_between_identities_has_few_degrees_of_freedom(spark):
    """Balanced, each identity in one group: the test is that of the identities' means, with as many degrees of freedom."""
    r = np.random.default_rng(0)
    who = np.repeat(np.arange(12), 5)
    group, y = who % 3, r.normal(0, 3, 12)[who] + r.normal(0, 1, 60)
    rows = {x.contrast: x for x in group_statistics(frame(spark, group, group * 0, y * 0 + 1, who, y), ["y"], "grp", (), "who").collect()}
    means = np.array([y[who == i].mean() for i in range(12)])
    centre = np.array([means[np.arange(12) % 3 == g].mean() for g in range(3)])
    within = ((means - centre[np.arange(12) % 3]) ** 2).sum() / 9
    assert math.isclose(rows[None].statistic, 4 * ((centre - centre.mean()) ** 2).sum() / 2 / within, rel_tol=1e-5)
    assert all(abs(rows[c].df - 9) < 0.01 for c in rows if c) and math.isclose(rows["A - B"].se, math.sqrt(within / 2), rel_tol=1e-5)
    assert abs(rows[None].p_raw - integral(4.5, 1.0, 9 / (9 + 2 * rows[None].statistic))) < 1e-4


def test_no_variance_of_intercepts_is_least_squares():
    x = np.column_stack([np.ones(8), np.tile([0, 1], 4), [1.0, 2, 0, 3, 3, 0, 2, 1]])
    gram = x.T @ x
    sums = np.array([x[i : i + 2].sum(axis=0) for i in range(0, 8, 2)])
    fit = Fit(gram, 8, [(2, 4, sums.T @ sums)])
    assert fit.ratio == 0.0 and fit.contrast(np.array([0, 1.0]))[2] == 6.0 and np.allclose(fit.beta, np.linalg.lstsq(x[:, :2], x[:, 2], rcond=None)[0])


def test_notes_and_absent_levels(spark):
    group, sex, age, who, y = data(2, 20)
    df = frame(spark, group * 0, sex, age, who, y)
    got = group_statistics(df, ["y"], "grp").collect()
    assert [(r.metric, r.note, r.n_used, r.p_holm_global) for r in got] == [("y", "Insufficient data or fewer than two groups.", 20, None)]
    assert [r.note for r in group_statistics(df.limit(0), ["y"], "grp", levels={"grp": ["A"]}).collect()] == ["Insufficient data or fewer than two groups."]
    two = group_statistics(frame(spark, np.where(group == 0, 1, group), sex, age, who, y), ["y"], "grp", ("sex",), levels={"grp": ["A", "B", "C"], "sex": ["f", "m", "x"]}).collect()
    assert {r.contrast for r in two} == {None, "B - C"}
    twin = frame(spark, group, sex, age, who, y).selectExpr("*", "age * 0 + 1 as again", "age * 3 + 1 as old")
    assert all(r.note is None and r.statistic is not None for r in group_statistics(twin, ["y"], "grp", ("age", "old", "again")).collect())
