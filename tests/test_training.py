"""Prepared sets, classification and clusters of windows against numpy."""

import numpy as np
import pytest
from pyspark.ml import Transformer
from pyspark.sql import functions as F

from pawprint.operators.labels import windowed_features
from pawprint.operators.training import classified, label_clusters, prepared, products, singular_rows


def tracks(spark, lengths=(14, 9, 5, 2), seed=0):
    r = np.random.default_rng(seed)
    rows = [(f"t{t}", i, float(x), float(y), 3.0, "abc"[int(r.integers(0, 3))]) for t, n in enumerate(lengths) for i, (x, y) in enumerate(r.normal(0, 1, (n, 2)))]
    return spark.createDataFrame(rows, "file string, frame int, x double, y double, same double, label string").repartition(3)


def test_prepared_set(spark):
    w = windowed_features(tracks(spark), ["x", "y"], 2)
    got = prepared(w).collect()
    assert len(got) == 10 + 5 + 1
    assert all(r.level == "abc".index(r.label) and r.one_hot == [int(c == r.label) for c in "abc"] and len(r.features) == 10 for r in got)
    assert [(r.file, r.frame) for r in got] == [(r.file, r.frame) for r in prepared(w.repartition(5)).collect()] != sorted((r.file, r.frame) for r in got)
    unseen = {r.label: (r.level, r.one_hot) for r in prepared(w.withColumn("label", F.when(F.col("label") != "a", F.col("label"))), levels=["c", "x"]).collect()}
    assert unseen == {"b": (None, [0, 0]), "c": (0, [1, 0]), None: (None, [0, 0])}
    assert prepared(w.limit(0)).count() == 0


class Stub(Transformer):
    """The class by the sign of the window's first number; no number of a class for large ones."""

    def _transform(self, df):
        from pyspark.ml.functions import vector_to_array

        first = vector_to_array("features")[0]
        return df.withColumn("prediction", F.when(first > 1, 7.0).when(first > 0, 1.0).otherwise(0.0))


def test_classified_is_as_long_as_the_track(spark):
    df = tracks(spark)
    got = {(r.file, r.frame): r.classification for r in classified(df, ["x", "y"], 2, Stub(), ["low", "high"]).collect()}
    at = {(r.file, r.frame): r.x for r in df.collect()}
    n = {"t0": 14, "t1": 9, "t2": 5, "t3": 2}
    assert len(got) == len(at)
    for (f, i), label in got.items():
        x = at.get((f, i - 2)) if 2 <= i < n[f] - 2 else None
        assert label == (None if x is None or x > 1 else "high" if x > 0 else "low")


@pytest.mark.parametrize("z_score", [True, False])
def test_left_singular_vectors_equal_numpy(spark, z_score):
    w = windowed_features(tracks(spark, (40, 25)), ["x", "same", "y"], 1).select("file", "frame", "features")
    rows = w.orderBy("file", "frame").collect()
    x = np.array([r.features for r in rows])
    n, sums, square = products(w)
    assert n == len(x) and np.allclose(sums, x.sum(axis=0)) and np.allclose(square, x.T @ x)
    if z_score:
        sd = x.std(axis=0, ddof=1)
        x = np.divide(x - x.mean(axis=0), sd, out=np.zeros_like(x), where=sd > 1e-9)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    left, values = singular_rows(w, 4, z_score)
    got = np.array([r.left for r in left.orderBy("file", "frame").collect()])
    assert np.allclose(values, s[:4]) and np.allclose(got * np.sign((got * u[:, :4]).sum(axis=0)), u[:, :4], atol=1e-8)
    assert len(singular_rows(w, 50, z_score)[1]) == np.linalg.matrix_rank(x)
    plain = np.array([r.left for r in singular_rows(w, None, z_score)[0].orderBy("file", "frame").collect()])
    assert np.allclose(plain, x)


def test_clusters_of_labels(spark):
    """Two kinds of stretches fall into two clusters, over tracks; the ends have none."""
    rows = [(f"t{t}", i, 10.0 * ((i // 20 + t) % 2) + 0.01 * ((i * 7) % 5), float(t)) for t in range(3) for i in range(80)]
    df = spark.createDataFrame([*rows, ("short", 0, 1.0, 1.0)], "file string, frame int, x double, y double")
    got = {(r.file, r.frame): r.unsupervised for r in label_clusters(df, ["x"], 1, clusters=2, dimensions=2).collect()}
    assert len(got) == len(rows) + 1 and got["short", 0] is None
    for t in range(3):
        assert got[f"t{t}", 0] is None and got[f"t{t}", 79] is None
        kinds = {(i // 20 + t) % 2: set() for i in range(40)}
        for i in range(1, 79):
            if i % 20 not in (0, 19):
                kinds[(i // 20 + t) % 2].add(got[f"t{t}", i])
        assert all(len(k) == 1 for k in kinds.values()) and kinds[0] != kinds[1] and set.union(*kinds.values()) == {"1", "2"}
    assert {r.unsupervised for r in label_clusters(df.filter("file = 'short'"), ["x"], 1, clusters=2).collect()} == {None}
