"""Sets of windows for models of behaviour: preparation, classification, clusters of labels.

Windows are those of labels.windowed_features() at every frame of a track that has enough neighbours; the frames at a
track's ends have none, and get a null label in what models return, so that labels are as long as the track.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pawprint.operators.labels import windowed_features

#: Rows that are multiplied at a time.
BLOCK_ROWS = 4096


def label_levels(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: levels, the sorted distinct labels, a few names."""
    return df.agg(F.sort_array(F.collect_set(label)).alias("levels"))


def prepared(windows: DataFrame, label: str = "label", levels: list[str] | None = None, seed: int | None = 123, id_cols: tuple[str, ...] = ("file", "frame")) -> DataFrame:
    """The windows of all tracks stacked, with level (place of the label among the sorted ones, from 0) and one_hot (array<int>).

    With a seed, rows are in a shuffled order that depends on their identifiers alone: one sort by their hash. A label
    that is not among given levels has a null level and no 1; so has a null label.
    """
    one = F.lit(None).cast("array<string>") if levels is None else F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<string>")
    rows = windows.crossJoin(F.broadcast(label_levels(windows, label))) if levels is None else windows.withColumn("levels", one)  # one row
    place = F.nullif(F.array_position("levels", F.col(label)).cast("int"), F.lit(0)) - 1
    out = rows.withColumn("level", place).withColumn("one_hot", F.transform("levels", lambda x, i: F.coalesce((i == F.col("level")).cast("int"), F.lit(0)))).drop("levels")
    return out if seed is None else out.orderBy(F.xxhash64(F.lit(seed), *id_cols), *id_cols)


def _with_ends(df: DataFrame, found: DataFrame, k: int, name: str, keys: list[str]) -> DataFrame:
    """found (keys, frame, name) and a null for each of the k frames at a track's ends. No join: both read one exchange of df."""
    w = Window.partitionBy(*keys)
    ends = df.select(*keys, "frame", F.row_number().over(w.orderBy("frame")).alias("__i"), F.count(F.lit(1)).over(w).alias("__n"))
    ends = ends.filter((F.col("__i") <= k) | (F.col("__i") > F.col("__n") - k))
    kind = dict(found.dtypes)[name]
    return found.select(*keys, "frame", name).unionByName(ends.select(*keys, "frame", F.lit(None).cast(kind).alias(name)))


def classified(df: DataFrame, cols: list[str], k: int, model: Model, levels: list[str], keys: list[str] | None = None, prediction: str = "prediction") -> DataFrame:
    """keys, frame, classification: the label that a fitted model gives each window; null for the k frames at a track's ends.

    model is any transformer that reads features (a vector) and writes a class number as prediction; levels are its
    classes' labels in order. A number without a label, and one that the model leaves out, is null.
    """
    keys = keys or ["file"]
    windows = windowed_features(df, cols, k, keys).select(*keys, "frame", array_to_vector("features").alias("features"))
    names = F.array(*[F.lit(x) for x in levels]).cast("array<string>")
    label = F.get(names, F.col(prediction).cast("int"))
    return _with_ends(df, model.transform(windows).select(*keys, "frame", label.alias("classification")), k, "classification", keys)


def products(df: DataFrame, col: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, their sums and the products of all pairs of an array column's places: blocks are multiplied in tasks and added up in two steps, so that the driver gets one matrix of the array's size."""

    def added(batches):
        total = None
        for b in batches:
            for row in b.column(0).to_pylist():
                part = np.frombuffer(row)
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], ["part"])

    def multiplied(batches):
        total = None
        for b in batches:
            lists = b.column(0)
            if not len(lists):
                continue
            x = np.asarray(lists.flatten(), float).reshape(len(lists), -1)
            x = np.column_stack([np.ones(len(x)), x])
            for i in range(0, len(x), BLOCK_ROWS):
                part = x[i : i + BLOCK_ROWS].T @ x[i : i + BLOCK_ROWS]
                total = part if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], ["part"])

    parts = df.select(col).mapInArrow(multiplied, "part binary")
    parts = parts.repartition(16).mapInArrow(added, "part binary").coalesce(1).mapInArrow(added, "part binary").first()
    if parts is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    g = np.frombuffer(parts[0])
    g = g.reshape(int(np.sqrt(len(g))), -1)
    return int(g[0, 0]), g[0, 1:].copy(), g[1:, 1:].copy()


def standardised(n: int, sums: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations (n - 1) and the products of standardised columns. A column of no variance has deviation 0 and products 0."""
    means = sums / n
    centred = square - n * np.outer(means, means)
    var = np.diag(centred) / max(n - 1, 1)
    deviations = np.sqrt(np.where(var > 1e-12 * np.maximum(np.diag(square) / n, 1e-300), var, 0.0))
    scale = np.divide(1.0, deviations, out=np.zeros_like(deviations), where=deviations > 0)
    return means, deviations, centred * np.outer(scale, scale)


def left_vectors(square: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors divided by their singular values (a matrix that gives left ones from rows), and the values, largest first. Fewer than dimensions where the rank is less. The largest entry of each right vector is positive."""
    values, vectors = np.linalg.eigh(square)
    order = np.argsort(values)[::-1][:dimensions]
    order = order[values[order] > 1e-10 * max(values.max(), 0.0)]
    values, vectors = np.sqrt(values[order]), vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return vectors / values, values


def singular_rows(windows: DataFrame, dimensions: int | None, z_score: bool = True, col: str = "features") -> tuple[DataFrame, np.ndarray]:
    """windows with left (array<double>): each row's entries of the left singular vectors of all rows, standardised first with z_score; and the singular values. Without dimensions, left is the (standardised) row itself.

    Columns of no variance are 0 when standardised. Rows of all tracks are one matrix.
    """
    n, sums, square = products(windows, col)
    means, deviations = np.zeros(len(sums)), np.ones(len(sums))
    if z_score and n:
        means, deviations, square = standardised(n, sums, square)
    turn, values = (None, np.zeros(0)) if dimensions is None or not n else left_vectors(square, dimensions)
    scale = np.divide(1.0, deviations, out=np.zeros_like(deviations), where=deviations > 0)

    def run(batches):
        for b in batches:
            lists = b.column(b.schema.names.index(col))
            x = (np.asarray(lists.flatten(), float).reshape(len(b), -1) - means) * scale if len(b) else np.zeros((0, 1))
            x = x if turn is None else x @ turn
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], [*b.schema.names, "left"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)
    return windows.mapInArrow(run, f"{kinds}, left array<double>"), values


def label_clusters(df: DataFrame, cols: list[str], k: int, clusters: int = 20, z_score: bool = True, dimensions: int | None = None, seed: int = 123, keys: list[str] | None = None) -> DataFrame:
    """keys, frame, unsupervised: the k-means cluster ("1" to clusters) of each frame's window among the windows of all tracks, null at a track's ends.

    Windows are standardised with z_score, and with dimensions turned into as many left singular vectors. Clusters are
    numbered by their centres' first coordinate.
    """
    keys = keys or ["file"]
    windows = windowed_features(df, cols, k, keys).select(*keys, "frame", "features")
    rows, _ = singular_rows(windows, dimensions, z_score)
    rows = rows.select(*keys, "frame", array_to_vector("left").alias("x")).persist()
    try:
        if rows.isEmpty():
            return _with_ends(df, rows.select(*keys, "frame", F.lit("").alias("unsupervised")), k, "unsupervised", keys)
        model = KMeans(k=clusters, seed=seed, featuresCol="x", predictionCol="c", maxIter=50).fit(rows)
    finally:
        rows.unpersist()
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    names = F.array(*[F.lit(str(order.index(i) + 1)) for i in range(len(order))])
    return _with_ends(df, model.transform(rows).select(*keys, "frame", F.get(names, F.col("c")).alias("unsupervised")), k, "unsupervised", keys)
