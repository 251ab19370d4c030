"""Ethogram of joint velocities: smoothed speeds of all joints, and k-means over frames."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pawprint.functions.filters import joint_speeds
from pawprint.operators.interpolate import interpolate


def velocity_ethogram(wide: DataFrame, points: list[str], states: int = 10, window: int = 25, degree: int = 3, seed: int = 1, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """keys, frame, <point>_speed, state (1 to states): clusters of frames by their joints' velocities, over all tracks.

    Missing places are interpolated first. States are numbered by the mean of their centres' speeds, slowest first;
    frames of tracks shorter than a window, and of joints that are never seen, have no speeds and no state.
    """
    cols = [f"{p}_{c}" for p in points for c in "xy"]
    filled = interpolate(wide.select(*keys, "frame", *cols), cols)
    speeds = [f"{p}_speed" for p in points]
    moved = joint_speeds(filled, points, 1.0, window, degree, keys).select(*keys, "frame", *speeds)
    whole = moved.dropna(subset=speeds).withColumn("__v", array_to_vector(F.array(*speeds))).persist()
    try:
        if whole.isEmpty():
            return moved.withColumn("state", F.lit(None).cast("int"))
        model = KMeans(k=states, seed=seed, featuresCol="__v", predictionCol="__c").fit(whole)
    finally:
        whole.unpersist()
    centres = [float(c.mean()) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=centres.__getitem__)
    names = F.array(*[F.lit(order.index(i) + 1) for i in range(len(centres))])
    found = model.transform(whole).withColumn("state", F.get(names, F.col("__c"))).drop("__v", "__c")
    absent = moved.filter(" or ".join(f"`{c}` is null" for c in speeds)).withColumn("state", F.lit(None).cast("int"))
    return found.unionByName(absent)
