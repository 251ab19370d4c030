"""Novel object, social preference, plus maze, swim and head angle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawprint.functions.geometry import angle_clockwise, distance
from pawprint.functions.windows import centred_mean, majority, track, visited
from pawprint.operators.movement import transitions


def contact(d: Column, body: Column, near: float, body_least: float = 1.0) -> Column:
    return (d <= near) & (body > body_least)


def proximity(d: Column, near: float, far: float) -> Column:
    return (d > near) & (d <= far)


def object_contact(d: Column, body: Column, angle: Column, near: float, inside: Column | None = None, least_deg: float = 70.0, body_least: float = 1.0) -> Column:
    """The nose within near of the object, or inside its outline where one is given, the body off it, and the object not behind the head.

    angle: at the nose between the object and the body, in degrees; unknown angles make an unknown contact.
    """
    return (d <= near if inside is None else inside) & (body > body_least) & (F.round(angle, 9) >= least_deg)


def proximity_ahead(d: Column, angle: Column, near: float, far: float, least_deg: float = 90.0) -> Column:
    return proximity(d, near, far) & (F.round(angle, 9) >= least_deg)


def latency(flag: Column, fps: float, first: int = 0) -> Column:
    """An aggregate: seconds to the first frame of the flag, null if there is none. first: the number of a track's first frame."""
    return (F.min(F.when(flag, F.col("frame"))) + first) / F.lit(float(fps))


def flag_time(flag: Column, session_s: float) -> Column:
    """An aggregate: the share of true rows (null flags left out) of the session, in s."""
    return F.avg(flag.cast("int")) * session_s


def side_of_novel(loc: Column, left: Column, right: Column, novel_right_is_left: bool = True) -> Column:
    """What is booked as novel; null without a known location. The default books the left side where the location is R."""
    r, other = (left, right) if novel_right_is_left else (right, left)
    return F.when(loc == "R", r).when(loc == "L", other)


def visits(df: DataFrame, flag: Column, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    return df.withColumn("__v", visited(flag, track(*keys))).groupBy(*keys).agg(F.count_if("__v").alias("visits"))


def rearings(df: DataFrame, a: Column, b: Column, near: float = 1.0, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Frames where both distances fall to near at once."""
    w = track(*keys)
    rise = lambda d: visited(d <= near, w)
    return df.withColumn("__r", rise(a) & rise(b)).groupBy(*keys).agg(F.count_if("__r").alias("rearings"))


def nosedips(df: DataFrame, head_in: Column, body_in: Column, neck_closed: Column, k: int, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Head outside, body inside the arena, neck not in a closed arm, smoothed; half of the transitions, which smooth once more."""
    dips = df.withColumn("__d", majority(~head_in & body_in & ~neck_closed, k, track(*keys)))
    return transitions(dips, F.col("__d"), k, list(keys)).select(*keys, (F.col("transitions") / F.lit(2)).alias("nosedips"))


def floating(df: DataFrame, accelerations: list[Column], cutoff: float, k: int, fps: float, speed: Column, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """time_floating_s, percent_floating, swim_distance, swim_speed: floating where the smoothed mean acceleration is under cutoff."""
    known = sum((F.when(a.isNotNull(), 1).otherwise(0) for a in accelerations), F.lit(0))
    mean = F.abs(F.try_divide(sum((F.coalesce(a, F.lit(0.0)) for a in accelerations), F.lit(0.0)), known))
    out = df.withColumn("__m", mean).withColumn("__f", centred_mean(F.col("__m"), k, track(*keys)) < cutoff).withColumn("__v", speed)
    swim = F.when(~F.col("__f"), F.col("__v"))
    n = F.count_if("__f")
    return out.groupBy(*keys).agg((n / F.lit(fps)).alias("time_floating_s"), (n / F.count(F.lit(1)) * 100).alias("percent_floating"), F.coalesce(F.sum(swim), F.lit(0.0)).alias("swim_distance"), (F.avg(swim) * fps).alias("swim_speed"))


def head_angles(df: DataFrame, points: list[str], cutoff_rad: float, k: int, fps: float, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Mean clockwise angle of p1 - p2 to p3 - p4 and the times tilted either way, smoothed."""
    p = [(F.col(f"{n}_x"), F.col(f"{n}_y")) for n in points]
    angle = angle_clockwise(p[0][0] - p[1][0], p[0][1] - p[1][1], p[2][0] - p[3][0], p[2][1] - p[3][1])
    w = track(*keys)
    out = df.withColumn("__a", angle)
    out = out.withColumn("__cw", majority(F.col("__a") > cutoff_rad, k, w)).withColumn("__ccw", majority(F.col("__a") < -cutoff_rad, k, w))
    return out.groupBy(*keys).agg(F.avg("__a").alias("mean_angle"), (F.count_if("__cw") / F.lit(fps)).alias("time_cw_s"), (F.count_if("__ccw") / F.lit(fps)).alias("time_ccw_s"))


def skeleton_features(wide: DataFrame, distances: dict[str, tuple[str, str]], angles: dict[str, tuple[str, str, str, str]], areas: dict[str, tuple[str, ...]]) -> DataFrame:
    """file, frame and named features of wide points: distances, total angles of two vectors, polygon areas."""
    from pawprint.functions.geometry import angle_total, area

    at = lambda p: (F.col(f"{p}_x"), F.col(f"{p}_y"))
    vec = lambda a, b: (at(a)[0] - at(b)[0], at(a)[1] - at(b)[1])
    out = [distance(*at(a), *at(b)).alias(n) for n, (a, b) in distances.items()]
    out += [angle_total(*vec(a, b), *vec(c, d)).alias(n) for n, (a, b, c, d) in angles.items()]
    out += [area(*[at(p) for p in ps]).alias(n) for n, ps in areas.items()]
    return wide.select("file", "frame", *out)


def epm_report(moved: DataFrame, center: Column, arms: dict[str, Column], fps: float, integration: int, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """zone_report() of a plus maze's seven zones. arms: closed_left, closed_right, open_top, open_bottom."""
    from pawprint.operators.movement import zone_report

    zones = {"center": center, "open": arms["open_top"] | arms["open_bottom"], "closed": arms["closed_left"] | arms["closed_right"], **arms}
    return zone_report(moved, zones, fps, integration, list(keys))


def debounced_contacts(df: DataFrame, flag: Column, around: int = 10, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """keys, contacts: changes of the flag at frames with at least around true frames among around before and after; none at a track's ends, where the count isn't complete.

    Changes count in turn: to true at odd frames, to false at even ones (from the first).
    """
    w = track(*keys)
    on = F.coalesce(flag, F.lit(False))
    near, whole = F.count_if(on).over(w.rowsBetween(-around, around)), F.count(F.lit(1)).over(w.rowsBetween(-around, around))
    step = on.cast("int") - F.coalesce(F.lag(on.cast("int")).over(w), F.lit(0))
    wanted = F.when(F.row_number().over(w) % 2 == 1, 1).otherwise(-1)
    hit = (step == wanted) & (near >= around) & (whole == 2 * around + 1)
    return df.withColumn("__h", hit).groupBy(*keys).agg(F.count_if("__h").alias("contacts"))
