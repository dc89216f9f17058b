"""Hole traces from survey stations (depth, azimuth, dip negative down, degrees).

Each step between two stations has a closed form; a trace is the running sum of the steps. The
first station's attitude holds from the collar, the last one's beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("minimum_curvature", "balanced_tangential", "radius_of_curvature", "tangential")


def _direction(az, dip):
    a, d = F.radians(az), F.radians(dip)
    return F.cos(d) * F.sin(a), F.cos(d) * F.cos(a), F.sin(d)


def traces(stations: DataFrame, collars: DataFrame, method: str = "minimum_curvature") -> DataFrame:
    """``hole, depth, x, y, z`` at each station; ``collars`` has ``hole, x, y, z``."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    order = Window.partitionBy("hole").orderBy("depth")
    s = stations.select("hole", "depth", "azimuth", "dip")
    s = s.withColumns({"d0": F.coalesce(F.lag("depth").over(order), F.lit(0.0)), "a0": F.coalesce(F.lag("azimuth").over(order), F.col("azimuth")), "i0": F.coalesce(F.lag("dip").over(order), F.col("dip"))})
    step = F.col("depth") - F.col("d0")
    x0, y0, z0 = _direction(F.col("a0"), F.col("i0"))
    x1, y1, z1 = _direction(F.col("azimuth"), F.col("dip"))
    if method == "tangential":
        parts = [step * v for v in (x1, y1, z1)]
    elif method == "balanced_tangential":
        parts = [step / 2 * (p + q) for p, q in ((x0, x1), (y0, y1), (z0, z1))]
    elif method == "minimum_curvature":
        bend = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x0 * x1 + y0 * y1 + z0 * z1)))
        ratio = F.when(bend < 1e-9, 1.0).otherwise(2 / F.nullif(bend, F.lit(0.0)) * F.tan(bend / 2))
        parts = [step / 2 * (p + q) * ratio for p, q in ((x0, x1), (y0, y1), (z0, z1))]
    else:
        turn = F.radians(F.pmod(F.col("azimuth") - F.col("a0") + 180, F.lit(360.0)) - 180)
        tilt = F.radians(F.col("dip") - F.col("i0"))
        a0, i0, i1 = F.radians("a0"), F.radians("i0"), F.radians("dip")
        flat = F.when(F.abs(tilt) < 1e-9, F.cos(i0)).otherwise((F.sin(i1) - F.sin(i0)) / F.nullif(tilt, F.lit(0.0)))
        drop = F.when(F.abs(tilt) < 1e-9, F.sin(i0)).otherwise((F.cos(i0) - F.cos(i1)) / F.nullif(tilt, F.lit(0.0)))
        east = F.when(F.abs(turn) < 1e-9, F.sin(a0)).otherwise((F.cos(a0) - F.cos(a0 + turn)) / F.nullif(turn, F.lit(0.0)))
        north = F.when(F.abs(turn) < 1e-9, F.cos(a0)).otherwise((F.sin(a0 + turn) - F.sin(a0)) / F.nullif(turn, F.lit(0.0)))
        parts = [step * flat * east, step * flat * north, step * drop]
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    moved = s.select("hole", "depth", *(p.alias(n) for p, n in zip(parts, ("dx", "dy", "dz"))))
    moved = moved.select("hole", "depth", *(F.sum(f"d{c}").over(run).alias(f"s{c}") for c in "xyz"))
    return moved.join(collars.select("hole", "x", "y", "z"), "hole").select("hole", "depth", *((F.col(c) + F.col(f"s{c}")).alias(c) for c in "xyz"))


def attitude_at(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Points (hole, depth) with azimuth (the shorter way round) and dip between their stations."""
    order = Window.partitionBy("hole").orderBy("depth")
    ends = stations.select("hole", F.col("depth").alias("d0"), F.col("azimuth").alias("a0"), F.col("dip").alias("i0"), F.lead("depth").over(order).alias("d1"), F.lead("azimuth").over(order).alias("a1"), F.lead("dip").over(order).alias("i1"), (F.row_number().over(order) == 1).alias("head"))
    held = points.join(ends, "hole").where(((F.col("d0") <= F.col("depth")) & (F.col("d1").isNull() | (F.col("depth") < F.col("d1")))) | (F.col("head") & (F.col("depth") < F.col("d0"))))
    share = F.when(F.col("d1").isNull() | (F.col("depth") < F.col("d0")), 0.0).otherwise((F.col("depth") - F.col("d0")) / F.nullif(F.col("d1") - F.col("d0"), F.lit(0.0)))
    turn = F.pmod(F.coalesce("a1", "a0") - F.col("a0") + 180, F.lit(360.0)) - 180
    a = F.col("a0") + share * turn
    # not pmod: what lies a hair below 0 is 360 as in the SQL, pmod makes it 0
    return held.select("hole", "depth", (a - 360 * F.floor(a / 360)).alias("azimuth"), (F.col("i0") + share * (F.coalesce("i1", "i0") - F.col("i0"))).alias("dip"))


def point_on_trace(points: DataFrame, trace: DataFrame) -> DataFrame:
    """Points (hole, depth) with x, y, z, linear between trace vertices and clamped to its ends."""
    order = Window.partitionBy("hole").orderBy("depth")
    legs = trace.select("hole", F.col("depth").alias("d0"), *(F.col(c).alias(f"{c}0") for c in "xyz"), F.lead("depth").over(order).alias("d1"), *(F.lead(c).over(order).alias(f"{c}1") for c in "xyz"), (F.row_number().over(order) == 1).alias("head"))
    held = points.join(legs, "hole").where(((F.col("d0") <= F.col("depth")) & (F.col("d1").isNull() | (F.col("depth") < F.col("d1")))) | (F.col("head") & (F.col("depth") < F.col("d0"))))
    share = F.when(F.col("d1").isNull() | (F.col("depth") < F.col("d0")), 0.0).otherwise((F.col("depth") - F.col("d0")) / F.nullif(F.col("d1") - F.col("d0"), F.lit(0.0)))
    return held.select("hole", "depth", *((F.col(f"{c}0") + share * (F.coalesce(f"{c}1", f"{c}0") - F.col(f"{c}0"))).alias(c) for c in "xyz"))
