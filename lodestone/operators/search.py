"""Searches in a turned ellipsoid: caps by octant, hole and number, support classes, estimates.

Coordinates are turned into the ellipsoid's own, each axis in units of its range, where the search is a ball of
radius one and goes through a grid join like any other, in rounds of growing radius: samples that lie farther than all
others change none of those already taken. Caps are row numbers with an upper bound, which
Spark prunes before the shuffle, so a target takes along no more than its caps allow per task. A hole's or
octant's cap goes before the overall one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.spatial import nearest
from lodestone.staging import dealt

#: Closer than this share of the ranges a sample is the block's value.
ON_SPOT = 1e-6


def ellipsoid_axes(azimuth: float, dip: float) -> list[tuple[float, float, float]]:
    """Unit vectors (east, north, up): down the dip, along the strike, across both."""
    a, d = math.radians(azimuth), math.radians(dip)
    major = (math.sin(a) * math.cos(d), math.cos(a) * math.cos(d), -math.sin(d))
    strike = (math.cos(a), -math.sin(a), 0.0)
    across = tuple(major[(i + 1) % 3] * strike[(i + 2) % 3] - major[(i + 2) % 3] * strike[(i + 1) % 3] for i in range(3))
    return [major, strike, across]


def turned(df: DataFrame, azimuth: float, dip: float, ranges: tuple[float, float, float]) -> DataFrame:
    """``df`` with ``__u, __v, __w``: place in the ellipsoid's axes, in units of its ranges."""
    place = lambda axis, reach: (F.col("x") * axis[0] + F.col("y") * axis[1] + F.col("z") * axis[2]) / reach
    return df.withColumns({c: place(a, r) for c, a, r in zip(("__u", "__v", "__w"), ellipsoid_axes(azimuth, dip), ranges)})


def hole_cap(most: int, least_holes: int = 1, most_per_hole: int = 0) -> int | None:
    """How many samples of one hole count: an equal share of ``most`` where several holes are asked for."""
    caps = [max(1, math.ceil(most / least_holes))] if least_holes > 1 else []
    return min([*caps, most_per_hole] if most_per_hole > 0 else caps, default=None)


def neighbours(
    targets: DataFrame,
    samples: DataFrame,
    target_key: str,
    sample_key: str,
    value: str,
    azimuth: float,
    dip: float,
    ranges: tuple[float, float, float],
    most: int = 16,
    least_holes: int = 1,
    most_per_hole: int = 0,
    most_per_octant: int = 0,
    hole: str = "hole",
    domain: str | None = None,
) -> DataFrame:
    """The samples each target uses: ``target_key, rank, d2, octant, dx, dy, dz, hole, value, length``.

    Both have ``x, y, z``; samples also ``hole``, ``value`` and, if they have it, ``length``. Distances ``d2`` are squared, in units of
    the ranges; ties go by ``sample_key``. With ``domain`` only samples of the nearest one's domain are used,
    and none if it has no domain. Samples without a place or value take no part.
    """
    real = F.lit(True)
    for c in ("x", "y", "z", value):
        real = real & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    length = F.col("length").cast("double") if "length" in samples.columns else F.lit(None).cast("double")
    held = samples.where(real).select("x", "y", "z", F.col(sample_key).alias("key"), F.col(hole).cast("string").alias("hole"), F.col(value).cast("double").alias("value"), length.alias("length"), (F.col(domain) if domain else F.lit(0)).alias("domain"))
    axes = ("__u", "__v", "__w")
    d = {a: F.col(f"b.{a}") - F.col(f"a.{a}") for a in "xyz"}
    bit: Column = sum((F.when(c >= 0, 1 << i).otherwise(0) for i, c in enumerate(d.values())), F.lit(0))

    def capped(df: DataFrame, by: list[str], cap: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(target_key, *by).orderBy("d2", "key"))).where(F.col("rank") <= cap)

    def choose(pairs: DataFrame) -> DataFrame:
        near = pairs.select(F.col(f"a.{target_key}").alias(target_key), "d2", bit.cast("int").alias("octant"), *(c.alias(f"d{a}") for a, c in d.items()), *(F.col(f"b.{c}").alias(c) for c in ("key", "hole", "value", "length", "domain")))
        if domain:
            own = near.groupBy(target_key).agg(F.min_by("domain", F.struct("d2", "key")).alias("own"))
            near = near.join(dealt(own), target_key).where(F.col("domain") == F.col("own")).drop("own")
        if most_per_octant:
            near = capped(near, ["octant"], most_per_octant)
        if (cap := hole_cap(most, least_holes, most_per_hole)) is not None:
            near = capped(near, ["hole"], cap)
        return capped(near, [], most).select(target_key, "rank", "d2", "octant", "dx", "dy", "dz", "hole", "value", "length")

    found = turned(targets.select(target_key, "x", "y", "z"), azimuth, dip, ranges)
    return nearest(found, turned(held, azimuth, dip, ranges), target_key, 1.0, most, choose, axes)


def support(used: DataFrame, targets: DataFrame, target_key: str, least: int = 1, least_holes: int = 1, tolerance: float = 0.0, power: float = 2.0) -> DataFrame:
    """A row for each target: ``n, holes, octants, nearest, around_x, around_y, around_z, support, data_index, estimate``.

    ``used`` comes from ``neighbours``. A target is "unsupported" (no estimate) with fewer than ``least`` samples or
    ``least_holes`` holes; "interpolated" if samples of two holes or more lie on both sides of it on every axis, farther off
    than ``tolerance``; else "extrapolated". ``data_index`` is the cube root of (1 - nearest) * min(holes, 3) / 3 *
    min(octants, 6) / 6, where ``nearest`` is in units of the ranges. The estimate is the mean weighted by length over
    distance to ``power``; a sample on the spot is the estimate.
    """
    sides = [F.max(F.when(F.col(f"d{a}") < -tolerance, 1).otherwise(0)) + F.max(F.when(F.col(f"d{a}") > tolerance, 1).otherwise(0)) == 2 for a in "xyz"]
    bits = F.bit_count(F.bit_or(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), F.col("octant") + 1)))
    w = F.when(F.col("length") > 0, F.col("length")).otherwise(1.0) / F.pow(F.sqrt("d2"), F.lit(float(power)))
    off = F.sqrt("d2") >= ON_SPOT
    got = used.groupBy(target_key).agg(
        F.count("*").alias("n"),
        F.count_distinct("hole").alias("holes"),
        bits.cast("long").alias("octants"),
        F.sqrt(F.min("d2")).alias("nearest"),
        *(s.alias(f"around_{a}") for s, a in zip(sides, "xyz")),
        F.min_by("value", "rank").alias("__first"),
        (F.sum(F.when(off, w * F.col("value"))) / F.sum(F.when(off, w))).alias("__mean"),
    )
    enough = (F.col("n") >= least) & (F.col("holes") >= least_holes)
    inside = F.col("around_x") & F.col("around_y") & F.col("around_z") & (F.col("holes") >= 2)
    kind = F.when(~F.coalesce(enough, F.lit(False)), "unsupported").when(inside, "interpolated").otherwise("extrapolated")
    index = F.cbrt(F.greatest(F.lit(0.0), 1 - F.col("nearest")) * F.least(F.col("holes"), F.lit(3)) / 3 * F.least(F.col("octants"), F.lit(6)) / 6)
    whole = targets.select(target_key).join(dealt(got), target_key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    estimate = F.when(enough, F.when(F.col("nearest") < ON_SPOT, F.col("__first")).otherwise(F.col("__mean")))
    return whole.select(target_key, *(zero(c) for c in ("n", "holes", "octants")), "nearest", *(F.coalesce(f"around_{a}", F.lit(False)).alias(f"around_{a}") for a in "xyz"), kind.alias("support"), F.when(enough, index).otherwise(0.0).alias("data_index"), estimate.alias("estimate"))


def support_counts(classes: DataFrame) -> DataFrame:
    """Blocks and mean index of each support class."""
    return classes.groupBy("support").agg(F.count("*").alias("blocks"), F.avg("data_index").alias("data_index"), F.sum(F.when(F.col("holes") == 1, 1).otherwise(0)).alias("one_hole"))
