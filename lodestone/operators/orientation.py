"""Directions: mean directions, spread, rose bins, plane poles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pole(dip: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """Downward normal (east, north, up) of a plane with dip and dip direction in degrees."""
    d, a = F.radians(dip), F.radians(azimuth)
    return -F.sin(d) * F.sin(a), -F.sin(d) * F.cos(a), -F.cos(d)


def fisher(rows: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """n, resultant length, mean direction (azimuth, plunge below horizontal) and kappa = (n-1)/(n-R)."""
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"__{a}") for a, c in zip("xyz", (x, y, z))))
    r = F.sqrt(F.col("__x") ** 2 + F.col("__y") ** 2 + F.col("__z") ** 2)
    s = s.withColumn("resultant", r)
    return s.select(*by, "n", "resultant", F.pmod(F.degrees(F.atan2("__x", "__y")), F.lit(360.0)).alias("azimuth"), F.degrees(F.asin(-F.col("__z") / F.col("resultant"))).alias("plunge"), ((F.col("n") - 1) / F.nullif(F.col("n") - F.col("resultant"), F.lit(0.0))).alias("kappa"))


def rose(rows: DataFrame, by: list[str], azimuth: str, width: int = 30, axial: bool = False) -> DataFrame:
    """Counts and shares of azimuths in bins of ``width`` degrees; axial data fold to a half circle."""
    full = 180.0 if axial else 360.0
    b = (F.floor(F.pmod(F.col(azimuth), F.lit(full)) / width) * width).cast("int").alias("bin")
    n = rows.where(F.col(azimuth).isNotNull()).groupBy(*by, b).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def angle_to_axis(dip: Column, azimuth: Column, hole_azimuth: Column, hole_dip: Column) -> Column:
    """Alpha: the angle in degrees between a plane and a hole (dip negative down)."""
    px, py, pz = pole(dip, azimuth)
    a, i = F.radians(hole_azimuth), F.radians(hole_dip)
    dot = px * F.cos(i) * F.sin(a) + py * F.cos(i) * F.cos(a) + pz * F.sin(i)
    return F.degrees(F.asin(F.least(F.lit(1.0), F.abs(dot))))


def true_width(length: Column, alpha: Column) -> Column:
    """Width across a plane of a downhole length that meets it at ``alpha`` degrees."""
    return length * F.sin(F.radians(alpha))
