"""Value grids as long tables (i east, j south, z): terrain, flow, overlay, zones.

Neighbourhoods are groupings by shifted cell numbers, so a grid of any size stays partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import stats

#: Directions of flow in the order that breaks ties: E, SE, S, SW, W, NW, N, NE.
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _seen(grid: DataFrame, value: str) -> DataFrame:
    """Each cell's value sent to itself (``k`` -1) and to the cells that look at it, with the direction they look in.

    Cells meet by a grouping of this, never by a join: the planner takes exploded rows for as small as those they
    came from and would broadcast them.
    """
    looks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for k, (di, dj) in enumerate(((0, 0), *DIRECTIONS), -1)))
    return grid.select("i", "j", F.col(value).alias("__nz"), F.explode(looks).alias("o")).select((F.col("i") - F.col("o.di")).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"), F.col("o.k").alias("k"), "__nz")


def flow_directions(grid: DataFrame, value: str = "z", size: float = 1.0) -> DataFrame:
    """D8: the strictly steepest way down; ``i, j, direction`` (-1 in a pit)."""
    own = F.col("k") == -1
    met = _seen(grid, value).groupBy("i", "j").agg(F.bool_or(own).alias("__in"), F.max(F.when(own, F.col("__nz"))).alias("__z"), *(F.min(F.when(F.col("k") == k, F.col("__nz"))).alias(f"n{k}") for k in range(8)))
    slope = [(F.col("__z") - F.col(f"n{k}")) / F.lit(math.sqrt(2) * size if k % 2 else float(size)) for k in range(8)]
    best = F.array_max(F.array(*(F.when(s > 0, F.struct(s.alias("s"), F.lit(-k).alias("k"))) for k, s in enumerate(slope))))
    return met.where("__in").select("i", "j", F.coalesce(-best["k"], F.lit(-1)).alias("direction"))


def slopes(grid: DataFrame, value: str = "z", size: float = 1.0) -> DataFrame:
    """Horn's 3 x 3 gradients; at an edge the missing neighbour is the cell itself. ``i, j, gx, gy``."""
    own = F.when(F.col("k") == -1, F.struct(F.col("__nz").alias("z")))
    met = _seen(grid, value).groupBy("i", "j").agg(F.collect_set(own).alias("__own"), *(F.max(F.when(F.col("k") == k, F.col("__nz"))).alias(f"n{k}") for k in range(8)))
    wide = met.withColumn("__own", F.explode("__own")).withColumn("__z", F.col("__own.z"))
    n = [F.coalesce(f"n{k}", "__z") for k in range(8)]
    e, se, s, sw, w, nw, no, ne = n
    gx = ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * size)
    gy = ((sw + 2 * s + se) - (nw + 2 * no + ne)) / (8 * size)
    return wide.select("i", "j", gx.alias("gx"), gy.alias("gy"))


def hillshade(grid: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, value: str = "z", size: float = 1.0) -> DataFrame:
    """Illumination 0 to 1 from gradients: ``i, j, shade, slope``."""
    g = slopes(grid, value, size)
    steep = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    a, alt = math.radians(azimuth), math.radians(altitude)
    # rows run south: the light's direction is (sin az, -cos az) in (i, j)
    lit = (math.sin(alt) - math.cos(alt) * (F.col("gx") * math.sin(a) - F.col("gy") * math.cos(a))) / F.sqrt(1 + steep * steep)
    return g.select("i", "j", F.greatest(F.lit(0.0), lit).alias("shade"), F.degrees(F.atan(steep)).alias("slope"))


def membership(x: Column, low: float, high: float, log: bool = False) -> Column:
    """Fuzzy membership: 0 at ``low``, 1 at ``high`` (either way round), linear or in log10 between."""
    if log:
        x, low, high = F.when(x > 0, F.log10(x)), math.log10(low), math.log10(high)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def fuzzy_overlay(members: list[Column], rule: str, gamma: float = 0.7) -> Column:
    """and, product and gamma need every member; or and sum skip those that are missing."""
    every = members[0].isNotNull()
    for m in members[1:]:
        every = every & m.isNotNull()
    product, rest = F.lit(1.0), F.lit(1.0)
    for m in members:
        product = product * m
        rest = rest * (1 - F.coalesce(m, F.lit(0.0)))
    some = F.coalesce(*members).isNotNull()
    if rule == "and":
        return F.when(every, F.least(*members)) if len(members) > 1 else members[0]
    if rule == "or":
        return F.greatest(*members) if len(members) > 1 else members[0]
    if rule == "product":
        return F.when(every, product)
    if rule == "sum":
        return F.when(some, 1 - rest)
    if rule == "gamma":
        return F.when(every, F.pow(1 - rest, F.lit(gamma)) * F.pow(product, F.lit(1 - gamma)))
    raise ValueError(rule)


def weights_of_evidence(cells: DataFrame, pattern: str, deposit: str) -> DataFrame:
    """W+, W-, contrast and its studentized value of a binary pattern; 0.5 stands for empty cells."""
    p, d = F.col(pattern) == 1, F.col(deposit) == 1
    count = lambda c, n: F.greatest(F.count(F.when(c, 1)).cast("double"), F.lit(0.5)).alias(n)
    t = cells.agg(count(p & d, "pd"), count(p & ~d, "pn"), count(~p & d, "ad"), count(~p & ~d, "an"))
    wp = F.log((F.col("pd") / (F.col("pd") + F.col("ad"))) / (F.col("pn") / (F.col("pn") + F.col("an"))))
    wm = F.log((F.col("ad") / (F.col("pd") + F.col("ad"))) / (F.col("an") / (F.col("pn") + F.col("an"))))
    sd = F.sqrt(1 / F.col("pd") + 1 / F.col("pn") + 1 / F.col("ad") + 1 / F.col("an"))
    return t.select(wp.alias("w_plus"), wm.alias("w_minus"), (wp - wm).alias("contrast"), ((wp - wm) / sd).alias("studentized"))


def zonal_stats(cells: DataFrame, zone: str, value: str, cell_area: float) -> DataFrame:
    """Count, mean, extremes, type-7 percentiles and area of the cells of each zone."""
    held = cells.where(F.col(value).isNotNull())
    means = held.groupBy(zone).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    marks = stats.quantiles(held, [zone], value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return means.join(marks, zone).select(zone, "n", "mean", "least", "most", "p10", "p50", "p90", (F.col("n") * cell_area).alias("area"))
