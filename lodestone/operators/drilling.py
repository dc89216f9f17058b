"""Drilling as a whole: survey spacing, deviation, hole spacing, lines and slabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.spatial import k_nearest
from lodestone.operators.stats import cumulative
from lodestone.staging import staged


def survey_gaps(stations: DataFrame, times: float = 3.0) -> DataFrame:
    """Steps between stations longer than ``times`` the hole's median step."""
    order = Window.partitionBy("hole").orderBy("depth")
    steps = stations.select("hole", F.lag("depth").over(order).alias("from_"), F.col("depth").alias("to_")).where("from_ is not null and to_ > from_").withColumn("step", F.col("to_") - F.col("from_"))
    usual = steps.groupBy("hole").agg(F.percentile("step", F.lit(0.5)).alias("usual"))
    return steps.join(usual, "hole").where(F.col("step") > times * F.col("usual"))


def deviation(stations: DataFrame) -> DataFrame:
    """Per hole: lift (dip) and drift (azimuth, the shorter way) in degrees per 100 m, first to last station."""
    ends = stations.groupBy("hole").agg(*(f(F.struct("depth", "azimuth", "dip")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))))
    run = F.nullif(F.col("b.depth") - F.col("a.depth"), F.lit(0.0))
    turn = F.pmod(F.col("b.azimuth") - F.col("a.azimuth") + 180, F.lit(360.0)) - 180
    return ends.select("hole", ((F.col("b.dip") - F.col("a.dip")) * 100 / run).alias("lift"), (turn * 100 / run).alias("drift")).where("lift is not null")


def spacing(points: DataFrame, key: str, start: float) -> DataFrame:
    """Distance of each point to its nearest other: n, least, upper median and most."""
    near = staged(k_nearest(points, points, key, 1, start, other=key).select(F.sqrt("d2").alias("d")), "spacing")
    half = F.floor(F.col("total") / 2)
    middle = F.max(F.when((F.col("cum") > half) & (F.col("cum") - F.col("w") <= half), F.col("d")))
    return cumulative(near, [], "d").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("n"), F.min("d").alias("least"), middle.alias("median"), F.max("d").alias("most"))


def best_line(points: DataFrame) -> DataFrame:
    """Line of least squared distance through points: centre and bearing (0-180 degrees from north)."""
    s = points.agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("__xx"), F.var_pop("y").alias("__yy"), F.covar_pop("x", "y").alias("__xy"))
    return s.select("n", "cx", "cy", F.pmod(90 - F.degrees(0.5 * F.atan2(2 * F.col("__xy"), F.col("__xx") - F.col("__yy"))), F.lit(180.0)).alias("bearing"))


def to_line(points: DataFrame, line: DataFrame) -> DataFrame:
    """Points with distance along and to the right of a line (one row: cx, cy, bearing)."""
    b = F.radians("bearing")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    placed = points.withColumn("__k", F.lit(1)).join(F.broadcast(line.select("cx", "cy", "bearing", F.lit(1).alias("__k")).limit(1)), "__k").drop("__k")
    return placed.withColumns({"along": dx * F.sin(b) + dy * F.cos(b), "offset": dx * F.cos(b) - dy * F.sin(b)}).drop("cx", "cy", "bearing")


def slab_runs(trace: DataFrame, low: float, high: float) -> DataFrame:
    """Parts of each trace leg between two levels: ``hole, from_, to_`` in depth."""
    order = Window.partitionBy("hole").orderBy("depth")
    legs = trace.select("hole", F.col("depth").alias("d1"), F.col("z").alias("z1"), F.lag("depth").over(order).alias("d0"), F.lag("z").over(order).alias("z0")).where("d0 is not null and d1 > d0")
    run = F.nullif(F.col("z1") - F.col("z0"), F.lit(0.0))
    at = lambda level: (F.lit(level) - F.col("z0")) / run
    inside = (F.col("z0") >= low) & (F.col("z0") <= high)
    s0 = F.when(run.isNull(), F.when(inside, 0.0)).otherwise(F.greatest(F.lit(0.0), F.least(at(low), at(high))))
    s1 = F.when(run.isNull(), F.when(inside, 1.0)).otherwise(F.least(F.lit(1.0), F.greatest(at(low), at(high))))
    step = F.col("d1") - F.col("d0")
    return legs.select("hole", (F.col("d0") + s0 * step).alias("from_"), (F.col("d0") + s1 * step).alias("to_")).where("to_ > from_ + 1e-9")


def unit_probability(runs: DataFrame, cell: str, unit: str) -> DataFrame:
    """Share of realisations that give a cell each unit."""
    n = runs.groupBy(cell, unit).agg(F.count("*").alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(cell)))


def unit_entropy(probabilities: DataFrame, cell: str) -> DataFrame:
    """Most likely unit's probability and entropy (bits) per cell."""
    p = F.col("probability")
    return probabilities.groupBy(cell).agg(F.max(p).alias("most"), (-F.sum(p * F.log2(p))).alias("entropy"))


def total_of(parts: list[Column]) -> Column:
    """Sum of parts, null unless every part is there."""
    every, out = F.lit(True), F.lit(0.0)
    for p in parts:
        every, out = every & p.isNotNull(), out + p
    return F.when(every, out)


def twin_values(rows: DataFrame, col: str) -> DataFrame:
    """Values that differ only by case, spaces, punctuation or a plural s: ``key, spelling, n``."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.col(col)), r"[\s_\-]+", ""), "s$", "")
    n = rows.where(F.col(col).isNotNull()).groupBy(key.alias("key"), F.col(col).alias("spelling")).agg(F.count("*").alias("n"))
    return n.withColumn("__k", F.count("*").over(Window.partitionBy("key"))).where("__k > 1").drop("__k")


def density_weighted(rows: DataFrame, by: list[str], value: str, length: str, density: str) -> DataFrame:
    """Grade by length x density; parts without a density take the group's length-weighted mean of the known ones."""
    v, w, d = F.col(value), F.col(length), F.col(density)
    known = rows.groupBy(*by).agg((F.sum(F.when(d.isNotNull(), w * d)) / F.sum(F.when(d.isNotNull(), w))).alias("__d"))
    use = F.coalesce(d, F.col("__d"), F.lit(1.0))
    return rows.where(v.isNotNull()).join(known, by).groupBy(*by).agg((F.sum(v * w * use) / F.sum(w * use)).alias("grade"), F.sum(w * use).alias("mass"))
