"""Plan grids with their panels and contours, neighbour choice, sample supports and what carries the metal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.spatial import within
from lodestone.operators.stats import cumulative, quantiles

# What flag columns write for a result outside the limits.
BELOW = r"^(<|LDL|BDL|BLD|<DL|<LDL|LT|LTDL|ND|NOTDETECTED|BELOWDETECTION(LIMIT)?|BELOWDL)$"
ABOVE = r"^(>|UDL|ODL|ADL|>DL|>UDL|GT|GTDL|OL|OVERLIMIT|OVERRANGE|ABOVEDETECTION(LIMIT)?|ABOVEDL)$"


def plan_grid(points: DataFrame, key: str, cell: float, radius: float, pad: float = 0.0, power: float = 2.0) -> DataFrame:
    """Nodes ``i, j, x, y, gt, thickness`` by inverse distance from holes (``x, y, gt, thickness``) within ``radius``.

    Nodes cover the holes' box; one without a hole in reach has no row. A node on a hole takes
    its values (ties by ``key``). No thickness counts as 0. No holes: no rows.
    """
    held = points.where("x is not null and y is not null and gt is not null")
    box = held.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box[0] is None:
        nodes = held.sparkSession.createDataFrame([], "i long, j long, x double, y double")
    else:
        x0, y0 = box[0] - pad, box[1] - pad
        nx, ny = (max(1, math.ceil((hi + pad - lo) / cell) + 1) for lo, hi in ((x0, box[2]), (y0, box[3])))
        k = F.col("id")
        nodes = held.sparkSession.range(nx * ny).select((k % nx).alias("i"), F.floor(k / nx).alias("j")).withColumns({"x": x0 + F.col("i") * cell, "y": y0 + F.col("j") * cell})
    r, w = F.sqrt("d2"), 1 / F.pow(F.sqrt("d2"), F.lit(power))
    met = within(nodes, held, radius)
    on = r < 1e-6
    one = lambda c: F.coalesce(F.min_by(F.when(on, F.coalesce(c, F.lit(0.0))), F.when(on, F.col(f"b.{key}"))), F.sum(F.when(~on, w * F.coalesce(c, F.lit(0.0)))) / F.sum(F.when(~on, w)))
    return met.groupBy("a").agg(one(F.col("b.gt")).alias("gt"), one(F.col("b.thickness")).alias("thickness")).select("a.*", "gt", "thickness")


def plan_summary(grid: DataFrame, cell: float, cutoff: float, density: float) -> DataFrame:
    """One row over nodes at or above a cut-off: nodes, area, volume, tonnes, grade (GT over thickness)."""
    area = cell * cell
    s = grid.where(F.col("gt") >= cutoff).agg(F.count("*").alias("nodes"), F.coalesce(F.sum("thickness"), F.lit(0.0)).alias("__t"), F.coalesce(F.sum("gt"), F.lit(0.0)).alias("__g"))
    return s.select("nodes", (F.col("nodes") * area).alias("area"), (F.col("__t") * area).alias("volume"), (F.col("__t") * area * density).alias("tonnes"), (F.col("__g") / F.nullif(F.col("__t"), F.lit(0.0))).alias("grade"))


def panels(grid: DataFrame, cell: float, side: float, cutoff: float, density: float) -> DataFrame:
    """Grid nodes in square panels: nodes, mean GT and thickness, tonnes, and ``ore`` where the GT reaches the cut-off."""
    at = lambda c: F.floor((F.col(c) * cell + cell / 2) / side)
    s = grid.where("gt is not null").groupBy(at("i").alias("pi"), at("j").alias("pj")).agg(F.count("*").alias("nodes"), F.avg("gt").alias("gt"), F.avg(F.coalesce("thickness", F.lit(0.0))).alias("thickness"))
    return s.withColumn("tonnes", F.col("thickness") * F.col("nodes") * cell * cell * density).withColumn("ore", F.col("gt") >= cutoff)


def contours(grid: DataFrame, value: str, level: float) -> DataFrame:
    """Straight pieces ``i, j, x1, y1, x2, y2`` (in cells) where a grid (``i, j``) crosses a level; marching squares.

    A square of four nodes needs all its values. The nodes meet by one grouping on the square
    they belong to, so there is one shuffle and no join.
    """
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    held = grid.where(F.col(value).isNotNull()).select("i", "j", F.col(value).cast("double").alias("v"), F.explode(corners).alias("c"))
    square = held.groupBy((F.col("i") - F.col("c.a")).alias("i"), (F.col("j") - F.col("c.b")).alias("j")).agg(F.count("*").alias("n"), *(F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col("v"))).alias(f"v{a}{b}") for a in (0, 1) for b in (0, 1))).where("n = 4")
    i, j = F.col("i").cast("double"), F.col("j").cast("double")

    def crossing(p: str, q: str, point) -> Column:
        a, b = F.col(p), F.col(q)
        x, y = point((level - a) / F.nullif(b - a, F.lit(0.0)))
        return F.when((a >= level) != (b >= level), F.struct(x.alias("x"), y.alias("y")))

    sides = [crossing("v00", "v10", lambda t: (i + t, j)), crossing("v10", "v11", lambda t: (i + 1, j + t)), crossing("v01", "v11", lambda t: (i + t, j + 1)), crossing("v00", "v01", lambda t: (i, j + t))]
    met = square.withColumn("p", F.filter(F.array(*sides), lambda s: s.isNotNull())).where(F.size("p") >= 2)
    pieces = met.select("i", "j", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2, F.lit(2))).alias("k"))
    return pieces.select("i", "j", *(F.get("p", F.col("k") + o)[c].alias(f"{c}{o + 1}") for o in (0, 1) for c in ("x", "y")))


def chosen_neighbours(pairs: DataFrame, block: str, hole: str, order: list[str], most: int, min_holes: int = 1, per_hole: int = 0) -> DataFrame:
    """Of each block's candidates the first ``most`` in order, with no more from one hole than the rules leave."""
    cap = min([math.ceil(most / min_holes)] * (min_holes > 1) + [per_hole] * (per_hole > 0), default=None)
    if cap is not None:
        pairs = pairs.withColumn("__h", F.row_number().over(Window.partitionBy(block, hole).orderBy(*order))).where(F.col("__h") <= max(1, cap)).drop("__h")
    return pairs.withColumn("__k", F.row_number().over(Window.partitionBy(block).orderBy(*order))).where(F.col("__k") <= most).drop("__k")


def material_holes(used: DataFrame, block: str, hole: str, d2: str, length: str | None = None, power: float = 2.0, share: float = 0.05) -> DataFrame:
    """Holes that give at least ``share`` of a block's inverse-distance weight: ``block, hole, share``."""
    w = (F.coalesce(F.col(length), F.lit(1.0)) if length else F.lit(1.0)) / F.pow(F.greatest(F.col(d2), F.lit(1e-6)), F.lit(power / 2))
    s = used.groupBy(block, hole).agg(F.sum(w).alias("__w"))
    s = s.withColumn("share", F.col("__w") / F.sum("__w").over(Window.partitionBy(block)))
    return s.where(F.col("share") >= share - 1e-9).select(block, hole, "share")


def transformed(rows: DataFrame, value: str, how: str, percentile: float = 98.0) -> DataFrame:
    """Rows with ``value`` changed: ``log`` (log10 of 1 + value), ``logfloor`` (log10, half the least positive value at least) or ``cap``.

    Rows without a value go. ``logfloor`` of a column without a positive value has no rows;
    ``cap`` cuts at the value of rank floor(p (n - 1)).
    """
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    v = F.col(value)
    if how == "log":
        return held.withColumn(value, F.log10(F.greatest(v, F.lit(0.0)) + 1))
    if how == "logfloor":
        least = held.agg(F.min(F.when(v > 0, v))).first()[0]
        return held.limit(0) if least is None else held.withColumn(value, F.log10(F.greatest(v, F.lit(least / 2))))
    rank = F.floor((F.col("total") - 1) * (min(100.0, max(0.0, percentile)) / 100))
    top = cumulative(held, [], value).where((F.col("cum") > rank) & (F.col("cum") - F.col("w") <= rank)).select(value).first()
    return held if top is None else held.withColumn(value, F.least(v, F.lit(top[0])))


def split_intervals(rows: DataFrame, longest: float) -> DataFrame:
    """Intervals cut into equal parts no longer than ``longest`` (0.25 at least); those without a length go."""
    length = F.col("to_") - F.col("from_")
    n = F.greatest(F.lit(1), F.ceil(length / max(0.25, longest))).cast("int")
    cut = rows.where(length > 0).withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    step = length / F.col("__n")
    return cut.withColumns({"from_": F.col("from_") + F.col("__i") * step, "to_": F.col("from_") + (F.col("__i") + 1) * step}).drop("__n", "__i")


def metal_carriers(rows: DataFrame, carry: str) -> DataFrame:
    """One row: the fewest samples that hold half the metal, samples that hold any, the share of the ten highest; none without metal.

    Counts run over distinct values in buckets, so no task sorts all samples.
    """
    held = rows.where(F.col(carry) > 0)
    n = cumulative(held, [], carry)
    metal = cumulative(held, [], carry, F.col(carry)).select(carry, F.col("w").alias("m"), F.col("cum").alias("mc"), F.col("total").alias("mt"))
    top = n.join(metal, carry).withColumns({"before": F.col("total") - F.col("cum"), "above": F.col("mt") - F.col("mc")})
    middle = top.where((F.col("above") < F.col("mt") / 2) & (F.col("above") + F.col("m") >= F.col("mt") / 2))
    half = middle.select((F.col("before") + F.ceil((F.col("mt") / 2 - F.col("above")) / F.col(carry) - 1e-9)).cast("long").alias("half_from"), F.col("total").alias("contributing"), "mt")
    ten = held.select(carry).orderBy(F.desc(carry)).limit(10).agg(F.sum(carry).alias("__ten")).withColumn("__k", F.lit(1))
    return half.withColumn("__k", F.lit(1)).join(F.broadcast(ten), "__k").select("half_from", "contributing", F.round(F.col("__ten") / F.col("mt"), 3).alias("ten_share"))


def below_detection_pairs(rows: DataFrame, columns: list[str], below: dict[str, Column]) -> DataFrame:
    """Per pair of columns: rows with both values, and those of them where either is below detection; one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    either = lambda a, b: F.coalesce(below[a], F.lit(False)) | F.coalesce(below[b], F.lit(False))
    s = rows.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(both(a, b), 1)).alias("n"), F.count(F.when(both(a, b) & either(a, b), 1)).alias("below")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    return s.select(F.explode(F.array(*(F.col(f"p{k}") for k in range(len(pairs))))).alias("p")).select("p.*")


def method_pairs(rows: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Two methods on the same samples, per group: ``n``, median relative difference in %, median ratio, ``different`` (not the same quantity)."""
    a, b = F.col(first), F.col(second)
    mean = (a + b) / 2
    held = rows.where(a.isNotNull() & b.isNotNull()).withColumns({"__rpd": F.coalesce(F.abs(a - b) / F.nullif(mean, F.lit(0.0)) * 100, F.lit(0.0)), "__ratio": F.when(a > 0, b / a)})
    rpd = quantiles(held, by, "__rpd", {"median_rpd": 0.5})
    ratios = quantiles(held, by, "__ratio", {"median_ratio": 0.5}).drop("n")
    r = F.col("median_ratio")
    return rpd.join(ratios, by, "left").withColumn("different", F.coalesce((r < 0.5) | (r > 2), F.lit(False)))


def flag_qualifier(cell: Column) -> Column:
    """``<``, ``>`` or null of a flag cell."""
    s = F.regexp_replace(F.upper(F.trim(cell.cast("string"))), r"[\s_.-]+", "")
    return F.when(s.rlike(BELOW), "<").when(s.rlike(ABOVE), ">")


def logged_volume(runs: DataFrame, by: list[str], spacing: float) -> DataFrame:
    """Per group: logged metres, holes, and metres times the area that a hole stands for (spacing squared)."""
    length = F.col("to_") - F.col("from_")
    return runs.where(length > 0).groupBy(*by).agg(F.sum(length).alias("metres"), F.count_distinct("hole").alias("holes")).withColumn("volume", F.col("metres") * spacing * spacing)
