"""Blocks and meshes as tables: values, support, agreement, volumes, and transforms of coordinates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.spatial import within

OUNCE = 31.1034768  # grams


def revenue_per_grade(unit: str, price: float, recovery_pct: float, price_per: str = "oz", factor: float = 1.0) -> float:
    """Revenue of a tonne per unit of grade; grades in g/t or ppm are priced by gram, those in % by tonne of metal."""
    if unit in ("g/t", "ppm"):
        per = price / OUNCE if price_per == "oz" else price
        return recovery_pct / 100 * per * factor
    if unit == "%":
        return 0.01 * recovery_pct / 100 * price * factor
    raise ValueError(unit)


def block_values(blocks: DataFrame, revenue: float, processing: float, mining: float) -> DataFrame:
    """Blocks with ``tonnes``, ``is_ore`` (worth its processing) and ``net``: revenue less costs, waste costs its mining."""
    tonnes = F.col("volume") * F.col("density")
    ore = F.coalesce(F.col("value") >= processing / revenue, F.lit(False))
    net = F.when(ore, tonnes * (F.col("value") * revenue - processing)).otherwise(0.0) - tonnes * mining
    return blocks.select("*", tonnes.alias("tonnes"), ore.alias("is_ore"), net.alias("net"))


def stope_values(blocks: DataFrame, by: list[str], revenue: float, cost: float) -> DataFrame:
    """Revenue, cost and margin of what is mined, by stope or level."""
    t = F.col("volume") * F.col("density")
    s = blocks.groupBy(*by).agg(F.sum(t).alias("tonnes"), (F.sum(t * F.greatest(F.col("value"), F.lit(0.0))) * revenue).alias("revenue"))
    return s.withColumn("cost", F.col("tonnes") * cost).withColumn("margin", F.col("revenue") - F.col("cost"))


def below_drilling(blocks: DataFrame, samples: DataFrame, key: str, radius: float) -> DataFrame:
    """Share of an estimate below the deepest sample near it in plan: ``blocks, of, metal_share``.

    Every hole's deepest sample counts within ``radius`` of a block's column; a block whose top
    lies below the lowest of them is below drilling, one without a hole near isn't.
    """
    deep = samples.groupBy("hole").agg(F.min_by(F.struct("x", "y", "z"), F.struct("z", "x", "y")).alias("d")).select("d.*")
    columns = blocks.select("x", "y").distinct()
    low = within(columns, deep, radius).groupBy(F.col("a.x").alias("x"), F.col("a.y").alias("y")).agg(F.min("b.z").alias("__low"))
    metal = F.greatest(F.coalesce(F.col("value"), F.lit(0.0)), F.lit(0.0)) * F.col("volume")
    under = F.coalesce(F.col("z") + F.col("dz") / 2 < F.col("__low"), F.lit(False))
    s = blocks.join(low, ["x", "y"], "left").agg(F.count(F.when(under, 1)).alias("blocks"), F.count("*").alias("of"), F.sum(metal).alias("__all"), F.coalesce(F.sum(F.when(under, metal)), F.lit(0.0)).alias("__under"))
    return s.select("blocks", "of", F.when(F.col("__all") > 0, F.col("__under") / F.col("__all")).otherwise(0.0).alias("metal_share"))


def cell_of(axes: dict[str, tuple[float, float, int]]) -> list[Column]:
    """Cell numbers of a point on a lattice given by (origin, step, cells) of each axis, held to the lattice."""
    return [F.least(F.greatest(F.floor((F.col(a) - o) / s + 0.5), F.lit(0)), F.lit(n - 1)).cast("int").alias(f"i{a}") for a, (o, s, n) in axes.items()]


def value_at(points: DataFrame, cells: DataFrame, axes: dict[str, tuple[float, float, int]], take: list[str]) -> DataFrame:
    """Points with columns of the lattice cell nearest to them; cells have ``ix, iy, ...``."""
    keys = [f"i{a}" for a in axes]
    return points.select("*", *cell_of(axes)).join(cells.select(*keys, *take), keys, "left").drop(*keys)


def support(points: DataFrame, cells: DataFrame, axes: dict[str, tuple[float, float, int]], cutoff: float) -> DataFrame:
    """Samples at or above a cut-off against the shell at it: ``above, inside, outside, no_data``."""
    met = value_at(points.where(F.col("value") >= cutoff).withColumnRenamed("value", "__own"), cells, axes, ["value"])
    return met.agg(F.count("*").alias("above"), F.count(F.when(F.col("value") >= cutoff, 1)).alias("inside"), F.count(F.when(F.col("value") < cutoff, 1)).alias("outside"), F.count(F.when(F.col("value").isNull(), 1)).alias("no_data"))


def terrain_offsets(collars: DataFrame, cells: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Collars with ``offset``: height above the terrain at the nearest cell."""
    met = value_at(collars.withColumnRenamed("z", "__z"), cells.withColumnRenamed("z", "terrain"), axes, ["terrain"])
    return met.withColumn("offset", F.col("__z") - F.col("terrain")).withColumnRenamed("__z", "z")


def placed_samples(samples: DataFrame, cells: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Samples with a height: their own, else the terrain's, else 0; ``placed`` says which."""
    met = value_at(samples.withColumnRenamed("z", "__z"), cells.withColumnRenamed("z", "__t"), axes, ["__t"])
    how = F.when(F.col("__z").isNotNull(), "own").when(F.col("__t").isNotNull(), "terrain").otherwise("flat")
    return met.select(*(c for c in samples.columns if c != "z"), F.coalesce("__z", "__t", F.lit(0.0)).alias("z"), how.alias("placed"))


def agreement(rows: DataFrame, model: str, log: str) -> DataFrame:
    """Confusion of a model's units with logged ones: ``model, log, n, share`` (of the logged unit)."""
    held = rows.where(F.col(model).isNotNull() & F.col(log).isNotNull()).groupBy(F.col(model).alias("model"), F.col(log).alias("log")).agg(F.count("*").alias("n"))
    totals = held.groupBy("log").agg(F.sum("n").alias("__t"))
    return held.join(totals, "log").select("model", "log", "n", (F.col("n") / F.col("__t")).alias("share"))


def coarse_cells(cells: DataFrame, k: int, value: str) -> DataFrame:
    """k x k means of a grid with the extremes of what they hide: ``bi, bj, n, mean, least, most``."""
    return cells.where(F.col(value).isNotNull()).groupBy(F.floor(F.col("i") / k).cast("int").alias("bi"), F.floor(F.col("j") / k).cast("int").alias("bj")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def isopach(upper: DataFrame, lower: DataFrame, cell: float) -> DataFrame:
    """Thickness between two height grids where both have a value: count, mean, extremes, crossings, volume."""
    t = upper.select("i", "j", F.col("z").alias("u")).join(lower.select("i", "j", F.col("z").alias("l")), ["i", "j"]).select((F.col("u") - F.col("l")).alias("t")).where("t is not null")
    return t.agg(F.count("*").alias("cells"), F.avg("t").alias("mean"), F.min("t").alias("least"), F.max("t").alias("most"), F.count(F.when(F.col("t") < 0, 1)).alias("negative"), (F.sum(F.greatest(F.col("t"), F.lit(0.0))) * cell * cell).alias("volume"))


def unit_stats(cells: DataFrame, shape: tuple[int, int, int], cell_volume: float) -> DataFrame:
    """Of each unit of a block: cells, volume, faces against other units and the half-cell band along them.

    ``cells`` has ``i, j, k, unit``; faces on the outside of the block don't count.
    """
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in steps))
    near = cells.select("unit", F.explode(around).alias("o"), "i", "j", "k").select("unit", *((F.col(x) + F.col(f"o.{y}")).cast("int").alias(x) for x, y in zip("ijk", "abc")))
    near = near.where(reduce(and_, (F.col(x).between(0, n - 1) for x, n in zip("ijk", shape))))
    met = near.join(cells.select(*(F.col(x).cast("int").alias(x) for x in "ijk"), F.col("unit").alias("other")), ["i", "j", "k"], "left")
    faces = met.where(~F.col("unit").eqNullSafe(F.col("other"))).groupBy("unit").agg(F.count("*").alias("faces"))
    size = cells.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.count("*").alias("cells"))
    n = F.coalesce(F.col("faces"), F.lit(0))
    return size.join(faces, "unit", "left").select("unit", "cells", (F.col("cells") * cell_volume).alias("volume"), n.alias("faces"), (n * cell_volume / 2).alias("band"))


def mesh_volume(triangles: DataFrame, by: list[str]) -> DataFrame:
    """Volume of closed meshes by signed tetrahedra and the edges that not exactly two triangles share.

    ``triangles`` has ``a, b, c``, structs of x, y, z.
    """
    x = lambda p, c: F.col(f"{p}.{c}")
    det = x("a", "x") * (x("b", "y") * x("c", "z") - x("b", "z") * x("c", "y")) + x("a", "y") * (x("b", "z") * x("c", "x") - x("b", "x") * x("c", "z")) + x("a", "z") * (x("b", "x") * x("c", "y") - x("b", "y") * x("c", "x"))
    vol = triangles.groupBy(*by).agg((F.abs(F.sum(det)) / 6).alias("volume"), F.count("*").alias("triangles"))
    sides = F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    edges = triangles.select(*by, F.explode(sides).alias("e")).groupBy(*by, "e").agg(F.count("*").alias("k"))
    open_ = edges.groupBy(*by).agg(F.count(F.when(F.col("k") != 2, 1)).alias("open_edges"))
    return vol.join(open_, by)


def supported(points: DataFrame, key: str, radius: float, least: int, axes: tuple[str, ...] = ("x", "y"), stretch: dict[str, float] | None = None) -> DataFrame:
    """Points with at least ``least`` others inside their search ellipsoid, its axes along the coordinates.

    ``stretch`` gives an axis' radius as a multiple of ``radius``.
    """
    scaled = points.select(key, *((F.col(a) / (stretch or {}).get(a, 1.0)).alias(a) for a in axes))
    near = within(scaled, scaled, radius, axes).where(F.col(f"a.{key}") != F.col(f"b.{key}"))
    good = near.groupBy(F.col(f"a.{key}").alias(key)).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return points.join(good.select(key), key, "left_semi")


def similarity_fit(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scale, rotation (degrees, anticlockwise) and shift that carry (x, y) to (u, v) by least squares, with the RMS misfit."""
    c = lambda a, b: F.covar_pop(a, b)
    s = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), (F.var_pop("x") + F.var_pop("y")).alias("s"), (c("x", "u") + c("y", "v")).alias("p"), (c("x", "v") - c("y", "u")).alias("q"), (F.var_pop("u") + F.var_pop("v")).alias("t")).where("n >= 2 and s > 0")
    a, b = F.col("p") / F.col("s"), F.col("q") / F.col("s")
    rms = F.sqrt(F.greatest(F.col("t") - (F.col("p") * F.col("p") + F.col("q") * F.col("q")) / F.col("s"), F.lit(0.0)))
    return s.select(*(by or []), "n", F.sqrt(a * a + b * b).alias("scale"), F.degrees(F.atan2(b, a)).alias("rotation"), (F.col("mu") - a * F.col("mx") + b * F.col("my")).alias("shift_x"), (F.col("mv") - b * F.col("mx") - a * F.col("my")).alias("shift_y"), rms.alias("rms"))


def affine_fit(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """u = a x + b y + c and v = d x + e y + f by least squares: the six numbers."""
    s = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.avg(k).alias(f"m{k}") for k in "xyuv"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), *(F.covar_pop(k, t).alias(k + t) for k in "xy" for t in "uv"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    one = lambda t: ((F.col("yy") * F.col(f"x{t}") - F.col("xy") * F.col(f"y{t}")) / det, (F.col("xx") * F.col(f"y{t}") - F.col("xy") * F.col(f"x{t}")) / det)
    (a, b), (d, e) = one("u"), one("v")
    good = s.where((F.col("n") >= 3) & (det > 0))
    return good.select(*(by or []), "n", a.alias("a"), b.alias("b"), (F.col("mu") - a * F.col("mx") - b * F.col("my")).alias("c"), d.alias("d"), e.alias("e"), (F.col("mv") - d * F.col("mx") - e * F.col("my")).alias("f"))


def pivot_ilr(parts: list[str]) -> Column:
    """Pivot log-ratios of positive parts: each part against the geometric mean of those after it; null if one isn't positive."""
    logs = [F.log(c) for c in parts]
    good = reduce(and_, (F.coalesce(F.col(c) > 0, F.lit(False)) for c in parts))
    out = []
    for i in range(len(parts) - 1):
        rest = logs[i + 1 :]
        out.append((logs[i] - reduce(lambda a, b: a + b, rest) / len(rest)) * (len(rest) / (len(rest) + 1)) ** 0.5)
    return F.when(good, F.array(*out))
