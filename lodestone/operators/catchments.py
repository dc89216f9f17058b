"""Flow along a forest by pointer doubling: accumulation, sub-catchments of sites, the tree of sites.

Each cell points to the one it drains into. A round doubles how far every pointer reaches, so a stream of a
million cells takes twenty rounds, not a million; a round is one grouping and two joins, cut by a written
table. A round that finds pointers beyond the number of cells has met a cycle, which is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.grids import DIRECTIONS
from lodestone.staging import dealt, staged


def downstream(flow: DataFrame) -> DataFrame:
    """``node, to`` (structs of i and j) of ``flow`` (i, j, direction); ``to`` is null in a pit and off the grid."""
    di, dj = (F.array(*(F.lit(d[x]) for d in DIRECTIONS)) for x in (0, 1))
    place = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    to = F.when(F.col("direction") >= 0, place(F.col("i") + F.get(di, F.col("direction")), F.col("j") + F.get(dj, F.col("direction"))))
    edges = flow.select(place(F.col("i"), F.col("j")).alias("node"), to.alias("__to"))
    inside = edges.select(F.col("node").alias("to"))
    return edges.join(dealt(inside), F.col("__to") == F.col("to"), "left").select("node", "to")


def _rounds(now: DataFrame, name: str, step) -> DataFrame:
    """Applies ``step`` to the written table until no pointer is left."""
    now = staged(now, name)
    total, live = now.agg(F.count("*"), F.count("to")).first()
    reach = 1
    while live:
        if reach > 2 * total:
            raise ValueError("the flow has a cycle")
        now = staged(step(now), name)
        live = now.agg(F.count("to")).first()[0]
        reach *= 2
    return now


def accumulate(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``node, total``: the weight (1 each without a column of it) of all nodes that drain through a node, itself included.

    ``edges`` has ``node`` (distinct) and ``to``. With pointers of reach k, a node's sum covers what is fewer
    than k steps upstream; the sums of nodes exactly k steps upstream double that.
    """

    def step(now: DataFrame) -> DataFrame:
        gathered = now.where("to is not null").groupBy(F.col("to").alias("__at")).agg(F.sum("total").alias("__more"))
        jump = now.select(F.col("node").alias("__via"), F.col("to").alias("__next"))
        met = now.join(dealt(gathered), F.col("node") == F.col("__at"), "left").join(dealt(jump), F.col("to") == F.col("__via"), "left")
        return met.select("node", F.col("__next").alias("to"), (F.col("total") + F.coalesce("__more", F.lit(0))).alias("total"))

    one = F.col(weight) if weight else F.lit(1).cast("long")
    return _rounds(edges.select("node", "to", one.alias("total")), "flow", step).select("node", "total")


def flow_accumulation(flow: DataFrame) -> DataFrame:
    """``i, j, cells``: cells that drain through each cell, itself included."""
    kinds = dict(flow.dtypes)
    return accumulate(downstream(flow)).select(*(F.col(f"node.{c}").cast(kinds[c]).alias(c) for c in "ij"), F.col("total").alias("cells"))


def first_site(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """``node, site``: the first site that each node's flow reaches, its own included; null without one.

    ``sites`` has ``site, node``; of several on one node the least keeps it.
    """
    own = sites.groupBy(F.col("node").alias("__n")).agg(F.min("site").alias("site"))

    def step(now: DataFrame) -> DataFrame:
        jump = now.select(F.col("node").alias("__via"), F.col("to").alias("__next"), F.col("site").alias("__site"))
        met = now.join(dealt(jump), F.col("to") == F.col("__via"), "left")
        return met.select("node", F.when(F.col("__site").isNull(), F.col("__next")).alias("to"), F.coalesce("site", "__site").alias("site"))

    start = edges.join(dealt(own), F.col("node") == F.col("__n"), "left").select("node", F.when(F.col("site").isNull(), F.col("to")).alias("to"), "site")
    return _rounds(start, "sites", step).select("node", "site")


def site_tree(edges: DataFrame, sites: DataFrame, labels: DataFrame) -> DataFrame:
    """``site, down, own, total``: the next site downstream, the site's own cells and those of its whole catchment.

    ``labels`` comes from ``first_site``. A site that another keeps the cell of has no row.
    """
    at = sites.groupBy("node").agg(F.min("site").alias("site"))
    below = labels.select(F.col("node").alias("__below"), F.col("site").alias("down"))
    links = at.join(dealt(edges.withColumnRenamed("node", "__n")), F.col("node") == F.col("__n")).join(dealt(below), F.col("to") == F.col("__below"), "left").select("site", "down")
    own = labels.where("site is not null").groupBy(F.col("site").alias("__s")).agg(F.count("*").alias("own"))
    links = staged(links.join(dealt(own), F.col("site") == F.col("__s")).select("site", "down", "own"), "site-links")
    total = accumulate(links.select(F.col("site").alias("node"), F.col("down").alias("to"), "own"), "own")
    return links.join(dealt(total), F.col("site") == F.col("node")).select("site", "down", "own", "total")


def snap_sites(sites: DataFrame, accumulation: DataFrame, radius: float, size: float = 1.0) -> DataFrame:
    """``site, i, j, cells, moved``: the cell of most accumulation within ``radius`` of each site (``site, x, y``).

    Cell (i, j) lies at (i size, j size). Of equals the site's own cell wins, then the first by j and i. A site
    off the grid has no row.
    """
    steps = int(radius // size) + 1
    near = [(a, b) for b in range(-steps, steps + 1) for a in range(-steps, steps + 1) if (a * a + b * b) ** 0.5 * size <= radius or (a, b) == (0, 0)]
    around = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in near)))
    ci, cj = F.floor(F.col("x") / size + 0.5), F.floor(F.col("y") / size + 0.5)
    cells = accumulation.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "cells")
    looks = sites.select("site", "x", "y", ci.alias("ci"), cj.alias("cj"), around.alias("o")).withColumns({"i": F.col("ci") + F.col("o.a"), "j": F.col("cj") + F.col("o.b")})
    own = F.when((F.col("o.a") == 0) & (F.col("o.b") == 0), 0).otherwise(1)
    order = Window.partitionBy("site").orderBy(F.desc("cells"), "__own", "j", "i")
    met = looks.withColumn("__own", own).join(dealt(cells), ["i", "j"])
    home = met.where("__own = 0").select("site")
    best = met.join(dealt(home), "site", "left_semi").withColumn("__r", F.row_number().over(order)).where("__r = 1")
    dx, dy = F.col("i") * size - F.col("x"), F.col("j") * size - F.col("y")
    return best.select("site", "i", "j", "cells", F.sqrt(dx * dx + dy * dy).alias("moved"))


def productivity(values: DataFrame, value: str, background: float, area: str) -> DataFrame:
    """Hawkes' productivity: what is above the background times the catchment's area; null without all three."""
    given = (F.col(value) > 0) & F.lit(background > 0) & (F.col(area) > 0)
    return values.withColumn("productivity", F.when(given, (F.col(value) - background) * F.col(area)))
