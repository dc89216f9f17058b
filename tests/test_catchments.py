"""Flow by pointer doubling against walks cell by cell."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catchments, grids

FLOW = "i int, j int, direction int"


def grid(seed, w=12, h=9):
    """Every cell drains to the east or south or is a pit; some drain off the grid."""
    rng = random.Random(seed)
    return [(i, j, rng.choice([0, 0, 1, 2, 3, 3, -1] if rng.random() < 0.5 else [0, 1, 2])) for i in range(w) for j in range(h) if rng.random() < 0.95]


def walk(flow, cell):
    by = {(i, j): d for i, j, d in flow}
    out = [cell]
    while by[cell] >= 0:
        di, dj = grids.DIRECTIONS[by[cell]]
        cell = (cell[0] + di, cell[1] + dj)
        if cell not in by:
            break
        out.append(cell)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walks(spark, seed):
    flow = grid(seed)
    df = spark.createDataFrame(flow, FLOW).repartition(3)
    want = Counter(c for i, j, _ in flow for c in walk(flow, (i, j)))
    assert {(r.i, r.j): r.cells for r in catchments.flow_accumulation(df).collect()} == dict(want)

    rng = random.Random(seed)
    cells = rng.sample([(i, j) for i, j, _ in flow], 9)
    cells.append(cells[0])  # two sites on one cell
    sites = spark.createDataFrame([(s, c) for s, c in enumerate(cells)], "site int, node struct<i:long,j:long>")
    of = {}
    for s, c in enumerate(cells):
        of.setdefault(c, s)
    first = {(i, j): next((of[c] for c in walk(flow, (i, j)) if c in of), None) for i, j, _ in flow}
    edges = catchments.downstream(df)
    labels = catchments.first_site(edges, sites)
    assert {(r.node.i, r.node.j): r.site for r in labels.collect()} == first
    tree = {r.site: (r.down, r.own, r.total) for r in catchments.site_tree(edges, sites, labels).collect()}
    own = Counter(s for s in first.values() if s is not None)
    assert tree == {s: (next((of[c] for c in walk(flow, cell)[1:] if c in of), None), own[s], want[cell]) for cell, s in of.items()}


def test_a_long_stream_takes_few_rounds(spark, monkeypatch):
    rounds = []
    keep = catchments.staged
    monkeypatch.setattr(catchments, "staged", lambda df, name: rounds.append(name) or keep(df, name))
    n = 20_000
    edges = spark.range(n).selectExpr("id AS node", "CASE WHEN id < 19999 THEN id + 1 END AS to")
    got = catchments.accumulate(edges)
    assert got.where("node = 19999").first().total == n and got.agg({"total": "sum"}).first()[0] == n * (n + 1) // 2
    assert len(rounds) <= 17


def test_cycles_weights_and_empty_tables(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node int, to int")
    with pytest.raises(ValueError, match="cycle"):
        catchments.accumulate(ring)
    tree = spark.createDataFrame([(1, None, 0.5), (2, 1, 2.0), (3, 1, 4.0), (4, 3, 8.0)], "node int, to int, w double")
    assert {r.node: r.total for r in catchments.accumulate(tree, "w").collect()} == {1: 14.5, 2: 2.0, 3: 12.0, 4: 8.0}
    assert catchments.flow_accumulation(spark.createDataFrame([], FLOW)).count() == 0


def test_snapping(spark):
    acc = spark.createDataFrame([(i, j, 10 * (i == 3) + j) for i in range(6) for j in range(6)], "i int, j int, cells long")
    sites = spark.createDataFrame([(1, 2.2, 2.0), (2, 0.0, 0.0), (3, 50.0, 0.0), (4, 3.0, 5.0)], "site int, x double, y double")
    got = {r.site: (r.i, r.j, r.cells, round(r.moved, 6)) for r in catchments.snap_sites(sites, acc, 1.5).collect()}
    assert got == {1: (3, 3, 13, round((0.64 + 1) ** 0.5, 6)), 2: (0, 1, 1, 1.0), 4: (3, 5, 15, 0.0)}
    level = acc.selectExpr("i", "j", "1L AS cells")
    assert catchments.snap_sites(sites.where("site = 1"), level, 1.5).first()[1:4] == (2, 2, 1)


def test_productivity(spark):
    v = spark.createDataFrame([(30.0, 2.0), (5.0, 2.0), (None, 2.0), (30.0, 0.0)], "v double, km2 double")
    assert [r.productivity for r in catchments.productivity(v, "v", 10.0, "km2").collect()] == [40.0, -10.0, None, None]


def test_large_tables_are_not_broadcast(spark):
    """Well packed tables look small to the planner; the driver had to hold the whole grid."""
    flow = spark.range(400).selectExpr("cast(id % 20 as int) as i", "cast(id div 20 as int) as j", "cast(if(id % 20 = 19, -1, 0) as int) as direction")
    edges = catchments.downstream(flow)
    node = F.struct((F.col("id") % 20).alias("i"), F.expr("id div 20").alias("j"))
    sites = spark.range(0, 400, 7).select(F.col("id").alias("site"), node.alias("node"))
    labels = catchments.first_site(edges, sites)
    acc = catchments.flow_accumulation(flow)
    at = sites.select("site", F.col("node.i").cast("double").alias("x"), F.col("node.j").cast("double").alias("y"))
    for out in (edges, labels, acc, catchments.site_tree(edges, sites, labels), catchments.snap_sites(at, acc, 2.0)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.cells for r in acc.collect()) == sorted(list(range(1, 21)) * 20)
