"""Operators against brute force and on odd input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone import graph
from lodestone.functions import assay
from lodestone.operators import catchments, grids, intervals, quality, spatial, stats

IV = "hole long, from_ double, to_ double, value double, code string"


def intervals_of(spark, rows):
    return spark.createDataFrame(rows, IV)


def test_segments_mean_of_overlap(spark):
    iv = intervals_of(spark, [(1, 0.0, 10.0, 2.0, "a"), (1, 5.0, 15.0, 4.0, "a"), (1, 5.0, 15.0, 4.0, "a"), (1, 20.0, 20.0, 9.0, "a"), (2, 0.0, 5.0, -1.0, "b"), (2, None, 5.0, 1.0, "b")])
    got = sorted((r.hole, r.from_, r.to_, r.value, r.n, r.conflict) for r in intervals.segments(iv).collect())
    assert got == [(1, 0.0, 5.0, 2.0, 1, False), (1, 5.0, 10.0, 3.0, 2, True), (1, 10.0, 15.0, 4.0, 1, False)]


def test_composite_brute_force(spark):
    rng = random.Random(3)
    rows, at = [], 0.0
    for _ in range(40):
        n = rng.randint(1, 7)
        if rng.random() < 0.8:
            rows.append((1, at, at + n, float(rng.randint(0, 9)), "a"))
        at += n
    got = {r.from_: (r.covered, r.value) for r in intervals.composite(intervals_of(spark, rows), 5.0, 0.5).collect()}
    first = rows[0][1]
    want = {}
    for k in range(60):
        lo, hi = first + 5 * k, first + 5 * k + 5
        parts = [(min(hi, t) - max(lo, f), v) for _, f, t, v, _ in rows if min(hi, t) > max(lo, f)]
        covered = sum(p for p, _ in parts)
        if covered >= 2.5:
            want[lo] = (covered, sum(p * v for p, v in parts) / covered)
    assert set(got) == set(want)
    assert all(math.isclose(got[k][0], want[k][0]) and math.isclose(got[k][1], want[k][1]) for k in want)


def test_intercepts_bridge_only_while_the_average_holds():
    rows = [(0.0, 2.0, 9.0), (2.0, 4.0, 1.0), (4.0, 6.0, 9.0), (6.0, 20.0, 0.0), (20.0, 22.0, 9.0)]
    assert intervals.fold_intercepts(rows, 6.0, 5.0, 1.0) == [(0.0, 6.0, 6.0, 6.0, 38 / 6, 3), (20.0, 22.0, 2.0, 2.0, 9.0, 1)]
    assert intervals.fold_intercepts(rows, 6.0, 1.0, 1.0) == [(0.0, 2.0, 2.0, 2.0, 9.0, 1), (4.0, 6.0, 2.0, 2.0, 9.0, 1), (20.0, 22.0, 2.0, 2.0, 9.0, 1)]
    assert intervals.fold_intercepts([], 6.0, 1.0, 1.0) == []


def test_gaps_of_holes_without_rows(spark):
    iv = intervals_of(spark, [(1, 2.0, 4.0, 1.0, "a")])
    ends = spark.createDataFrame([(1, 10.0), (2, 5.0)], "hole long, length double")
    assert sorted(tuple(r) for r in intervals.gaps(iv, ends).collect()) == [(1, 0.0, 2.0), (1, 4.0, 10.0), (2, 0.0, 5.0)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_empty_and_null_intervals(spark, rows):
    iv = intervals_of(spark, rows)
    assert intervals.segments(iv).count() == 0
    assert intervals.composite(iv, 2.0).count() == 0
    assert intervals.merge_touching(iv, "code").count() == 0
    assert intervals.intercepts(iv, 1.0, 1.0, 1.0).count() == 0
    assert stats.above_cutoffs(iv.withColumn("w", F.lit(1.0)), "value", "w", [1.0]).count() == 1


def test_k_nearest_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, float(rng.randint(0, 500)), float(rng.randint(0, 500))) for i in range(80)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {}
    for r in spatial.k_nearest(df, df, "id", 4, 10.0, other="id").collect():
        got.setdefault(r.a.id, {})[r["rank"]] = r.b.id
    for i, x, y in pts:
        near = sorted(((px - x) ** 2 + (py - y) ** 2, j) for j, px, py in pts if j != i)[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [j for _, j in near]


def test_clusters_of_a_long_chain(spark):
    """A survey line whose keys fall away from the smallest one is one cluster."""
    chain = [(0, 0.0, 0.0), *((200 - i, 10.0 * (i + 1), 0.0) for i in range(200))]
    pts = spark.createDataFrame([*chain, (500, 0.0, 99.0), (501, 9.0, 99.0), (502, 0.0, 500.0)], "id long, x double, y double")
    got = {r.id: r.cluster for r in spatial.clusters(pts, "id", 10.0).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 502}


def test_components_that_have_not_settled_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=1)
    assert {r.component for r in graph.components(edges).collect()} == {0}


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    """The driver's memory follows the plans it runs, so settled edges are told by counts alone."""
    written = []
    monkeypatch.setattr(graph, "staged", lambda df, name, f=graph.staged: (written.append(name), f(df, name))[1])
    edges = spark.createDataFrame([(5, i) for i in range(6, 40)] + [(50, 51), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 5 for i in range(5, 40)} | {50: 50, 51: 50}
    assert written == ["edges", "least"]
    assert graph.components(edges.where("a < 0")).count() == 0


def test_components_of_a_hub(spark):
    """Node 1000 has more than FEW edges and isn't the smallest of its component."""
    edges = [(1000, i) for i in range(700, 1000)] + [(1000, i) for i in range(1001, 1300)] + [(3, 1200), (2000, 2001), (2001, 2002)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 3 for i in (3, *range(700, 1300))} | {i: 2000 for i in (2000, 2001, 2002)}


def test_flow_accumulation_of_a_slope(spark):
    grid = spark.createDataFrame([(i, j, float(100 - i)) for i in range(5) for j in range(3)], "i int, j int, z double")
    flow = grids.flow_directions(grid)
    acc = {(r.i, r.j): r.cells for r in catchments.flow_accumulation(flow).collect()}
    assert all(acc[(4, j)] == 5 for j in range(3)) and acc[(0, 0)] == 1


def test_cells(spark):
    df = spark.createDataFrame([("<0.5",), (">10",), ("-1",), ("-999",), (" na ",), ("1,5",), (None,), ("x",)], "c string")
    got = [(r.c.v, r.c.q) for r in df.select(assay.censored(F.col("c")).alias("c")).collect()]
    assert got == [(0.25, "<"), (10.0, ">"), (0.5, "<"), (None, None), (None, None), (1.5, None), (None, None), (None, None)]


def test_qc_classes(spark):
    df = spark.createDataFrame([("BLANK", None, True), (None, "OREAS 12", False), (None, "dup of 3", True), (None, "field dup", False), (None, None, False)], "t string, c string, known boolean")
    got = [r[0] for r in df.select(quality.classify_qc(F.col("t"), F.col("c"), F.col("known"))).collect()]
    assert got == ["blank", "standard", "regular", "duplicate", "regular"]


def test_average_ranks_on_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert sorted(r.k for r in stats.average_ranks(df, "v", "k").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_read_xyz_and_geojson(spark, tmp_path):
    from lodestone.sources import tables

    (tmp_path / "a.xyz").write_text("/ note\nLINE 10\n1 2 3\n4 5 *\nTIE 7\n6,7,8\n")
    got = [(r.line_id, r.x, r.y, r.v) for r in tables.read_xyz_lines(spark, str(tmp_path / "a.xyz"), ["x", "y", "v"]).orderBy("pos").collect()]
    assert got == [("10", 1.0, 2.0, 3.0), ("10", 4.0, 5.0, None), ("7", 6.0, 7.0, 8.0)]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"name":"p"}}]}')
    assert [tuple(r) for r in tables.read_geojson(spark, str(tmp_path / "g.json"), ["name"]).collect()] == [(1.0, 2.0, "p")]


def test_guess_numeric_leaves_identifiers(spark):
    from lodestone.sources import tables

    raw = spark.createDataFrame([("0045", "1.5", "7"), ("0046", "na", "x")], "code2 string, au string, note string")
    assert tables.guess_numeric(raw) == ["au"]


def test_codes_of_samples_with_nulls_and_repeats(spark):
    rows = [("DH1", 10.0, 20.0, None), ("DH1", 10.0, 20.0, None), ("DH1", 10.0, 20.0, 5.0), ("DH1", 500.0, 510.0, None), ("DH2", 5.0, 5.0, 1.0), ("DH3", None, 1.0, 1.0)]
    samples = spark.createDataFrame(rows, "hole string, from_ double, to_ double, value double")
    log = spark.createDataFrame([("DH1", 0.0, 14.0, "B"), ("DH1", 14.0, 300.0, "A"), ("DH1", 505.0, 506.0, None)], "hole string, from_ double, to_ double, code string")
    for f in (intervals.code_by_overlap, intervals.code_at_midpoint):
        got = sorted((tuple(r) for r in f(samples, log, bucket=7.0).collect()), key=repr)
        want = [(*r, "A" if r[0] == "DH1" and r[1] == 10.0 else None) for r in rows]
        assert got == sorted(want, key=repr)


def test_intercepts_keep_the_holes_type_and_count_no_metre_twice(spark):
    rows = [("DH001", 0.0, 4.0, 2.0), ("DH001", 1.0, 2.0, 5.0), ("DH002", 0.0, 2.0, None)]
    iv = spark.createDataFrame(rows, "hole string, from_ double, to_ double, value double")
    got = [tuple(r) for r in intervals.intercepts(iv, 2.0, 0.0, 1.0).collect()]
    assert got == [("DH001", 0.0, 4.0, 4.0, 4.0, (2.0 + 3.5 + 4.0) / 4.0, 3)]
    ends = intervals.open_ends(intervals.intercepts(iv, 3.0, 0.0, 1.0), iv, spark.createDataFrame([("DH001", 2.0)], "hole string, length double"))
    assert [(r.open_top, r.open_bottom) for r in ends.collect()] == [(False, True)]


def test_k_nearest_of_points_with_a_null_column(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 9.0, 0.0, None), (3, 500.0, 0.0, "n")], "id long, x double, y double, note string")
    got = sorted((r.a.id, r.b.id) for r in spatial.k_nearest(pts, pts, "id", 1, 10.0, other="id").collect())
    assert got == [(1, 2), (2, 1), (3, 2)]


def test_quantiles_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randint(0, 30))) for _ in range(301)] + [("a", None), ("c", 4.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    import numpy as np

    for r in stats.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}).collect():
        own = [v for g, v in rows if g == r.g and v is not None]
        assert r.n == len(own) and np.allclose((r.a, r.b, r.c), np.quantile(own, [0.1, 0.5, 1.0]))


def test_moving_median_brute_force(spark):
    rng = random.Random(6)
    rows = [(h, float(rng.randint(0, 400)), float(rng.randint(0, 9))) for h in (1, 2) for _ in range(150)]
    got = sorted((r.hole, r.depth, r.value, r.filtered) for r in intervals.moving_median(spark.createDataFrame(rows, "hole long, depth double, value double"), 7.0).collect())
    want = []
    for h, d, v in rows:
        near = sorted(x for g, e, x in rows if g == h and abs(e - d) <= 7.0)
        want.append((h, d, v, near[(len(near) + 1) // 2 - 1]))
    assert got == sorted(want)


def test_neighbours_of_cells_are_not_broadcast(spark):
    """Exploded rows look small to the planner: eight times the grid went to the driver."""
    grid = spark.range(400).selectExpr("cast(id % 20 as int) as i", "cast(id div 20 as int) as j", "cast((id * 7919) % 10007 as double) as z")
    for out in (grids.flow_directions(grid), grids.hillshade(grid)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 400


def test_grids_with_odd_cells(spark):
    """A missing height, a height that is no number, a cell given twice."""
    grid = spark.createDataFrame([(0, 0, 5.0), (1, 0, None), (0, 1, 3.0), (0, 1, 1.0), (1, 1, 4.0), (9, 9, 2.0)], "i int, j int, z double")
    assert sorted(tuple(r) for r in grids.flow_directions(grid).collect()) == [(0, 0, 2), (0, 1, -1), (1, 0, -1), (1, 1, 4), (9, 9, -1)]
    assert sorted((r.i, r.j) for r in grids.slopes(grid).collect()) == [(0, 0), (0, 1), (0, 1), (1, 0), (1, 1), (9, 9)]
