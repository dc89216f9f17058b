"""Repeated rows stay rows of their own, whatever an operator groups by."""

import math
import random

import pytest

from lodestone.operators import intervals, joins, spatial

IV = "hole string, from_ double, to_ double, value double, code string"


def test_equal_windows_and_values(spark):
    windows = spark.createDataFrame([("a", 0.0, 10.0), ("a", 0.0, 10.0), ("a", 5.0, 15.0)], "hole string, from_ double, to_ double")
    values = spark.createDataFrame([("a", 0.0, 5.0, 4.0, "X"), ("a", 6.0, 8.0, 1.0, "Y"), ("a", 6.0, 8.0, 1.0, "Y"), ("a", 20.0, 30.0, 9.0, "Z")], IV)
    got = sorted((r.from_, r.to_, round(r.value, 9), r.covered) for r in intervals.overlap_means(windows, values).collect())
    assert got == [(0.0, 10.0, round(24 / 9, 9), 9.0)] * 2 + [(5.0, 15.0, 1.0, 4.0)]
    metres = sorted((r.from_, r.code, r.metres) for r in intervals.metres_by_code(windows, values).collect())
    assert metres == [(0.0, "X", 5.0)] * 2 + [(0.0, "Y", 4.0)] * 2 + [(5.0, "Y", 4.0)]


def test_equal_readings(spark):
    readings = spark.createDataFrame([("a", 3.0, None), ("a", 3.0, None), ("a", 12.0, "n"), ("b", 3.0, "n")], "hole string, depth double, note string")
    held = spark.createDataFrame([("a", 0.0, 10.0), ("a", 2.0, 4.0)], "hole string, from_ double, to_ double")
    got = [(r.depth, r.from_, r.to_) for r in intervals.readings_in_intervals(readings, held, 5.0).collect()]
    assert got == [(3.0, 2.0, 4.0)] * 2
    assert intervals.code_by_overlap(held.unionByName(held), held.selectExpr("*", "'Q' AS code")).count() == 4


def test_equal_readings_of_a_field_survey(spark):
    base = spark.createDataFrame([("s", 0.0, 10.0), ("s", 10.0, 30.0)], "station string, t double, v double")
    readings = spark.createDataFrame([(1, 5.0, 100.0), (1, 5.0, 100.0), (2, 10.0, 50.0)], "line int, t double, v double")
    got = sorted((r.line, r.drift, r.corrected) for r in joins.diurnal_correct(readings, base, "t", "v", "station", 60.0).collect())
    assert got == [(1, 0.0, 100.0)] * 2 + [(2, 10.0, 40.0)]


def test_nearest_of_equal_queries(spark):
    queries = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (9.0, 0.0)], "x double, y double")
    points = spark.createDataFrame([(5, 1.0, 0.0), (6, 2.0, 0.0), (7, 900.0, 0.0)], "id int, x double, y double")
    got = sorted((r.a.x, r.rank, r.b.id) for r in spatial.k_nearest(queries, points, "id", 2, 2.0).collect())
    assert got == [(0.0, 1, 5)] * 2 + [(0.0, 2, 6)] * 2 + [(9.0, 1, 6), (9.0, 2, 5)]
    assert spatial.k_nearest(queries, points, "id", 5, 20.0).count() == 9  # all there are, however far
    assert spatial.k_nearest(queries, points.limit(0), "id", 2, 0.5).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_against_all_pairs(spark, k):
    rng = random.Random(k)
    q = [(rng.uniform(0, 100), rng.choice([0.0, 5.0])) for _ in range(20)]
    p = [(i, rng.uniform(0, 400), rng.uniform(0, 5)) for i in range(60)]
    got = sorted((r.a.x, r.rank, r.b.id) for r in spatial.k_nearest(spark.createDataFrame([*q, q[0]], "x double, y double"), spark.createDataFrame(p, "id int, x double, y double"), "id", k, 8.0).collect())
    want = sorted((x, n + 1, i) for x, y in [*q, q[0]] for n, (_, i) in enumerate(sorted((math.hypot(px - x, py - y), i) for i, px, py in p)[:k]))
    assert got == want
