"""The two-segment break against a fit of every break in numpy."""

import random

import numpy as np
import pytest

from lodestone.operators import stats


def brute(points, least):
    points = sorted(points)
    x, y = np.array(points, dtype=float).T
    sse = lambda a, b: (lambda f: ((f - y[a:b]) ** 2).sum())(np.polyval(np.polyfit(x[a:b], y[a:b], 1), x[a:b]))
    found = [(sse(0, k) + sse(k, len(x)), k) for k in range(least, len(x) - least + 1)]
    return min(found)


@pytest.mark.parametrize("cuts", [2, 16, 128])
def test_against_every_break(spark, cuts):
    rng = random.Random(cuts)
    groups = {g: [(1e4 + i + rng.random() * 0.5, 3.0 * min(i, at) + 40 * max(0, i - at) + rng.gauss(0, 2)) for i in range(n)] for g, at, n in (("a", 30, 80), ("b", 12, 40), ("few", 3, 15))}
    rows = [(g, x, y) for g, pts in groups.items() for x, y in pts] + [("a", None, 1.0), ("a", 1.0, None), (None, 1.0, 1.0), ("b", float("nan"), 1.0)]
    got = {r.g: r for r in stats.two_segment_break(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), "x", "y", ["g"], 8, cuts).collect()}
    assert got.keys() == {"a", "b"}
    for g, r in got.items():
        sse, k = brute(groups[g], 8)
        assert r.k == k and r.n == len(groups[g]) and r.sse == pytest.approx(sse, rel=1e-4) and r.at == sorted(groups[g])[k][0]
        assert r.slope_low == pytest.approx(3, abs=0.5) and r.slope_high == pytest.approx(40, abs=0.5) and r.sse_one > r.sse


def test_without_groups_and_points(spark):
    line = spark.range(40).selectExpr("id AS x", "abs(id - 20) AS y")
    assert stats.two_segment_break(line, "x", "y").first().k in (20, 21)
    assert stats.two_segment_break(line.limit(0), "x", "y").count() == 0
