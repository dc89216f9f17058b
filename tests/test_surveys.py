"""Survey and plan operators against plain Python on small, odd input."""

import math
import random
from statistics import median

import pytest

from lodestone.operators import desurvey, plan, surveys


def spikes(vals, window, k, least):
    """Running medians with ends reflected, and which values are spikes."""
    half, n = max(1, window // 2), len(vals)
    finite = lambda v: v is not None and math.isfinite(v)

    def at(j):
        if 0 <= j < n:
            return vals[j]
        end, other = (vals[0], vals[min(n - 1, -j)]) if j < 0 else (vals[-1], vals[max(0, 2 * (n - 1) - j)])
        return 2 * end - other if finite(end) and finite(other) else None

    run = [(lambda w: median(w) if w else None)([v for v in map(at, range(j - half, j + half + 1)) if finite(v)]) for j in range(n)]
    off = [abs(v - m) if finite(v) and m is not None else None for v, m in zip(vals, run)]
    limit = max(least, k * 1.4826 * median([d for d in off if d is not None])) if any(d is not None for d in off) else least
    return run, [d is not None and d > limit for d in off]


@pytest.mark.parametrize("stretch", [6, 8192])
def test_despiked_in_stretches(spark, stretch):
    rng = random.Random(5)
    lines = {"a": [rng.gauss(0, 2) + (90 if i % 17 == 3 else 0) for i in range(83)], "b": [1.0], "c": [5.0, None, 400.0], None: [0.0] * 9 + [500.0] + [float("nan")] + [0.0] * 3}
    data = [(line, i * 3, v) for line, vals in lines.items() for i, v in enumerate(vals)]
    rng.shuffle(data)
    got = surveys.despiked(spark.createDataFrame(data, "line string, k long, v double"), "line", "k", "v", 5, 6.0, 3.0, stretch).collect()
    assert len(got) == len(data)
    for line, vals in lines.items():
        mine = sorted((x for x in got if x.line == line), key=lambda x: x.k)
        run, bad = spikes(vals, 5, 6.0, 3.0)
        assert [x.spike for x in mine] == bad
        assert [x.running for x in mine] == pytest.approx(run)


def test_despiked_without_rows(spark):
    assert surveys.despiked(spark.createDataFrame([], "line string, k long, v double"), "line", "k", "v").count() == 0


def test_ties_as_a_sorted_pass_takes_them(spark):
    rng = random.Random(3)
    sites = [[(i, rng.randrange(60) * 1.0, rng.randrange(60) * 1.0) for i in range(90)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "id long, x double, y double") for s in sites)
    edges = sorted(((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, p[0], q[0]) for p in sites[0] for q in sites[1])
    ua, ub, want = set(), set(), set()
    for d2, i, j in edges:
        if d2 <= 64 and i not in ua and j not in ub:
            ua.add(i)
            ub.add(j)
            want.add((i, j))
    got = [(r.a, r.b) for r in surveys.tie_pairs(a, b, "id", 8.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_lone_or_absent_grid(spark):
    empty = spark.createDataFrame([], "id long, x double, y double, gt double, thickness double")
    assert plan.plan_grid(empty, "id", 10.0, 5.0).count() == 0
    one = spark.createDataFrame([(1, 3.0, 4.0, 7.0, None), (2, 3.0, 4.0, 9.0, 2.0)], "id long, x double, y double, gt double, thickness double")
    got = plan.plan_grid(one, "id", 10.0, 5.0).collect()
    assert [(r.gt, r.thickness) for r in got] == [(7.0, 0.0)]


def test_square_met_twice_by_a_level(spark):
    saddle = spark.createDataFrame([(0, 0, 9.0), (1, 0, 1.0), (1, 1, 9.0), (0, 1, 1.0), (2, 0, 9.0)], "i int, j int, v double")
    got = sorted((r.x1, r.y1, r.x2, r.y2) for r in plan.contours(saddle, "v", 5.0).collect())
    assert got == [(0.5, 0.0, 1.0, 0.5), (0.5, 1.0, 0.0, 0.5)]


def test_carriers_against_a_sorted_pass(spark):
    rng = random.Random(9)
    vals = [rng.choice([0.0, 1.0, 2.0, 5.0, 40.0]) for _ in range(200)] + [-3.0]
    v = sorted((x for x in vals if x > 0), reverse=True)
    acc = half = 0
    while acc < sum(v) / 2:
        acc += v[half]
        half += 1
    r = plan.metal_carriers(spark.createDataFrame([(x,) for x in vals], "v double"), "v").first()
    assert (r.half_from, r.contributing, r.ten_share) == (half, len(v), round(sum(v[:10]) / sum(v), 3))
    assert plan.metal_carriers(spark.createDataFrame([(0.0,)], "v double"), "v").count() == 0


def test_azimuth_a_hair_below_north(spark):
    """63 - 98 * 4.5 / 7 is -1.4e-14 in doubles; the SQL makes it 360."""
    stations = spark.createDataFrame([(1, 10.0, 63.0, -60.0), (1, 17.0, 325.0, -60.0)], "hole int, depth double, azimuth double, dip double")
    points = spark.createDataFrame([(1, 14.5), (1, 5.0), (1, 99.0)], "hole int, depth double")
    got = {r.depth: r.azimuth for r in desurvey.attitude_at(points, stations).collect()}
    assert got == {14.5: 360.0, 5.0: 63.0, 99.0: 325.0}
