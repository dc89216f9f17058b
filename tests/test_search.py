"""Searches in a turned ellipsoid against a dense pass in numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import search


def tables(spark, seed=2):
    rng = random.Random(seed)
    rows = [(i, f"h{i % 9}", rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(-40, 0), float(rng.randint(0, 30)), rng.choice([None, 0.0, 1.0, 2.5]), rng.choice(["A", "B", None])) for i in range(250)]
    rows += [(900 + i, "dense", 30.0 + i / 100, 30.0, -20.0, float(i), 1.0, "A") for i in range(60)]
    rows += [(990, "h1", None, 0.0, 0.0, 1.0, 1.0, "A"), (991, "h1", 1.0, 1.0, -1.0, None, 1.0, "A"), (992, "h2", 10.0, 10.0, -10.0, 5.0, 1.0, "B"), (993, "h2", 10.0, 10.0, -10.0, 6.0, 1.0, "A")]
    blocks = [(i, x, y, z) for i, (x, y, z) in enumerate((x, y, z) for x in (0.0, 10.0, 30.0, 55.0) for y in (10.0, 30.0, 50.0) for z in (-10.0, -20.0, -35.0))] + [(500, 500.0, 0.0, 0.0)]
    samples = spark.createDataFrame(rows, "id int, hole string, x double, y double, z double, v double, length double, code string")
    return rows, blocks, samples, spark.createDataFrame(blocks, "block int, x double, y double, z double")


def dense_pass(rows, block, azimuth, dip, ranges, most, cap, per_octant, domain):
    a, d = math.radians(azimuth), math.radians(dip)
    major = np.array([math.sin(a) * math.cos(d), math.cos(a) * math.cos(d), -math.sin(d)])
    strike = np.array([math.cos(a), -math.sin(a), 0])
    turn = np.stack([major, strike, np.cross(major, strike)]) / np.array(ranges)[:, None]
    found = []
    for key, hole, *p, v, length, code in rows:
        if None in p or v is None:
            continue
        off = np.array(p) - np.array(block[1:])
        d2 = float(((turn @ off) ** 2).sum())
        if d2 <= 1:
            found.append((d2, key, hole, v, length, code, off))
    found.sort(key=lambda f: (round(f[0], 12), f[1]))
    if domain and found:
        found = [f for f in found if f[5] == found[0][5] and f[5] is not None]
    octant = lambda f: sum(1 << i for i in range(3) if f[6][i] >= 0)
    for key, limit in ((octant, per_octant), (lambda f: f[2], cap)):
        seen, kept = Counter(), []
        for f in found:
            seen[key(f)] += 1
            if not limit or seen[key(f)] <= limit:
                kept.append(f)
        found = kept
    return [(f, octant(f)) for f in found[:most]]


@pytest.mark.parametrize(
    ("azimuth", "dip", "ranges", "how"),
    [
        (0.0, 0.0, (20.0, 20.0, 20.0), {}),
        (35.0, 50.0, (30.0, 20.0, 8.0), {"least_holes": 3}),
        (210.0, -20.0, (40.0, 12.0, 12.0), {"most_per_hole": 2, "most_per_octant": 2}),
        (90.0, 90.0, (25.0, 15.0, 30.0), {"domain": "code", "most_per_octant": 1}),
    ],
)
def test_against_a_dense_pass(spark, azimuth, dip, ranges, how):
    rows, blocks, samples, targets = tables(spark)
    used = search.neighbours(targets, samples.repartition(3), "block", "id", "v", azimuth, dip, ranges, most=10, **how)
    got = {}
    for u in used.collect():
        got.setdefault(u.block, []).append((u["rank"], u.hole, u.value, u.octant, u.d2))
    least_holes = how.get("least_holes", 1)
    cap = search.hole_cap(10, least_holes, how.get("most_per_hole", 0))
    classes = {r.block: r for r in search.support(used, targets, "block", least=2, least_holes=least_holes, tolerance=1.0).collect()}
    assert len(classes) == len(blocks)
    kinds = set()
    for block in blocks:
        want = dense_pass(rows, block, azimuth, dip, ranges, 10, cap, how.get("most_per_octant", 0), "domain" in how)
        mine = sorted(got.get(block[0], []))
        assert [(h, v, o) for _, h, v, o, _ in mine] == [(f[2], f[3], o) for f, o in want]
        assert np.allclose([d2 for *_, d2 in mine], [f[0] for f, _ in want])
        c = classes[block[0]]
        holes, octants = {f[2] for f, _ in want}, {o for _, o in want}
        assert (c.n, c.holes, c.octants) == (len(want), len(holes), len(octants))
        offs = np.array([f[6] for f, _ in want]).reshape(-1, 3)
        around = [bool((offs[:, i] < -1).any() and (offs[:, i] > 1).any()) for i in range(3)]
        assert [c.around_x, c.around_y, c.around_z] == around
        enough = len(want) >= 2 and len(holes) >= least_holes
        kind = "unsupported" if not enough else "interpolated" if all(around) and len(holes) >= 2 else "extrapolated"
        assert c.support == kind
        kinds.add(kind)
        if not enough:
            assert c.estimate is None and c.data_index == 0
            continue
        near = math.sqrt(want[0][0][0])
        assert c.data_index == pytest.approx((max(0, 1 - near) * min(len(holes), 3) / 3 * min(len(octants), 6) / 6) ** (1 / 3))
        weights = [((f[4] or 0) or 1.0) / f[0] for f, _ in want] if near >= 1e-6 else None
        assert c.estimate == pytest.approx(want[0][0][3] if weights is None else np.average([f[3] for f, _ in want], weights=weights))
    assert len(kinds) >= 2
    assert sum(r.blocks for r in search.support_counts(spark.createDataFrame([c.asDict() for c in classes.values()], search.support(used, targets, "block").schema)).collect()) == len(blocks)


def test_caps_are_pruned_before_the_shuffle(spark):
    _, _, samples, targets = tables(spark)
    used = search.neighbours(targets, samples, "block", "id", "v", 0.0, 0.0, (20.0, 20.0, 20.0), most=10)
    assert "WindowGroupLimit" in used._jdf.queryExecution().toString()


def test_no_samples(spark):
    _, blocks, samples, targets = tables(spark)
    used = search.neighbours(targets, samples.limit(0), "block", "id", "v", 0.0, 0.0, (20.0, 20.0, 20.0))
    assert {r.support for r in search.support(used, targets, "block").collect()} == {"unsupported"}


def test_few_pairs_are_formed(spark, monkeypatch):
    """All samples in the ellipsoid were ranked for each block."""
    from lodestone.operators import spatial

    _, _, samples, targets = tables(spark)
    formed, within = [], spatial.within

    def counted(left, right, radius, axes=("x", "y")):
        out = within(left, right, radius, axes)
        formed.append(out.count())
        return out

    for module in (spatial, search):
        monkeypatch.setattr(module, "within", counted, raising=False)
    used = search.neighbours(targets, samples, "block", "id", "v", 35.0, 50.0, (90.0, 80.0, 70.0), most=4)
    assert used.groupBy("block").count().where("count = 4").count() == 36
    assert "Broadcast" not in used._jdf.queryExecution().executedPlan().toString()
    assert sum(formed) < 36 * 312 / 3
