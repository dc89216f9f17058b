"""Composites of a stream: one batch, many batches, late rows and a hole's end give the same."""

import math
import random
from collections import defaultdict

import pytest

from lodestone.streaming import compositor, logs

SCHEMA = "hole string, from_ double, to_ double, Fe double, code string, last boolean"


def rows():
    rng = random.Random(3)
    out = []
    for h in range(6):
        at = rng.choice([-7.5, 0.0, 3.0])
        for i in range(25):
            to = at + rng.choice([0.5, 1.0, 2.5, 14.0])
            out.append((f" H{h}", at, to, rng.choice([None, 1.0, 2.5, math.nan, 9.0]), rng.choice([None, " ", "A", " B", "C"]), i == 24 and h % 2 == 0))
            at = to if rng.random() < 0.9 else to - 0.25
    out += [("H0", 1.0, 1.0, 5.0, "A", False), ("H0", 5.0, 2.0, 5.0, "A", False), (None, 0.0, 1.0, 5.0, "A", False), (" ", 0.0, 1.0, 5.0, "A", False), ("H1", None, 1.0, 5.0, "A", False), ("H9", None, None, None, None, True), ("H3", 0.0, math.inf, 1.0, "A", False)]
    return [*out, out[0], out[0]]


def brute(data, length):
    bins = defaultdict(list)
    for hole, a, b, fe, code, _ in data:
        if hole and hole.strip() and a is not None and b is not None and math.isfinite(b) and b > a:
            k = math.floor(a / length)
            while k * length < b - 1e-9:
                top, base = max(a, k * length), min(b, (k + 1) * length)
                if base - top > 1e-9:
                    bins[hole.strip(), k].append((top, base, fe, code.strip() if code and code.strip() else None))
                k += 1
    out = {}
    for key, parts in bins.items():
        known = [(t, b, v) for t, b, v, _ in parts if v is not None and not math.isnan(v)]
        metres, first = defaultdict(float), {}
        for t, b, _, c in parts:
            if c:
                metres[c] += b - t
                first[c] = min(first.get(c, t), t)
        code = min(metres, key=lambda c: (-round(metres[c], 6), first[c], c)) if metres else None
        out[key] = (min(p[0] for p in parts), max(p[1] for p in parts), len(parts), sum((b - t) * v for t, b, v in known) / sum(b - t for t, b, _ in known) if known else None, code)
    return out


@pytest.mark.parametrize(("files", "slack", "length"), [(1, 0.0, 5.0), (4, 0.0, 5.0), (7, 8.0, 2.0), (3, 1e9, 5.0)])
def test_the_same_in_any_batches(spark, tmp_path, files, slack, length):
    data = rows()
    random.Random(files).shuffle(data)
    for i in range(files):
        spark.createDataFrame(data[i::files], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = logs.read_growing(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    stream = compositor.parts(source, length, ["Fe"], ["code"], slack=slack, ended="last", keys=3)
    compositor.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    published = spark.read.schema(compositor.PART).parquet(str(tmp_path / "out"))
    still = compositor.open_parts(spark, str(tmp_path / "state"))
    got = {(r.hole, r.k): (r.from_, r.to_, r.n, r.Fe, r.code) for r in compositor.composites(published.unionByName(still), ["Fe"], ["code"]).collect()}
    want = brute(data, length)
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert g[:3] == pytest.approx(w[:3]) and g[4] == w[4] and (g[3] is None) == (w[3] is None) and (w[3] is None or math.isclose(g[3], w[3]))
    held = {r.hole for r in still.select("hole").distinct().collect()}
    assert held.isdisjoint({"H0", "H2", "H4"})  # their end was read, so nothing of them stays open
    if slack < 1:
        assert published.count() > 0 and still.count() <= 3  # the deepest bin of each hole without an end


def test_files_that_come_later(spark, tmp_path):
    data = rows()
    parts = None
    for share in (data[::2], data[1::2]):
        spark.createDataFrame(share, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        source = logs.read_growing(spark, str(tmp_path / "in"), SCHEMA)
        compositor.run_to_end(compositor.parts(source, 5.0, ["Fe"], ended="last", keys=3), str(tmp_path / "out"), str(tmp_path / "state"))
        parts = spark.read.schema(compositor.PART).parquet(str(tmp_path / "out")).unionByName(compositor.open_parts(spark, str(tmp_path / "state")))
    got = {(r.hole, r.k): r.n for r in compositor.composites(parts, ["Fe"]).collect()}
    assert got == {k: v[2] for k, v in brute(data, 5.0).items()}


def test_a_length_is_needed(spark):
    with pytest.raises(ValueError, match="above 0"):
        compositor.parts(spark.createDataFrame([], SCHEMA), 0.0, ["Fe"])


def test_typed_readings(spark):
    data = [(" a ", "1,5", "3.5", 7), ("a", "x", "2", None), ("", "1", "1", 1), (None, "1", "3", 2), ("b", "1e400", "2", 3), ("b", None, "", 4)]
    raw = spark.createDataFrame(data, "id string, top string, gr string, n int")
    got = [tuple(r) for r in logs.typed_readings(raw, "id", ["gr", "n"], depth="top").collect()]
    assert got == [("a", 1.5, 3.5, 7.0, True), ("a", None, 2.0, None, False), (None, 1.0, 1.0, 1.0, False), (None, 1.0, 3.0, 2.0, False), ("b", None, 2.0, 3.0, False), ("b", None, None, 4.0, False)]
    assert [r.depth for r in logs.typed_readings(raw, "id", [], interval=("top", "gr")).collect()] == [2.5, None, 1.0, 2.0, None, None]


def test_state_lies_on_disk_under_enough_keys(spark, tmp_path):
    """All open bins lay in the executors' memory, a 256th of all holes at a time in a worker's."""
    import os

    assert compositor.keys_for(10) == 256
    assert compositor.keys_for(54_000_000) * 4096 > 53_000_000
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.range(1, 9).selectExpr("cast(id as string) as hole", "0D as from_", "30D as to_", "1D as v").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("hole string, from_ double, to_ double, v double").parquet(str(tmp_path / "in"))
    compositor.run_to_end(compositor.parts(source, 20.0, ["v"]), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.conf.get(name) == before
    assert any(f.endswith(".zip") for _, _, names in os.walk(tmp_path / "state") for f in names) or any(f.endswith(".changelog") for _, _, names in os.walk(tmp_path / "state") for f in names)
    assert compositor.open_parts(spark, str(tmp_path / "state")).count() == 16
