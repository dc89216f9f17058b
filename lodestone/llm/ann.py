"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are turned into points on which the largest inner product is the smallest distance
(one more coordinate fills the length up to the longest vector's), projected by several random
rotations with random shifts and put in order along a Hilbert curve for each. Spark
range-partitions the rows by curve and key; each partition is cut into segments of a fixed
number of rows, and queries, which stand in the same order, know the segment they fall into.
A query looks at the segments around its own on every curve. What they hold is ranked by the
inner product of the original vectors, summed in the order of the components so that a pair
has one score wherever it is met; tasks thin their lists to the best of each query, and these
merge by query and row.

How many segments a query must look at depends on the data: in high dimensions without
structure neighbours are hardly closer than other rows on any curve. So the reach is measured:
a bounded sample of queries is answered by brute force and the smallest reach that finds
``recall`` of the true neighbours is taken.

Of a vector that many rows share, the rows of the k + 1 smallest ids are candidates: no other
can be among the k first. So a hot vector doesn't push others out of the segments near it.

Defined cases: vectors that are null, zero, of another length than most or hold a null or
non-finite component take no part. Rows with one vec_id are candidates each, repeated rows
too; a query leaves out all rows of its own id. Query rows of one id and one vector ask once,
those of one id and different vectors each, with lists of their own. With fewer candidates
than k all of them return; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import staged
from lodestone.llm.vectors import clean, matrix_of, usual_length

PROJECTED, BITS = 6, 8


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with coordinates below 2**bits.

    The coordinates are turned, from the highest bit on, into the frame of the sub-cube they
    lie in, then Gray-decoded; the bits are read across the coordinates.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            there = (x[i] & level) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(there, low, swap)
            if i:
                x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(x: np.ndarray, longest: float, curves: int, seed: int, as_query: bool) -> np.ndarray:
    """A row of keys per curve."""
    norms = np.sqrt((x * x).sum(axis=1))
    scale = norms if as_query else np.full(len(x), longest)
    points = x / scale[:, None]
    last = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))
    points = np.concatenate([points, last[:, None]], axis=1)
    out = np.empty((curves, len(x)), dtype=np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, c])
        axes = np.linalg.qr(rng.normal(size=(points.shape[1], min(PROJECTED, points.shape[1]))))[0]
        spread = 2.5 / np.sqrt(points.shape[1])
        place = (points @ axes / spread + 1) / 2 * 0.75 + rng.uniform(0, 0.25, size=axes.shape[1])
        out[c] = hilbert(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)
    return out


def _keyed(longest: float, curves: int, seed: int, dims: int, as_query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix_of(part, dims)
                keys = curve_keys(x, longest, curves, seed, as_query)
                vectors = pa.array([r.tobytes() for r in x], pa.binary())
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, dtype=np.int32)), pa.array(keys[c]), part.column("vec_id"), part.column("row"), vectors, pa.array(np.full(len(x), as_query))], names=["curve", "key", "vec_id", "row", "x", "asks"])

    return run


_KEYED_SQL = "curve int, key long, vec_id long, row long, x binary, asks boolean"
_SEGMENT_SQL = "asks boolean, curve int, part int, seg int, rows binary, ids binary, x binary"


def _segments(size: int):
    """Rows in order along the curves, ``size`` at a time, as one row: row numbers, ids, matrix.

    Queries give rows of their own, with the segment that is open where they stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, counts = TaskContext.get().partitionId(), None, {}
        held: dict[bool, list[tuple]] = {False: [], True: []}

        def emit() -> Iterator[pa.RecordBatch]:
            for asks, rows in held.items():
                if rows:
                    numbers, ids, x = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([asks]), pa.array([place], pa.int32()), pa.array([part], pa.int32()), pa.array([counts[place]], pa.int32()), pa.array([np.array(numbers, dtype=np.int64).tobytes()], pa.binary()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([b"".join(x)], pa.binary())],
                        names=["asks", "curve", "part", "seg", "rows", "ids", "x"],
                    )
                    rows.clear()

        for batch in batches:
            for curve, number, i, x, asks in zip(*(batch.column(c).to_pylist() for c in ("curve", "row", "vec_id", "x", "asks"))):
                if curve != place:
                    yield from emit()
                    place, counts[curve] = curve, 0
                elif len(held[asks]) >= size:
                    yield from emit()
                    counts[curve] += 1
                held[asks].append((number, i, x))
        yield from emit()

    return run


def top_pairs(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of rows and scores: for each query the ``k`` best rows of a block.

    The matrix product only chooses: its last bits depend on the block's shape, so all that may
    reach the ``k``-th best within twice the bound of the rounding error of either sum goes on,
    and its score is summed anew, component by component.
    """
    rough = q @ x.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    cut = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(q), -np.inf)
    error = (q.shape[1] + 1) * np.finfo(np.float64).eps * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
    at, j = np.nonzero((rough >= (cut - 4 * error)[:, None]) & (rough > -np.inf))
    scores = np.empty(len(at))
    q_t, x_t = np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)
    for lo in range(0, len(at), 1 << 18):
        r, c = at[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
        total = np.zeros(len(r))
        for q_d, x_d in zip(q_t, x_t):
            total += q_d[r] * x_d[c]
        scores[lo : lo + len(r)] = total
    by = np.lexsort((ids[j], -scores, at))
    at, j, scores = at[by], j[by], scores[by]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], j[keep], scores[keep]


_PAIR = np.dtype([("query_id", "<i8"), ("asked", "<i8"), ("vec_id", "<i8"), ("row", "<i8"), ("score", "<f8")])
_LISTS_SQL = "asked long, pairs binary"


def thinned(pairs: np.ndarray, k: int) -> np.ndarray:
    """Of (query, asked, id, row, score) the ``k`` best of each query, a row once."""
    pairs = pairs[np.lexsort((pairs["row"], pairs["asked"]))]
    keep = np.ones(len(pairs), dtype=bool)
    keep[1:] = (pairs["row"][1:] != pairs["row"][:-1]) | (pairs["asked"][1:] != pairs["asked"][:-1])
    pairs = pairs[keep]
    pairs = pairs[np.lexsort((pairs["row"], pairs["vec_id"], -pairs["score"], pairs["asked"]))]
    return pairs[np.arange(len(pairs)) - np.searchsorted(pairs["asked"], pairs["asked"]) < k]


def _ranked(k: int, dims: int, hold: int = 400_000):
    """A list of the ``k`` best of each query over all blocks that a task meets, thinned as they grow."""
    kind = _PAIR

    def out(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], pairs["asked"][1:] != pairs["asked"][:-1]])[: len(pairs)])
        lists = [part.tobytes() for part in np.split(pairs, first[1:])] if len(first) else []
        yield pa.RecordBatch.from_pydict({"asked": pa.array(pairs["asked"][first]), "pairs": pa.array(lists, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for q_rows, q_ids, q_x, rows, ids, x in zip(*(batch.column(c).to_pylist() for c in ("q_rows", "q_ids", "q_x", "rows", "ids", "x"))):
                asked, own, numbers, i = (np.frombuffer(b, dtype=np.int64) for b in (q_rows, q_ids, rows, ids))
                at, j, scores = top_pairs(np.frombuffer(q_x).reshape(-1, dims), own, np.frombuffer(x).reshape(-1, dims), i, k)
                found = np.empty(len(at), dtype=kind)
                found["query_id"], found["asked"], found["vec_id"], found["row"], found["score"] = own[at], asked[at], i[j], numbers[j], scores
                held.append(found)
                size += len(found)
                if size > hold:
                    held = [thinned(np.concatenate(held), k)]
                    size = len(held[0])
                    if size > hold // 2:  # as many queries as that: pass them on
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(thinned(np.concatenate(held), k))

    return run


def _merged(k: int):
    """The tasks' lists of each query as its ``k`` best; a query's lists follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def emit() -> pa.RecordBatch:
            pairs = thinned(np.frombuffer(b"".join(held), dtype=_PAIR), k)
            columns = {n: pa.array(np.ascontiguousarray(pairs[n])) for n in _PAIR.names}
            return pa.RecordBatch.from_pydict({"query_id": columns["query_id"], "asked": columns["asked"], "rank": pa.array(np.arange(1, len(pairs) + 1, dtype=np.int32)), "vec_id": columns["vec_id"], "row": columns["row"], "score": columns["score"]})

        for batch in batches:
            for asked, pairs in zip(batch.column("asked").to_pylist(), batch.column("pairs").to_pylist()):
                if held and asked != now:
                    yield emit()
                    held.clear()
                now = asked
                held.append(pairs)
                if len(held) >= 4096:  # a query met by very many tasks
                    held[:] = [thinned(np.frombuffer(b"".join(held), dtype=_PAIR), k).tobytes()]
        if held:
            yield emit()

    return run


def _best_pairs(lists: DataFrame, k: int) -> DataFrame:
    """``query_id, asked, rank, vec_id, row, score``: a row met several times counts once, then the ``k`` best."""
    dealt = lists.repartition("asked").sortWithinPartitions("asked")
    return dealt.mapInArrow(_merged(k), "query_id long, asked long, rank int, vec_id long, row long, score double")


def exact_sample(rows: DataFrame, sample: list, k: int, dims: int) -> DataFrame:
    """``asked, row, ...``: brute force for a bounded list of queries, which goes to every task."""
    packed = [pa.array([b], pa.binary()) for b in (np.array([r.row for r in sample]).tobytes(), np.array([r.vec_id for r in sample]).tobytes(), np.array([r.embedding for r in sample], dtype=np.float64).tobytes())]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = matrix_of(part, dims)
                mine = [pa.array([part.column(c).to_numpy().tobytes()], pa.binary()) for c in ("row", "vec_id")]
                yield pa.RecordBatch.from_arrays([*packed, *mine, pa.array([x.tobytes()], pa.binary())], names=["q_rows", "q_ids", "q_x", "rows", "ids", "x"])

    rank = _ranked(k, dims)
    return _best_pairs(rows.mapInArrow(lambda batches: rank(blocks(batches)), _LISTS_SQL), k)


def _places(segments: DataFrame, of_rows: set[int], of_queries: set[int]) -> dict[tuple[bool, int], list[tuple[int, int]]]:
    """(query?, row number) -> (curve, segment) of a bounded set of rows and queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = {False: np.array(sorted(of_rows), dtype=np.int64), True: np.array(sorted(of_queries), dtype=np.int64)}
        for batch in batches:
            for asks, curve, seg, rows in zip(*(batch.column(c).to_pylist() for c in ("asks", "curve", "at", "rows"))):
                mine = np.intersect1d(np.frombuffer(rows, dtype=np.int64), want[asks])
                if len(mine):
                    yield pa.RecordBatch.from_pydict({"asks": pa.array([asks] * len(mine)), "row": pa.array(mine), "curve": pa.array([curve] * len(mine), pa.int32()), "at": pa.array([seg] * len(mine), pa.int64())})

    out: dict[tuple[bool, int], list[tuple[int, int]]] = {}
    for r in segments.select("asks", "curve", "at", "rows").mapInArrow(run, "asks boolean, row long, curve int, at long").collect():
        out.setdefault((r.asks, r.row), []).append((r.curve, r.at))
    return out


def measured_reach(segments: DataFrame, rows: DataFrame, sample: list, k: int, dims: int, recall: float) -> int:
    """The smallest number of segments to either side that holds ``recall`` of the sample's true neighbours."""
    truth = exact_sample(rows, sample, k, dims).select("asked", "row").collect()
    places = _places(segments, {r.row for r in truth}, {r.asked for r in truth})
    gaps = []
    for r in truth:
        mine = dict(places[(True, r.asked)])
        gaps.append(min(abs(seg - mine[curve]) for curve, seg in places[(False, r.row)]))
    return int(np.sort(gaps)[max(0, int(np.ceil(recall * len(gaps))) - 1)]) if gaps else 0


def nearest(vectors: DataFrame, is_query, k: int = 20, curves: int = 8, segment_rows: int = 2048, recall: float = 0.95, sample: int = 128, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = usual_length(vectors)
    if dims is None:
        return empty
    usable = clean(vectors, dims, nonzero=True)
    # the rank is limited before its shuffle too, so a hot vector costs few rows
    copies = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    rows = usable.groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(k)).alias("__n")).withColumn("__c", F.row_number().over(copies)).where(F.col("__c") <= k + 1)
    rows = rows.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i")).select("vec_id", "embedding", F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "vectors")
    asked = staged(usable.where(is_query).distinct().withColumn("row", F.monotonically_increasing_id()), "queries")
    longest = rows.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)))).first()[0]
    few = asked.orderBy(F.xxhash64("vec_id"), "row").limit(sample).collect()
    if longest is None or not few:
        return empty

    keyed = rows.mapInArrow(_keyed(longest, curves, seed, dims, False), _KEYED_SQL).unionByName(asked.mapInArrow(_keyed(longest, curves, seed, dims, True), _KEYED_SQL))
    ordered = keyed.repartitionByRange(n, "curve", "key", "vec_id", "row").sortWithinPartitions("curve", "key", "vec_id", "row")
    segments = staged(ordered.mapInArrow(_segments(segment_rows), _SEGMENT_SQL), "segments")
    # a curve's partitions follow one another: number their segments through (a row per partition and curve)
    starts, last, at = [], {}, 0
    for r in segments.groupBy("curve", "part").agg((F.max("seg") + 1).alias("n")).orderBy("curve", "part").collect():
        first = last[r.curve][0] if r.curve in last else at
        starts.append((r.curve, r.part, at))
        at += r.n
        last[r.curve] = (first, at - 1)
    place = spark.createDataFrame([(c, p, s, *last[c]) for c, p, s in starts], "curve int, part int, start long, lo long, hi long")
    segments = segments.join(F.broadcast(place), ["curve", "part"]).withColumn("at", F.col("start") + F.col("seg"))

    reach = measured_reach(segments, rows, few, k, dims, recall)
    data = segments.where(~F.col("asks")).select("at", "rows", "ids", "x")
    near = F.sequence(F.greatest(F.col("at") - reach, F.col("lo")), F.least(F.col("at") + reach, F.col("hi")))
    asks = segments.where("asks").select(F.explode(near).alias("at"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    found = asks.join(data.hint("shuffle_hash"), "at").select("q_rows", "q_ids", "q_x", "rows", "ids", "x").mapInArrow(_ranked(k, dims), _LISTS_SQL)
    return _best_pairs(found, k).select("query_id", "rank", "vec_id", "score")
