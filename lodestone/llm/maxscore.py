"""Exact top-k search by MaxScore over quantised vectors.

A shard is a block of vectors. For each dimension it posts every row by how far its component
lies above the shard's smallest (for queries with a positive weight there) and below the
largest (for negative ones); a row at that end isn't posted. Each posting list is cut at a
quantile into a high part, which only the rows past the cut are in, and a low part. The parts
are the terms of a query; the weight times the longest reach of a part bounds what it adds.

With the k-th best score known so far as threshold, the terms of smallest bounds that together
can't lift a row to it are non-essential. Essential postings are traversed; rows that they
don't hold or leave too low are out. The others are probed in the non-essential terms, widest
bound first, and drop out as soon as their score and the bounds left can't reach the
threshold, which rises as the shards of a task follow one another.

Queries go in blocks to every shard by an equi-join on the partition that the shard comes
from; the shards' best rows merge by rank. Scores are integers, so results are exact and ties
go to the smaller id.

Defined cases: vectors that are null, empty, of another length than most or hold a null or
non-finite component take no part. Rows with one vec_id are candidates each; a query leaves
out all rows of its own id. Query rows of one id and one vector ask once, those of one id and
different vectors each, with lists of their own. Components past 2**12 are multiplied as whole
numbers without bound, and a score outside the range of long counts as its nearest end. With
fewer candidates than k all of them return; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import staged
from lodestone.llm.vectors import best, blocks_of, clean, usual_length

WIDE = float(2**12)
HIGH = 0.75  # quantile of a posting list's reach at which its high part begins
LONG = (-(2**63), 2**63 - 1)
_OUT_SQL = "query_id long, asked long, vec_id long, score long"
_OUT = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """The same as numbers without bound; doubles from 2**53 on are whole."""
    return np.array([int(v) * 256 if abs(v) >= 2**53 else math.floor(256 * v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


class Postings:
    """The posting lists of one shard, in both directions of every dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.low_end, self.high_end = ids, x.min(axis=0), x.max(axis=0)
        at = min(len(x) - 1, int(HIGH * len(x)))
        self.sides = []
        for reach in (x - self.low_end, self.high_end - x):  # up, down
            cut = np.partition(reach, at, axis=0)[at]
            low = np.ascontiguousarray(np.minimum(reach, cut).T)
            beyond = np.maximum(reach - cut, 0).T
            rows = [np.flatnonzero(b) for b in beyond]
            self.sides.append((cut, beyond.max(axis=1), low, np.ascontiguousarray(beyond), rows))

    def top(self, weights: np.ndarray, own: int, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best of the rows that reach the threshold."""
        base = float(np.where(weights > 0, weights * self.low_end, weights * self.high_end).sum())
        terms = []  # (bound, high part?, dimension)
        for d in np.flatnonzero(weights).tolist():
            cut, beyond = self.sides[int(weights[d] < 0)][:2]
            terms += [(abs(weights[d]) * cut[d], False, d), (abs(weights[d]) * beyond[d], True, d)]
        terms = sorted(t for t in terms if t[0] > 0)
        sums = np.cumsum([base, *(t[0] for t in terms)])
        few = int(np.searchsorted(sums[1:], threshold, side="left"))  # terms that can't reach it together
        if sums[0] >= threshold:
            few = 0
        elif few == len(terms):
            return np.empty(0, dtype=np.int64), np.empty(0)
        got = np.zeros(len(self.ids))
        for _, high, d in terms[few:]:
            _, _, low, beyond, rows = self.sides[int(weights[d] < 0)]
            if high:
                got[rows[d]] += abs(weights[d]) * beyond[d][rows[d]]
            else:
                got += abs(weights[d]) * low[d]
        # sums[few] is the base score with all that non-essential terms can add
        live = np.flatnonzero((self.ids != own) & ((got > 0) | (few == 0)) & (got + sums[few] >= threshold))
        got = got[live]
        for i in range(few - 1, -1, -1):
            _, high, d = terms[i]
            got += abs(weights[d]) * self.sides[int(weights[d] < 0)][3 if high else 2][d][live]
            if i % 4 == 0:
                keep = got + sums[i] >= threshold
                live, got = live[keep], got[keep]
                if not len(live):
                    break
        score = got + base
        at = best(score, self.ids[live], k)
        return live[at], score[at]


def top_wide(x: np.ndarray, ids: np.ndarray, weights: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
    """The same where sums don't fit: exact products, scores held to the ends of long."""
    live = np.flatnonzero(ids != own)
    exact = [min(max(v, LONG[0]), LONG[1]) for v in (x[live] @ weights).tolist()]
    order = sorted(range(len(live)), key=lambda i: (-exact[i], ids[live[i]]))[:k]
    return live[order], [exact[i] for i in order]


def _packed(size: int, dims: int):
    """A row per block: ids and the matrix as bytes, rows with components past WIDE apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks_of(batches, size, dims):
            wide = np.abs(x).max(axis=1) > WIDE
            for part in (~wide, wide):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([ids[part].tobytes()], pa.binary()), "x": pa.array([x[part].tobytes()], pa.binary())})

    return run


def _search(k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thresholds: dict[int, np.ndarray] = {}  # of each query of each block; k rows are known to reach it
        shard: tuple | None = None
        for batch in batches:
            for block, q_ids, q_x, part, v_ids, v_x in zip(*(batch.column(c).to_pylist() for c in ("q", "q_ids", "q_x", "shard", "ids", "x"))):
                own, raw = np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(q_x).reshape(-1, dims)
                if shard is None or shard[0] != part:
                    x = np.frombuffer(v_x).reshape(-1, dims)
                    ids, fits = np.frombuffer(v_ids, dtype=np.int64), np.abs(x).max() <= WIDE and dims <= 4096
                    shard = (part, ids, x, Postings(ids, quantised(x)) if fits else None)
                _, ids, x, postings = shard
                threshold = thresholds.setdefault(block, np.full(len(own), -np.inf))
                exact = postings is None or np.abs(raw).max() > WIDE
                asked, numbers = (whole_numbers(raw), whole_numbers(x)) if exact else (quantised(raw), None)
                out: list[tuple] = []
                for q, weights in enumerate(asked):
                    rows, scores = top_wide(numbers, ids, weights, own[q], k) if exact else postings.top(weights, own[q], k, threshold[q])
                    if len(rows) == k and not exact:
                        threshold[q] = max(threshold[q], scores[-1])
                    out += [(int(own[q]), (block << 20) + q, i, int(s)) for i, s in zip(ids[rows].tolist(), scores)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192, query_block: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` highest integer inner products."""
    spark = vectors.sparkSession
    dims = usual_length(vectors)
    blocks_sql = "ids binary, x binary"
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = clean(vectors, dims).mapInArrow(_packed(block, dims), blocks_sql)
    shards = staged(shards.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("shard")), "shards")
    asked = clean(queries, dims).distinct().mapInArrow(_packed(query_block, dims), blocks_sql)
    asked = staged(asked.select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__n")), "query-blocks")
    # block numbers: partition and place in it, small enough to number queries too
    asked = asked.select("q_ids", "q_x", (F.shiftleft(F.col("__p").cast("long"), 20) + F.col("__n").bitwiseAND((1 << 20) - 1)).alias("q"))
    last = shards.agg(F.max("part")).first()[0]
    if last is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # each query block meets each shard: blocks x shards rows, each a matrix product's worth
    dealt = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = dealt.repartition(n, "part").join(shards.hint("shuffle_hash"), "part")
    found = pairs.select("q", "q_ids", "q_x", "shard", "ids", "x").mapInArrow(_search(k, dims), _OUT_SQL)
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
