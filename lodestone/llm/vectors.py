"""Vectors in blocks, for searches of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str = "embedding", nonzero: bool = False) -> Column:
    """True for vectors that take part: not null or empty, every component a finite number."""
    x = F.col(col)
    inf = F.lit(float("inf"))
    good = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf))
    if nonzero:
        good = good & F.exists(x, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


def usual_length(table: DataFrame) -> int | None:
    """The length that most vectors have, the smaller of equals; None without any."""
    sizes = table.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).groupBy(F.size("embedding").alias("d")).count()
    first = sizes.orderBy(F.desc("count"), "d").first()
    return first.d if first else None


def clean(table: DataFrame, dims: int, nonzero: bool = False) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors of length ``dims`` that take part."""
    rows = table.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dims)).where(usable(nonzero=nonzero))
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))


def matrix_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch, all of which have ``dims`` components."""
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def blocks_of(batches: Iterator[pa.RecordBatch], size: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of ``size`` rows at most from batches of (vec_id, embedding)."""
    ids, rows, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            if held + part.num_rows > size:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows, held = [], [], 0
            ids.append(part.column("vec_id").to_numpy())
            rows.append(matrix_of(part, dims))
            held += part.num_rows
    if held:
        yield np.concatenate(ids), np.concatenate(rows)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, the highest first, ties to the smaller id."""
    if k < len(scores):
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
