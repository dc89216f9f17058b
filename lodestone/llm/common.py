"""What the operators share: the shared folder, staged tables, row identity, Arrow output."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.staging import fresh_dir, shared_dir, staged  # noqa: F401

_HELD: dict[str, Callable[[], None]] = {}


def holds(name: str, drop: Callable[[], None]) -> None:
    """Say that this worker process now keeps the caches of ``name``; those of others are dropped.

    Workers outlive stages, so the caches of operators that are done would add up.
    """
    for other in [n for n in _HELD if n != name]:
        _HELD.pop(other)()
    _HELD[name] = drop


#: Stands for a null document id inside an operator: it sorts before every real id.
NULL_ID = -(2**63)


def ident(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that tell rows apart: ``__did`` (null ids as NULL_ID) and ``__tkey``.

    Rows with equal id and equal text are the same document to every operator.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__did"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__tkey"),
    ]


def packed(docs: DataFrame, *inner: Column) -> DataFrame:
    """All of a caller's columns as one struct ``row``, and the operator's own beside it.

    So no name of an operator's own can meet one of the caller's.
    """
    return docs.select(F.struct("*").alias("row"), *inner)


def unpacked(df: DataFrame, columns: list[str], text: Column | None = None) -> list[Column]:
    """The caller's columns out of ``row``, with another ``text`` where one is given."""
    return [text.alias(c) if text is not None and c.lower() == "text" else F.col("row").getField(c).alias(c) for c in columns]


def binary_values(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def signed64(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the caller's columns of these names, for which results stand."""
    low = {n.lower() for n in names}
    return docs.select(*(docs[c] for c in docs.columns if c.lower() not in low))


def frequent(counts: DataFrame, col: str, size: int) -> Column:
    """Says which rows are among the ``size`` of the highest counts: all down to a class of counts.

    Counts fall into some hundred classes by their logarithm; those that fit in whole are taken.
    """
    level = F.floor(F.log2(col) * 8).cast("int")
    least, held = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if held + r["count"] > size:
            break
        least, held = r["level"], held + r["count"]
    return level >= least if least is not None else F.lit(False)
