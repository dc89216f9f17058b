"""Project tables as views for ad-hoc SQL, under fixed names and types.

Dips are negative down in every view. Nothing is copied: a view is the plan of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_extra(rows: DataFrame, base: dict[str, str]) -> DataFrame:
    """The base columns by name and type (null where a table lacks them), then the others."""
    have = {c.lower(): c for c in rows.columns}
    cols = [(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in base.items()]
    low = {c.lower() for c in base}
    return rows.select(*cols, *(c for c in rows.columns if c.lower() not in low))


def collars(rows: DataFrame) -> DataFrame:
    return _with_extra(rows, {"hole_id": "string", "x": "double", "y": "double", "z": "double", "azimuth": "double", "dip": "double", "length": "double"})


def survey(rows: DataFrame) -> DataFrame:
    return _with_extra(rows, {"hole_id": "string", "depth": "double", "azimuth": "double", "dip": "double"})


def layer(rows: DataFrame) -> DataFrame:
    """An interval or point log: its bounds or depth, then value, extra and description, then the rest."""
    have = {c.lower() for c in rows.columns}
    base = {"hole_id": "string"} | ({"from": "double", "to": "double"} if "from" in have else {}) | ({"depth": "double"} if "depth" in have else {})
    return _with_extra(rows, base | {"value": "string", "extra": "double", "description": "string"})


def boundaries(rows: DataFrame) -> DataFrame:
    """One row per boundary: its parts and vertices counted from ``parts``, arrays of points."""
    count = F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p))
    told = rows.withColumns({"part_count": F.size("parts"), "vertex_count": count}).drop("parts")
    return _with_extra(told, {"name": "string", "kind": "string", "status": "string", "part_count": "int", "vertex_count": "int"})


def surface_samples(rows: DataFrame, elements: list[str], attributes: list[str]) -> DataFrame:
    """Samples with a column per element; the attributes that a row has go as JSON."""
    some = F.greatest(*(F.col(a).isNotNull().cast("int") for a in attributes), F.lit(0)) > 0
    told = rows.withColumn("attrs", F.when(some, F.to_json(F.struct(*attributes))))
    return _with_extra(told.drop(*attributes), {"sample_id": "string", "x": "double", "y": "double", "z": "double", "medium": "string", "attrs": "string"} | {e: "double" for e in elements})


def publish(tables: dict[str, DataFrame]) -> list[str]:
    """Make the tables views; returns their names."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
    return sorted(tables)
