"""Cell semantics of assay tables and filters on columns, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes and texts that mean "no data", units in ppm, oxide factors.
NO_DATA = (-999.0, -999.25, -9999.0, -99999.0, -999999.0)
NO_DATA_TEXT = ("", "na", "n/a", "nan", "null", "none", "-", "ns", "nd")
UNIT_PPM = {"ppb": 0.001, "ppm": 1.0, "g/t": 1.0, "%": 10000.0}
OXIDE_FACTOR = {"Si": 2.1392, "Al": 1.8895, "Fe": 1.4297, "Mg": 1.6583, "Ca": 1.3992, "Na": 1.348, "K": 1.2046, "Ti": 1.6683, "P": 2.2914, "Mn": 1.2912}


def number(cell: Column) -> Column:
    """A cell as a number; blanks, no-data texts and no-data codes are null; a decimal comma counts."""
    text = F.trim(cell.cast("string"))
    plain = F.when(text.rlike(r"^[+-]?\d+,\d+$"), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    value = F.when(~F.lower(text).isin(*NO_DATA_TEXT), plain).try_cast("double")
    return F.when(~value.isin(*NO_DATA) & ~F.isnan(value), value)


def censored(cell: Column) -> Column:
    """``struct(v, q)``: "<x" is half of x with "<", ">x" is x with ">", a negative is half of it with "<"."""
    text = F.trim(cell.cast("string"))
    mark = F.regexp_extract(text, r"^([<>])", 1)
    value = number(F.regexp_replace(text, r"^[<>]\s*", ""))
    v = F.when((mark == "<") | (value < 0), F.abs(value) / 2).otherwise(value)
    q = F.when((mark == "<") | (value < 0), "<").when(mark == ">", ">")
    return F.struct(v.alias("v"), F.when(v.isNotNull(), q).alias("q"))


def convert(value: Column, unit: str, to: str) -> Column:
    return value * (UNIT_PPM[unit] / UNIT_PPM[to])


def as_oxide(value: Column, element: str) -> Column:
    return value * OXIDE_FACTOR[element]


def column_filter(column: Column, text: str, numeric: bool) -> Column:
    """One column's filter: ``>= 6``, ``6..8``, ``= 3``, ``blank``, ``!word``, ``"exact"``, a word."""
    t = text.strip()
    if not t:
        return F.lit(True)
    if t.lower() in ("blank", "!blank"):
        blank = column.isNull() | (F.trim(column.cast("string")) == "")
        return ~blank if t[0] == "!" else blank
    num = r"([+-]?\d+(?:\.\d+)?)"
    if numeric and (m := re.fullmatch(rf"(>=|<=|>|<|=)\s*{num}", t)):
        v = float(m[2])
        return F.coalesce({">=": column >= v, "<=": column <= v, ">": column > v, "<": column < v, "=": column == v}[m[1]], F.lit(False))
    if numeric and (m := re.fullmatch(rf"{num}\s*\.\.\s*{num}", t)):
        return F.coalesce(column.between(float(m[1]), float(m[2])), F.lit(False))
    low = F.lower(column.cast("string"))
    if len(t) > 1 and t[0] == t[-1] == '"':
        return F.coalesce(low == t[1:-1].lower(), F.lit(False))
    if t[0] == "!":
        return ~F.coalesce(low.contains(t[1:].lower()), F.lit(False))
    return F.coalesce(low.contains(t.lower()), F.lit(False))


def filter_table(rows: DataFrame, filters: dict[str, str], search: str = "", order: str | None = None, ascending: bool = True) -> DataFrame:
    """Column filters (all must hold), a search in any column, and an order with blanks last."""
    kinds = dict(rows.dtypes)
    for name, text in filters.items():
        rows = rows.where(column_filter(F.col(name), text, kinds[name] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[name].startswith("decimal")))
    if search:
        hit = F.lit(False)
        for name in kinds:
            hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(search.lower()), F.lit(False))
        rows = rows.where(hit)
    if order:
        rows = rows.orderBy(F.col(order).asc_nulls_last() if ascending else F.col(order).desc_nulls_last())
    return rows


def metal_equivalent(grades: dict[str, Column], prices: dict[str, float], recoveries: dict[str, float], main: str) -> Column:
    """Equivalent grade of the main metal: grades weighed by price times recovery; missing ones add 0."""
    base = prices[main] * recoveries[main]
    out = F.lit(0.0)
    for name, g in grades.items():
        out = out + F.coalesce(g, F.lit(0.0)) * (prices[name] * recoveries[name] / base)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows with the same keys; other rows stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_holes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incoming rows replace all earlier rows of the same hole."""
    return upsert(old, new, ["hole"])


def pivot_long(rows: DataFrame, keys: list[str], symbol: str, value: str, order: str, symbols: list[str]) -> DataFrame:
    """Long results as one row per sample and a column per element; the first by ``order`` wins."""
    first = [F.min_by(F.when(F.col(symbol) == s, F.col(value)), F.when((F.col(symbol) == s) & F.col(value).isNotNull(), F.col(order))).alias(s) for s in symbols]
    return rows.groupBy(*keys).agg(*first)
