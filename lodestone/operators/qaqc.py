"""What the results themselves say of a laboratory's limits, units and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import stats


def _counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A row per distinct value with its count ``k``; all below works on these."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("k"))


def zero_steps(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups whose zeros lie below a reporting step: ``step`` (smallest positive value) and ``zeros``.

    Zeros count if there are 20 of them and they are a twentieth of the results.
    """
    s = _counts(rows, by, value).groupBy(*by).agg(F.min(F.when(F.col("v") > 0, F.col("v"))).alias("step"), F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("k"))), F.lit(0)).alias("zeros"), F.sum(F.when(F.col("v") > 0, F.col("k"))).alias("__pos"))
    return s.where((F.col("__pos") > 0) & (F.col("zeros") >= 20) & (F.col("zeros") / (F.col("zeros") + F.col("__pos")) >= 0.05)).select(*by, "step", "zeros")


def censoring_floor(rows: DataFrame, by: list[str], value: str, min_share: float = 0.05) -> DataFrame:
    """Groups whose smallest positive value holds so many results that it reads as half a detection limit.

    ``floor, n, share, dl, next``: at least 20 results and ``min_share`` of the positive ones lie
    on it, and zeros don't make it a reporting step; ``next`` is the next value above.
    """
    counts = _counts(rows, by, value)
    low = counts.where("v > 0").groupBy(*by).agg(F.min("v").alias("floor"), F.sum("k").alias("__pos"))
    on = (F.col("v") > 0) & (F.col("v") <= F.col("floor") * (1 + 1e-9))
    met = counts.join(low, by).groupBy(*by, "floor", "__pos").agg(F.sum(F.when(on, F.col("k"))).alias("n"), F.min(F.when((F.col("v") > 0) & ~on, F.col("v"))).alias("next"))
    met = met.join(zero_steps(rows, by, value).select(*by), by, "left_anti").withColumn("share", F.col("n") / F.col("__pos"))
    return met.where((F.col("n") >= 20) & (F.col("share") >= min_share)).select(*by, "floor", "n", "share", F.round(F.col("floor") * 2, 9).alias("dl"), "next")


def censoring_ceiling(rows: DataFrame, by: list[str], value: str, least: int = 5) -> DataFrame:
    """Groups whose largest value is round and held by many results: an upper limit whose ">" was lost.

    ``ceiling, n, next``: at least ``least`` results on it, more than twice those on the next value
    down, and no more than two significant figures.
    """
    counts = _counts(rows, by, value)
    high = counts.groupBy(*by).agg(F.max("v").alias("ceiling")).where("ceiling > 0")
    size = F.pow(F.lit(10.0), F.floor(F.log10("ceiling")) - 1)
    high = high.where(F.abs(F.round(F.col("ceiling") / size) * size - F.col("ceiling")) <= F.col("ceiling") * 1e-9)
    on = F.col("v") >= F.col("ceiling") * (1 - 1e-9)
    met = counts.join(high, by).groupBy(*by, "ceiling").agg(F.sum(F.when(on, F.col("k"))).alias("n"), F.coalesce(F.max_by(F.when(~on, F.col("k")), F.when(~on, F.col("v"))), F.lit(0)).alias("next"))
    return met.where((F.col("n") >= least) & (F.col("n") > 2 * F.col("next")))


def floor_elements(rows: DataFrame, element: str, value: str, min_share: float) -> DataFrame:
    """Elements with at least ``min_share`` of their results on the floor: ``element, share, floor, dl``."""
    return censoring_floor(rows, [element], value).where(F.col("share") >= min_share).select(element, "share", "floor", "dl")


def percent_reading_ppm(rows: DataFrame, element: str, value: str) -> DataFrame:
    """Elements given in per cent whose positive results have a median over 100: ``median, most, n``."""
    held = rows.where((F.col(value) > 0) & ~F.isnan(value))
    most = held.groupBy(element).agg(F.max(value).alias("most"))
    return stats.quantiles(held, [element], value, {"median": 0.5}).where("n >= 3 and median > 100").join(most, element).select(element, "median", "most", "n")


def group_means(rows: DataFrame, by: list[str], values: list[str], require: list[str]) -> DataFrame:
    """Means and counts of several elements over the rows that carry all required ones, with ``n`` and ``used``."""
    whole = F.lit(True)
    for c in require:
        whole = whole & F.col(c).isNotNull()
    out: list[Column] = [F.count("*").alias("n"), F.count(F.when(whole, 1)).alias("used")]
    for c in values:
        out += [F.avg(F.when(whole, F.col(c))).alias(f"mean_{c}"), F.count(F.when(whole, F.col(c))).alias(f"n_{c}")]
    return rows.groupBy(*by).agg(*out)


def oxide_totals(rows: DataFrame, oxides: list[str]) -> DataFrame:
    """Rows with ``total`` of their oxides in per cent (null unless all are there) and ``over_100``, the oxides above 100."""
    every = F.lit(True)
    total: Column = F.lit(0.0)
    for c in oxides:
        every, total = every & F.col(c).isNotNull(), total + F.coalesce(F.col(c), F.lit(0.0))
    over = F.filter(F.array(*(F.when(F.col(c) > 100, F.lit(c)) for c in oxides)), lambda x: x.isNotNull())
    return rows.select("*", F.when(every, total).alias("total"), over.alias("over_100"))


def outside_tolerance(totals: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Rows whose total lies outside the bounds (either may be missing) or that have an oxide above 100."""
    out = F.size("over_100") > 0
    if low is not None:
        out = out | F.coalesce(F.col("total") < low, F.lit(False))
    if high is not None:
        out = out | F.coalesce(F.col("total") > high, F.lit(False))
    return totals.where(out)


def classes_by_quartile(rows: DataFrame, value: str, least: int = 8) -> DataFrame:
    """Rows with ``class``: 1 to 4 by the quartiles of ``value`` (fewer where quartiles meet), null without a reading.

    Fewer than ``least`` readings give no classes. The one-row quartiles go to every row by a
    constant key.
    """
    marks = stats.quantiles(rows, [], value, {"a": 0.25, "b": 0.5, "c": 0.75}).where(F.col("n") >= least)
    marks = marks.select(F.array_distinct(F.array("a", "b", "c")).alias("__m"), F.lit(1).alias("__one"))
    above = F.size(F.filter("__m", lambda m: m <= F.col(value)))
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(marks), "__one", "left").withColumn("class", F.when(F.col(value).isNotNull() & F.col("__m").isNotNull(), above + 1)).drop("__one", "__m")


def density_by_code(rows: DataFrame, code: str, value: str, low: float, high: float, least: int) -> DataFrame:
    """Mean density of each code and whether it may fill: ``taken``, ``few`` readings or mean ``outside`` the range."""
    s = rows.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).where("n > 0")
    state = F.when(F.col("n") < least, "few").when(F.col("mean").between(low, high), "taken").otherwise("outside")
    return s.select(code, "n", "mean", state.alias("state"))


def robust_scores(rows: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """Positive values with their robust score in log10: distance from the population's median over 1.4826 MAD."""
    held = rows.where(F.col(value) > 0).withColumn("__lg", F.log10(value))
    mid = stats.quantiles(held, by, "__lg", {"__mid": 0.5}).drop("n")
    away = held.join(mid, by).withColumn("__away", F.abs(F.col("__lg") - F.col("__mid")))
    spread = stats.quantiles(away, by, "__away", {"__mad": 0.5}).drop("n").where("__mad > 0")
    return away.join(spread, by).withColumn(out, (F.col("__lg") - F.col("__mid")) / (1.4826 * F.col("__mad"))).drop("__lg", "__mid", "__away", "__mad")


def pathfinder_index(scores: DataFrame, key: str, elements: list[str]) -> DataFrame:
    """Mean of the robust scores of several elements: at least two, and half of them, must be there."""
    cols = [F.col(e) for e in elements]
    have = F.filter(F.array(*cols), lambda v: v.isNotNull())
    need = max(2, -(-len(elements) // 2))
    mean = F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.size(have)
    return scores.select(key, F.when(F.size(have) >= need, mean).alias("index"))


def anomaly_classes(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Rows with ``class``: how many of the population's quantiles their value reaches."""
    marks = stats.quantiles(rows, by, value, {f"__q{i}": p for i, p in enumerate(shares)}).drop("n")
    reached = F.size(F.filter(F.array(*(F.col(f"__q{i}") for i in range(len(shares)))), lambda q: q <= F.col(value)))
    return rows.where(F.col(value).isNotNull()).join(marks, by).withColumn("class", reached).drop(*(f"__q{i}" for i in range(len(shares))))
