"""Quality control: standards, duplicates and the rule catalogue of data checks.

A check is one scan: each rule is a condition, and the rules a row breaks are exploded into
issue rows ``severity, category, rule, hole, from_, to_``. Checks between rows use one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISSUE = ["severity", "category", "rule", "hole", "from_", "to_"]


def _issues(rows: DataFrame, category: str, rules: list[tuple[str, str, Column]], lo: str, hi: str) -> DataFrame:
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in rules)), lambda x: x.isNotNull())
    return rows.withColumn("__i", F.explode(found)).select("__i.severity", F.lit(category).alias("category"), "__i.rule", F.col("hole"), F.col(lo).cast("double").alias("from_"), F.col(hi).cast("double").alias("to_"))


def interval_issues(rows: DataFrame, collars: DataFrame, category: str = "Intervals", value: str = "value", least: float | None = None, most: float | None = None) -> DataFrame:
    """Issues of an interval table; ``collars`` has ``hole, length``."""
    order = Window.partitionBy("hole").orderBy("from_", "to_")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    j = rows.join(collars.select("hole", F.col("length").alias("__end"), F.lit(True).alias("__known")), "hole", "left")
    j = j.withColumns({"__reach": F.max("to_").over(before), "__pf": F.lag("from_").over(order), "__pt": F.lag("to_").over(order)})
    f, t, v = F.col("from_"), F.col("to_"), F.col(value)
    same = (f == F.col("__pf")) & (t == F.col("__pt"))
    rules = [
        ("error", "bound missing", f.isNull() | t.isNull()),
        ("error", "from after to", f > t),
        ("error", "negative depth", (f < 0) | (t < 0)),
        ("warning", "zero length", f == t),
        ("warning", "beyond end of hole", t > F.col("__end") + 1e-6),
        ("error", "no collar", F.col("__known").isNull()),
        ("info", "no value", v.isNull()),
        ("warning", "overlap", (F.col("__reach") > f + 1e-6) & ~F.coalesce(same, F.lit(False))),
        ("warning", "duplicate interval", same),
        ("info", "gap", F.col("__reach") < f - 1e-6),
    ]
    if least is not None:
        rules.append(("warning", "value below range", v < least))
    if most is not None:
        rules.append(("warning", "value above range", v > most))
    return _issues(j, category, rules, "from_", "to_")


def collar_issues(collars: DataFrame) -> DataFrame:
    """``hole, x, y, z, azimuth, dip, length``: missing places, odd angles, repeats, shared places."""
    n = F.count("*").over(Window.partitionBy("hole"))
    place = F.count("*").over(Window.partitionBy(F.round("x"), F.round("y"), F.round("z")))
    j = collars.withColumns({"__n": n, "__same": place})
    rules = [
        ("error", "no hole id", F.col("hole").isNull()),
        ("error", "no position", F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()),
        ("warning", "azimuth outside 0-360", (F.col("azimuth") < 0) | (F.col("azimuth") > 360)),
        ("warning", "dip outside -90-90", F.abs("dip") > 90),
        ("warning", "length not positive", F.col("length") <= 0),
        ("warning", "repeated hole id", F.col("__n") > 1),
        ("warning", "shared position", (F.col("__same") > 1) & F.col("x").isNotNull()),
    ]
    return _issues(j.withColumn("__z", F.lit(0.0)), "Collars", rules, "__z", "length")


def survey_issues(stations: DataFrame, collars: DataFrame) -> DataFrame:
    """``hole, depth, azimuth, dip``: bad values, repeats, doglegs in degrees per 30 m, missing collars."""
    order = Window.partitionBy("hole").orderBy("depth")
    j = stations.join(collars.select("hole", F.col("length").alias("__end"), F.lit(True).alias("__known")), "hole", "left")
    j = j.withColumns({"__d": F.lag("depth").over(order), "__a": F.lag("azimuth").over(order), "__i": F.lag("dip").over(order)})
    step = F.col("depth") - F.col("__d")
    i0, i1, turn = F.radians("__i"), F.radians("dip"), F.radians(F.col("azimuth") - F.col("__a"))
    bend = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(i0) * F.sin(i1) + F.cos(i0) * F.cos(i1) * F.cos(turn)))))
    rate = bend * 30 / F.nullif(step, F.lit(0.0))
    rules = [
        ("error", "depth missing or negative", F.col("depth").isNull() | (F.col("depth") < 0)),
        ("warning", "azimuth outside 0-360", (F.col("azimuth") < 0) | (F.col("azimuth") > 360)),
        ("warning", "dip outside -90-90", F.abs("dip") > 90),
        ("warning", "repeated depth", step == 0),
        ("error", "no collar", F.col("__known").isNull()),
        ("warning", "below end of hole", F.col("depth") > F.col("__end") + 1e-6),
        ("warning", "dogleg", (step >= 10) & (bend >= 2) & (rate >= 3) & ~((rate >= 20) & (bend >= 5))),
        ("error", "dogleg", (step >= 10) & (bend >= 5) & (rate >= 20)),
        ("warning", "points upward", F.col("dip") > 0),
    ]
    return _issues(j, "Survey", rules, "__d", "depth")


def duplicate_pairs(samples: DataFrame, keys: list[str], order: str, value: str, limit_pct: float) -> DataFrame:
    """Later rows of the same keys against the first: ``v1, v2, rpd, within``; equal repeats aren't pairs."""
    w = Window.partitionBy(*keys).orderBy(order)
    j = samples.where(F.col(value).isNotNull()).withColumns({"v1": F.first(value).over(w), "__n": F.row_number().over(w)})
    pairs = j.where((F.col("__n") > 1) & (F.col(value) != F.col("v1"))).withColumn("v2", F.col(value))
    rpd = F.abs(F.col("v1") - F.col("v2")) / F.nullif((F.col("v1") + F.col("v2")) / 2, F.lit(0.0)) * 100
    return pairs.select(*keys, order, "v1", "v2", rpd.alias("rpd"), (rpd <= limit_pct).alias("within"))


def duplicate_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("within"), 1)).alias("n_within"), F.avg("rpd").alias("mean_rpd"))


def blank_failures(rows: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col(value) > limit, 1)).alias("n_failed"), F.max(value).alias("most"))


def classify_qc(sample_type: Column, code: Column, known: Column) -> Column:
    """regular, blank, duplicate or standard: by sample type, then a known hole, then what the code says."""
    t, c = F.lower(F.coalesce(sample_type, F.lit(""))), F.lower(F.coalesce(code, F.lit("")))
    named = lambda x: F.when(x.contains("blank"), "blank").when(x.contains("dup"), "duplicate").when(x.rlike("std|standard|crm|oreas"), "standard")
    return F.coalesce(named(t), F.when(known, "regular"), named(c), F.lit("regular"))
