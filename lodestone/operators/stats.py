"""Statistics with and without weights, over groups; all of them aggregates or windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.staging import staged


def cumulative(rows: DataFrame, by: list[str], value: str, weight: Column | None = None, cuts: int = 128) -> DataFrame:
    """Per distinct value: its weight ``w``, the weight ``cum`` up to it and the group's ``total``.

    A group may be most of the table, so it isn't sorted by one task: values are cut into
    buckets of about equal counts (an approximate aggregate), buckets are summed first, and
    a window runs inside each bucket on top of the sum of those before. The cuts only decide
    who does the work. Rows with a null value or group take no part.
    """
    held = rows.where(F.col(value).isNotNull())
    for c in by:
        held = held.where(F.col(c).isNotNull())
    marks = held.agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 20 * cuts)).first()[0]
    marks = sorted(set(marks or []))
    one = held.groupBy(*by, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("w"))
    kind = f"array<{dict(held.dtypes)[value]}>"
    one = one.withColumn("__b", F.size(F.filter(F.lit(marks).cast(kind), lambda m: m <= F.col(value))) if marks else F.lit(0))
    sums = one.groupBy(*by, "__b").agg(F.sum("w").alias("__s"))
    group = Window.partitionBy(*by)
    before = F.sum("__s").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "__b", F.coalesce(before, F.lit(0)).alias("__o"), F.sum("__s").over(group).alias("total"))
    run = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("__c", F.sum("w").over(run)).join(sums, [*by, "__b"]).select(*by, value, "w", (F.col("__o") + F.col("__c")).alias("cum"), "total")


def nearest_rank(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The value at rank round(p (n - 1)), halves up."""
    rank = F.floor((F.col("total") - 1) * p + 0.5)  # from 0
    held = cumulative(rows, by, value).where((F.col("cum") > rank) & (F.col("cum") - F.col("w") <= rank))
    return held.select(*by, F.col(value).alias("quantile"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Type-7 quantiles, exact and without a group in one task: a column for each named share, and ``n``."""
    cum = cumulative(rows, by, value)

    def one(p: float) -> Column:
        place = (F.col("total") - 1) * p
        low = F.floor(place)
        at = lambda k: F.max(F.when((F.col("cum") > k) & (F.col("cum") - F.col("w") <= k), F.col(value)))
        return at(low) + (F.coalesce(at(low + 1), at(low)) - at(low)) * F.max(place - low)

    return cum.groupBy(*by).agg(F.max("total").cast("long").alias("n"), *(one(p).alias(name) for name, p in shares.items()))


def length_percentile(rows: DataFrame, by: list[str], value: str, weight: str, p: float) -> DataFrame:
    """The smallest value whose cumulative weight reaches the share ``p`` of the whole."""
    cum = cumulative(rows.where(F.col(weight) > 0), by, value, F.col(weight))
    return cum.where(F.col("cum") >= F.col("total") * p).groupBy(*by).agg(F.min(value).alias("quantile"))


def weighted_summary(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """n, weight, mean, reliability-weights variance (V1 - V2/V1) and coefficient of variation in %."""
    v, w = F.col(value), F.col(weight)
    held = rows.where(v.isNotNull() & (w > 0))
    s = held.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), F.sum(w * w).alias("__w2"), F.sum(w * v).alias("__s"), F.sum(w * v * v).alias("__q"), F.min(v).alias("least"), F.max(v).alias("most"))
    mean = F.col("__s") / F.col("weight")
    spread = (F.col("__q") - F.col("__s") * F.col("__s") / F.col("weight")) / F.nullif(F.col("weight") - F.col("__w2") / F.col("weight"), F.lit(0.0))
    return s.select(*by, "n", "weight", "least", "most", mean.alias("mean"), spread.alias("variance"), (100 * F.sqrt(F.greatest(spread, F.lit(0.0))) / F.nullif(mean, F.lit(0.0))).alias("cv"))


def cap_audit(rows: DataFrame, by: list[str], value: str, weight: str, cap: float) -> DataFrame:
    """What a cap does: samples above it, metal and the share of metal that it takes."""
    v, w = F.col(value), F.col(weight)
    over = v > cap
    s = rows.where(v > 0).groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(over, 1)).alias("n_capped"), F.sum(v * w).alias("metal"), F.coalesce(F.sum(F.when(over, (v - cap) * w)), F.lit(0.0)).alias("removed"))
    return s.withColumn("removed_pct", 100 * F.col("removed") / F.col("metal"))


def top_metal(rows: DataFrame, value: str, weight: str, tops: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50, 100)) -> DataFrame:
    """Share of all metal in the richest samples; a top-k by order and limit, then one aggregate."""
    metal = rows.where(F.col(value) > 0).select((F.col(value) * F.col(weight)).alias("metal"), F.col(value).alias("v"))
    total = metal.agg(F.sum("metal").alias("all"))
    most = metal.orderBy(F.desc("v"), F.desc("metal")).limit(max(tops))
    ranked = most.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("v"), F.desc("metal"))))
    sums = ranked.agg(*(F.sum(F.when(F.col("rank") <= k, F.col("metal"))).alias(f"top{k}") for k in tops))
    stacked = sums.selectExpr(f"stack({len(tops)}, {', '.join(f'{k}L, top{k}' for k in tops)}) as (top, metal)")
    return stacked.withColumn("__k", F.lit(1)).join(F.broadcast(total.withColumn("__k", F.lit(1))), "__k").select("top", "metal", (F.col("metal") / F.col("all")).alias("share"))


def above_cutoffs(rows: DataFrame, value: str, weight: str, cutoffs: list[float]) -> DataFrame:
    """For each cut-off: samples, metres, metal and mean at or above it, with shares of the whole.

    One pass: every cut-off is a conditional aggregate of the same scan.
    """
    v, w = F.col(value), F.col(weight)
    cuts = sorted(set(cutoffs))
    aggs: list[Column] = [F.count("*").alias("n"), F.sum(w).alias("m"), F.sum(F.when(v > 0, v * w)).alias("g")]
    for i, c in enumerate(cuts):
        hit = v >= c
        aggs += [F.count(F.when(hit, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(hit, w)), F.lit(0.0)).alias(f"m{i}"), F.coalesce(F.sum(F.when(hit & (v > 0), v * w)), F.lit(0.0)).alias(f"g{i}")]
    one = rows.where(v.isNotNull()).agg(*aggs)
    wide = one.selectExpr("n", "m", "g", f"stack({len(cuts)}, {', '.join(f'{float(c)}D, n{i}, m{i}, g{i}' for i, c in enumerate(cuts))}) as (cutoff, n_above, metres_above, metal_above)")
    return wide.select("cutoff", "n_above", "metres_above", "metal_above", (F.col("n_above") / F.col("n")).alias("n_share"), (F.col("metres_above") / F.col("m")).alias("metres_share"), (F.col("metal_above") / F.col("g")).alias("metal_share"))


def control_limits(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per standard (two results or more): mean, SD (n - 1) and results beyond 2 and 3 SD.

    Sums are taken of the distance from a reference value of the group, so nothing cancels.
    """
    v = F.col(value)
    ref = rows.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).where("n >= 2")
    dev = F.abs(v - F.col("mean"))
    flagged = rows.where(v.isNotNull()).join(ref, by)
    beyond = flagged.groupBy(*by).agg(F.count(F.when(dev > 2 * F.col("sd"), 1)).alias("beyond_2sd"), F.count(F.when(dev > 3 * F.col("sd"), 1)).alias("beyond_3sd"))
    return ref.join(beyond, by)


def box_by_code(rows: DataFrame, code: str, value: str, least_n: int = 3) -> DataFrame:
    """Type-7 quartiles, mean and count of a value by code; codes with few readings are left out."""
    means = rows.where(F.col(value).isNotNull()).groupBy(code).agg(F.avg(value).alias("mean"))
    quarts = quantiles(rows, [code], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    return quarts.where(F.col("n") >= least_n).join(means, code).select(code, "n", "mean", "p25", "p50", "p75", "p90")


def population_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Positive values: n, zeros, median, MAD x 1.4826, mean and SD of log10, Tukey fence in log10."""
    v = F.col(value)
    pos = rows.where(v > 0)
    lg = F.log10(v)
    zeros = rows.groupBy(*by).agg(F.count(F.when(v <= 0, 1)).alias("n_zero"))
    mid = quantiles(pos, by, value, {"median": 0.5})
    logs = pos.select(*by, lg.alias("__lg"))
    fence = quantiles(logs, by, "__lg", {"__q1": 0.25, "__q3": 0.75}).drop("n")
    mean = logs.groupBy(*by).agg(F.avg("__lg").alias("log_mean"), F.stddev_samp("__lg").alias("log_sd"))
    away = pos.join(mid.select(*by, "median"), by).select(*by, F.abs(v - F.col("median")).alias("__away"))
    spread = quantiles(away, by, "__away", {"__mad": 0.5}).drop("n")
    out = zeros.join(mid, by).join(mean, by).join(fence, by).join(spread, by)
    return out.select(*by, "n", "n_zero", "median", (1.4826 * F.col("__mad")).alias("mad"), "log_mean", "log_sd", F.pow(F.lit(10.0), F.col("__q3") + 1.5 * (F.col("__q3") - F.col("__q1"))).alias("tukey_fence"))


def average_ranks(rows: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 with the mean rank for ties, from one count per distinct value."""
    by = by or []
    ranks = cumulative(rows, by, value).select(*by, value, (F.col("cum") - F.col("w") + (F.col("w") + 1) / 2).alias(out))
    return rows.join(ranks, [*by, value])


def pearson(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """n and r over rows that have both values."""
    held = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return held.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """n and rho over rows that have both values.

    Rows are first counted by their pair of values, so ranks are joined to distinct pairs and
    not to rows; the mean of ranks is (n + 1) / 2 whatever the ties.
    """
    by = by or []
    pairs = staged(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("__k")), "pairs")

    def ranks(v: str, out: str) -> DataFrame:
        rank = F.col("cum") - F.col("w") + (F.col("w") + 1) / 2 - (F.col("total") + 1) / 2
        return cumulative(pairs, by, v, F.col("__k")).select(*by, v, rank.alias(out))

    met = pairs.join(ranks(x, "__rx"), [*by, x]).join(ranks(y, "__ry"), [*by, y])
    k, rx, ry = F.col("__k"), F.col("__rx"), F.col("__ry")
    sums = met.groupBy(*by).agg(F.sum(k).alias("n"), F.sum(k * rx * ry).alias("__xy"), F.sum(k * rx * rx).alias("__xx"), F.sum(k * ry * ry).alias("__yy"))
    return sums.select(*by, "n", (F.col("__xy") / F.nullif(F.sqrt(F.col("__xx")) * F.sqrt(F.col("__yy")), F.lit(0.0))).alias("r"))


def line_fit(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares: slope, intercept, r2 and n."""
    held = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return held.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def probability_points(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Each distinct value's plotting position: (cumulated weight - half its own) / total."""
    cum = cumulative(rows.where(F.col(weight) > 0), by, value, F.col(weight))
    return cum.select(*by, value, ((F.col("cum") - F.col("w") / 2) / F.col("total")).alias("position"))


def class_breaks(rows: DataFrame, value: str, classes: int, rule: str = "quantile") -> DataFrame:
    """Class edges by equal widths or equal counts (type 7): ``class, upper``."""
    held = rows.where(F.col(value).isNotNull())
    if rule == "equal":
        one = held.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        return one.select(F.explode(F.sequence(F.lit(1), F.lit(classes))).alias("class"), "lo", "hi").select("class", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("class") / classes).alias("upper"))
    one = quantiles(held, [], value, {f"q{i}": i / classes for i in range(1, classes + 1)})
    stacked = ", ".join(f"{i}, q{i}" for i in range(1, classes + 1))
    return one.selectExpr(f"stack({classes}, {stacked}) as (class, upper)")


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, average ranks on ties: ``n_pos, n_neg, auc``."""
    ranked = average_ranks(rows.where(F.col(score).isNotNull()), score, "__r")
    s = ranked.agg(F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("__s"), F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"), F.count(F.when(F.col(label) != 1, 1)).alias("n_neg"))
    return s.select("n_pos", "n_neg", ((F.col("__s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def two_segment_break(rows: DataFrame, x: str, y: str, by: list[str] | None = None, least: int = 8, cuts: int = 128) -> DataFrame:
    """Where two straight lines, fitted apart, follow the points best: ``n, k, at, sse, sse_one, slope_low, slope_high``.

    Points go by ``x``, then ``y``; the upper line begins with point ``k`` (from 0) at ``at``; each line has ``least`` points or more, so
    a group with fewer than twice as many has no row. Of equal breaks the first counts. Sums of moments run inside buckets of about
    equal counts on top of those before, so all breaks are scored in one pass and no group is one task's.
    """
    by = by or []
    held = rows.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    for c in by:
        held = held.where(F.col(c).isNotNull())
    marks = held.agg(F.percentile_approx("x", [i / cuts for i in range(1, cuts)], 20 * cuts), F.avg("x"), F.avg("y")).first()
    edges = sorted(set(marks[0] or []))
    # about the middle, so that squares stay small; lines don't change by it
    held = held.withColumns({"u": F.col("x") - F.lit(marks[1] or 0.0), "v": F.col("y") - F.lit(marks[2] or 0.0)})
    held = held.withColumn("__b", F.size(F.filter(F.lit(edges).cast("array<double>"), lambda m: m <= F.col("x"))) if edges else F.lit(0))
    moments = {"n": F.lit(1), "x": F.col("u"), "y": F.col("v"), "xx": F.col("u") * F.col("u"), "xy": F.col("u") * F.col("v"), "yy": F.col("v") * F.col("v")}
    held = staged(held, "points")
    group = Window.partitionBy(*by)
    sums = held.groupBy(*by, "__b").agg(*(F.sum(m).alias(f"s_{k}") for k, m in moments.items()))
    before = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__b", *(F.coalesce(F.sum(f"s_{k}").over(before), F.lit(0)).alias(f"o_{k}") for k in moments), *(F.sum(f"s_{k}").over(group).alias(f"t_{k}") for k in moments))
    run = Window.partitionBy(*by, "__b").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1)
    each = held.select(*by, "__b", "x", *(F.coalesce(F.sum(m).over(run), F.lit(0)).alias(f"r_{k}") for k, m in moments.items())).join(sums, [*by, "__b"])
    low = {k: F.col(f"o_{k}") + F.col(f"r_{k}") for k in moments}
    whole = {k: F.col(f"t_{k}") for k in moments}
    high = {k: whole[k] - low[k] for k in moments}

    def line(s: dict[str, Column]) -> tuple[Column, Column]:
        sxx, sxy, syy = (s[a] - s[b] * s[c] / s["n"] for a, b, c in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
        slope = F.when(sxx > 0, sxy / F.nullif(sxx, F.lit(0.0))).otherwise(0.0)
        return F.greatest(F.lit(0.0), syy - slope * sxy), slope

    open_ = each.where((low["n"] >= least) & (high["n"] >= least))
    (e0, s0), (e1, s1), (one, _) = line(low), line(high), line(whole)
    scored = open_.select(*by, whole["n"].alias("n"), low["n"].alias("k"), F.col("x").alias("at"), (e0 + e1).alias("sse"), one.alias("sse_one"), s0.alias("slope_low"), s1.alias("slope_high"))
    best = scored.groupBy(*by).agg(F.min(F.struct("sse", "k", "at", "n", "sse_one", "slope_low", "slope_high")).alias("b"))
    return best.where("b is not null").select(*by, "b.n", "b.k", "b.at", "b.sse", "b.sse_one", "b.slope_low", "b.slope_high")
