"""Downhole intervals: half-open [from, to) ranges along a hole.

Every operator takes a table with the columns ``hole, from_, to_`` and what it names besides.
Order inside a hole is by ``from_, to_`` and never by arrival. Rows of zero or negative length
and rows without bounds take no part unless said otherwise. Joins are equi-joins on the hole,
and on a depth bucket where a hole may be long, with the range as a residual condition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.repeats import COUNT, again, once

EPS = 1e-6


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("to_") > F.col("from_"))


def runs(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows with ``__run``: the number of the run of equal values, touching or overlapping, that they are in."""
    order = Window.partitionBy("hole").orderBy("from_", "to_", value)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("to_").over(before)
    fresh = reach.isNull() | (F.col("from_") > reach + EPS) | ~F.lag(value).over(order).eqNullSafe(F.col(value))
    marked = valid(rows).withColumn("__new", F.when(fresh, 1).otherwise(0))
    return marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_touching(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows of equal value that touch or overlap become one: ``hole, value, from_, to_, n``."""
    return runs(rows, value).groupBy("hole", "__run", value).agg(F.min("from_").alias("from_"), F.max("to_").alias("to_"), F.count("*").alias("n")).drop("__run")


def islands(rows: DataFrame) -> DataFrame:
    """Covered stretches whatever their values: ``hole, from_, to_, n``."""
    return merge_touching(rows.withColumn("__one", F.lit(1)), "__one").drop("__one")


def gaps(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """What of [0, length) no row covers; ``ends`` has ``hole, length``. Holes without rows give one gap."""
    cover = islands(rows).select("hole", "from_", "to_")
    bounds = ends.select("hole", F.lit(0.0).alias("from_"), F.lit(0.0).alias("to_")).unionByName(ends.select("hole", F.col("length").alias("from_"), F.col("length").alias("to_")))
    order = Window.partitionBy("hole").orderBy("from_", "to_")
    held = cover.join(ends, "hole", "left_semi").unionByName(bounds)
    reach = F.max("to_").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = held.withColumn("__reach", reach).where(F.col("from_") > F.col("__reach") + EPS)
    return found.join(ends, "hole").select("hole", F.col("__reach").alias("from_"), F.least("from_", "length").alias("to_")).where(F.col("to_") > F.col("from_") + EPS)


def overlap_summary(rows: DataFrame) -> DataFrame:
    """Rows that begin before the running maximum of the ends above: ``hole, n_rows, n_overlaps, overlap_m``."""
    order = Window.partitionBy("hole").orderBy("from_", "to_")
    reach = F.max("to_").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = valid(rows).withColumn("__over", F.greatest(F.lit(0.0), F.least(F.col("to_"), reach) - F.col("from_")))
    marked = marked.withColumn("__over", F.when(reach.isNull(), 0.0).otherwise(F.col("__over")))
    return marked.groupBy("hole").agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col("__over") > EPS, 1).otherwise(0)).cast("long").alias("n_overlaps"), F.sum("__over").alias("overlap_m"))


def segments(rows: DataFrame, value: str = "value") -> DataFrame:
    """Overlapping rows as disjoint segments with the mean of what covers them.

    ``hole, from_, to_, value, n, conflict``: exact repeats count once, negative values count
    as not assayed, ``conflict`` says that two values or more met. Breakpoints are laid out in
    one sweep per hole; rows meet the segments inside them by depth buckets.
    """
    clean = valid(rows).select("hole", "from_", "to_", F.when(F.col(value) >= 0, F.col(value)).alias("__v")).where("__v is not null").distinct()
    points = clean.select("hole", F.col("from_").alias("p")).unionByName(clean.select("hole", F.col("to_").alias("p"))).distinct()
    order = Window.partitionBy("hole").orderBy("p")
    pieces = points.select("hole", F.col("p").alias("from_"), F.lead("p").over(order).alias("to_")).where("to_ is not null")
    met = overlap_pairs(pieces, clean).groupBy("a.hole", "a.from_", "a.to_")
    return met.agg(F.avg("b.__v").alias(value), F.count("*").alias("n"), (F.min("b.__v") < F.max("b.__v")).alias("conflict"))


def composite(rows: DataFrame, length: float, min_coverage: float = 0.5, domain: str | None = None, cap: float | None = None, value: str = "value") -> DataFrame:
    """Fixed-length composites of disjoint intervals: ``hole[, domain], from_, to_, value, covered``.

    Windows begin at a hole's first sample, or anew at each edge of a run of one domain. Values
    are capped before averaging; the grade is over covered metres; windows covered by less than
    ``min_coverage`` of their length are left out.
    """
    base = valid(rows).where(F.col(value).isNotNull()).withColumn("__v", F.least(F.col(value), F.lit(cap)) if cap is not None else F.col(value))
    if domain:
        run = Window.partitionBy("hole", "__run")
        cut = runs(base.withColumn("__code", F.col(domain)), "__code").withColumns({"__top": F.min("from_").over(run), "__bottom": F.max("to_").over(run)})
    else:
        cut = base.join(base.groupBy("hole").agg(F.min("from_").alias("__top"), F.max("to_").alias("__bottom")), "hole").withColumn("__code", F.lit(None).cast("string"))
    first = F.floor((F.col("from_") - F.col("__top")) / length)
    last = F.ceil((F.col("to_") - F.col("__top")) / length) - 1
    bins = cut.withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, last))))
    lo = F.greatest("from_", F.col("__top") + F.col("__bin") * length)
    hi = F.least("to_", F.col("__top") + (F.col("__bin") + 1) * length)
    part = bins.withColumn("__len", hi - lo).where(F.col("__len") > EPS)
    out = part.groupBy("hole", "__code", "__top", "__bottom", "__bin").agg(F.sum("__len").alias("covered"), F.sum(F.col("__len") * F.col("__v")).alias("__sum"))
    out = out.where(F.col("covered") >= min_coverage * length - EPS)
    head = F.col("__top") + F.col("__bin") * length
    cols = ["hole", F.col("__code").alias(domain)] if domain else ["hole"]
    return out.select(*cols, head.alias("from_"), F.least(head + length, F.col("__bottom")).alias("to_"), (F.col("__sum") / F.col("covered")).alias(value), "covered")


def _overlap(a: str = "a", b: str = "b") -> Column:
    return F.least(F.col(f"{a}.to_"), F.col(f"{b}.to_")) - F.greatest(F.col(f"{a}.from_"), F.col(f"{b}.from_"))


def overlap_pairs(left: DataFrame, right: DataFrame, bucket: float = 64.0) -> DataFrame:
    """All overlapping pairs as structs ``a`` and ``b`` with ``metres``.

    Both sides are laid into depth buckets, so a hole with millions of rows is joined bucket by
    bucket; a pair counts in the bucket where its overlap begins.
    """
    spread = lambda t, n: valid(t).withColumn("__b", F.explode(F.sequence(F.floor(F.col("from_") / bucket), F.floor((F.col("to_") - EPS) / bucket)))).alias(n)
    a, b = spread(left, "a"), spread(right, "b")
    pairs = a.join(b, (F.col("a.hole") == F.col("b.hole")) & (F.col("a.__b") == F.col("b.__b")) & (F.col("a.from_") < F.col("b.to_")) & (F.col("b.from_") < F.col("a.to_")))
    pairs = pairs.where(F.floor(F.greatest(F.col("a.from_"), F.col("b.from_")) / bucket) == F.col("a.__b"))
    pick = lambda t, n: F.struct(*(F.col(f"{n}.{c}").alias(c) for c in t.columns)).alias(n)
    return pairs.select(pick(left, "a"), pick(right, "b"), _overlap().alias("metres"))


def _coded(samples: DataFrame, log: DataFrame, code: str, holds: Column, rank: Column, bucket: float) -> DataFrame:
    """Samples with the code of the log row of highest ``rank`` that ``holds`` them; null without one.

    One join by (hole, depth bucket) that keeps samples without a match. Equal samples go as one
    with a count, so nulls in any column and repeated rows stay as they are.
    """
    cols = samples.columns
    one = once(samples)
    buckets = lambda c: F.sequence(F.floor(F.col("from_") / bucket), F.floor((F.col("to_") - EPS) / bucket))
    a = one.withColumn("__b", F.explode_outer(F.when(F.col("to_") > F.col("from_"), buckets(0)))).alias("a")
    b = valid(log).withColumn("__b", F.explode(buckets(0))).alias("b")
    first = F.floor(F.greatest(F.col("a.from_"), F.col("b.from_")) / bucket) == F.col("a.__b")
    met = a.join(b, (F.col("a.hole") == F.col("b.hole")) & (F.col("a.__b") == F.col("b.__b")) & (F.col("a.from_") < F.col("b.to_")) & (F.col("b.from_") < F.col("a.to_")) & first & holds, "left")
    keys = [F.col(f"a.{c}").alias(c) for c in cols]
    best = met.groupBy(*keys, F.col(f"a.{COUNT}").alias(COUNT)).agg(F.max_by(F.col(f"b.{code}"), F.when(F.col("b.hole").isNotNull(), rank)).alias(code))
    return again(best).select(*cols, code)


def code_by_overlap(samples: DataFrame, log: DataFrame, code: str = "code", bucket: float = 64.0) -> DataFrame:
    """Samples with the code that overlaps most of them, the shallower on ties; null without one."""
    return _coded(samples, log, code, F.lit(True), F.struct(_overlap(), -F.col("b.from_"), -F.col("b.to_")), bucket)


def code_at_midpoint(samples: DataFrame, log: DataFrame, code: str = "code", bucket: float = 64.0) -> DataFrame:
    """Samples with the code of the interval that holds their middle, the last to begin on ties."""
    mid = (F.col("a.from_") + F.col("a.to_")) / 2
    return _coded(samples, log, code, (F.col("b.from_") <= mid) & (mid < F.col("b.to_")), F.struct(F.col("b.from_"), F.col("b.to_")), bucket)


def overlap_means(windows: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """Windows with the overlap-weighted mean of ``value`` inside them and the metres covered.

    Equal windows stay rows of their own, equal rows of values count each.
    """
    pairs = overlap_pairs(once(windows), values.where(F.col(value).isNotNull()))
    got = pairs.groupBy("a").agg(F.sum(F.col("metres") * F.col(f"b.{value}")).alias("__s"), F.sum("metres").alias("covered"))
    return again(got.select("a.*", (F.col("__s") / F.col("covered")).alias(value), "covered"))


def metres_by_code(windows: DataFrame, log: DataFrame, code: str = "code") -> DataFrame:
    """Metres of each code inside each window; equal windows stay rows of their own."""
    met = overlap_pairs(once(windows), log).groupBy("a", F.col(f"b.{code}").alias(code)).agg(F.sum("metres").alias("metres"))
    return again(met.select("a.*", code, "metres"))


def reading_bins(readings: DataFrame, size: float, value: str = "value") -> DataFrame:
    """Point readings in fixed bins: ``hole, bin_from, bin_to, n, mean, least, most``."""
    b = F.floor(F.col("depth") / size + 1e-9)
    return readings.where(F.col(value).isNotNull()).groupBy("hole", b.alias("__b")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")).select("hole", (F.col("__b") * size).alias("bin_from"), ((F.col("__b") + 1) * size).alias("bin_to"), "n", "mean", "least", "most")


def moving_median(readings: DataFrame, half_width: float, value: str = "value") -> DataFrame:
    """Each reading with the lower-middle median of those within ``half_width`` of its depth."""
    w, block = float(half_width), 16.0 * half_width
    # a stretch of the hole with its neighbours' edges goes to one task, not the hole
    at = lambda d: F.floor((F.col("depth") + d) / block)
    dealt = readings.withColumn("__own", at(0.0)).withColumn("__s", F.explode(F.array_distinct(F.array(at(-w), at(0.0), at(w)))))
    held = F.sort_array(F.expr(f"collect_list(`{value}`) OVER (PARTITION BY hole, __s ORDER BY depth RANGE BETWEEN {w}D PRECEDING AND {w}D FOLLOWING)"))
    out = dealt.withColumn("filtered", F.element_at(held, F.floor((F.size(held) + 1) / 2).cast("int")))
    return out.where(F.col("__own").eqNullSafe(F.col("__s"))).drop("__own", "__s")


def readings_in_intervals(readings: DataFrame, intervals: DataFrame, bucket: float = 64.0) -> DataFrame:
    """Readings with the interval that holds them, [from, to); the last to begin on ties. Equal readings stay."""
    spread = valid(intervals).withColumn("__b", F.explode(F.sequence(F.floor(F.col("from_") / bucket), F.floor((F.col("to_") - EPS) / bucket)))).withColumnRenamed("hole", "__hole")
    own = once(readings).withColumn("__rb", F.floor(F.col("depth") / bucket))
    met = own.join(spread, (F.col("hole") == F.col("__hole")) & (F.col("__rb") == F.col("__b")) & (F.col("from_") <= F.col("depth")) & (F.col("depth") < F.col("to_")))
    last = Window.partitionBy(*readings.columns).orderBy(F.desc("from_"), F.desc("to_"))
    return again(met.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__b", "__rb", "__hole"))


def hole_totals(rows: DataFrame, cutoff: float, value: str = "value") -> DataFrame:
    """Per hole: metres assayed, grade by length, grade times thickness and the same above a cut-off."""
    length = F.col("to_") - F.col("from_")
    above = F.col(value) >= cutoff
    out = valid(rows).where(F.col(value).isNotNull()).groupBy("hole").agg(F.sum(length).alias("metres"), F.sum(length * F.col(value)).alias("gt"), F.coalesce(F.sum(F.when(above, length)), F.lit(0.0)).alias("metres_above"), F.coalesce(F.sum(F.when(above, length * F.col(value))), F.lit(0.0)).alias("gt_above"), F.max(value).alias("most"), F.min(F.when(above, F.col("from_"))).alias("first_above"))
    return out.withColumn("grade", F.col("gt") / F.col("metres"))


def coded_thickness(rows: DataFrame, code: str, wanted: str) -> DataFrame:
    """Per hole: thickness, top and base of one code; thickness 0 where the hole is logged without it."""
    hit = F.col(code) == wanted
    return valid(rows).groupBy("hole").agg(F.coalesce(F.sum(F.when(hit, F.col("to_") - F.col("from_"))), F.lit(0.0)).alias("thick"), F.min(F.when(hit, F.col("from_"))).alias("top"), F.max(F.when(hit, F.col("to_"))).alias("base"))


def first_code(rows: DataFrame, cover: tuple[str, ...], code: str = "code") -> DataFrame:
    """Per hole the first logged code that isn't cover, and its depth."""
    kept = valid(rows).where(~F.col(code).isin(*cover))
    return kept.groupBy("hole").agg(F.min_by(code, F.struct("from_", "to_", code)).alias(code), F.min("from_").alias("depth"))


INTERCEPT_SQL = "from_ double, to_ double, length double, sampled double, grade double, n long"


def fold_intercepts(rows: list[tuple[float, float, float]], cutoff: float, max_dilution: float, min_length: float, top_cut: float | None = None) -> list[tuple]:
    """(from, to, length, sampled, grade, n) of one hole's rows (from, to, value) in order."""
    capped = (lambda v: min(v, top_cut)) if top_cut is not None else (lambda v: v)
    out, i = [], 0
    while i < len(rows):
        start, end, v = rows[i]
        i += 1
        if v < cutoff:
            continue
        metal, sampled, n = capped(v) * (end - start), end - start, 1
        wait_metal, wait_len, wait_n = 0.0, 0.0, 0  # below the cut-off since the run's end
        for j in range(i, len(rows)):
            f, t, v = rows[j]
            if v < cutoff:
                wait_metal, wait_len, wait_n = wait_metal + capped(v) * (t - f), wait_len + t - f, wait_n + 1
                if t - end > max_dilution + EPS:
                    break
                continue
            both = metal + wait_metal + capped(v) * (t - f)
            if f - end > max_dilution + EPS or both / (sampled + wait_len + t - f) < cutoff:
                break
            metal, sampled, n = both, sampled + wait_len + t - f, n + wait_n + 1
            end, wait_metal, wait_len, wait_n, i = t, 0.0, 0.0, 0, j + 1
        if end - start >= min_length - EPS:
            out.append((start, end, end - start, sampled, metal / sampled, n))
    return out


def intercepts(rows: DataFrame, cutoff: float, max_dilution: float, min_length: float, top_cut: float | None = None) -> DataFrame:
    """Best intercepts: runs at or above a cut-off, bridged while the average holds.

    A run takes in a stretch below the cut-off (with unsampled metres) of at most
    ``max_dilution`` metres if the average of the whole, over sampled metres, stays at or above
    the cut-off. Rows that overlap are resolved to segments first, so no metre counts twice. The
    fold follows a hole's segments in order: they are dealt by hole, sorted, and streamed; a task
    holds one hole's at a time. A hole's id keeps its type.
    """

    def run(batches):
        hole, held = None, []

        def done() -> list[tuple]:
            return [(hole, *x) for x in fold_intercepts(held, cutoff, max_dilution, min_length, top_cut)] if held else []

        out: list[tuple] = []
        for pdf in batches:
            for h, f, t, v in zip(pdf["hole"].tolist(), pdf["from_"].tolist(), pdf["to_"].tolist(), pdf["value"].tolist()):
                if h != hole:
                    out += done()
                    hole, held = h, []
                held.append((f, t, v))
            yield pd.DataFrame(out, columns=["hole", "from_", "to_", "length", "sampled", "grade", "n"])
            out = []
        yield pd.DataFrame(done(), columns=["hole", "from_", "to_", "length", "sampled", "grade", "n"])

    clean = segments(rows).where("hole is not null").select("hole", F.col("from_").cast("double"), F.col("to_").cast("double"), F.col("value").cast("double"))
    # holes without a value at the cut-off have no intercept and aren't sent to Python
    rich = clean.withColumn("__most", F.max("value").over(Window.partitionBy("hole"))).where(F.col("__most") >= cutoff).drop("__most")
    return rich.sortWithinPartitions("hole", "from_", "to_").mapInPandas(run, f"hole {dict(rows.dtypes)['hole']}, {INTERCEPT_SQL}")


def attach_including(parents: DataFrame, inner: DataFrame) -> DataFrame:
    """High-grade intercepts with the parent that holds them; equal intervals are no parents."""
    held = (F.col("a.from_") <= F.col("b.from_") + EPS) & (F.col("a.to_") >= F.col("b.to_") - EPS) & (F.col("a.length") > F.col("b.length") + EPS)
    return overlap_pairs(parents, inner).where(held).select("b.hole", F.col("a.from_").alias("parent_from"), F.col("a.to_").alias("parent_to"), F.col("b.from_").alias("from_"), F.col("b.to_").alias("to_"), F.col("b.grade").alias("grade"))


def open_ends(found: DataFrame, rows: DataFrame, ends: DataFrame, value: str = "value") -> DataFrame:
    """Intercepts with ``open_top`` and ``open_bottom``: they reach the hole's first or last sample, or its end.

    ``ends`` has ``hole, length``; a hole without an entry is open by its samples only.
    """
    reach = rows.where(F.col(value).isNotNull()).groupBy("hole").agg(F.min("from_").alias("__f"), F.max("to_").alias("__t"))
    held = found.join(reach, "hole", "left").join(ends.select("hole", F.col("length").alias("__l")), "hole", "left")
    top = F.coalesce(F.col("from_") <= F.col("__f") + 0.01, F.lit(False))
    bottom = F.coalesce(F.col("to_") >= F.col("__t") - 0.01, F.lit(False)) | F.coalesce((F.col("__l") > 0) & (F.col("to_") >= F.col("__l") - 0.01), F.lit(False))
    return held.select(*found.columns, top.alias("open_top"), bottom.alias("open_bottom"))


def diluted(found: DataFrame, min_width: float, factor: Column | None = None) -> DataFrame:
    """Intercepts diluted to a mining width: ``true_width, width, diluted_grade, gram_metres, is_diluted``.

    ``factor`` turns a length along the hole into a true width; without one the length counts.
    """
    own = F.col("length") * factor if factor is not None else F.col("length")
    wide = F.greatest(own, F.lit(float(min_width)))
    kept = found.where((F.col("grade") >= 0) & (F.col("length") > 0))
    return kept.select(*found.columns, own.alias("true_width"), wide.alias("width"), (F.col("grade") * own / wide).alias("diluted_grade"), (F.col("grade") * own).alias("gram_metres"), (wide > own).alias("is_diluted"))


def contacts(rows: DataFrame, code: str = "code") -> DataFrame:
    """Top and base of every unit of a log, row splits inside a unit left out: ``hole, code, side, depth``."""
    units = merge_touching(rows, code)
    sides = F.array(F.struct(F.lit("top").alias("side"), F.col("from_").alias("depth")), F.struct(F.lit("base").alias("side"), F.col("to_").alias("depth")))
    return units.select("hole", code, F.explode(sides).alias("s")).select("hole", code, "s.side", "s.depth")


def changed_intervals(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("hole", "source")) -> DataFrame:
    """Holes (by source) that come re-split: an interval new in the file overlaps one that it no longer has.

    ``hole, source, stale``: how many old intervals are gone. The same boundaries with other
    results are a top-up, not this.
    """
    bounds = [*keys, "from_", "to_"]
    o, n = (valid(t).select(*bounds).distinct() for t in (old, new))
    o = o.join(n.select(*keys).distinct(), list(keys), "left_semi")
    gone, fresh = o.join(n, bounds, "left_anti"), n.join(o, bounds, "left_anti")
    met = overlap_pairs(gone, fresh).where((F.col("metres") > 1e-9) & (F.col(f"a.{keys[1]}") == F.col(f"b.{keys[1]}"))).select(*(F.col(f"a.{k}").alias(k) for k in keys)).distinct()
    return gone.join(met, list(keys), "left_semi").groupBy(*keys).agg(F.count("*").alias("stale"))
