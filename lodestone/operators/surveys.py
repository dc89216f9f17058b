"""Surveys along lines and holes: cleaning, ratios, levelling ties, methods, corridors, angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.spatial import within
from lodestone.operators.stats import quantiles
from lodestone.staging import staged

# How survey tables name a station's method.
ASSUMED = r"(?i)^(assumed|assume|nominal|plan(ned)?|design(ed)?|collar([\s_-]*(shot|set[\s_-]*up|setup|orientation|az(imuth)?))?|est(imated)?|none|no[\s_-]*survey|not[\s_-]*surveyed|unsurveyed|default|theoretical|projected)$"
MEASURED = r"(?i)gyro|reflex|ems|eastman|multi[\s_-]*shot|single[\s_-]*shot|\bmss?\b|\bsss?\b|deviflex|devi[\s_-]*shot|north[\s_-]*seeking|maxibor|camera|tropari|acid|magnetic|mag[\s_-]*shot|survey(ed)?[\s_-]*tool|downhole|\bdh\b|wireline|electronic|digital|champ|ezshot|ez[\s_-]*trac|trushot|sprint|azi[\s_-]*aligner|imdex|boart|devico|surveyed|measured"


def numbered(rows: DataFrame, by: list[str], order: str, name: str, cuts: int = 128) -> DataFrame:
    """Rows with their place (from 0) within the group as ``name``; no group is sorted by one task.

    ``order`` must differ within a group. It is cut into buckets of about equal counts; a row's
    place is its place in the bucket on top of the counts of the buckets before.
    """
    marks = rows.agg(F.percentile_approx(order, [i / cuts for i in range(1, cuts)], 20 * cuts)).first()[0]
    bucket = F.when(F.col(order).isNull(), 0)
    for i, m in enumerate(sorted(set(marks or []))):
        bucket = bucket.when(F.col(order) < m, i)
    cut = rows.withColumn("__b", bucket.otherwise(cuts))
    before = F.sum("__k").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut.groupBy(*by, "__b").agg(F.count("*").alias("__k"))
    counts = counts.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), F.col("__b").alias("__gb"), F.coalesce(before, F.lit(0)).alias("__o"), F.sum("__k").over(Window.partitionBy(*by)).alias("__n"))
    placed = cut.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(order)) - 1)
    met = F.col("__b") == F.col("__gb")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return placed.join(counts, met).withColumn(name, F.col("__o") + F.col("__r")).select(*rows.columns, name, "__n")


def despiked(rows: DataFrame, line: str, order: str, value: str, window: int = 11, k: float = 6.0, least: float = 20.0, stretch: int = 8192) -> DataFrame:
    """Rows with ``running`` (median of the window about them), ``limit`` and ``spike``.

    A spike lies more than the limit from its running median: ``k`` times the line's median
    deviation (times 1.4826), ``least`` at least. Past its ends a line goes on as reflected
    through its end value. A null or not finite value is no spike and is left out of medians;
    rows without a line are one line. Lines are worked on in stretches of rows with their edges
    doubled, so that a long line is spread over tasks.
    """
    half = max(1, window // 2)
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value)).cast("double")
    held = numbered(rows.withColumn("__v", v), [line], order, "__j")
    own = F.floor(F.col("__j") / stretch)
    edges = F.array_distinct(F.array(own, F.greatest(F.floor((F.col("__j") - half) / stretch), F.lit(0)), F.floor((F.col("__j") + half) / stretch)))
    spread = held.withColumn("__own", own).withColumn("__s", F.explode(edges))
    near = F.collect_list(F.struct(F.col("__v").alias("v"))).over(Window.partitionBy(line, "__s").orderBy("__j").rowsBetween(-half, half))
    around = spread.withColumn("__w", near).where(F.col("__s") == F.col("__own"))
    j, last = F.col("__j"), F.col("__n") - 1
    at = lambda i: F.get(F.col("__w"), (i - F.greatest(j - half, F.lit(0))).cast("int"))["v"]

    def reflected(o: Column) -> Column:
        i = j + o
        low = 2 * at(F.lit(0)) - at(F.least(last, -i))
        high = 2 * at(last) - at(F.greatest(F.lit(0), 2 * last - i))
        return F.when(i < 0, low).when(i > last, high).otherwise(at(i))

    seen = F.array_sort(F.filter(F.transform(F.sequence(F.lit(-half), F.lit(half)), reflected), lambda x: x.isNotNull()))
    n = F.size("__m")
    middle = (F.get("__m", F.floor((n - 1) / 2).cast("int")) + F.get("__m", F.floor(n / 2).cast("int"))) / 2
    run = around.withColumn("__m", seen).withColumn("running", F.when(n > 0, middle)).drop("__m", "__w", "__s", "__own")
    run = staged(run.withColumn("__d", F.abs(F.col("__v") - F.col("running"))).withColumn("__line", F.coalesce(F.col(line).cast("string"), F.lit(""))), "despiked")
    mads = quantiles(run, ["__line"], "__d", {"__mad": 0.5}).select("__line", "__mad")
    limit = F.greatest(F.lit(float(least)), k * 1.4826 * F.coalesce("__mad", F.lit(0.0)))
    out = run.join(mads, "__line", "left").withColumn("limit", limit)
    return out.withColumn("spike", F.coalesce(F.col("__d") > F.col("limit"), F.lit(False))).select(*rows.columns, "running", "limit", "spike")


def good_signal(rows: DataFrame, quality: str, least: float = 50.0) -> DataFrame:
    """Rows whose quality isn't a number below ``least``; a cell that is no number keeps its row."""
    return rows.where(~F.coalesce(F.col(quality).try_cast("double") < least, F.lit(False)))


def largest_anomaly(rows: DataFrame, by: list[str], value: str, k: float = 10.0) -> DataFrame:
    """Per group the largest distance from the median among readings within ``k`` scaled deviations; null if it is 0."""
    mid = quantiles(rows, by, value, {"__m": 0.5}).drop("n")
    off = staged(rows.join(mid, by).withColumn("__d", F.abs(F.col(value) - F.col("__m"))), "anomaly")
    mad = quantiles(off, by, "__d", {"__mad": 0.5}).drop("n")
    kept = (F.col("__mad") <= 0) | (F.col("__d") <= k * 1.4826 * F.col("__mad"))
    return off.join(mad, by).groupBy(*by).agg(F.nullif(F.max(F.when(kept, F.col("__d"))), F.lit(0.0)).alias("anomaly"))


def ratio(over: str, under: str) -> Column:
    """A ratio of two channels; null unless both are there and the lower one is positive."""
    return F.when(F.col(under) > 0, F.col(over) / F.col(under))


def tie_pairs(reference: DataFrame, survey: DataFrame, key: str, radius: float) -> DataFrame:
    """Sites of two surveys paired one to one, the closest first (ties by keys): ``a, b, d2`` with both rows' ``key``.

    The pairs that are the closest of both their ends are the ones that a pass over the sorted
    pairs would take; they are taken at once, their ends leave, and the rest goes on until no
    pair is left.
    """
    todo = staged(within(reference, survey, radius).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), "d2"), "ties")
    done = todo.limit(0)
    while not todo.isEmpty():
        rank = F.struct("d2", "a", "b")
        best = [todo.groupBy(c).agg(F.min(rank).alias("e")).select("e.*") for c in ("a", "b")]
        taken = staged(best[0].join(best[1], ["d2", "a", "b"], "left_semi").select("a", "b", "d2"), "ties-taken")
        done = done.unionByName(taken)
        todo = staged(todo.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti").select("a", "b", "d2"), "ties")
    return done


def level_factor(pairs: DataFrame, reference: str, survey: str) -> DataFrame:
    """One row: ties ``n``, the median ratio ``factor`` and its 16 % and 84 % quantiles; both values must be positive."""
    held = pairs.where((F.col(reference) > 0) & (F.col(survey) > 0)).withColumn("__q", F.col(reference) / F.col(survey))
    return quantiles(held, [], "__q", {"factor": 0.5, "low": 0.16, "high": 0.84}).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def method_class(cell: Column) -> Column:
    """``assumed``, ``measured`` or null of a station's method."""
    text = F.trim(cell.cast("string"))
    return F.when(text.rlike(ASSUMED), "assumed").when(text.rlike(MEASURED), "measured")


def methods_by_hole(stations: DataFrame, method: str) -> DataFrame:
    """Per hole ``measured`` if any station was, else ``assumed``, else ``unread`` where a method is given that neither list knows."""
    kind = method_class(F.col(method))
    named = F.trim(F.col(method).cast("string")) != ""
    s = stations.where(F.col("hole").isNotNull() & named).groupBy("hole").agg(F.max(kind == "measured").alias("__m"), F.max(kind == "assumed").alias("__a"))
    return s.select("hole", F.when(F.col("__m"), "measured").when(F.col("__a"), "assumed").otherwise("unread").alias("method"))


def attitude_assumed(collars: DataFrame, stations: DataFrame) -> DataFrame:
    """Collars without a station whose azimuth or dip is missing: drawn as vertical for want of better."""
    blind = F.col("azimuth").isNull() | F.isnan("azimuth") | F.col("dip").isNull() | F.isnan("dip")
    return collars.where(blind).join(stations.select("hole"), "hole", "left_anti")


def _from_line(a: tuple[float, float], b: tuple[float, float]) -> tuple[Column, Column]:
    """Distance to the line's part between ``a`` and ``b`` and signed offset (left of the line above 0) of ``x, y``."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    px, py = F.col("x") - a[0], F.col("y") - a[1]
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / square)) if square else F.lit(0.0)
    return F.hypot(px - t * dx, py - t * dy), (py * dx - px * dy) / (square**0.5 or 1.0)


def corridor_runs(trace: DataFrame, a: tuple[float, float], b: tuple[float, float], half_width: float) -> DataFrame:
    """Depth runs ``hole, from_, to_`` of traces (``hole, depth, x, y``) within a section's corridor.

    Where a leg crosses the corridor's edge the depth is interpolated by distance. A run of one
    station with no leg isn't returned.
    """
    order = Window.partitionBy("hole").orderBy("depth")
    placed = trace.select("hole", "depth", _from_line(a, b)[0].alias("d"))
    legs = placed.select("hole", F.col("depth").alias("m1"), F.col("d").alias("d1"), F.lag("depth").over(order).alias("m0"), F.lag("d").over(order).alias("d0")).where("m0 is not null")
    in0, in1 = F.col("d0") <= half_width, F.col("d1") <= half_width
    cross = F.col("m0") + (half_width - F.col("d0")) / F.nullif(F.col("d1") - F.col("d0"), F.lit(0.0)) * (F.col("m1") - F.col("m0"))
    parts = legs.where(in0 | in1).select("hole", F.when(in0, F.col("m0")).otherwise(cross).alias("f"), F.when(in1, F.col("m1")).otherwise(cross).alias("t"))
    down = Window.partitionBy("hole").orderBy("f", "t")
    fresh = F.coalesce((F.col("f") > F.lag("t").over(down)).cast("int"), F.lit(1))
    runs = parts.withColumn("__f", fresh).withColumn("__r", F.sum("__f").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("hole", "__r").agg(F.min("f").alias("from_"), F.max("t").alias("to_")).drop("__r")


def corridor_offsets(trace: DataFrame, a: tuple[float, float], b: tuple[float, float], half_width: float) -> DataFrame:
    """Per hole with a station in the corridor: the least and largest signed offset of those stations."""
    d, off = _from_line(a, b)
    return trace.where(d <= half_width).groupBy("hole").agg(F.min(off).alias("least"), F.max(off).alias("most"))


def alpha_angle(dip_direction: Column, dip: Column, azimuth: Column, hole_dip: Column) -> Column:
    """Angle in degrees between a hole (dip below 0 going down) and a plane: 90 where the hole meets it square on."""
    p, h = F.radians(dip), F.radians(hole_dip)
    along = F.sin(p) * F.cos(h) * F.cos(F.radians(azimuth - dip_direction)) + F.cos(p) * F.sin(h)
    return F.degrees(F.asin(F.least(F.lit(1.0), F.abs(along))))


def sampling_weight(alpha: Column, most: float = 10.0) -> Column:
    """Weight 1 / sin(alpha) that makes up for planes seldom met, ``most`` at most."""
    s = F.sin(F.radians(F.greatest(F.lit(0.0), F.least(F.lit(90.0), alpha))))
    return F.when(s > 0, F.least(F.lit(float(most)), 1 / s)).otherwise(F.lit(float(most)))
